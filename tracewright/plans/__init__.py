"""Query modules; each registers its queries when imported."""

from __future__ import annotations

import importlib
import pkgutil

FLAGSHIP = "traj_report"


def load() -> tuple[dict, dict]:
    """All queries and SQL of the core library."""
    for m in pkgutil.iter_modules(__path__):
        if m.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{m.name}")
    from tracewright.plans import registry

    return dict(registry.QUERIES), dict(registry.SQL)
