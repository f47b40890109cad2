"""Plug-in functions: loading a scorer from a file, running it as an Arrow function, limiting its time."""

from __future__ import annotations

import importlib.util
import signal
import threading
from collections.abc import Callable
from functools import wraps

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_function(path: str, name: str, **kwargs: object) -> Callable:
    """The function ``name`` of a Python file with keyword arguments bound; a missing file or name is an error."""
    spec = importlib.util.spec_from_file_location("plugin", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    fn = getattr(module, name)
    return wraps(fn)(lambda *a: fn(*a, **kwargs)) if kwargs else fn


def timed(seconds: float, default: object = None) -> Callable:
    """A call that takes longer than ``seconds`` gives ``default``; only the main thread of a worker can be interrupted."""

    def wrap(fn: Callable) -> Callable:
        @wraps(fn)
        def run(*args):
            if threading.current_thread() is not threading.main_thread():
                return fn(*args)

            def stop(signum, frame):
                raise TimeoutError

            old = signal.signal(signal.SIGALRM, stop)
            signal.setitimer(signal.ITIMER_REAL, seconds)
            try:
                return fn(*args)
            except TimeoutError:
                return default
            finally:
                signal.setitimer(signal.ITIMER_REAL, 0)
                signal.signal(signal.SIGALRM, old)

        return run

    return wrap


def score_udf(fn: Callable, seconds: float | None = None, failed: float = 0.0):
    """A scorer of (text, truth) as an Arrow function: a number, a dictionary with ``score``, or a tuple whose first item counts.

    Errors and timeouts score ``failed``.
    """
    call = timed(seconds, failed)(fn) if seconds else fn

    def one(a, b) -> float:
        try:
            got = call(a, b)
        except Exception:
            return failed
        if isinstance(got, dict):
            got = got["score"]
        return float(got[0] if isinstance(got, tuple) else got)

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series, truth: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(text, truth, strict=True)], dtype="float64")

    return score
