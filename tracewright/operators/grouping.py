"""Group statistics that survive a hot group: partial aggregation first, then an equi-join that adaptive execution can split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6


def with_group_stats(df: DataFrame, keys: list[str], stats: dict[str, Column], of: DataFrame | None = None) -> DataFrame:
    """``df`` with statistics of its groups. ``of`` is the part the statistics are taken over (all rows by default).

    Null keys are a group of their own. Rows of a group that ``of`` does not have get nulls.
    """
    per = (df if of is None else of).groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    names = [f"_g{i}" for i in range(len(keys))]
    per = per.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    on = [df[k].eqNullSafe(per[n]) for k, n in zip(keys, names, strict=True)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(per, cond, "left").drop(*names)


def scalar(df: DataFrame) -> Column:
    """The single value of a one-row, one-column frame, as an uncorrelated subquery of the plan."""
    return df.scalar()


def mean_or_zero(x: Column) -> Column:
    """Group mean, 0 for a single row."""
    return F.when(F.count(x) > 1, F.avg(x)).otherwise(F.lit(0.0))


def std_or_one(x: Column) -> Column:
    """Sample standard deviation (ddof 1), 1 for a single row."""
    return F.when(F.count(x) > 1, F.stddev_samp(x)).otherwise(F.lit(1.0))
