"""Filters over groups, trajectories and tokens."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators.frame import number
from tracewright.operators.grouping import scalar, with_group_stats
from tracewright.operators.ranks import first_ranks, ordered


def top_entropy_tokens(tokens: DataFrame, ratio: float, entropy: str = "entropy", order: tuple[str, ...] = ("row_id", "pos")) -> DataFrame:
    """The valid tokens of largest entropy over the whole frame: ``floor(n * ratio + 0.9999)`` of ``n``, ties by position.

    Exact without a global window: the k-th largest key is found by counting in ranges and compared with.
    """
    valid = tokens.where("mask > 0")
    k = math.floor(valid.count() * ratio + 0.9999)
    return valid.where(first_ranks(valid, [ordered(-F.col(entropy)), *[F.col(c) for c in order]], k))


def top_entropy_turns(turns: DataFrame, ratio: float, traj: str = "traj_uid", entropy: str = "entropy", order: str = "row_id") -> DataFrame:
    """``keep``: whether a turn is among the ``max(1, ceil(n * ratio))`` of largest entropy of its trajectory."""
    w = W.partitionBy(traj)
    rank = F.row_number().over(w.orderBy(F.desc(entropy), order))
    k = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(w) * ratio))
    return turns.withColumn("keep", rank <= k)


def differing_groups(df: DataFrame, uid: str = "uid", score: str = "score", group_n: int = 2) -> DataFrame:
    """Rows of groups whose scores are not all the same; all rows if there is no such group, or if groups have one row."""
    if group_n <= 1:
        return df
    d = with_group_stats(df, [uid], {"_lo": F.min(score), "_hi": F.max(score)})
    some = scalar(df.groupBy(uid).agg((F.min(score) != F.max(score)).alias("x")).agg(F.coalesce(F.bool_or("x"), F.lit(False))))
    return d.where((F.col("_lo") != F.col("_hi")) | ~some).drop("_lo", "_hi")


def spread_groups(df: DataFrame, uid: str = "uid", metric: str = "score") -> DataFrame:
    """Rows of groups whose population deviation is positive or that have one row."""
    d = with_group_stats(df, [uid], {"_s": F.stddev_pop(metric), "_n": F.count(F.lit(1))})
    return d.where((F.col("_s") > 0) | (F.col("_n") == 1)).drop("_s", "_n")


def accuracy_band(df: DataFrame, uid: str, score: str, lo: float, hi: float, oversample: int = 1, length: str | None = None, max_length: int | None = None) -> DataFrame:
    """Groups kept first by passing (mean score in the band, no row at the length limit), then by group key: one in ``oversample`` groups.

    Groups are numbered by ranges on a table of their own; the choice is ordered by (passes, key).
    """
    stats = {"_m": F.avg(score)} | ({"_x": F.max(length)} if length else {})
    per = df.groupBy(uid).agg(*[c.alias(n) for n, c in stats.items()])
    ok = (F.col("_m") >= lo) & (F.col("_m") <= hi)
    if length:
        ok = ok & (F.col("_x") < max_length)
    per = per.select(uid, (~ok).alias("late"))
    n = per.count() // oversample
    kept = number(per, ["late", uid], "_rank").where(F.col("_rank") < n).select(uid)
    return df.join(kept, uid, "left_semi")


def any_error_in(df: DataFrame, traj: str, error: str, codes: list[str]) -> DataFrame:
    """``(traj, exceeded)``: whether a step of the trajectory has an error of the set; null errors count as none."""
    return df.groupBy(traj).agg(F.coalesce(F.bool_or(F.col(error).isin(codes)), F.lit(False)).alias("exceeded"))


def not_longer(df: DataFrame, tokens: str, most: int) -> DataFrame:
    """Rows of at most ``most`` tokens; a null array has none."""
    return df.where(F.coalesce(F.size(tokens), F.lit(0)) <= most)
