"""Length-aware partitioning, dynamic batches, resampling and bootstrap."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.grouping import scalar


def balanced_parts(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """``k`` parts of near-equal sums by largest differencing, indices sorted within a part.

    Windows and partial partitions compare by sum, then by number of items, then by the items, so the result does not depend
    on the order of equal items. With ``equal_size`` every part has the same number of items.
    """
    if len(lengths) < k:
        raise ValueError(f"{len(lengths)} items for {k} parts")
    if equal_size and len(lengths) % k:
        raise ValueError(f"{len(lengths)} items do not divide into {k} parts")
    by_length = sorted((n, i) for i, n in enumerate(lengths))
    empty = (0, 0, ())
    grouped = [by_length[i : i + k] for i in range(0, len(by_length), k)] if equal_size else [[x] for x in by_length]
    heap = []
    for items in grouped:
        windows = sorted([(n, 1, ((i, n),)) for n, i in items] + [empty] * (k - len(items)), reverse=True)
        heapq.heappush(heap, _Partial(windows))
    while len(heap) > 1:
        a, b = heapq.heappop(heap).windows, heapq.heappop(heap).windows
        met = [(x[0] + y[0], x[1] + y[1], x[2] + y[2]) for x, y in zip(a, reversed(b), strict=True)]
        heapq.heappush(heap, _Partial(sorted(met, reverse=True)))
    parts = [sorted(i for i, _ in w[2]) for w in heap[0].windows]
    if not all(parts):
        raise ValueError("a part is empty")
    return parts


class _Partial:
    """A partial partition in a heap: the widest spread first, then the fullest window."""

    __slots__ = ("windows",)

    def __init__(self, windows: list[tuple]):
        self.windows = windows

    def __lt__(self, other: _Partial) -> bool:
        mine, theirs = self.windows[0][0] - self.windows[-1][0], other.windows[0][0] - other.windows[-1][0]
        return mine > theirs if mine != theirs else self.windows[0] > other.windows[0]


def greedy_parts(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Items in order, each to the part of smallest sum (the first of equal ones); ``equal_size`` evens the counts by a bias."""
    bias = sum(lengths) + 1 if equal_size else 0
    heap = [(0, j) for j in range(k)]
    parts: list[list[int]] = [[] for _ in range(k)]
    for i, n in enumerate(lengths):
        total, j = heap[0]
        parts[j].append(i)
        heapq.heapreplace(heap, (total + n + bias, j))
    return parts


def partition_groups(df: DataFrame, group: str, row: str, length: str, k: int, method: str = "balanced", equal_size: bool = False) -> DataFrame:
    """``part`` of each row within its group (a batch: a group fits a task by construction of the batches)."""
    fn = {"balanced": balanced_parts, "greedy": greedy_parts}[method]
    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, row, length)}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row).reset_index(drop=True)
        part = np.zeros(len(pdf), np.int64)
        for j, members in enumerate(fn(pdf[length].tolist(), min(k, len(pdf)) if not equal_size else k, equal_size)):
            part[members] = j
        return pdf.assign(part=part)[[group, row, length, "part"]]

    schema = ", ".join([f"`{c}` {t}" for c, t in kinds.items()] + ["part long"])
    return df.select(group, row, length).groupBy(group).applyInPandas(one, schema)


def micro_batch_count(total: int, max_tokens: int, least: int = 1, multiple_of: int = 1) -> int:
    """Micro-batches for a token budget, at least ``least`` and a multiple."""
    n = max(least, -(-total // max_tokens))
    return -(-n // multiple_of) * multiple_of


def micro_batches(df: DataFrame, group: str, row: str, length: str, max_tokens: int) -> DataFrame:
    """Micro-batch of each row of its batch: as many as the batch's tokens need, balanced by length."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, row, length)}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row).reset_index(drop=True)
        k = min(len(pdf), micro_batch_count(int(pdf[length].sum()), max_tokens))
        part = np.zeros(len(pdf), np.int64)
        for j, members in enumerate(balanced_parts(pdf[length].tolist(), k)):
            part[members] = j
        return pdf.assign(micro=part)[[group, row, length, "micro"]]

    return df.select(group, row, length).groupBy(group).applyInPandas(one, ", ".join([f"`{c}` {t}" for c, t in kinds.items()] + ["micro long"]))


def imbalance(df: DataFrame, group: str, part: str, length: str) -> DataFrame:
    """Per group: largest, smallest and mean part sums, and the largest over the mean."""
    per = df.groupBy(group, part).agg(F.sum(length).alias("s"))
    return per.groupBy(group).agg(F.max("s").alias("largest"), F.min("s").alias("smallest"), F.avg("s").alias("mean"), (F.max("s") / F.avg("s")).alias("ratio"))


def reweights(df: DataFrame, score: str = "score", method: str = "pow", power: float = 2.0) -> DataFrame:
    """``weight`` for resampling: |score|^power, extremes only (max_min), or 0.4 for the best and 0.1 (max_random); plus 1e-8."""
    s = F.col(score)
    if method == "pow":
        w = F.pow(F.abs(s), F.lit(power))
    elif method == "max_min":
        ends = scalar(df.agg(F.struct(F.max(s).alias("hi"), F.min(s).alias("lo"))))
        return df.withColumn("_e", ends).withColumn("weight", F.when((s == F.col("_e.hi")) | (s == F.col("_e.lo")), 1.0).otherwise(0.0) + 1e-8).drop("_e")
    elif method == "max_random":
        w = F.when(s == scalar(df.agg(F.max(s))), 0.4).otherwise(0.1)
    else:
        raise ValueError(method)
    return df.withColumn("weight", F.greatest(w + 1e-8, F.lit(1e-8)))


def resample(df: DataFrame, row: str = "row_id", weight: str = "weight", seed: int = 42, slices: int = 1024) -> DataFrame:
    """As many draws as rows, with replacement, by systematic sampling on the running weight: ``copies`` of each row drawn.

    A row's copies are the sampling points in its stretch of the running weight; the running sum is taken per slice of the row's
    hash and the slices' sums are added, so no task orders all rows and no draw is a join.
    """
    from pyspark.sql import Window as W

    d = df.withColumn("_h", F.xxhash64(row, F.lit(seed))).withColumn("_b", F.pmod("_h", F.lit(slices)))
    per = d.groupBy("_b").agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_c"))
    before = per.select("_b", (F.sum("_w").over(W.orderBy("_b")) - F.col("_w")).alias("_before"))
    total = scalar(per.agg(F.struct(F.sum("_w").alias("w"), F.sum("_c").alias("n"))))
    run = d.join(F.broadcast(before), "_b").withColumn("_hi", F.col("_before") + F.sum(weight).over(W.partitionBy("_b").orderBy("_h", row))).withColumn("_t", total)
    scale = F.col("_t.n") / F.col("_t.w")
    offset = (seed % 997) / 997
    copies = F.floor(F.col("_hi") * scale - offset) - F.floor((F.col("_hi") - F.col(weight)) * scale - offset)
    return run.withColumn("copies", copies.cast("long")).drop("_h", "_b", "_before", "_hi", "_t").where("copies > 0")


def bootstrap_indices(n: int, size: int, draws: int = 1000, seed: int = 42) -> np.ndarray:
    """The index matrix that every prompt with ``n`` responses shares for a subset size: seeded anew for each metric."""
    rng = np.random.RandomState(seed)
    return np.stack([rng.choice(n, size=size, replace=True) for _ in range(draws)])


def validation_metrics(df: DataFrame, source: str, prompt: str, value: str, pred: str | None = None, order: str = "row_id", draws: int = 1000, seed: int = 42) -> DataFrame:
    """``(source, metric, value)``: mean@N, std@N, best/worst@n and maj@n by bootstrap, averaged over the prompts of a source.

    A prompt's responses are one row (a group is the samples of one prompt); the majority goes to the vote seen first in a draw.
    """
    item = [F.col(order).alias("o"), F.col(value).cast("double").alias("v")] + ([F.col(pred).cast("string").alias("p")] if pred else [])
    rows = df.groupBy(source, prompt).agg(F.array_sort(F.collect_list(F.struct(*item))).alias("r"))
    # values and codes of the votes in the order of their first sight are made natively, as two plain arrays
    seen = F.transform(F.transform("r", lambda x: x["p"]) if pred else F.array(), lambda p: F.coalesce(F.concat(F.lit("v"), p), F.lit("n")))
    rows = rows.select(source, F.transform("r", lambda x: x["v"]).alias("vals"), seen.alias("seen"))
    rows = rows.select(source, "vals", F.transform("seen", lambda p: (F.array_position("seen", p) - 1).cast("int")).alias("codes"))
    # prompts are dealt out over all cores: what a prompt costs is its draws, not its bytes
    cores = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(cores)
    kind = df.schema[source].dataType.simpleString()

    def one(batches):
        cache: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            size = pdf["vals"].map(len).to_numpy()
            for n in np.unique(size):
                members = np.flatnonzero(size == n)
                for lo in range(0, len(members), 64):
                    part = pdf.iloc[members[lo : lo + 64]]
                    vals = np.stack(part["vals"].to_numpy()).astype(float)
                    codes = np.stack(part["codes"].to_numpy()).astype(np.int64) if pred else None
                    named = list(_prompt_metrics(vals, codes, cache, draws, seed))
                    k = len(part)
                    yield pd.DataFrame({"source": np.tile(part[source].to_numpy(), len(named)), "metric": np.repeat([m for m, _ in named], k), "value": np.concatenate([v for _, v in named])})

    per = rows.mapInPandas(one, f"source {kind}, metric string, value double")
    return per.groupBy("source", "metric").agg(F.avg("value").alias("value"))


def _prompt_metrics(vals: np.ndarray, codes: np.ndarray | None, cache: dict, draws: int, seed: int):
    """``(metric, value per prompt)`` of prompts with the same number of responses; ``vals`` and ``codes`` are prompts x responses."""
    n = vals.shape[1]
    yield f"mean@{n}", vals.mean(1)
    if n < 2:
        return
    yield f"std@{n}", vals.std(1)
    for k in [2**i for i in range(1, 64) if 2**i < n] + [n]:
        if (n, k) not in cache:
            cache[n, k] = bootstrap_indices(n, k, draws, seed)
        drawn = vals[:, cache[n, k]]
        for name, got in (("best", drawn.max(2)), ("worst", drawn.min(2))):
            yield f"{name}@{k}/mean", got.mean(1)
            yield f"{name}@{k}/std", got.std(1)
        if codes is not None:
            maj = _majority(codes[:, cache[n, k]], drawn)
            yield f"maj@{k}/mean", maj.mean(1)
            yield f"maj@{k}/std", maj.std(1)


def _majority(votes: np.ndarray, vals: np.ndarray) -> np.ndarray:
    """Per draw (last axis: responses) the value of the first response with the most frequent vote; of equal counts the one seen first."""
    count, first = np.zeros(votes.shape[:-1], np.int64), np.zeros(votes.shape[:-1], np.int64)
    for code in range(int(votes.max()) + 1):
        here = votes == code
        n, at = here.sum(-1), here.argmax(-1)
        better = (n > count) | ((n == count) & (n > 0) & (at < first))
        count, first = np.where(better, n, count), np.where(better, at, first)
    return np.take_along_axis(vals, first[..., None], -1)[..., 0]
