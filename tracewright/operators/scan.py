"""Ordered recurrences over the tokens of a sequence, as folds inside the row (arrays) or running sums (token rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators.grouping import scalar


def to_arrays(tokens: DataFrame, row: str, pos: str, cols: list[str]) -> DataFrame:
    """One row per sequence with the columns as arrays in order of ``pos``."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("_p"), *cols)))
    out = tokens.groupBy(row).agg(packed.alias("_t"))
    return out.select(row, *[_field("_t", c).alias(c) for c in cols])


def _field(items: str, name: str) -> Column:
    return F.transform(items, lambda t: t[name])


def to_rows(seqs: DataFrame, row: str, pos: str, cols: list[str]) -> DataFrame:
    """Token rows of array columns; positions from 1."""
    return seqs.select(row, F.posexplode(F.arrays_zip(*cols)).alias("_p", "_t")).select(row, (F.col("_p") + 1).alias(pos), *[F.col(f"_t.{c}").alias(c) for c in cols])


def _backward(items: Column, start: Column, step) -> Column:
    """A right-to-left fold whose state is a struct with the array ``out`` of results, in forward order."""
    return F.aggregate(F.reverse(items), start, step, lambda s: F.reverse(s["out"]))


def gae(seqs: DataFrame, reward: str = "reward", value: str = "value", mask: str = "mask", gamma: float = 1.0, lam: float = 0.95) -> DataFrame:
    """Generalised advantage estimates with the mask's carry: columns ``advantage_raw`` and ``returns`` (arrays). Empty arrays stay empty."""
    z = F.transform(F.arrays_zip(reward, value, mask), lambda t: F.struct(t[reward].alias("r"), t[value].alias("v"), t[mask].cast("double").alias("m")))
    none = F.array().cast("array<double>")
    start = F.struct(F.lit(0.0).alias("nv"), F.lit(0.0).alias("gl"), none.alias("out"))

    def step(s: Column, t: Column) -> Column:
        last = t["r"] + gamma * s["nv"] - t["v"] + gamma * lam * s["gl"]
        nv = t["v"] * t["m"] + (1 - t["m"]) * s["nv"]
        gl = last * t["m"] + (1 - t["m"]) * s["gl"]
        return F.struct(nv.alias("nv"), gl.alias("gl"), F.concat(s["out"], F.array(gl)).alias("out"))

    out = seqs.withColumn("advantage_raw", _backward(z, start, step))
    return out.withColumn("returns", F.zip_with("advantage_raw", F.col(value), lambda a, v: a + v))


def discounted(seqs: DataFrame, reward: str = "reward", mask: str | None = "mask", gamma: float = 0.99) -> DataFrame:
    """Discounted returns from the right as ``returns``; with a mask the running return is reset after each masked step."""
    if mask:
        z = F.transform(F.arrays_zip(reward, mask), lambda t: F.struct(t[reward].alias("r"), t[mask].cast("double").alias("m")))
    else:
        z = F.transform(reward, lambda r: F.struct(r.alias("r"), F.lit(1.0).alias("m")))
    start = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        run = t["r"] + gamma * s["run"]
        return F.struct((run * t["m"]).alias("run"), F.concat(s["out"], F.array(run)).alias("out"))

    return seqs.withColumn("returns", _backward(z, start, step))


def remax(tokens: DataFrame, row: str = "row_id", pos: str = "pos", reward: str = "reward", mask: str = "mask", baseline: str = "baseline") -> DataFrame:
    """Reverse running sum of masked rewards (``returns``) less the masked baseline (``advantage``), on token rows."""
    w = W.partitionBy(row).orderBy(F.desc(pos)).rowsBetween(W.unboundedPreceding, 0)
    out = tokens.withColumn("returns", F.sum(F.col(reward) * F.col(mask)).over(w))
    return out.withColumn("advantage", F.col("returns") - F.col(baseline) * F.col(mask))


def whiten(rows: DataFrame, col: str, mask: str, name: str) -> DataFrame:
    """Masked whitening over the whole frame: variance with Bessel's correction, 1e-8 under the root."""
    x, m = F.col(col), F.col(mask)
    mean = scalar(rows.agg(F.sum(x * m) / (F.sum(m) + 1e-8)))
    out = rows.withColumn("_mean", mean)
    var = scalar(out.agg(F.sum(m * (x - F.col("_mean")) ** 2) / (F.sum(m) + 1e-8) * (F.sum(m) / (F.sum(m) - 1))))
    return out.withColumn(name, (x - F.col("_mean")) / F.sqrt(var + 1e-8)).drop("_mean")


def span_struct(spans: Column) -> Column:
    """``ARRAY<ARRAY<DOUBLE>>`` to spans; pairs with start after end, or not two long, are left out."""
    ok = F.filter(spans, lambda p: (F.size(p) == 2) & (F.get(p, 0) <= F.get(p, 1)))
    return F.transform(ok, lambda p: F.struct(F.get(p, 0).alias("s"), F.get(p, 1).alias("e")))


def merge_spans(spans: Column) -> Column:
    """Sorted, overlapping or touching spans merged."""
    empty = F.slice(spans, 1, 0)

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        overlaps = F.coalesce(x["s"] <= last["e"], F.lit(False))
        return F.when(overlaps, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), empty, step)


def _length(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0.0), lambda a, x: a + x["e"] - x["s"])


def span_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two span sets; two empty sets give 1, one empty set 0."""
    ma, mb = merge_spans(a), merge_spans(b)
    one = lambda x: F.aggregate(mb, F.lit(0.0), lambda t, y: t + F.greatest(F.lit(0.0), F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"])))
    inter = F.aggregate(ma, F.lit(0.0), lambda t, x: t + one(x))
    union = _length(ma) + _length(mb) - inter
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(inter / (union + 1e-12))


def adaptive_kl(steps: list[tuple[float, int]], init: float = 0.2, target: float = 6.0, horizon: float = 10_000) -> list[float]:
    """The coefficient after each (kl, steps) update: the error is clipped to 0.2. The list is one entry a training step."""
    out, value = [], init
    for kl, n in steps:
        value *= 1 + max(-0.2, min(0.2, kl / target - 1)) * n / horizon
        out.append(value)
    return out


class FixedKL:
    def __init__(self, value: float):
        self.value = value

    def update(self, kl: float, n: int) -> float:
        return self.value


class AdaptiveKL:
    def __init__(self, init: float, target: float, horizon: float):
        self.value, self.target, self.horizon = init, target, horizon

    def update(self, kl: float, n: int) -> float:
        self.value = adaptive_kl([(kl, n)], self.value, self.target, self.horizon)[0]
        return self.value


def kl_controller(kind: str, coef: float, target: float = 6.0, horizon: float = 10_000) -> FixedKL | AdaptiveKL:
    """Controller factory: ``fixed`` or ``adaptive``."""
    if kind == "fixed":
        return FixedKL(coef)
    if kind == "adaptive":
        if horizon <= 0:
            raise ValueError("horizon must be positive")
        return AdaptiveKL(coef, target, horizon)
    raise NotImplementedError(kind)

