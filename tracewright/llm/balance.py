"""A sample with target shares per category, by the cube method.

Inclusion probabilities are planned rows over available rows of a category, and the sample is balanced on the category
indicators. The kernel of these indicators is spanned by differences of two records of one category, so a flight step is a
duel: the probabilities of two records move along +1/-1, which keeps the category's sum, until one is 0 or 1. Flights run per
node of a hash of the ids on many disjoint pairs at once; what stays unresolved (one record a category and node at most) merges
upward through a tree of nodes, and the landing settles the last record of each category so that the size of the sample stays.
The report has the residual imbalance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.text import label_key
from tracewright.session import materialize

FAN_IN = 64
NODE_ROWS = 50_000


def flight(cat: np.ndarray, pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase for disjoint category indicators: the new probabilities; at most one a category stays within (0, 1)."""
    pi = pi.astype(float).copy()
    eps = 1e-9
    while True:
        open_ = np.flatnonzero((pi > eps) & (pi < 1 - eps))
        if not len(open_):
            break
        order = open_[np.argsort(cat[open_], kind="stable")]
        c = cat[order]
        first = np.r_[True, c[1:] != c[:-1]]
        rank = np.arange(len(c)) - np.maximum.accumulate(np.where(first, np.arange(len(c)), 0))
        left = np.flatnonzero((rank[:-1] % 2 == 0) & (c[1:] == c[:-1])) if len(c) > 1 else np.array([], int)
        if not len(left):
            break
        a, b = order[left], order[left + 1]
        x, y = pi[a], pi[b]
        up, down = np.minimum(1 - x, y), np.minimum(x, 1 - y)  # steps along +(1,-1) and -(1,-1)
        go_up = rng.random(len(a)) < down / (up + down)
        pi[a] = np.where(go_up, x + up, x - down)
        pi[b] = np.where(go_up, y - up, y + down)
    return np.where(pi <= eps, 0.0, np.where(pi >= 1 - eps, 1.0, pi))


def _fly(pdf: pd.DataFrame, seed: int, node: int) -> pd.DataFrame:
    """One flight over the open rows of a node, in hash order and seeded by the node, so that a task that runs again draws the same."""
    pdf = pdf.sort_values(["h", "row_id", "category"], kind="stable")
    cats, _ = pd.factorize(pdf["category"], sort=True)
    return pdf.astype({"category": object}).assign(pi=flight(cats, pdf["pi"].to_numpy(), np.random.default_rng([seed, node, len(pdf)])))


def planned_rows(available: list[int], shares: list[float], least: list[float], size: int) -> list[float]:
    """Rows to draw of each category by water-filling, ``size`` in all where there are enough.

    A category with less than its target (the larger of its minimum and its share of ``size``) is taken whole. What is left goes to the
    others in proportion to their shares, none under its minimum and none over what is available.
    """
    wanted = [max(m, s * size) for m, s in zip(least, shares, strict=True)]
    out = [float(n) if n < w else 0.0 for n, w in zip(available, wanted, strict=True)]
    open_ = [i for i, (n, w) in enumerate(zip(available, wanted, strict=True)) if n >= w]
    left = max(0.0, size - sum(out))
    fill = lambda level: [min(float(available[i]), max(float(least[i]), level * shares[i])) for i in open_]
    lo, hi = 0.0, max([size, *(available[i] / shares[i] for i in open_ if shares[i] > 0)], default=0.0)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(fill(mid)) < left else (lo, mid)
    for i, x in zip(open_, fill(hi), strict=True):
        out[i] = x
    return out


def cube_samples(df: DataFrame, row_id: str, fields: list[str], targets: DataFrame, fraction: float = 0.2, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """``(samples, report)``, one sample a field: ``samples(field_name, row_id, category)`` and a report with a row a target.

    ``fraction`` of all rows (rounded down) is the size of each sample; :func:`planned_rows` gives the rows of a category. The report has
    ``available``, ``wanted`` (the larger of ``min_rows`` and ``target_share`` times the size), ``planned``, ``drawn``, ``residual``
    (drawn less planned, under 1) and ``short``: every row of the category is in the sample and they are fewer than wanted. Rows whose
    label is null or has no target are never drawn. Repeated rows count each on its own. The draws depend on ids and
    labels only, not on files or partitions. An empty table gives empty samples and a report in which every category that wants rows is short.
    """
    spark = df.sparkSession
    labels = F.array(*(F.struct(F.lit(f).alias("field_name"), label_key(F.col(f)).alias("key")) for f in fields))
    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.explode(labels).alias("l")).select("row_id", "l.*").where("key IS NOT NULL")
    listed = targets.where(F.col("field_name").isin(fields)).select("*", label_key(F.col("category")).alias("key")).collect()  # one row a target
    named = spark.createDataFrame([(r["field_name"], r["key"], i) for i, r in enumerate(listed)], "field_name string, key string, target int")
    have = {r["target"]: r["n"] for r in rows.join(F.broadcast(named), ["field_name", "key"]).groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = int(np.floor(fraction * df.count() + 1e-9))
    plan = []
    for f in fields:
        own = [i for i, r in enumerate(listed) if r["field_name"] == f]
        rows_of = planned_rows([have.get(i, 0) for i in own], [listed[i]["target_share"] for i in own], [float(listed[i]["min_rows"] or 0) for i in own], size)
        for i, planned in zip(own, rows_of, strict=True):
            r, n = listed[i], have.get(i, 0)
            plan.append((f, r["category"], r["key"], n, max(float(r["min_rows"] or 0), r["target_share"] * size), planned, min(1.0, planned / n) if n else 0.0))
    plan_df = spark.createDataFrame(plan, "field_name string, category string, key string, available long, wanted double, planned double, pi double")
    nodes = max(1, -(-sum(have.values()) // (NODE_ROWS * max(1, len(fields)))))
    sched = rows.join(F.broadcast(plan_df.select("field_name", "key", "category", "pi")), ["field_name", "key"]).where("pi > 0").withColumn("h", F.xxhash64("row_id", F.lit(seed)))
    sure = sched.where("pi >= 1").select("field_name", "row_id", "category")
    schema = "field_name string, node int, row_id long, category string, pi double, h long"

    def fly(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = _fly(pdf, seed, int(key[1]))
        if len(out) and lone:
            # landing: one row a category is open; without the balance of categories they settle so that the size of the sample stays
            open_ = ((out["pi"] > 0) & (out["pi"] < 1)).to_numpy()
            pi = out["pi"].to_numpy().copy()
            pi[open_] = flight(np.zeros(int(open_.sum()), int), pi[open_], np.random.default_rng([seed, 1, int(open_.sum())]))
            out = out.assign(pi=pi)
        out = out[out["pi"] > 0].assign(field_name=key[0], node=int(key[1]))
        return out[["field_name", "node", "row_id", "category", "pi", "h"]]

    drawn = [sure]
    level = sched.where("pi < 1").withColumn("node", F.pmod("h", F.lit(nodes)).cast("int")).select("field_name", "node", "row_id", "category", "pi", "h")
    while True:
        lone = nodes == 1
        flown = materialize(level.groupBy("field_name", "node").applyInPandas(fly, schema), "flight")
        drawn.append(flown.where("pi = 1").select("field_name", "row_id", "category"))
        level = flown.where("pi < 1")
        if lone:
            break
        nodes = -(-nodes // FAN_IN)
        level = level.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("int"))
    # a part of a row may be left of the whole sample: it is taken with that probability
    land = F.pmod(F.xxhash64("row_id", "category", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn.append(level.where(land < F.col("pi")).select("field_name", "row_id", "category"))
    sample = drawn[0]
    for x in drawn[1:]:
        sample = sample.unionByName(x)
    counts = sample.groupBy("field_name", "category").agg(F.count(F.lit(1)).alias("drawn"))
    n = F.coalesce("drawn", F.lit(0))
    short = (n >= F.col("available")) & (n < F.col("wanted"))
    report = plan_df.join(F.broadcast(counts), ["field_name", "category"], "left").select(
        "field_name", "category", "available", "wanted", "planned", n.alias("drawn"), (n - F.col("planned")).alias("residual"), short.alias("short")
    )
    return sample, report


def cube_sample(df: DataFrame, row_id: str, field: str, targets: DataFrame, fraction: float = 0.2, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """:func:`cube_samples` for one field, the sample without ``field_name``."""
    sample, report = cube_samples(df, row_id, [field], targets, fraction, seed)
    return sample.drop("field_name"), report
