"""Splits that keep related records together.

Records and entities (recordings, sources, authors) form a bipartite graph. The smallest record id is propagated over it until
nothing changes; a component is then assigned to a split as a whole. With one entity column a component is one entity's
records, so a single round is final; with more columns rounds of hooking and jumping follow until no label falls, each cut by a written
table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.groups import attach
from tracewright.llm.text import label_key, recording_key
from tracewright.session import materialize

BIG_SHARE = 1 / 1000
SLICE_ROWS = 50_000
MAX_LABELS = 2_000
JUMPS = 2


def components(df: DataFrame, row_id: str, entities: dict[str, Column]) -> DataFrame:
    """``(row_id, component)``: the smallest row id that is reachable over shared entities.

    A null entity links nothing; a row without any entity is its own component. With one entity column one round is final. With more, each
    round gives every row the least label that it meets over its entities, hooks the row that a label names to the least that its
    followers have met, and lets rows jump to the label of their label, so that a chain of ``n`` records takes about ``log n`` rounds.
    The rounds end when no label falls; there is no bound on them.
    """
    named = [F.struct(F.lit(i).alias("kind"), e.cast("string").alias("value")) for i, e in enumerate(entities.values())]
    rows = df.select(F.col(row_id).alias("row_id"), F.filter(F.array(*named), lambda x: x["value"].isNotNull()).alias("ents")).where(F.col("row_id").isNotNull())
    edges = rows.select("row_id", F.explode("ents").alias("ent")).distinct() if len(named) > 1 else rows.select("row_id", F.explode("ents").alias("ent"))
    loose = rows.where(F.size("ents") == 0).select("row_id", F.col("row_id").alias("component"))
    if len(named) == 1:
        return _round(edges.withColumn("label", F.col("row_id"))).select("row_id", F.col("label").alias("component")).unionByName(loose)
    edges = materialize(edges, "edges")
    state = edges.withColumn("label", F.col("row_id"))
    while True:
        met = _round(state).groupBy("row_id", "before").agg(F.min("label").alias("low"))
        met = materialize(met, "met")
        if not met.where("low < before").limit(1).count():
            return met.select("row_id", F.col("before").alias("component")).unionByName(loose)
        # a label is a row: it is hooked to the least label that its followers have met
        hooks = met.groupBy(F.col("before").alias("row_id")).agg(F.min("low").alias("hook"))
        hooked = materialize(met.join(hooks, "row_id", "left").select("row_id", F.least("low", F.coalesce("hook", "low")).alias("label")), "hooked")
        for _ in range(JUMPS):
            # every row takes the label of its label
            followers = hooked.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
            further = followers.join(hooked.select(F.col("row_id").alias("label"), F.col("label").alias("next")), "label")
            total = followers.agg(F.sum("n")).first()[0] or 0
            hooked = materialize(attach(hooked, further, ["label"], "n", "row_id", total).select("row_id", F.col("next").alias("label")), "jumped")
        state = materialize(edges.join(hooked, "row_id"), "label")


def _round(state: DataFrame) -> DataFrame:
    """Each entity takes the least label of its rows, each row that of its entity; ``before`` keeps the row's old label."""
    low = materialize(state.groupBy("ent").agg(F.min("label").alias("low"), F.count(F.lit(1)).alias("n")), "low")
    total = low.agg(F.sum("n")).first()[0] or 0
    return attach(state, low, ["ent"], "n", "row_id", total).select("row_id", "ent", F.col("low").alias("label"), F.col("label").alias("before"))


def place(groups: list[dict[str, int]], goal: dict[str, dict[str, float]], names: list[str]) -> list[str]:
    """A split for each group, given its rows per label, in the given order: the one that leaves the least squared deviation.

    ``goal`` has the rows wanted per label and split. A squared deviation is taken relative to what was wanted, so that all splits fill alike;
    it is summed over all labels of the group and its size. Ties go to the first split.
    """
    labels = {lb: i for i, lb in enumerate(goal)}
    left = np.array([[goal[lb][s] for s in names] for lb in goal], float).reshape(len(goal), len(names))
    whole = left.sum(0)
    per_label, per_size = 1 / np.maximum(left, 1e-9), 1 / np.maximum(whole, 1e-9)
    out = []
    for g in groups:
        at, n = np.array([labels[lb] for lb in g], np.int64), np.array(list(g.values()), float)
        size = n.sum()
        # (left - n)^2 - left^2 over the labels, and the same for the size
        cost = (n[:, None] * (n[:, None] - 2 * left[at]) * per_label[at]).sum(0) + size * (size - 2 * whole) * per_size
        s = int(cost.argmin())
        left[at, s] -= n
        whole[s] -= size
        out.append(names[s])
    return out


def assign_splits(df: DataFrame, row_id: str, component: DataFrame, label: Column, shares: dict[str, float], seed: int = 7) -> DataFrame:
    """``(row_id, component, split)`` with whole components in one split, sizes near ``shares`` and label shares near equal.

    A component counts with all its labels. Components of more than ``BIG_SHARE`` of the rows (at most ``1 / BIG_SHARE`` of them)
    are placed first by :func:`place`, largest first. The others are dealt by hash into slices of about ``SLICE_ROWS`` rows of
    component and label; each slice is placed likewise against its part of what the big ones have left. Null labels are a label of
    their own; more than ``MAX_LABELS`` labels are an error.
    """
    spark, names = df.sparkSession, list(shares)
    lab = df.select(F.col(row_id).alias("row_id"), F.coalesce(label.cast("string"), F.lit("")).alias("label"))
    per = materialize(component.dropDuplicates(["row_id"]).join(lab, "row_id").groupBy("component", "label").agg(F.count(F.lit(1)).alias("n")), "per")
    totals = {r["label"]: r["n"] for r in per.groupBy("label").agg(F.sum("n").alias("n")).limit(MAX_LABELS + 1).collect()}
    if len(totals) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels: stratify by a coarser column")
    total = sum(totals.values())
    kind = component.schema["component"].dataType.simpleString()
    sizes = materialize(per.groupBy("component").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")), "sizes")
    big_of = sizes.where(F.col("n") > max(1, total * BIG_SHARE)).select("component", F.col("n").alias("size"))
    big: dict = {}
    for r in per.join(F.broadcast(big_of), "component").collect():  # at most 1 / BIG_SHARE components by MAX_LABELS labels
        big.setdefault((-r["size"], r["component"]), {})[r["label"]] = r["n"]
    order = sorted(big)
    goal = {lb: {s: n * shares[s] for s in names} for lb, n in totals.items()}
    placed = place([big[k] for k in order], goal, names)
    fixed = spark.createDataFrame([(k[1], s) for k, s in zip(order, placed, strict=True)], f"component {kind}, split string")
    for k, s in zip(order, placed, strict=True):
        for lb, n in big[k].items():
            goal[lb][s] -= n
    # the part of every label's other rows that each split is still to get
    part = {}
    for lb, room in goal.items():
        free = {s: max(0.0, v) for s, v in room.items()}
        part[lb] = {s: v / (sum(free.values()) or 1.0) for s, v in free.items()}
    n_rows = sizes.agg(F.coalesce(F.sum("labels"), F.lit(0))).first()[0]
    slices = max(1, -(-n_rows // SLICE_ROWS))
    small = per.join(F.broadcast(fixed.select("component")), "component", "left_anti").withColumn("slice", F.pmod(F.xxhash64("component", F.lit(seed)), F.lit(slices)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: dict = {}
        for c, lb, n in zip(pdf["component"], pdf["label"], pdf["n"], strict=True):
            groups.setdefault(c, {})[lb] = n
        own = pdf.groupby("label")["n"].sum()
        want = {lb: {s: n * part[lb][s] for s in names} for lb, n in sorted(own.items())}
        ids = sorted(groups, key=lambda c: (-sum(groups[c].values()), c))
        groups = {c: dict(sorted(groups[c].items())) for c in ids}
        return pd.DataFrame({"component": ids, "split": place([groups[c] for c in ids], want, names)}).astype({"component": pdf["component"].dtype})

    rest = small.groupBy("slice").applyInPandas(one, f"component {kind}, split string")
    sized = sizes.select("component", "n").join(rest.unionByName(fixed), "component")
    return attach(component.select("row_id", "component"), sized, ["component"], "n", "row_id", total).select("row_id", "component", "split")


def split_report(df: DataFrame, row_id: str, splits: DataFrame, label: Column, shares: dict[str, float]) -> DataFrame:
    """Per label and split: rows, their share of the label, and how far that is from the split's share. Null labels are ``''``."""
    lab = df.select(F.col(row_id).alias("row_id"), F.coalesce(label.cast("string"), F.lit("")).alias("label"))
    per = lab.join(splits, "row_id").groupBy("label").pivot("split", list(shares)).agg(F.count(F.lit(1)))
    long = per.select("label", F.explode(F.array(*(F.struct(F.lit(s).alias("split"), F.coalesce(F.col(s), F.lit(0)).alias("n"), F.lit(float(shares[s])).alias("wanted")) for s in shares))).alias("x"), sum((F.coalesce(F.col(s), F.lit(0)) for s in shares), F.lit(0)).alias("rows"))
    return long.select("label", "x.split", "x.n", (F.col("x.n") / F.col("rows")).alias("share"), (F.col("x.n") / F.col("rows") - F.col("x.wanted")).alias("deviation"))


def recording_components(df: DataFrame, row_id: str, with_source: bool = False) -> DataFrame:
    """Components over the recordings of ``video``, and over ``data_source`` too where asked for."""
    ents = {"video": recording_key(F.col("video"))} | ({"data_source": label_key(F.col("data_source"))} if with_source else {})
    return components(df, row_id, ents)
