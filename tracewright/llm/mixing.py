"""Mixing sources to target weights by capped water-filling.

Each source gets its weight of the mix; a source that would be used more often than its cap is clamped there and the excess is
spread over the others in proportion to their weights, until nothing is over. Whole repetitions take every record; the
fractional one takes records in seeded hash order up to its share: sums per slice of the hash show in which slice a source's share
ends, so that only the records of that slice are put in order. The order is of ids, texts and occurrences, not of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.text import label_key
from tracewright.llm.tokens import VOCABULARY, token_sizes, with_occurrence
from tracewright.session import materialize

SLICE_ROWS = 100_000


def water_fill(weights: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Amounts per source: at most its cap, in proportion to the weights among sources that are not at it."""
    given: dict[str, float] = {}
    free = {s: w for s, w in weights.items() if w > 0}
    left = float(total)
    while free:
        sum_w = sum(free.values())
        over = [s for s in free if left * free[s] / sum_w > caps[s] + 1e-9]
        if not over:
            given |= {s: left * w / sum_w for s, w in free.items()}
            break
        for s in over:
            given[s] = caps[s]
            del free[s]
        left = max(0.0, total - sum(given.values()))
    return {s: given.get(s, 0.0) for s in weights}


def mix(df: DataFrame, id_col: str, text_col: str, source_col: str, targets: DataFrame, share: float = 0.5, path: str = VOCABULARY, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(records, report)``: how often each record is used, and per source its wanted, given and actual share.

    The mix has ``share`` of all tokens, those of rows without a listed source included. ``records`` is ``(id, source, copies,
    tokens)`` with ``copies`` from 1 to the source's ``max_repeats``. ``short`` marks sources of which the mix has every record as often as
    it may and still less than their own target; ``mix_tokens`` and ``mix_wanted`` are the size of the whole mix, made and asked for.
    The ``targets`` table is one row a source, and sums per source are all that reaches the driver. Null or unlisted sources are
    never used; null and empty texts count 0 tokens; repeated rows are records of their own; an empty table gives no records.
    """
    spark = df.sparkSession
    named = df.select(F.col(id_col).alias("id"), label_key(F.col(source_col)).alias("key"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    sizes = materialize(token_sizes(named, "id", "text", ("key", "h"), path), "sizes")
    wanted = targets.select("source", label_key(F.col("source")).alias("key"), "target_weight", "max_repeats")
    listed = wanted.collect()  # one row a source of the target table
    keys = [r["key"] for r in listed]
    if len(set(keys)) != len(keys):
        raise ValueError("a source is listed twice in the targets")
    # what is not listed is one group, so that the sums are as many as the targets and one
    group = F.when(F.col("key").isin(keys), F.col("key")).otherwise(F.lit(None).cast("string")) if keys else F.lit(None).cast("string")
    sums = sizes.groupBy(group.alias("key")).agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    have = {r["key"]: r["n"] for r in sums}
    total = share * sum(have.values())
    caps = {r["key"]: float(r["max_repeats"] * have.get(r["key"], 0)) for r in listed}
    given = water_fill({r["key"]: r["target_weight"] for r in listed}, caps, total)
    plan = []
    for r in listed:
        n = have.get(r["key"], 0)
        times = given[r["key"]] / n if n else 0.0
        whole = min(int(times + 1e-12), r["max_repeats"])
        plan.append((r["source"], r["key"], r["target_weight"], r["max_repeats"], n, r["target_weight"] * total, given[r["key"]], whole, given[r["key"]] - whole * n if whole < r["max_repeats"] else 0.0))
    plan_df = spark.createDataFrame(plan, "source string, key string, target_weight double, max_repeats int, available long, wanted double, given double, whole int, rest double")
    slices = max(1, -(-sum(r["rows"] for r in sums) // SLICE_ROWS))
    rows = with_occurrence(sizes, ["id", "key", "h", "tokens"]).join(F.broadcast(plan_df.select("key", "source", "whole", "rest", "max_repeats")), "key")
    rows = rows.withColumn("u", F.xxhash64("id", "h", "occurrence", F.lit(seed))).withColumn("slice", F.pmod("u", F.lit(slices)))
    per = rows.groupBy("key", "slice").agg(F.sum("tokens").alias("n"))
    upto = per.select("key", "slice", "n", F.sum("n").over(W.partitionBy("key").orderBy("slice")).alias("upto"))
    ends = upto.join(F.broadcast(plan_df.select("key", "rest")), "key").where("upto > rest").groupBy("key").agg(F.min_by(F.struct(F.col("slice").alias("last"), (F.col("upto") - F.col("n")).alias("before")), "slice").alias("e")).select("key", "e.*")
    rows = rows.join(F.broadcast(ends), "key", "left")  # one row a source
    inside = rows.where("slice = last")
    at = F.col("before") + F.sum("tokens").over(W.partitionBy("key").orderBy("u", "id", "h", "occurrence")) - F.col("tokens") / 2
    sure = rows.where("last IS NULL OR slice <> last").withColumn("extra", F.when((F.col("rest") > 0) & (F.col("last").isNull() | (F.col("slice") < F.col("last"))), 1).otherwise(0))
    cols = ["id", "source", "whole", "extra", "max_repeats", "tokens"]
    run = sure.select(*cols).unionByName(inside.withColumn("extra", F.when(at < F.col("rest"), 1).otherwise(0)).select(*cols))
    records = run.select("id", "source", F.least(F.col("whole") + F.col("extra"), F.col("max_repeats")).cast("int").alias("copies"), "tokens").where("copies > 0")
    used = records.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("actual"))
    report = plan_df.join(F.broadcast(used), "source", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    whole_mix = W.partitionBy(F.lit(1))  # over the rows of the target table
    short = (F.col("actual") >= F.col("max_repeats") * F.col("available")) & (F.col("actual") < F.col("wanted"))
    report = report.withColumn("mix_tokens", F.sum("actual").over(whole_mix)).select(
        "source", "target_weight", "max_repeats", "available", "wanted", "given", "actual", F.when(F.col("mix_tokens") > 0, F.col("actual") / F.col("mix_tokens")).otherwise(0.0).alias("actual_share"),
        short.alias("short"), "mix_tokens", F.lit(float(total)).alias("mix_wanted"),
    )
    return records.withColumnRenamed("id", id_col), report
