"""Queries of the training-data operators. ``SQL`` holds DuckDB text where whole tables allow it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.balance import cube_samples
from tracewright.llm.copies import collapse_copies, copy_groups, sample_items
from tracewright.llm.mixing import mix
from tracewright.llm.overlap import cross_split_overlaps
from tracewright.llm.packing import CAPACITY, over_capacity, pack
from tracewright.llm.pii import find_pii, mask_pii
from tracewright.llm.runs import field_runs, step_runs
from tracewright.llm.sql import SQL as SQL
from tracewright.llm.splits import assign_splits, components, recording_components, split_report
from tracewright.llm.text import label_key, recording_key
from tracewright.session import materialize, table

SPLIT_SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _add(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_add
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of two or more equal consecutive events in the step log and in the tool sequences."""
    cols = ["traj_id", "first_pos", "last_pos"]
    log = step_runs(table(spark, sf_dir, "steps")).where("n > 1").select(F.lit("steps").alias("src"), *cols)
    seq = field_runs(table(spark, sf_dir, "episodes"), "traj_id", "tool_sequence").where("n > 1").select(F.lit("tool_sequence").alias("src"), *cols)
    return log.unionByName(seq)


@_add
def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of the step log after collapsing: count and duration of each run."""
    return step_runs(table(spark, sf_dir, "steps")).select("traj_id", "first_pos", "last_pos", "n", F.round("seconds", 6).alias("seconds"), F.col("event.kind").alias("kind"))


@_add
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each training row that copies one with a smaller id, but for the way it is written."""
    return copy_groups(table(spark, sf_dir, "example_train_rl"), "row_id", sample_items()).where("row_id <> first_row_id")


@_add
def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record once, with the number of its copies."""
    return collapse_copies(table(spark, sf_dir, "example_train_rl"), "row_id", sample_items())


@_add
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each training row whose recording occurs under a smaller id."""
    found = recording_components(table(spark, sf_dir, "example_train_rl"), "row_id")
    return found.where("row_id <> component").select(F.col("component").alias("first_row_id"), "row_id")


@_add
def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80/10/10 splits by recording, question types spread evenly."""
    rows = table(spark, sf_dir, "example_train_rl")
    return assign_splits(rows, "row_id", materialize(recording_components(rows, "row_id"), "comp"), label_key(F.col("question_type")), SPLIT_SHARES)


@_add
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the share of each question type in each of the splits by recording is from the share of the split."""
    rows = table(spark, sf_dir, "example_train_rl")
    kind = label_key(F.col("question_type"))
    return split_report(rows, "row_id", p4_splits(spark, sf_dir), kind, SPLIT_SHARES)


@_add
def p4_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: rows and components of the splits by recording, components in more than one split, and whether every share is within a hundredth."""
    got = materialize(p4_splits(spark, sf_dir), "splits")
    per = got.groupBy("component").agg(F.countDistinct("split").alias("splits"))
    share = [F.abs(F.avg((F.col("split") == s).cast("double")) - v) for s, v in SPLIT_SHARES.items()]
    rows = got.agg(F.count(F.lit(1)).alias("n_rows"), (F.greatest(*share) <= 0.01).alias("near"))
    comps = per.agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.sum((F.col("splits") > 1).cast("long")), F.lit(0)).alias("torn"))
    return rows.join(comps, F.lit(True)).select("n_rows", "components", "torn", "near")  # one row each


@_add
def p4_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over recordings and older trajectories together."""
    rows = table(spark, sf_dir, "example_train_rl")
    return components(rows, "row_id", {"video": recording_key(F.col("video")), "traj": F.col("extra_info.traj_id")})


@_add
def p4_linked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over recordings and data sources together, with their rows: what shares a source hangs together."""
    return recording_components(table(spark, sf_dir, "example_train_rl"), "row_id", with_source=True).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@_add
def p4_source_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits that keep a whole ``data_source`` together; with few sources the shares are as near as whole sources allow."""
    rows = table(spark, sf_dir, "example_train_rl")
    whole = materialize(components(rows, "row_id", {"data_source": label_key(F.col("data_source"))}), "comp")
    return assign_splits(rows, "row_id", whole, label_key(F.col("question_type")), SPLIT_SHARES)


@_add
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that a fifth of the training rows cannot meet, from the reports of the three samples."""
    return p6_report(spark, sf_dir).where("short").select("field_name", "category")


@_add
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available, wanted and drawn rows of every target."""
    return cube_samples(table(spark, sf_dir, "example_train_rl"), "row_id", ["question_type", "data_source", "ability"], table(spark, sf_dir, "category_targets"))[1]


@_add
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation samples that occur, exactly or almost, among the training rows."""
    return cross_split_overlaps(table(spark, sf_dir, "example_eval"), table(spark, sf_dir, "example_train_rl")).select("eval_id", "row_id")


@_add
def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and training source."""
    found = cross_split_overlaps(table(spark, sf_dir, "example_eval"), table(spark, sf_dir, "example_train_rl"))
    per = found.groupBy("split", label_key(F.col("source")).alias("source"))
    return per.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("eval_id").alias("eval_samples"), F.countDistinct("row_id").alias("train_rows"))


@_add
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are larger than a container, from the packing of all documents."""
    return over_capacity(pack(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id").where(F.col("tokens") > CAPACITY).select("doc_id")


@_add
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers with their number of pieces and unused tokens."""
    packed = pack(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"), (F.lit(2048) - F.sum("tokens")).alias("unused"))


@_add
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose records cannot reach their weight within their repeats, from the report of the mix."""
    return p8_report(spark, sf_dir).where("short").select("source")


@_add
def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted, given and actual tokens and shares of every source of the mix."""
    return mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "source_targets"))[1]


@_add
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the mix with the number of times each is used."""
    return mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "source_targets"))[0]


@_add
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every e-mail address, phone number, identity number, street address and name in the documents."""
    return find_pii(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "kind", "start_pos", "end_pos")


@_add
def p9_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders in place of personal information."""
    return mask_pii(table(spark, sf_dir, "documents"), "doc_id", "text")
