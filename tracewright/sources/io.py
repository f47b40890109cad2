"""Readers and writers: JSON lines (lenient, raw, strict), JSON arrays, Parquet or JSON by extension, directory scans, logs.

A lenient reader leaves out blank lines and lines that are no JSON object; a valid object followed by other text counts as bad.
``line`` numbers rows of a file in file order (it grows, with gaps between splits).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lines(spark: SparkSession, path: str | list[str], recursive: bool = False, glob: str | None = None) -> DataFrame:
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))


def whole_object(text: Column) -> Column:
    """The text as ``VARIANT`` if it is one JSON object and nothing else; null otherwise."""
    body = F.trim(text)
    v = F.try_parse_json(F.when(body.rlike(r"(?s)^\{.*\}$"), body))
    # a parser that stops at the end of the first value would take "{..} {..}": the outer object must use the whole text
    return F.when(_one_object(body), v)


@F.pandas_udf(T.BooleanType())
def _one_object(text):
    import json

    decode = json.JSONDecoder().raw_decode

    def ok(s):
        try:
            return s is not None and decode(s)[1] == len(s)
        except ValueError:
            return False

    return text.map(ok)


def read_trajectories(spark: SparkSession, path: str | list[str], key: tuple[str, ...] = ("traj_id",), **where: object) -> DataFrame:
    """``(traj_id, file, line, record VARIANT)`` of JSON lines; blank lines, bad JSON and records without an id are left out.

    ``key`` names the fields that may hold the id; an empty one falls through to the next.
    """
    rows = _lines(spark, path, **where).where(F.trim("value") != "").withColumn("record", whole_object(F.col("value")))
    ids = [F.nullif(F.try_variant_get("record", f"$.{k}", "string"), F.lit("")) for k in key]
    return rows.select(F.coalesce(*ids).alias("traj_id"), "file", "line", "record").where("record IS NOT NULL AND traj_id IS NOT NULL")


def read_raw(spark: SparkSession, path: str | list[str], **where: object) -> DataFrame:
    """``(value, file, line, record)`` of every line that is not blank; bad JSON keeps its raw line and a null record."""
    return _lines(spark, path, **where).where(F.trim("value") != "").withColumn("record", whole_object(F.col("value")))


def read_strict(spark: SparkSession, path: str, schema: T.StructType | str, limit: int | None = None) -> DataFrame:
    """JSON lines with a schema; a bad line is an error when the rows are read."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.limit(limit) if limit is not None else df


def read_array(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON array of records per file."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def read_any(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Parquet, JSON lines or JSON arrays by extension, concatenated by name; another extension is an error."""
    out = None
    for p in [paths] if isinstance(paths, str) else paths:
        ext = os.path.splitext(p.rstrip("/"))[1]
        if ext == ".parquet":
            df = spark.read.parquet(p)
        elif ext == ".jsonl":
            df = spark.read.json(p)
        elif ext == ".json":
            df = read_array(spark, p)
        elif ext == ".csv":
            df = spark.read.option("header", "true").csv(p)
        else:
            raise ValueError(f"unknown extension of {p}")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths")
    return out


def by_name(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, file: str = "file") -> DataFrame:
    """Rows of files whose base name is (or is not) in a list; only one of the lists may be given."""
    if include and exclude:
        raise ValueError("include and exclude are exclusive")
    base = F.element_at(F.split(file, "/"), -1)
    if include:
        return df.where(base.isin(include))
    return df.where(~base.isin(exclude)) if exclude else df


def sample_pool(df: DataFrame, type_col: str, contains: str | None, duration: Column, max_duration: float, seed: int, key: str) -> DataFrame:
    """Rows of a type substring and a duration limit (unknown durations pass), ordered by seeded hash."""
    kept = df.where(F.coalesce(duration, F.lit(0.0)) <= max_duration)
    if contains:
        kept = kept.where(F.col(type_col).contains(contains))
    return kept.orderBy(F.xxhash64(key, F.lit(seed)), key)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A JSON object a row; nulls are written. The commit protocol makes the output appear whole or not at all."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def append_rollout(df: DataFrame, path: str, step: str = "global_step") -> None:
    """Rows appended as JSON lines in a folder per step."""
    body = F.to_json(F.struct(*[c for c in df.columns if c != step]), {"ignoreNullFields": "false"})
    df.select(step, body.alias("value")).write.mode("append").partitionBy(step).text(path)


def write_csv(frames: list[DataFrame], path: str, mode: str = "overwrite") -> None:
    """Frames with different metric columns as one CSV with their union; missing cells are empty."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.write.mode(mode).option("header", "true").csv(path)


def responses_table(df: DataFrame, key: str, order: str, response: str, keep: list[str]) -> DataFrame:
    """One row per prompt with its responses in order, as ``responses``."""
    g = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(response).alias("r")))).alias("_r"), *[F.min_by(c, order).alias(c) for c in keep])
    return g.select(key, *keep, F.transform("_r", lambda x: x["r"]).alias("responses"))


def metric_rows(df: DataFrame, step: Column, metrics: list[str]) -> DataFrame:
    """Wide metrics as ``(step, metric, value)``."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(step.alias("step"), F.inline(pairs))


def task_and_step(path: Column) -> Column:
    """``STRUCT<task, step>``: the folder of a file and the last number of its base name, null if that is no long."""
    parts = F.split(path, "/")
    step = F.nullif(F.regexp_extract(F.element_at(parts, -1), r"(\d+)(?!.*\d)", 1), F.lit("")).try_cast("long")
    return F.struct(F.try_element_at(parts, F.lit(-2)).alias("task"), step.alias("step"))


def deep_oss(spark_text: Column) -> Column:
    """Object-store URLs normalised wherever they stand in a JSON text, at any depth."""
    return F.regexp_replace(spark_text, r"https?://([^./\s\"]+)\.oss-[^/\s\"]*\.aliyuncs\.com/([^?#\s\"]+)(?:[?#][^\s\"]*)?", "oss://$1/$2")
