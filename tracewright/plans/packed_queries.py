"""Queries of the packed-field operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.packed import split_packed
from tracewright.plans.registry import query
from tracewright.session import table


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every option of every record with an element of ``options`` that holds more than one option."""
    parts = [
        split_packed(table(spark, sf_dir, name), key, "options").select(
            F.lit(name).alias("src"), F.col(key).cast("bigint").alias("rec_id"), "pos", "val"
        )
        for name, key in (("example_eval", "eval_id"), ("example_train_rl", "row_id"))
    ]
    return parts[0].unionByName(parts[1])
