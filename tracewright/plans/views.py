"""Shared inputs of the queries: the driver's tables in the shapes that the operators take, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.session import table

TOKENS_SQL = """tok AS (SELECT l_orderkey AS row_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos,
 l_discount * 1.0071 AS reward, l_tax * 1.0093 AS value, CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS mask, -(l_discount * 1.0137 + 0.0517) AS old_lp, -(l_tax * 1.0211 + 0.0613) AS lp, -(l_discount * 0.9173 + 0.0529) AS rollout_lp,
 (l_quantity - 25) / 10.37 AS adv, l_quantity / 51.3 AS entropy FROM lineitem)"""

SEQS_SQL = """seq AS (SELECT o_orderkey AS row_id, o_custkey AS uid, o_orderkey // 2 AS traj_uid, o_totalprice / 100003.7 AS score, o_totalprice / 250007.3 AS step_score,
 o_orderpriority AS anchor, 1 + o_orderkey % 7 AS n_tokens, o_orderstatus = 'P' AS ignored FROM orders)"""


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Token rows ``(row_id, pos, reward, value, mask, old_lp, lp, rollout_lp, adv, entropy)`` from ``lineitem``."""
    t = table(spark, d, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return t.select(
        F.col("l_orderkey").alias("row_id"), F.row_number().over(w).alias("pos"), (F.col("l_discount") * 1.0071).alias("reward"), (F.col("l_tax") * 1.0093).alias("value"),
        F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("mask"), (-(F.col("l_discount") * 1.0137 + 0.0517)).alias("old_lp"), (-(F.col("l_tax") * 1.0211 + 0.0613)).alias("lp"),
        (-(F.col("l_discount") * 0.9173 + 0.0529)).alias("rollout_lp"), ((F.col("l_quantity") - 25) / 10.37).alias("adv"), (F.col("l_quantity") / 51.3).alias("entropy"),
    )


def token_rows(spark: SparkSession, d: str) -> DataFrame:
    """The token rows without positions, for aggregates that need none: no shuffle."""
    t = table(spark, d, "lineitem")
    return t.select(
        F.col("l_orderkey").alias("row_id"), (F.col("l_discount") * 1.0071).alias("reward"), (F.col("l_tax") * 1.0093).alias("value"), F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("mask"),
        (-(F.col("l_discount") * 1.0137 + 0.0517)).alias("old_lp"), (-(F.col("l_tax") * 1.0211 + 0.0613)).alias("lp"), (-(F.col("l_discount") * 0.9173 + 0.0529)).alias("rollout_lp"), ((F.col("l_quantity") - 25) / 10.37).alias("adv"), (F.col("l_quantity") / 51.3).alias("entropy"),
    )


def seqs(spark: SparkSession, d: str) -> DataFrame:
    """Sequence rows ``(row_id, uid, traj_uid, score, step_score, anchor, n_tokens, ignored)`` from ``orders``."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("uid"), F.floor(F.col("o_orderkey") / 2).alias("traj_uid"), (F.col("o_totalprice") / 100003.7).alias("score"),
        (F.col("o_totalprice") / 250007.3).alias("step_score"), F.col("o_orderpriority").alias("anchor"), (1 + F.col("o_orderkey") % 7).alias("n_tokens"), (F.col("o_orderstatus") == "P").alias("ignored"),
    )


def r6(c: str | object, name: str | None = None) -> object:
    """Rounded to 6 places, which is how results are compared."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6).alias(name or c)
