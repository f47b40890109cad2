"""Joining rows to the summary of their group when one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_A_TASK = 200_000
HOT_SHARE = 1 / 20_000
HASHED_ROWS = 500_000


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, row_id: str, total: int, hashed: bool = False) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (with the row ``count`` of each key), salted for large groups.

    Groups of more than ``max(ROWS_A_TASK, total * HOT_SHARE)`` rows - at most ``1 / HOT_SHARE`` of them, which bounds what is
    broadcast - are spread over as many salts as they have such shares of rows; the rest join under salt 0. With ``hashed`` the
    groups' side of a partition is hashed in memory and nothing is sorted; since such a table cannot spill, both sides are first put into
    as many partitions as leave at most about ``HASHED_ROWS`` rows to one.
    """
    def join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        if not hashed:
            return left.join(right, on)
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // HASHED_ROWS))
        return left.repartition(parts, *on).join(right.repartition(parts, *on).hint("shuffle_hash"), on)

    limit = max(ROWS_A_TASK, int(total * HOT_SHARE))
    salts = F.ceil(F.col(count) / limit).cast("int")
    if total > limit:
        hot = groups.where(F.col(count) > limit).select(*keys, salts.alias("_salts")).dropDuplicates(keys)
        rows = rows.join(F.broadcast(hot), keys, "left")
        rows = rows.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(row_id), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
        groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
        return join(rows, groups, [*keys, "_salt"]).drop("_salt")
    return join(rows, groups, keys)
