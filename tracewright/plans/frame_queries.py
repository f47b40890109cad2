"""Queries of the ordered-frame verbs on ``orders``, whose keys are dense."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import frame as P
from tracewright.plans.registry import query
from tracewright.session import table

_F = "WITH f AS (SELECT o_orderkey AS row_id, o_custkey AS v, o_orderstatus AS s FROM orders), n AS (SELECT count(*) AS n FROM f)"


def _f(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("v"), F.col("o_orderstatus").alias("s"))


@query("frame_slice", f"{_F} SELECT CAST((row_id - (n - 1000)) // 3 AS BIGINT) AS row_id, v, s FROM f, n WHERE row_id >= n - 1000 AND row_id < n - 10 AND (row_id - (n - 1000)) % 3 = 0")
def q_slice(spark, d):
    return P.slice_rows(_f(spark, d), -1000, -10, 3)


@query("frame_index", f"{_F}, i AS (SELECT * FROM (VALUES (0, 5), (1, 2), (2, 5), (3, 0)) t(a, b) UNION ALL SELECT 4, n - 1 FROM n) SELECT CAST(a AS BIGINT) AS row_id, v, s FROM i JOIN f ON row_id = b")
def q_index(spark, d):
    return P.index(_f(spark, d), [5, 2, 5, 0, -1]).select("row_id", "v", "s")


@query("frame_mask", f"{_F} SELECT * FROM f WHERE s = 'F'")
def q_mask(spark, d):
    return P.mask(_f(spark, d).withColumn("keep", F.col("s") == "F"), "keep").drop("keep")


@query("frame_repeat", f"{_F} SELECT row_id * 3 + k AS row_id, v, s FROM f, range(3) t(k)")
def q_repeat(spark, d):
    return P.repeat(_f(spark, d), 3)


@query("frame_tile", f"{_F} SELECT row_id + n * k AS row_id, v, s FROM f, n, range(2) t(k)")
def q_tile(spark, d):
    return P.repeat(_f(spark, d), 2, interleave=False)


@query("frame_sample_repeat", f"{_F}, r AS (SELECT f.*, k FROM f, range(3) t(k) WHERE k < row_id % 4) SELECT row_number() OVER (ORDER BY row_id, k) - 1 AS row_id, v, s FROM r")
def q_sample_repeat(spark, d):
    return P.sample_repeat(_f(spark, d).withColumn("times", F.col("row_id") % 4), "times").select("row_id", "v", "s")


@query("frame_chunk", f"{_F} SELECT chunk, count(*) AS n_rows, sum(v) AS v FROM (SELECT CAST(row_id // CAST(ceil(n / 7) AS BIGINT) AS BIGINT) AS chunk, v FROM f, n) GROUP BY 1")
def q_chunk(spark, d):
    return P.chunk(_f(spark, d), 7, padded=True).groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("v").alias("v"))


@query("frame_pad", f"{_F} SELECT row_id, v, s FROM f UNION ALL SELECT row_id + n, v, s FROM f, n WHERE row_id < (77 - n % 77) % 77")
def q_pad(spark, d):
    return P.pad_to_divisor(_f(spark, d), 77)[0]


@query("frame_unpad", f"{_F} SELECT row_id, v, s FROM f")
def q_unpad(spark, d):
    padded, added = P.pad_to_divisor(_f(spark, d), 77)
    return P.unpad(padded, added)


@query("frame_padding_last", f"{_F} SELECT row_id, v, s FROM f UNION ALL SELECT n + k, v, s FROM f, n, range(5) t(k) WHERE row_id = n - 1")
def q_padding(spark, d):
    return P.padding(_f(spark, d), 5)


@query("frame_zip", f"{_F} SELECT row_id, v, s, v * 2 AS w FROM f")
def q_zip(spark, d):
    f = _f(spark, d)
    return P.zip_union(f, f.select("row_id", "v", (F.col("v") * 2).alias("w")))


@query("frame_concat", f"{_F} SELECT row_id, v, s FROM f UNION ALL SELECT row_id + n, v, s FROM f, n")
def q_concat(spark, d):
    f = _f(spark, d)
    return P.concat([f, f])


@query("frame_reorder", f"{_F} SELECT n - 1 - row_id AS row_id, v, s FROM f, n")
def q_reorder(spark, d):
    f = _f(spark, d)
    n = f.count()
    return P.reorder_by(f, f.select("row_id", (n - 1 - F.col("row_id")).alias("new_id"))).select("row_id", "v", "s")


@query("frame_unfold_chunks", "SELECT vec_id * 4 + k AS row_id, label, round(list_sum([x::DOUBLE FOR x IN embedding[CAST(k * (len(embedding) // 4) + 1 AS BIGINT):CAST((k + 1) * (len(embedding) // 4) AS BIGINT)]]), 5) AS total FROM embeddings, range(4) t(k)")
def q_unfold(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label", "embedding")
    out = P.unfold_chunks(e, 4, ["embedding"])
    return out.select("row_id", "label", F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("frame_fold", f"{_F} SELECT row_id // 5 AS row_id, len(list(v)) AS n, list(v ORDER BY row_id)[1] AS first_v, list(v ORDER BY row_id)[5] AS last_v FROM f GROUP BY 1")
def q_fold(spark, d):
    return P.fold(_f(spark, d), 5).select("row_id", F.size("v").cast("long").alias("n"), F.get("v", F.lit(0)).alias("first_v"), F.get("v", F.lit(4)).alias("last_v"))


@query("frame_unfold", f"{_F} SELECT row_id, v, s FROM f")
def q_unfold_rows(spark, d):
    return P.unfold(P.fold(_f(spark, d), 5), 5)


@query("frame_drop_last", f"{_F} SELECT row_id // 64 AS batch, count(*) AS n, sum(v) AS v FROM f, n WHERE row_id // 64 < n // 64 GROUP BY 1")
def q_drop_last(spark, d):
    return P.drop_last(_f(spark, d), 64).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


@query("frame_mini_batches", f"{_F} SELECT e AS epoch, b AS batch, 50 AS n FROM range(2) t(e), n, range(n // 50) u(b)")
def q_mini(spark, d):
    return P.mini_batches(_f(spark, d), 50, 2).groupBy(F.col("epoch").cast("long").alias("epoch"), "batch").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("frame_adjust_copy", f"{_F} SELECT count(*) + (7 - count(*) % 7) % 7 AS n, CAST(count(*) AS BIGINT) AS distinct_rows FROM f")
def q_adjust_copy(spark, d):
    out = P.adjust_size(_f(spark, d).withColumn("orig", F.col("row_id")), 7, "copy")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("orig").alias("distinct_rows"))


@query("frame_adjust_delete", f"{_F} SELECT count(*) - count(*) % 7 AS n, count(*) - count(*) % 7 - 1 AS last_id FROM f")
def q_adjust_delete(spark, d):
    return P.adjust_size(_f(spark, d), 7, "delete").agg(F.count(F.lit(1)).alias("n"), F.max("row_id").alias("last_id"))


@query("frame_select_rename", f"{_F} SELECT row_id, v AS value FROM f")
def q_select(spark, d):
    return P.rename(P.select(_f(spark, d), ["v"], ["missing"]), ["v"], ["value"])


@query("frame_pop", f"{_F} SELECT row_id, s FROM f")
def q_pop(spark, d):
    return P.pop(_f(spark, d), ["v"])[1]
