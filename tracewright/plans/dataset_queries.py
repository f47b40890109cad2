"""Queries of dataset preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import advantage as A
from tracewright.operators import datasets as D
from tracewright.operators import etl as E
from tracewright.plans.registry import query
from tracewright.plans.report_queries import STEPS_SQL, steps
from tracewright.session import table


@query("eval_samples", "SELECT eval_id, upper(split_part(question_type, '_', 1)) AS question_type, array_to_string(options, chr(10)) AS options_text FROM example_eval WHERE question_type IS NOT NULL")
def eval_samples(spark, d):
    return D.eval_sample(table(spark, d, "example_eval").where("question_type IS NOT NULL")).select("eval_id", "question_type", "options_text")


@query("shuffled_options", "SELECT p_partkey AS k, 4 AS n, 1 AS has_right FROM part")
def shuffled(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), D.shuffled_options(F.col("p_name"), F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.col("p_partkey")).alias("o"), "p_name")
    right = F.get("o.options", F.ascii("o.gold") - 65) == F.col("p_name")
    return p.select("k", F.size("o.options").alias("n"), right.cast("int").alias("has_right"))


@query("date_range", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1996-01-01' AND '1996-12-31'")
def date_range(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return D.date_range(o, "day", "1996-01-01", "1996-12-31").select("o_orderkey")


@query("split_percent", "SELECT CASE WHEN o_orderkey < round((SELECT count(*) FROM orders) * 0.75) THEN 'head' ELSE 'tail' END AS part, count(*) AS n FROM orders GROUP BY 1")
def split_percent(spark, d):
    return D.split_percent(table(spark, d, "orders"), "o_orderkey", 0.75).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("step_stats", f"WITH {STEPS_SQL}, j AS (SELECT traj_id, cur_step, coalesce(error_code, '') AS e, CASE WHEN coalesce(error_code, '') IN ('', 'OK') AND json_valid(output) THEN output END AS j FROM st), x AS (SELECT *, json_extract_string(j, '$.action.type') AS t FROM j) SELECT traj_id, cur_step, CASE WHEN e NOT IN ('', 'OK') THEN 'ERROR' ELSE coalesce(t, 'UNKNOWN') END AS action_type, CASE WHEN t = 'get_frames' THEN TRY_CAST(json_extract_string(j, '$.action.num') AS DOUBLE) END AS n_frames, CASE WHEN t = 'get_audio' THEN TRY_CAST(json_extract_string(j, '$.action.start') AS DOUBLE) END AS audio_start FROM x")
def step_stats(spark, d):
    s = steps(spark, d).select("traj_id", "cur_step", D.step_stats(F.col("output"), F.col("error_code")).alias("s"))
    return s.select("traj_id", "cur_step", "s.action_type", "s.n_frames", "s.audio_start")


@query("multichoice_answer", "SELECT row_id, nullif(upper(regexp_extract('Answer: ' || coalesce(answer, ''), '(?i)Answer[ \\t]*:[ \\t]*\\$?([A-D])\\$?', 1)), '') AS letter FROM example_train_rl")
def multichoice(spark, d):
    return table(spark, d, "example_train_rl").select("row_id", D.multichoice_answer(F.concat(F.lit("Answer: "), F.coalesce("answer", F.lit("")))).alias("letter"))


@query("pass_rate", "WITH c AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS c, CASE WHEN l_quantity < 4 THEN -4 WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS s FROM lineitem), f AS (SELECT k, min(c) FILTER (s = -4) AS f FROM c WHERE c < 10 GROUP BY 1) SELECT k, count(*) AS cases, round(count(*) FILTER (s = 1 AND (f IS NULL OR c < f)) / count(*), 6) AS pass_rate FROM c JOIN f USING (k) WHERE c < 10 GROUP BY k")
def pass_rate(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    code = F.when(F.col("l_quantity") < 4, -4).when(F.col("l_returnflag") == "R", 0).otherwise(1)
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.row_number().over(w) - 1).alias("c"), code.alias("s"))
    return D.pass_rate(c, "k", "c", "s", 10).withColumn("pass_rate", F.round("pass_rate", 6)).withColumn("cases", F.col("cases").cast("long"))


@query("common_prefix", "WITH p AS (SELECT c_custkey AS k, str_split(c_name, '') AS t, lag(str_split(c_name, '')) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS q FROM customer) SELECT k, CASE WHEN q IS NULL THEN NULL ELSE coalesce(list_min([i - 1 FOR i IN range(1, least(len(t), len(q)) + 1) IF t[i] <> q[i]]), least(len(t), len(q)))::INT END AS prefix FROM p")
def common_prefix(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey", F.split("c_name", "").alias("t"))
    return A.common_prefix(c, "c_nationkey", "k", "t").select("k", "prefix")


@query("hash_sample", "SELECT 100 AS n, 100 AS distinct_ids")
def hash_sample(spark, d):
    return E.hash_sample(table(spark, d, "orders"), "o_orderkey", 100).agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("o_orderkey").cast("int").alias("distinct_ids"))
