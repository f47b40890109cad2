"""Queries of state replay, windows over events, and the sources' projections, in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.plans.registry import query
from tracewright.plans.report_queries import STEPS_SQL, steps
from tracewright.plans.views import r6
from tracewright.session import table
from tracewright.sources import io
from tracewright.streaming import state as K


@query("replay_states", f"""WITH RECURSIVE {STEPS_SQL}, s AS (SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY cur_step) AS i, coalesce(valid, true) AS v, coalesce(step_reward, 0) AS r, coalesce(action_type = 'answer', false) AS a FROM st),
 f AS (SELECT DISTINCT traj_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS steps, CAST(0 AS DOUBLE) AS reward, CAST(0 AS BIGINT) AS retries, CAST(NULL AS VARCHAR) AS reason FROM s
 UNION ALL SELECT f.traj_id, s.i, f.steps + 1, f.reward + CASE WHEN v THEN r ELSE 0 END, f.retries + CASE WHEN v THEN 0 ELSE 1 END, CASE WHEN NOT v AND f.retries + 1 > 2 THEN 'RETRIES_EXCEEDED' WHEN v AND a THEN 'ANSWER' WHEN f.steps + 1 >= 15 THEN 'STEP_LIMIT_REACHED' END FROM f JOIN s ON s.traj_id = f.traj_id AND s.i = f.i + 1 WHERE f.reason IS NULL)
 SELECT traj_id, arg_max(steps, i) AS steps, round(arg_max(reward, i), 6) AS reward, arg_max(retries, i) AS retries, bool_or(reason IS NOT NULL) AS done, max(reason) AS reason FROM f GROUP BY 1""")
def replay_states(spark, d):
    s = steps(spark, d).select("traj_id", "cur_step", "valid", F.col("step_reward").alias("reward"), (F.col("action_type") == "answer").alias("answer"))
    out = K.replay(s, 15, 2)
    return out.select("traj_id", "steps", r6("reward"), "retries", "done", "reason")


@query("tumbling_events", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    return K.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"]).withColumn("total", F.round("total", 4))


@query("sliding_events", "WITH b AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b FROM events), w AS (SELECT b AS start FROM b UNION ALL SELECT b - INTERVAL 30 MINUTE FROM b) SELECT start, count(*) AS n FROM w GROUP BY 1")
def sliding(spark, d):
    return K.sliding(table(spark, d, "events"), "ts", "1 hour", "30 minutes")


@query("session_events", "WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def sessions(spark, d):
    return K.sessions(table(spark, d, "events"), "ts", "1 hour", "user_id").withColumn("total", F.round("total", 4))


@query("event_props", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def event_props(spark, d):
    v = io.whole_object(F.col("props"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"))


@query("metric_rows", "SELECT o_orderkey AS step, 'price' AS metric, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'cust', o_custkey::DOUBLE FROM orders")
def metric_rows(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust"))
    return io.metric_rows(o, F.col("k"), ["price", "cust"])


@query("responses_table", "SELECT o_custkey AS k, list(o_orderpriority ORDER BY o_orderkey) AS responses FROM orders GROUP BY 1")
def responses(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), F.col("o_orderpriority").alias("r"))
    return io.responses_table(o, "k", "o", "r", [])


@query("task_and_step", "WITH v AS (SELECT row_id, str_split(video, '/') AS p FROM example_train_rl WHERE video IS NOT NULL), n AS (SELECT *, nullif(regexp_extract(p[-1], '(\\d+)[^\\d]*$', 1), '') AS s FROM v) SELECT row_id, CASE WHEN len(p) > 1 THEN p[-2] END AS task, TRY_CAST(s AS BIGINT) AS step FROM n")
def task_and_step(spark, d):
    t = table(spark, d, "example_train_rl").where("video IS NOT NULL")
    return t.select("row_id", io.task_and_step(F.col("video")).alias("x")).select("row_id", "x.task", "x.step")
