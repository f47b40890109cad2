"""Queries of trajectory ETL, joins, set operations and partitioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import etl as E
from tracewright.operators import filters as X
from tracewright.operators import partition as B
from tracewright.plans.registry import query
from tracewright.plans.report_queries import STEPS_SQL, episodes, steps
from tracewright.plans.views import SEQS_SQL, r6, seqs
from tracewright.session import table

_LINE = STEPS_SQL + ", ln AS (SELECT *, traj_id || '#' || lpad(cur_step::VARCHAR, 6, '0') AS line FROM st)"


def _lined(spark, d):
    return steps(spark, d).withColumn("line", F.concat("traj_id", F.lit("#"), F.lpad(F.col("cur_step").cast("string"), 6, "0")))


@query("cheap_filter", f"WITH {STEPS_SQL}, k AS (SELECT traj_id FROM st GROUP BY 1 HAVING coalesce(bool_or(won), false) AND max(episode_reward) > 0.5 AND max(cur_step) + 1 >= 2) SELECT traj_id, cur_step FROM st WHERE traj_id IN (SELECT traj_id FROM k)")
def cheap_filter(spark, d):
    return E.winning_trajectories(steps(spark, d)).select("traj_id", "cur_step")


_BEST = ", t AS (SELECT traj_id, min(line) AS f, coalesce(arg_max(coalesce(won, false), line), false) AS won, arg_min(coalesce(video, ''), line) AS video, arg_min(coalesce(question_id, ''), line) AS question_id, count(*) AS n FROM ln GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY video, question_id ORDER BY won DESC, f DESC) AS rn FROM t)"


@query("sft_export", f"WITH {_LINE}{_BEST} SELECT traj_id, cur_step FROM ln WHERE coalesce(error_code, '') = '' AND traj_id IN (SELECT traj_id FROM r WHERE rn = 1 AND won AND n <= 12)")
def sft_export(spark, d):
    s = _lined(spark, d).withColumns({c: F.coalesce(c, F.lit("")) for c in ("video", "question_id")})
    return E.sft_export(s, ["video", "question_id"], 12).select("traj_id", "cur_step")


@query("rl_negatives", f"WITH {_LINE}, l AS (SELECT traj_id, arg_max(coalesce(won, false), line) AS won, arg_max(coalesce(error_code, ''), line) AS e FROM ln GROUP BY 1) SELECT traj_id, CASE WHEN e = '' THEN 'LOGIC_WRONG_ANSWER' ELSE e END AS error_reason FROM l WHERE NOT won AND e NOT IN ('FFMPEG_AUDIO_FAIL', 'FFMPEG_CLIP_FAIL', 'FFMPEG_FRAME_FAIL', 'TOKEN_LIMIT_EXCEEDED')")
def rl_negatives(spark, d):
    return E.rl_negatives(_lined(spark, d), [], [*E.ENV_ERRORS, E.TOKEN_LIMIT]).select("traj_id", "error_reason")


@query("purge", "WITH e AS (SELECT DISTINCT * FROM episodes), o AS (SELECT e.*, coalesce(len(x.options), 0) AS n FROM e LEFT JOIN example_eval x ON e.question_id = x.eval_id::VARCHAR) SELECT traj_id FROM o WHERE NOT (attempts < CASE WHEN question_type LIKE 'MCQ%' THEN n + 1 ELSE 5 END AND win = false)")
def purge(spark, d):
    x = table(spark, d, "example_eval").select(F.col("eval_id").cast("string").alias("question_id"), F.size(F.coalesce("options", F.array())).alias("n"))
    e = episodes(spark, d).join(x, "question_id", "left")
    return E.purge_incomplete(e, F.coalesce(F.col("question_type").startswith("MCQ"), F.lit(False)), F.col("n")).select("traj_id")


@query("merge_dedup", "SELECT arg_min(traj_id, (ingested_at, step)) AS traj_id, run_id, question_id FROM steps WHERE question_id IS NOT NULL AND run_id IS NOT NULL GROUP BY run_id, question_id HAVING min(step) > 0")
def merge_dedup(spark, d):
    s = table(spark, d, "steps").where("run_id IS NOT NULL AND question_id IS NOT NULL").select(F.concat("run_id", F.lit("|"), "question_id").alias("k"), "run_id", "question_id", "traj_id", "ingested_at", "step")
    return E.first_line_per(s, "k", ["ingested_at", "step"]).select("traj_id", "run_id", "question_id")


@query("meta_enrich", "WITH m AS (SELECT trim(question) AS q, trim(video) AS v, arg_max(origin_question_type, row_id) AS o FROM example_train_rl WHERE origin_question_type IS NOT NULL GROUP BY 1, 2) SELECT eval_id, coalesce(o, 'UNKNOWN') AS origin_question_type FROM example_eval LEFT JOIN m ON trim(question) = q AND trim(video) = v")
def meta_enrich(spark, d):
    ev = table(spark, d, "example_eval").select("eval_id", "question", "video")
    meta = table(spark, d, "example_train_rl").where("origin_question_type IS NOT NULL").select("question", "video", "origin_question_type", "row_id")
    return E.enrich(ev, meta, ["question", "video"], "origin_question_type", "row_id").select("eval_id", "origin_question_type")


@query("resume_anti", "SELECT eval_id FROM example_eval WHERE eval_id::VARCHAR NOT IN (SELECT question_id FROM episodes WHERE question_id IS NOT NULL)")
def resume_anti(spark, d):
    todo = table(spark, d, "example_eval").select("eval_id", F.col("eval_id").cast("string").alias("question_id"))
    return E.resume(todo, table(spark, d, "episodes"), ["question_id"]).select("eval_id")


@query("top_traj", f"WITH {_LINE}, f AS (SELECT traj_id, min(line) AS f FROM ln GROUP BY 1 ORDER BY f LIMIT 20) SELECT traj_id, cur_step FROM ln WHERE traj_id IN (SELECT traj_id FROM f)")
def top_traj(spark, d):
    return E.ranked_trajectories(_lined(spark, d), 20).select("traj_id", "cur_step")


@query("bottom_traj", f"WITH {_LINE}, f AS (SELECT traj_id, min(line) AS f FROM ln GROUP BY 1 ORDER BY f DESC LIMIT 20) SELECT traj_id, cur_step FROM ln WHERE traj_id IN (SELECT traj_id FROM f)")
def bottom_traj(spark, d):
    return E.ranked_trajectories(_lined(spark, d), 20, "bottom").select("traj_id", "cur_step")


@query("even_traj", f"WITH {_LINE}, f AS (SELECT traj_id, row_number() OVER (ORDER BY min(line)) - 1 AS i, count(*) OVER () AS n FROM ln GROUP BY 1), p AS (SELECT CAST(floor(k * (SELECT max(n) FROM f) / 15) AS BIGINT) AS i FROM range(15) t(k)) SELECT traj_id FROM f WHERE i IN (SELECT i FROM p)")
def even_traj(spark, d):
    return E.ranked_trajectories(_lined(spark, d), 15, "even").select("traj_id").distinct()


@query("best_of_n", "WITH e AS (SELECT DISTINCT * FROM episodes), a AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY started_at, traj_id) AS a FROM e), g AS (SELECT question_id, min(a) FILTER (win) AS w, count(*) AS n, coalesce(bool_or(win), false) AS win FROM a GROUP BY 1), b AS (SELECT question_id, first(a ORDER BY total_reward DESC NULLS LAST, a) AS b FROM a GROUP BY 1) SELECT question_id, coalesce(w, b) AS attempt, coalesce(w, n) AS attempts, win FROM g JOIN b USING (question_id)")
def best_of_n(spark, d):
    from pyspark.sql import Window as W

    a = episodes(spark, d).withColumn("a", F.row_number().over(W.partitionBy("question_id").orderBy("started_at", "traj_id")).cast("long"))
    return E.best_attempt(a, "question_id", "a", "win", "total_reward")


@query("first_pass", f"WITH {SEQS_SQL} SELECT row_id, CASE WHEN n_tokens % 3 = 0 THEN ignored ELSE false END AS first_pass, round(CASE WHEN n_tokens % 3 = 0 THEN score ELSE 0 END, 6) AS first_pass_reward FROM seq")
def first_pass(spark, d):
    s = seqs(spark, d).withColumn("retries", F.col("n_tokens") % 3)
    return E.first_pass(s, "row_id", "retries", "ignored", "score").select("row_id", "first_pass", r6("first_pass_reward"))


_CLASSES = {"MCQ": {"total": 20, "first": {"1-URGENT": 4, "2-HIGH": 4}, "fill": ["3-MEDIUM", "5-LOW"]}, "SIZE": {"total": 4, "fill": ["4-NOT SPECIFIED"]}}


@query("quota_merge")
def quota_merge(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("bucket"))
    return E.quota_merge(o, "bucket", "row_id", _CLASSES).select("row_id", "bucket", "batch")


@query("adjacent_pairs", "WITH o AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders), g AS (SELECT k // 2 AS pair, count(*) AS n, first(k ORDER BY p DESC, k) AS c, first(k ORDER BY p, k DESC) AS r FROM o GROUP BY 1) SELECT pair, c AS chosen, r AS rejected FROM g WHERE n = 2")
def adjacent_pairs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    return E.adjacent_pairs(o, "k", "p", []).select("pair", F.col("chosen.k").alias("chosen"), F.col("rejected.k").alias("rejected"))


@query("pairs_below", "SELECT o_orderkey AS row_id, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) - 1 AS below FROM orders")
def pairs_below(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey", "o_totalprice")
    return E.all_pairs_score(o, "o_custkey", "o_totalprice").select("row_id", F.col("below").cast("long").alias("below"))


@query("chosen_rejected_rows", "SELECT n_nationkey AS k, n_name AS text, 1 AS label FROM nation UNION ALL SELECT n_nationkey, n_name || '!', 0 FROM nation")
def chosen_rejected(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("c"), F.concat("n_name", F.lit("!")).alias("r"))
    return E.chosen_rejected_rows(n, "c", "r").select("k", "text", "label")


@query("set_union", "SELECT question_id FROM episodes WHERE run_id = 'r00-amber' UNION SELECT question_id FROM episodes WHERE run_id = 'r01-birch'")
def set_union(spark, d):
    e = table(spark, d, "episodes")
    return e.where("run_id = 'r00-amber'").select("question_id").union(e.where("run_id = 'r01-birch'").select("question_id")).distinct()


@query("set_intersect", "SELECT question_id FROM episodes WHERE run_id = 'r00-amber' INTERSECT SELECT question_id FROM episodes WHERE run_id = 'r01-birch'")
def set_intersect(spark, d):
    e = table(spark, d, "episodes")
    return e.where("run_id = 'r00-amber'").select("question_id").intersect(e.where("run_id = 'r01-birch'").select("question_id"))


@query("set_difference", "SELECT question_id FROM episodes WHERE run_id = 'r00-amber' EXCEPT SELECT question_id FROM episodes WHERE run_id = 'r01-birch'")
def set_difference(spark, d):
    e = table(spark, d, "episodes")
    return e.where("run_id = 'r00-amber'").select("question_id").subtract(e.where("run_id = 'r01-birch'").select("question_id"))


@query("dynamic_sampling", f"WITH {SEQS_SQL}, b AS (SELECT *, CASE WHEN score > 4 THEN 1 ELSE 0 END AS r FROM seq), g AS (SELECT uid FROM b GROUP BY 1 HAVING min(r) <> max(r)) SELECT row_id FROM b WHERE uid IN (SELECT uid FROM g)")
def dynamic_sampling(spark, d):
    s = seqs(spark, d).withColumn("r", F.when(F.col("score") > 4, 1).otherwise(0))
    return X.differing_groups(s, score="r").select("row_id")


@query("dapo_filter", f"WITH {SEQS_SQL}, b AS (SELECT *, CASE WHEN score > 4 THEN 1 ELSE 0 END AS r FROM seq), g AS (SELECT uid FROM b GROUP BY 1 HAVING stddev_pop(r) > 0 OR count(*) = 1) SELECT row_id FROM b WHERE uid IN (SELECT uid FROM g)")
def dapo_filter(spark, d):
    return X.spread_groups(seqs(spark, d).withColumn("r", F.when(F.col("score") > 4, 1).otherwise(0)), metric="r").select("row_id")


@query("accuracy_band", f"WITH {SEQS_SQL}, g AS (SELECT uid, NOT (avg(score) BETWEEN 2 AND 3 AND max(n_tokens) < 7) AS late FROM seq GROUP BY 1), r AS (SELECT uid, row_number() OVER (ORDER BY late, uid) AS rn, count(*) OVER () AS n FROM g) SELECT row_id FROM seq WHERE uid IN (SELECT uid FROM r WHERE rn <= n // 3)")
def accuracy_band(spark, d):
    return X.accuracy_band(seqs(spark, d), "uid", "score", 2, 3, 3, "n_tokens", 7).select("row_id")


@query("exceed_mask", f"WITH {STEPS_SQL} SELECT traj_id, coalesce(bool_or(error_code IN ('STEP_LIMIT_REACHED', 'INVALID_JSON')), false) AS exceeded FROM st GROUP BY 1")
def exceed_mask(spark, d):
    return X.any_error_in(steps(spark, d), "traj_id", "error_code", ["STEP_LIMIT_REACHED", "INVALID_JSON"])


@query("top_entropy_turns", f"WITH {SEQS_SQL}, r AS (SELECT row_id, row_number() OVER (PARTITION BY uid ORDER BY step_score DESC, row_id) AS rn, count(*) OVER (PARTITION BY uid) AS n FROM seq) SELECT row_id, rn <= greatest(1, ceil(n * 0.3)) AS keep FROM r")
def top_entropy_turns(spark, d):
    return X.top_entropy_turns(seqs(spark, d), 0.3, "uid", "step_score").select("row_id", "keep")


@query("overlong_filter", "SELECT vec_id FROM embeddings WHERE coalesce(len(embedding), 0) <= 64")
def overlong(spark, d):
    return X.not_longer(table(spark, d, "embeddings"), "embedding", 64).select("vec_id")


def _batches(spark, d):
    return table(spark, d, "documents").select(F.floor(F.col("doc_id") / 64).alias("g"), F.col("doc_id").alias("row_id"), F.coalesce("n_chars", F.lit(0)).alias("n"))


@query("kk_partition")
def kk_partition(spark, d):
    return B.partition_groups(_batches(spark, d), "g", "row_id", "n", 8)


@query("greedy_partition")
def greedy_partition(spark, d):
    return B.partition_groups(_batches(spark, d), "g", "row_id", "n", 8, "greedy")


@query("micro_batches")
def micro_batches(spark, d):
    return B.micro_batches(_batches(spark, d), "g", "row_id", "n", 20_000)


@query("imbalance_blocks", "WITH p AS (SELECT doc_id // 64 AS g, doc_id // 8 AS b, sum(coalesce(n_chars, 0)) AS s FROM documents GROUP BY 1, 2) SELECT g, CAST(max(s) AS BIGINT) AS largest, CAST(min(s) AS BIGINT) AS smallest, round(avg(s), 6) AS mean, round(max(s) / avg(s), 6) AS ratio FROM p GROUP BY 1")
def imbalance(spark, d):
    b = _batches(spark, d).withColumn("b", F.floor(F.col("row_id") / 8))
    return B.imbalance(b, "g", "b", "n").select("g", "largest", "smallest", r6("mean"), r6("ratio"))


@query("pf_ppo_weights", f"WITH {SEQS_SQL} SELECT row_id, round(abs(score) ^ 2 + 1e-8, 6) AS weight FROM seq")
def pf_weights(spark, d):
    return B.reweights(seqs(spark, d)).select("row_id", r6("weight"))


@query("pf_ppo_max_min", f"WITH {SEQS_SQL} SELECT count(*) FILTER (score = (SELECT max(score) FROM seq) OR score = (SELECT min(score) FROM seq)) AS n FROM seq")
def pf_max_min(spark, d):
    return B.reweights(seqs(spark, d), method="max_min").agg(F.count_if(F.col("weight") > 0.5).alias("n"))


@query("pf_ppo_resample", f"WITH {SEQS_SQL} SELECT count(*) AS draws FROM seq")
def pf_resample(spark, d):
    return B.resample(B.reweights(seqs(spark, d))).agg(F.sum("copies").alias("draws"))


@query("validation_bootstrap")
def validation_bootstrap(spark, d):
    s = seqs(spark, d).withColumn("pred", F.substring("anchor", 1, 1))
    return B.validation_metrics(s, "ignored", "uid", "score", "pred").withColumn("value", F.round("value", 6))


@query("validation_mean", f"WITH {SEQS_SQL}, p AS (SELECT ignored, uid, count(*) AS n, avg(score) AS m, stddev_pop(score) AS s FROM seq GROUP BY 1, 2) SELECT ignored AS source, 'mean@' || n AS metric, round(avg(m), 6) AS value FROM p GROUP BY 1, n UNION ALL SELECT ignored, 'std@' || n, round(avg(s), 6) FROM p WHERE n > 1 GROUP BY 1, n")
def validation_mean(spark, d):
    return B.validation_metrics(seqs(spark, d), "ignored", "uid", "score", draws=2).where("metric LIKE 'mean@%' OR metric LIKE 'std@%'").select("source", "metric", r6("value"))
