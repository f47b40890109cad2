"""Queries of the trajectory, run and evaluation reports on ``steps``, ``episodes`` and token rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import reports as R
from tracewright.operators.ranks import quantile
from tracewright.plans.registry import query
from tracewright.plans.views import TOKENS_SQL, r6, token_rows
from tracewright.session import materialize, table

STEPS_SQL = """st AS (SELECT * EXCLUDE rn FROM (SELECT traj_id, step - 1 AS cur_step, run_id, question_id, action_type, output, step_reward, episode_reward, generation_seconds, env_step_seconds, step_wall_seconds,
 extra_info.video AS video, extra_info.question_type AS question_type, extra_info.won AS won, extra_info.is_action_valid AS valid, extra_info.error_code AS error_code, extra_info.duration_seconds AS duration,
 row_number() OVER (PARTITION BY traj_id, step ORDER BY ingested_at) AS rn FROM steps) WHERE rn = 1)"""
OK = "(coalesce(valid, true) AND coalesce(error_code, '') = '')"
TRAJ_SQL = STEPS_SQL + f""", tr AS (SELECT traj_id, max(cur_step) + 1 AS n_steps, count(*) AS n_rows, coalesce(arg_max(coalesce(won, false), cur_step), false) AS won, arg_max(coalesce(episode_reward, 0), cur_step) AS reward,
 arg_max(coalesce(error_code, ''), cur_step) AS final_error, arg_max({OK}, cur_step) AS valid_last, bool_and({OK}) AS all_valid, min(cur_step) FILTER (NOT {OK}) AS first_invalid, arg_max(coalesce(question_type, ''), cur_step) AS question_type,
 arg_max(coalesce(run_id, ''), cur_step) AS run_id, arg_max(coalesce(question_id, ''), cur_step) AS question_id, arg_max(coalesce(duration, -1), cur_step) AS duration FROM st GROUP BY 1)"""
_S = lambda c: f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)"


def steps(spark, d):
    return R.canonical_steps(table(spark, d, "steps"))


def _round(df, *keep):
    return df.select(*[c if c in keep else r6(c) for c in df.columns])


def _sel(cols: dict[str, str], keys: dict[str, str] | None = None) -> str:
    return ", ".join([f"{x} AS {n}" for n, x in (keys or {}).items()] + [f"round(CAST({x} AS DOUBLE), 6) AS {n}" for n, x in cols.items()])


@query("traj_report", f"WITH {TRAJ_SQL} SELECT " + _sel({
    "trajectories": "count(*)", "wins": "count(*) FILTER (won)", "accuracy": _S("won"), "avg_reward": "avg(reward)", "valid_ratio": _S("all_valid"),
    "valid_ratio_excl_limit": "count(*) FILTER (all_valid) / nullif(count(*) - count(*) FILTER (final_error = 'STEP_LIMIT_REACHED'), 0)", "accuracy_valid": "count(*) FILTER (all_valid AND won) / greatest(count(*) FILTER (all_valid), 1)",
    "steps_mean": "avg(n_steps)", "steps_std": "coalesce(stddev_samp(n_steps), 0)", "steps_median": "median(n_steps)", "coverage": _S("n_steps <= (SELECT avg(n_steps) + stddev_samp(n_steps) FROM tr)")}) + " FROM tr")
def traj_report(spark, d):
    return _round(R.traj_report(steps(spark, d)))


@query("step_buckets", f"WITH {TRAJ_SQL} SELECT " + _sel({"accuracy": _S("won"), "avg_reward": "avg(reward)", "share": "count(*) / (SELECT count(*) FROM tr)"}, {"n_steps": "n_steps", "trajectories": "count(*)", "wins": "count(*) FILTER (won)", "valid_last": "count(*) FILTER (valid_last)"}) + " FROM tr GROUP BY n_steps")
def step_buckets(spark, d):
    return _round(R.step_buckets(steps(spark, d)), "n_steps", "trajectories", "wins", "valid_last")


_ACT = "coalesce(nullif(regexp_replace(lower({0}), '[^a-z0-9]', '', 'g'), ''), 'unknown')"


@query("action_distribution", f"WITH {STEPS_SQL} SELECT {_ACT.format('action_type')} AS action, count(*) AS total, count(*) FILTER ({OK}) AS valid, count(*) FILTER (NOT {OK}) AS invalid FROM st GROUP BY 1")
def action_distribution(spark, d):
    return R.action_distribution(steps(spark, d))


_BODY = r"regexp_replace(output, '^\s*```[a-zA-Z]*\s*|\s*```\s*$', '', 'g')"
_EV = f""", b AS (SELECT traj_id, {_BODY} AS body FROM st WHERE {OK}), j AS (SELECT traj_id, CASE WHEN json_valid(body) THEN body END AS j FROM b),
 e AS (SELECT traj_id, {_ACT.format("json_extract_string(j, '$.action.type')")} AS a, coalesce(TRY_CAST(json_extract_string(j, '$.action.num') AS DOUBLE), 0) AS num, greatest(0, coalesce(TRY_CAST(json_extract_string(j, '$.action.end') AS DOUBLE), 0) - coalesce(TRY_CAST(json_extract_string(j, '$.action.start') AS DOUBLE), 0)) AS sec FROM j),
 ev AS (SELECT traj_id, sum(CASE WHEN a = 'getframes' THEN num ELSE 0 END) AS frames, sum(CASE WHEN a = 'getclip' THEN sec ELSE 0 END) AS clip, sum(CASE WHEN a = 'getaudio' THEN sec ELSE 0 END) AS audio FROM e WHERE a IN ('getframes', 'getclip', 'getaudio') GROUP BY 1)"""


@query("evidence", f"WITH {STEPS_SQL}{_EV} SELECT traj_id, " + _sel({"frames": "frames", "clip": "clip", "audio": "audio"}) + " FROM ev")
def evidence(spark, d):
    return _round(R.evidence(steps(spark, d)), "traj_id")


@query("evidence_summary", f"WITH {STEPS_SQL}{_EV} SELECT " + _sel({"frames_mean": "avg(frames)", "frames_median": "median(frames)", "clip_mean": "avg(clip)", "clip_median": "median(clip)", "audio_mean": "avg(audio)", "audio_max": "max(audio)",
    "frames_p90": "(SELECT x[1 + CAST(round_even(0.9 * (len(x) - 1), 0) AS INT)] FROM (SELECT list(frames ORDER BY frames) AS x FROM ev))"}) + " FROM ev")
def evidence_summary(spark, d):
    e = materialize(R.evidence(steps(spark, d)), "evidence")
    middle = {c: F.lit(quantile(e, c, 0.5)).cast("double") for c in ("frames", "clip")}
    return _round(e.agg(F.avg("frames").alias("frames_mean"), middle["frames"].alias("frames_median"), F.avg("clip").alias("clip_mean"), middle["clip"].alias("clip_median"), F.avg("audio").alias("audio_mean"), F.max("audio").alias("audio_max")).withColumn("frames_p90", R.nearest_rank_of(e, "frames", 0.9).scalar()))


@query("first_invalid_steps", f"WITH {TRAJ_SQL} SELECT first_invalid, count(*) AS trajectories FROM tr WHERE NOT all_valid GROUP BY 1")
def first_invalid(spark, d):
    return R.first_invalid_steps(steps(spark, d))


@query("final_errors", f"WITH {TRAJ_SQL} SELECT final_error AS error_code, count(*) AS trajectories FROM tr WHERE final_error <> '' GROUP BY 1")
def final_errors(spark, d):
    return R.final_errors(steps(spark, d))


@query("macro_accuracy", f"WITH {TRAJ_SQL}, p AS (SELECT question_type, {_S('won')} AS a, avg(reward) AS r FROM tr GROUP BY 1) SELECT " + _sel({"types": "count(*)", "macro_accuracy": "avg(a)", "macro_reward": "avg(r)"}) + " FROM p")
def macro(spark, d):
    return _round(R.macro_accuracy(steps(spark, d)))


@query("calibration", f"WITH {STEPS_SQL}, l AS (SELECT traj_id, arg_max({_BODY}, cur_step) AS body, arg_max(coalesce(won, false), cur_step) AS won FROM st GROUP BY 1), c AS (SELECT round_even(TRY_CAST(json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.confidence') AS DOUBLE), 2) AS confidence, won FROM l) SELECT confidence, count(*) AS trajectories, round({_S('won')}, 6) AS accuracy FROM c WHERE confidence IS NOT NULL GROUP BY 1")
def calibration(spark, d):
    return _round(R.calibration(steps(spark, d)), "confidence", "trajectories")


@query("duration_buckets", f"WITH {TRAJ_SQL} SELECT CAST(floor(duration / 120) AS BIGINT) AS bucket, count(*) AS trajectories, round({_S('won')}, 6) AS accuracy, round(avg(n_steps), 6) AS avg_steps FROM tr WHERE duration >= 0 GROUP BY 1")
def duration_buckets(spark, d):
    return _round(R.duration_buckets(steps(spark, d)), "bucket", "trajectories")


@query("step_report", f"WITH {TRAJ_SQL} SELECT count(*) AS n_steps, count(*) FILTER ({OK}) AS valid, count(*) FILTER (NOT {OK}) AS invalid, count(*) FILTER (won) AS won, (SELECT count(*) FROM tr WHERE NOT won AND final_error = 'STEP_LIMIT_REACHED') AS failed_at_limit FROM st")
def step_report(spark, d):
    return R.step_report(steps(spark, d))


@query("validity_by_step", f"WITH {STEPS_SQL} SELECT cur_step, count(*) AS total, count(*) FILTER (coalesce(valid, true)) AS valid_rows, round({_S('coalesce(valid, true)')}, 6) AS ratio FROM st GROUP BY 1")
def validity_by_step(spark, d):
    return _round(R.validity_by_step(steps(spark, d)), "cur_step", "total", "valid_rows")


_RUNS = ", rt AS (SELECT run_id, traj_id, bool_and(coalesce(valid, true)) AS ok, coalesce(arg_max(coalesce(won, false), cur_step), false) AS won FROM st WHERE run_id IS NOT NULL GROUP BY 1, 2)"


@query("validity_over_runs", f"WITH {STEPS_SQL}{_RUNS}, x AS (SELECT DISTINCT run_id, traj_id, cur_step FROM st WHERE run_id IS NOT NULL), p AS (SELECT run_id, cur_step, {_S('ok')} AS r FROM x JOIN rt USING (run_id, traj_id) GROUP BY 1, 2) SELECT cur_step, round(avg(r), 6) AS avg_ratio, count(*) AS runs FROM p GROUP BY 1")
def validity_over_runs(spark, d):
    return _round(R.validity_by_step_over_runs(steps(spark, d)), "cur_step", "runs")


@query("run_table", f"WITH {STEPS_SQL}{_RUNS} SELECT run_id, count(*) AS trajectories, count(*) FILTER (ok) AS valid_trajectories, count(*) FILTER (won) AS wins, round({_S('ok')}, 6) AS valid_ratio, round({_S('won')}, 6) AS accuracy FROM rt GROUP BY 1")
def run_table(spark, d):
    return _round(R.run_table(steps(spark, d)), "run_id", "trajectories", "valid_trajectories", "wins")


_EP = "ep AS (SELECT DISTINCT * FROM episodes)"


def episodes(spark, d):
    return table(spark, d, "episodes").dropDuplicates()


@query("run_success", f"WITH {_EP}, p AS (SELECT run_id, count(*) AS trajectories, {_S('win')} AS accuracy, avg(steps) AS avg_steps FROM ep WHERE run_id IS NOT NULL GROUP BY 1) SELECT run_id, trajectories, round(accuracy, 6) AS accuracy, round(avg_steps, 6) AS avg_steps, CAST(coalesce(nullif(regexp_extract(run_id, '(\\d+)', 1), ''), '1152921504606846976') AS BIGINT) AS order_key, round((SELECT avg(accuracy) FROM p), 6) AS macro_accuracy FROM p")
def run_success(spark, d):
    e = episodes(spark, d).where("run_id IS NOT NULL")
    per = e.groupBy("run_id").agg(F.count(F.lit(1)).alias("trajectories"), R.share(F.col("win")).alias("accuracy"), F.avg("steps").alias("avg_steps"))
    number = F.coalesce(F.nullif(F.regexp_extract("run_id", r"(\d+)", 1), F.lit("")).cast("long"), F.lit(1 << 60))
    return _round(per.withColumns({"order_key": number, "macro_accuracy": per.agg(F.avg("accuracy")).scalar()}), "run_id", "trajectories", "order_key")


_RES = f"WITH {_EP}, q AS (SELECT run_id, question_id, max(total_reward) AS r FROM ep WHERE run_id IN ('r00-amber', 'r01-birch', 'r02-cedar') GROUP BY 1, 2)"


def _best(e):
    return e.groupBy("run_id", "question_id").agg(F.max("total_reward").alias("r"))


def _three(spark, d):
    return _best(episodes(spark, d).where(F.col("run_id").isin("r00-amber", "r01-birch", "r02-cedar")))


_ALL_RUNS = f"WITH {_EP}, q AS (SELECT run_id, question_id, max(total_reward) AS r FROM ep WHERE run_id IS NOT NULL GROUP BY 1, 2)"


@query("union_accuracy", f"{_ALL_RUNS}, n AS (SELECT count(DISTINCT run_id) AS n FROM q), g AS (SELECT question_id, bool_or(r >= 0.5) AS a, count(DISTINCT run_id) AS c, count(DISTINCT CASE WHEN r >= 0.5 THEN run_id END) AS o FROM q GROUP BY 1) SELECT " + _sel({
    "questions": "count(*)", "correct_any": "count(*) FILTER (a)", "union_accuracy": _S("a"), "in_every": "count(*) FILTER (c = n)", "correct_every": "count(*) FILTER (o = n)", "all_correct_ratio": "count(*) FILTER (o = n) / nullif(count(*) FILTER (c = n), 0)",
    "inconsistent_rate": "(count(*) FILTER (c = n) - count(*) FILTER (o = n)) / nullif(count(*) FILTER (c = n), 0)"}) + " FROM g, n")
def union_accuracy(spark, d):
    return _round(R.union_accuracy(_best(episodes(spark, d).where("run_id IS NOT NULL")), "run_id", "question_id", "r"))


@query("run_difference", f"{_RES} SELECT a.question_id, round(a.r, 6) AS reward_a, round(b.r, 6) AS reward_b FROM q a JOIN q b USING (question_id) WHERE a.run_id = 'r00-amber' AND b.run_id = 'r01-birch' AND (a.r >= 0.5) <> (b.r >= 0.5)")
def run_difference(spark, d):
    return _round(R.run_difference(_three(spark, d), "run_id", "question_id", "r", "r00-amber", "r01-birch"), "question_id")


@query("log_stats", f"WITH {STEPS_SQL}, f AS (SELECT traj_id, arg_min(coalesce(duration, -1), cur_step) AS d, count(*) AS n FROM st GROUP BY 1) SELECT " + _sel({"n_lines": "sum(n)", "trajectories": "count(*)", "mean_duration": "avg(CASE WHEN d < 0 THEN 0 ELSE d END)", "min_duration": "min(d) FILTER (d > 0)", "max_duration": "max(d) FILTER (d >= 0)"}) + " FROM f")
def log_stats(spark, d):
    s = steps(spark, d)
    first = s.groupBy("traj_id").agg(F.min_by(F.struct("duration"), "cur_step").alias("r"), F.count(F.lit(1)).alias("n"))
    return _round(first.select(F.col("r.duration").alias("d"), "n").agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("trajectories"), F.avg(F.coalesce("d", F.lit(0.0))).alias("mean_duration"), F.min(F.when(F.col("d") > 0, F.col("d"))).alias("min_duration"), F.max("d").alias("max_duration")))


@query("type_histogram", f"WITH {STEPS_SQL}, f AS (SELECT traj_id, arg_min(coalesce(question_type, ''), cur_step) AS q FROM st GROUP BY 1) SELECT nullif(q, '') AS question_type, count(*) AS trajectories, round(count(*) * 100 / (SELECT count(*) FROM f), 6) AS percent FROM f GROUP BY 1")
def type_histogram(spark, d):
    return _round(R.type_histogram(steps(spark, d)), "question_type", "trajectories")


@query("run_totals", f"WITH {STEPS_SQL} SELECT run_id, count(*) AS turns, count(*) FILTER (coalesce(valid, true)) AS valid_turns, count(DISTINCT traj_id) AS trajectories, (SELECT count(DISTINCT traj_id) FROM st) AS all_trajectories FROM st WHERE run_id IS NOT NULL GROUP BY 1")
def run_totals(spark, d):
    return R.run_totals(steps(spark, d))


@query("size_stats", "WITH t AS (SELECT list(n_chars::DOUBLE ORDER BY n_chars DESC)[1:3] AS x FROM documents) SELECT min(n_chars)::DOUBLE AS least, max(n_chars)::DOUBLE AS largest, CAST(floor(avg(n_chars)) AS BIGINT) AS mean, CAST(floor(median(n_chars)) AS BIGINT) AS median, round(avg(CASE WHEN n_chars > 4096 THEN 1.0 ELSE 0 END), 6) AS over_limit, (SELECT x[1] FROM t) AS top1, (SELECT x[2] FROM t) AS top2, (SELECT x[3] FROM t) AS top3 FROM documents")
def size_stats(spark, d):
    return _round(R.size_stats(table(spark, d, "documents"), "n_chars", 4096), "least", "largest", "mean", "median", "top1", "top2", "top3")


@query("top_errors", f"WITH {STEPS_SQL} SELECT error_code, count(*) AS n FROM st WHERE error_code IS NOT NULL GROUP BY 1 ORDER BY n DESC, min(traj_id || lpad(cur_step::VARCHAR, 6, '0')) LIMIT 5")
def top_errors(spark, d):
    s = steps(spark, d).withColumn("line", F.concat("traj_id", F.lpad(F.col("cur_step").cast("string"), 6, "0")))
    return R.most_common(s, "error_code", 5, "line")


@query("offline_eval", "WITH r AS (SELECT o_custkey AS p, arg_min(o_orderpriority, o_orderkey) AS src, avg(o_totalprice / 100003.7) AS s FROM orders GROUP BY 1) SELECT src AS data_source, round(avg(s), 6) AS score, count(*) AS n_rows FROM r GROUP BY 1")
def offline_eval(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("data_source"), F.collect_list(F.col("o_totalprice") / 100003.7).alias("scores"))
    return _round(R.offline_eval(o, "scores", "data_source").withColumnRenamed("rows", "n_rows"), "data_source", "n_rows")


@query("reduce_metrics", "WITH m AS (SELECT event_type || CASE event_id % 3 WHEN 0 THEN '/max' WHEN 1 THEN '/timing' ELSE '/mean' END AS metric, value FROM events) SELECT metric, round(CASE WHEN contains(metric, 'max') THEN max(value) WHEN contains(metric, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM m GROUP BY metric")
def reduce_metrics(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id") % 3
    m = e.select(F.concat("event_type", F.when(k == 0, "/max").when(k == 1, "/timing").otherwise("/mean")).alias("metric"), "value")
    return _round(R.reduce_metrics(m), "metric")


_DM = ", q AS (SELECT sum(reward) AS s, sum(mask) AS n FROM tok GROUP BY row_id)"


@query("data_metrics", f"WITH {TOKENS_SQL}{_DM} SELECT " + _sel({
    **{f"adv_{n}": f"{f}(adv) FILTER (mask > 0)" for n, f in (("mean", "avg"), ("max", "max"), ("min", "min"))}, **{f"value_{n}": f"{f}(value) FILTER (mask > 0)" for n, f in (("mean", "avg"), ("max", "max"), ("min", "min"))},
    "explained_var": "1 - var_samp(adv) FILTER (mask > 0) / (var_samp(value + adv) FILTER (mask > 0) + 1e-5)", **{f"score_{n}": f"(SELECT {f}(s) FROM q)" for n, f in (("mean", "avg"), ("max", "max"), ("min", "min"))},
    **{f"length_{n}": f"(SELECT {f}(n) FROM q)" for n, f in (("mean", "avg"), ("max", "max"), ("min", "min"))}, "empty_ratio": f"(SELECT {_S('n = 0')} FROM q)"}) + " FROM tok")
def data_metrics(spark, d):
    return _round(R.data_metrics(token_rows(spark, d)))


_LAT = {"generation_total": "sum(coalesce(generation_seconds, 0))", "env_total": "sum(coalesce(env_step_seconds, 0))", "wall_total": "sum(coalesce(step_wall_seconds, 0))", "generation_avg": "avg(coalesce(generation_seconds, 0))", "env_avg": "avg(coalesce(env_step_seconds, 0))",
        **{f"generation_p{p}": f"quantile_cont(coalesce(generation_seconds, 0), 0.{p})" for p in (50, 90, 95)}, **{f"env_p{p}": f"quantile_cont(coalesce(env_step_seconds, 0), 0.{p})" for p in (50, 90, 95)}}


@query("latency_summary", f"WITH {STEPS_SQL} SELECT traj_id, " + _sel(_LAT).replace(", 6) AS", ", 9) AS") + " FROM st GROUP BY 1")
def latency(spark, d):
    out = R.latency_summary(steps(spark, d))
    return out.select("traj_id", *[F.round(c, 9).alias(c) for c in out.columns if c != "traj_id"])


@query("tool_latency", f"WITH {STEPS_SQL} SELECT {_ACT.format('action_type')} AS action, count(*) AS n, round(sum(coalesce(env_step_seconds, 0)), 4) AS env_total, round(avg(coalesce(env_step_seconds, 0)), 6) AS env_avg FROM st GROUP BY 1")
def tool_latency(spark, d):
    return R.tool_latency(steps(spark, d)).select("action", "n", F.round("env_total", 4).alias("env_total"), r6("env_avg"))


_FIELDS = ("question_type", "run_id", "done", "win")


@query("breakdown", f"WITH {_EP} " + " UNION ALL ".join(
    f"SELECT '{f}' AS field, coalesce(nullif(trim(CAST({f} AS VARCHAR)), ''), 'UNKNOWN') AS value, count(*) AS n, round(avg(total_reward), 6) AS reward, round(avg(steps), 6) AS avg_steps, round(avg(CASE WHEN win THEN 1.0 ELSE 0 END), 6) AS accuracy FROM ep GROUP BY 2" for f in _FIELDS))
def breakdown(spark, d):
    m = {"n": F.count(F.lit(1)), "reward": F.avg("total_reward"), "avg_steps": F.avg("steps"), "accuracy": R.share(F.col("win"))}
    return _round(R.breakdown(episodes(spark, d), list(_FIELDS), m), "field", "value", "n")


_EVAL_TIMES = {"generation": "generation_seconds", "env_step": "env_step_seconds", "step_wall": "step_wall_seconds"}
_EVAL = {"valid_step_count": f"count(*) FILTER ({OK})", "invalid_step_count": f"count(*) FILTER (NOT {OK})"}
for _k, _c in _EVAL_TIMES.items():
    _EVAL |= {f"total_{_k}_seconds": f"sum(coalesce({_c}, 0))", f"avg_{_k}_seconds_per_step": f"avg(coalesce({_c}, 0))", f"valid_{_k}_seconds": f"sum(CASE WHEN {OK} THEN coalesce({_c}, 0) ELSE 0 END)", f"invalid_{_k}_seconds": f"sum(CASE WHEN NOT {OK} THEN coalesce({_c}, 0) ELSE 0 END)"}
for _k in ("generation", "env_step"):
    _EVAL |= {f"p{p}_{_k}_seconds_per_step": f"quantile_cont(coalesce({_EVAL_TIMES[_k]}, 0), 0.{p})" for p in (50, 90, 95)}
_EVAL |= {f"{c}_calls": f"count(*) FILTER ({_ACT.format('action_type')} = '{a}')" for c, a in (("frame", "getframes"), ("clip", "getclip"), ("audio", "getaudio"), ("answer", "answer"))}
_EVAL_VALUES = ["total_reward", "steps", "duration", "attempts", *_EVAL]
_EVAL_FIELDS = ("question_type", "run_id")
_EVAL_METRICS = "count(*) AS num_samples, count(*) FILTER (status = 'ok') AS num_success, count(*) FILTER (status <> 'ok') AS num_error, " + _sel(
    {"success_rate": _S("status = 'ok'"), "accuracy": "coalesce(count(*) FILTER (status = 'ok' AND win) / nullif(count(*) FILTER (status = 'ok'), 0), 0)", **{f"avg_{v}": f"coalesce(avg(coalesce({v}, 0)) FILTER (status = 'ok'), 0)" for v in _EVAL_VALUES}}).replace(", 6) AS", ", 9) AS")


@query("eval_breakdown", f"WITH {_EP}, {STEPS_SQL}, v AS (SELECT traj_id, " + ", ".join(f"{x} AS {n}" for n, x in _EVAL.items()) + f" FROM st GROUP BY 1), r AS (SELECT ep.*, v.* EXCLUDE traj_id, CASE WHEN lower(trim(done)) = 'true' THEN 'ok' ELSE 'error' END AS status FROM ep LEFT JOIN v USING (traj_id)) " + " UNION ALL ".join(
    f"SELECT '{f}' AS field, coalesce(nullif(trim(CAST({f} AS VARCHAR)), ''), 'UNKNOWN') AS value, {_EVAL_METRICS} FROM r GROUP BY 2" for f in _EVAL_FIELDS))
def eval_breakdown(spark, d):
    status = F.when(F.lower(F.trim("done")) == "true", "ok").otherwise("error")
    r = episodes(spark, d).join(R.episode_values(steps(spark, d)), "traj_id", "left").withColumn("status", status)
    out = R.eval_breakdown(r, list(_EVAL_FIELDS), _EVAL_VALUES, correct="win")
    whole = ("field", "value", "num_samples", "num_success", "num_error")
    return out.select(*[c if c in whole else F.round(F.col(c).cast("double"), 9).alias(c) for c in out.columns])


@query("success_by_type", f"WITH {TRAJ_SQL} SELECT 'ALL' AS question_type, round({_S('won')}, 6) AS success, round(avg(reward), 6) AS reward, count(*) AS n FROM tr UNION ALL SELECT coalesce(nullif(question_type, ''), 'UNKNOWN'), round({_S('won')}, 6), round(avg(reward), 6), count(*) FROM tr GROUP BY 1")
def success_by_type(spark, d):
    return _round(R.success_by_type(steps(spark, d)), "question_type", "n")


@query("episode_extent", f"WITH {TRAJ_SQL} SELECT traj_id, cur_step, " + _sel({f"{a}_{n}": f"(SELECT {f}({c}) FROM tr)" for a, c in (("reward", "reward"), ("length", "n_rows")) for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))}) + " FROM st")
def episode_extent(spark, d):
    return _round(R.episode_extent(steps(spark, d)), "traj_id", "cur_step")


@query("action_metrics", f"WITH {TRAJ_SQL} SELECT " + _sel({"error_ratio": _S("coalesce(error_code, '') <> ''"), "valid_ratio": _S("coalesce(valid, true)"), "wall_p95": "quantile_cont(step_wall_seconds, 0.95)", "wall_mean": "avg(step_wall_seconds)", "final_valid_ratio": f"(SELECT {_S('valid_last')} FROM tr)"}) + " FROM st")
def action_metrics(spark, d):
    return _round(R.action_metrics(steps(spark, d)))


@query("percentile_variants", "WITH x AS (SELECT o_custkey AS k, list(o_totalprice ORDER BY o_totalprice) AS v FROM orders GROUP BY 1), y AS (SELECT *, len(v) AS n, greatest(1, least(len(v) - 1, CAST(floor((len(v) + 1) * 9 / 10) AS INT))) AS j FROM x) SELECT k, round(v[1 + CAST(round_even(0.9 * (n - 1), 0) AS INT)], 4) AS nearest, round(CASE WHEN n = 1 THEN v[1] ELSE (v[j] * (10 - ((n + 1) * 9 - j * 10)) + v[j + 1] * ((n + 1) * 9 - j * 10)) / 10 END, 4) AS exclusive, round((SELECT quantile_cont(o_totalprice, 0.9) FROM orders WHERE o_custkey = k), 4) AS linear FROM y")
def percentiles(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"))
    c = F.col("o_totalprice")
    return o.agg(F.round(R.nearest_rank(c, 0.9), 4).alias("nearest"), F.round(R.exclusive_quantile(c, 9, 10), 4).alias("exclusive"), F.round(F.percentile(c, F.lit(0.9)), 4).alias("linear"))
