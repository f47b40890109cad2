"""Queries of the scoring and text functions on answers, questions and texts of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import parsing as P
from tracewright.functions import scoring as S
from tracewright.plans.registry import query
from tracewright.plans.report_queries import STEPS_SQL, steps
from tracewright.plans.views import r6
from tracewright.session import table

_GSM = "WITH g AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CASE WHEN l_returnflag = 'A' THEN 'so the total is #### ' || CAST(l_quantity AS INT) || ',000' WHEN l_returnflag = 'N' THEN 'it is ' || CAST(l_quantity AS INT) || ' .' ELSE 'none' END AS t, CAST(CAST(l_quantity AS INT) AS VARCHAR) || '000' AS truth FROM lineitem)"


def _gsm(spark, d):
    q = F.col("l_quantity").cast("int").cast("string")
    t = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("so the total is #### "), q, F.lit(",000"))).when(F.col("l_returnflag") == "N", F.concat(F.lit("it is "), q, F.lit(" ."))).otherwise("none")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), t.alias("t"), F.concat(q, F.lit("000")).alias("truth"))


@query("gsm8k_score", f"{_GSM}, a AS (SELECT *, replace(nullif(regexp_extract(t, '#### (-?[0-9.,]+)', 1), ''), ',', '') AS s FROM g) SELECT k, n, p, s AS answer, CASE WHEN s IS NULL THEN 0.0 WHEN s = truth THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM a")
def gsm8k(spark, d):
    return _gsm(spark, d).select("k", "n", "p", S.gsm8k_answer(F.col("t")).alias("answer"), S.gsm8k_score(F.col("t"), F.col("truth")).alias("score"))


@query("gsm8k_flexible", f"{_GSM} SELECT k, n, p, coalesce([x FOR x IN regexp_extract_all(t, '-?[0-9.,]+') IF x NOT IN ('', '.')][-1], regexp_extract_all(t, '-?[0-9.,]+')[1]) AS answer FROM g")
def gsm8k_flexible(spark, d):
    return _gsm(spark, d).select("k", "n", "p", S.gsm8k_answer(F.col("t"), flexible=True).alias("answer"))


# words are letters, digits and _ of any script, white space is of any kind; two passes, since neighbouring articles share a separator
_PLAIN = r"' ' || regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g') || ' '"
_ARTICLE = r"regexp_replace({0}, '([^\p{{L}}\p{{N}}_])(?:a|an|the)([^\p{{L}}\p{{N}}_])', '\1 \2', 'g')"
_NORM = (r"trim(regexp_replace({0}, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))".format(_ARTICLE.format(_ARTICLE.format(_PLAIN.format("question")))))


@query("qa_normal", f"SELECT eval_id, {_NORM} AS norm FROM example_eval WHERE question IS NOT NULL")
def qa_normal(spark, d):
    return table(spark, d, "example_eval").where("question IS NOT NULL").select("eval_id", S.qa_normal(F.col("question")).alias("norm"))


_TAG = "WITH t AS (SELECT p_partkey AS k, '<answer>none</answer> then <answer> The ' || p_name || '. </answer>' AS s, ['a ' || p_name, p_brand] AS g FROM part)"


def _tags(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("<answer>none</answer> then <answer> The "), "p_name", F.lit(". </answer>")).alias("s"), F.array(F.concat(F.lit("a "), "p_name"), "p_brand").alias("g"), "p_size", "p_name")


@query("qa_em", f"{_TAG} SELECT k, 1.0::DOUBLE AS score FROM t")
def qa_em(spark, d):
    return _tags(spark, d).select("k", S.qa_em_score(F.col("s"), F.col("g")).alias("score"))


@query("qa_subem", "SELECT p_partkey AS k, CASE WHEN contains(p_name, split_part(p_name, ' ', 2)) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM part")
def qa_subem(spark, d):
    return _tags(spark, d).select("k", S.qa_sub_em_score(F.col("s"), F.array(F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("score"))


@query("mcq_score", "SELECT row_id, CASE WHEN coalesce(answer, '') = '' THEN 0.0 WHEN upper(trim('b')) = upper(trim(substr(answer, 1, 1))) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM example_train_rl")
def mcq(spark, d):
    return table(spark, d, "example_train_rl").select("row_id", S.mcq_score(F.lit(" b "), F.col("answer")).alias("score"))


_ANS = "TRY_CAST(nullif(regexp_extract(answer, '([+-]?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE)"


@query("num_score", f"SELECT row_id, CASE WHEN round_even({_ANS}, 2) = round_even(TRY_CAST(duration_seconds AS DOUBLE), 2) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM example_train_rl")
def num(spark, d):
    return table(spark, d, "example_train_rl").select("row_id", S.num_score(F.col("duration_seconds").cast("string"), F.col("answer")).alias("score"))


@query("mra", "WITH x AS (SELECT o_orderkey AS k, (o_totalprice / 100003.7)::FLOAT AS p, ((o_custkey % 50) / 10.0 + 0.3)::FLOAT AS t FROM orders), e AS (SELECT k, (abs(p - t) / (abs(t) + 1e-8::FLOAT))::FLOAT AS r FROM x) SELECT k, list_sum([CASE WHEN r < (1::FLOAT - (0.5 + 0.05 * i)::FLOAT)::FLOAT THEN 1.0 ELSE 0.0 END FOR i IN range(10)])::DOUBLE / 10 AS score FROM e")
def mra(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("k"), S.mean_relative_accuracy(F.col("o_totalprice") / 100003.7, (F.col("o_custkey") % 50) / 10.0 + 0.3).alias("score"))


_SPANS = r"""WITH a AS (SELECT row_id, answer FROM example_train_rl WHERE answer IS NOT NULL AND json_valid(answer)),
 f AS (SELECT row_id, CASE WHEN regexp_matches(answer, '^\s*\[\s*\]\s*$') THEN 'none' WHEN regexp_matches(answer, '^\s*\[\s*\{') THEN 'objects' WHEN regexp_matches(answer, '^\s*\[\s*\[') THEN 'pairs' WHEN regexp_matches(answer, '^\s*\[\s*[-0-9]') THEN 'flat' END AS form, answer FROM a),
 p AS (SELECT row_id, form, CASE form WHEN 'none' THEN []::DOUBLE[][] WHEN 'pairs' THEN json_transform(CASE WHEN form = 'pairs' THEN answer END, '[["DOUBLE"]]') WHEN 'flat' THEN [json_transform(CASE WHEN form = 'flat' THEN answer END, '["DOUBLE"]')]
  WHEN 'objects' THEN [[o.start, o."end"] FOR o IN json_transform(CASE WHEN form = 'objects' THEN answer END, '[{"start": "DOUBLE", "end": "DOUBLE"}]')] END AS s FROM f WHERE form IS NOT NULL)
 SELECT row_id, len(s) AS n, round(coalesce(list_sum([x[2] - x[1] FOR x IN s]), 0), 6) AS seconds FROM p WHERE s IS NOT NULL AND len([x FOR x IN s IF len(x) <> 2 OR x[1] IS NULL OR x[2] IS NULL]) = 0"""


@query("span_parse", _SPANS)
def span_parse(spark, d):
    t = table(spark, d, "example_train_rl").select("row_id", S.parse_spans(F.col("answer")).alias("s")).where("s IS NOT NULL")
    return t.select("row_id", F.size("s").cast("long").alias("n"), r6(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["e"] - x["s"]), "seconds"))


@query("span_iou", "WITH o AS (SELECT o_orderkey AS k, (o_custkey % 40)::DOUBLE AS a, (o_custkey % 40 + 10)::DOUBLE AS b, (o_orderkey % 50)::DOUBLE AS c, (o_orderkey % 50 + 15)::DOUBLE AS d FROM orders), i AS (SELECT *, greatest(0, least(b, d) - greatest(a, c)) AS x FROM o) SELECT k, round(x / (25 - x + 1e-12), 6) AS iou FROM i")
def span_iou(spark, d):
    from tracewright.operators.scan import span_iou as iou

    s = lambda a, b: F.struct(a.cast("double").alias("s"), b.cast("double").alias("e"))
    c, k = F.col("o_custkey") % 40, F.col("o_orderkey") % 50
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), r6(iou(F.array(s(c, c + 5), s(c + 3, c + 10)), F.array(s(k + 5, k + 15), s(k, k + 5))), "iou"))


@query("frame_times", "SELECT o_orderkey AS k, [round(i * 12.5 / greatest(n - 1, 1), 6) FOR i IN range(n)] AS times FROM (SELECT o_orderkey, 1 + o_orderkey % 6 AS n FROM orders)")
def frame_times(spark, d):
    n = (1 + F.col("o_orderkey") % 6).cast("int")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.transform(S.frame_times(F.lit(0.0), F.lit(12.5), n), lambda x: F.round(x, 6)).alias("times"))


@query("limits_and_penalties", "SELECT row_id, least(6 + floor(duration_seconds / 60), 12)::INT AS step_limit, round(2.01375 * exp(-0.007 * greatest(duration_seconds + 1, 100)), 6) AS bonus, round(least(-(duration_seconds - 200) / 100, 0), 6) AS penalty FROM example_train_rl WHERE duration_seconds IS NOT NULL")
def limits(spark, d):
    t = table(spark, d, "example_train_rl").where("duration_seconds IS NOT NULL")
    c = F.col("duration_seconds")
    return t.select("row_id", S.step_limit(c, 6, 60.0, 12).alias("step_limit"), r6(S.length_bonus(c), "bonus"), r6(S.overlong_penalty(c, 300, 100), "penalty"))


@query("type_prefix", "SELECT row_id, upper(split_part(question_type, '_', 1)) AS t FROM example_train_rl WHERE question_type IS NOT NULL")
def type_prefix(spark, d):
    return table(spark, d, "example_train_rl").where("question_type IS NOT NULL").select("row_id", S.type_prefix(F.col("question_type")).alias("t"))


@query("question_ids", "SELECT eval_id, CASE WHEN coalesce(video, '') = '' THEN '' WHEN coalesce(question, '') <> '' THEN video || '||' || question ELSE video END AS qid, md5(coalesce(video, 'None') || '_' || coalesce(question, 'None')) AS resume_key FROM example_eval")
def question_ids(spark, d):
    return table(spark, d, "example_eval").select("eval_id", S.question_id(F.lit(None), F.col("video"), F.col("question")).alias("qid"), S.resume_key(F.col("video"), F.col("question")).alias("resume_key"))


@query("chat_transcript", "SELECT row_id, array_to_string([ '[' || upper(m.role) || ']: ' || coalesce(m.content, '') FOR m IN prompt], chr(10)) AS t FROM example_train_rl WHERE prompt IS NOT NULL")
def chat_transcript(spark, d):
    return table(spark, d, "example_train_rl").where("prompt IS NOT NULL").select("row_id", S.transcript(F.col("prompt")).alias("t"))


@query("eos_masks", "WITH e AS (SELECT vec_id, [CAST(floor(abs(x) * 40) AS INT) FOR x IN embedding] AS v FROM embeddings), p AS (SELECT vec_id, v, list_position([x IN (7, 9) FOR x IN v], true) AS p FROM e) SELECT vec_id, [CASE WHEN coalesce(p, 0) = 0 OR i + 1 <= p THEN 1 ELSE 0 END FOR i IN range(len(v))] AS mask FROM p")
def eos_masks(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x) * 40).cast("int")).alias("v"))
    return e.select("vec_id", S.eos_mask(F.col("v"), [7, 9]).alias("mask"))


@query("range_errors", f"WITH {STEPS_SQL}, s AS (SELECT traj_id, cur_step, action_type, cur_step * 40.0 - 10 AS a, cur_step * 45.0 + 5 AS b, cur_step + 3 AS n, duration FROM st WHERE action_type IN ('get_frames', 'get_clip', 'get_audio') AND duration IS NOT NULL) SELECT traj_id, cur_step, CASE action_type WHEN 'get_frames' THEN CASE WHEN a < 0 OR b > duration THEN 'FRAME_TS_OOB' WHEN b < a THEN 'CLIP_NEG_LEN' WHEN n > 16 THEN 'TOO_MANY_FRAMES' WHEN n < 1 THEN 'INVALID_FRAME_NUM' END WHEN 'get_audio' THEN CASE WHEN a < 0 OR b > duration THEN 'AUDIO_RANGE' WHEN b - a <= 0 THEN 'CLIP_NEG_LEN' WHEN b - a < 20 THEN 'AUDIO_TOO_SHORT' WHEN b - a > 60 THEN 'AUDIO_TOO_LONG' END ELSE CASE WHEN a < 0 OR b > duration THEN 'CLIP_RANGE' WHEN b <= a THEN 'CLIP_NEG_LEN' WHEN b - a > 60 THEN 'CLIP_TOO_LONG' END END AS code FROM s")
def range_errors(spark, d):
    s = steps(spark, d).where(F.col("action_type").isin("get_frames", "get_clip", "get_audio") & F.col("duration").isNotNull())
    a, b = F.col("cur_step") * 40.0 - 10, F.col("cur_step") * 45.0 + 5
    return s.select("traj_id", "cur_step", S.range_error(F.col("action_type"), a, b, F.col("cur_step") + 3, F.col("duration"), F.lit(True), F.lit(25.0), 16, 20.0, 60.0, 60.0).alias("code"))


@query("gsm8k_map", "SELECT n_nationkey AS k, 'openai/gsm8k' AS data_source, 'What is ' || n_name || '? Think.' AS content, n_nationkey::VARCHAR AS ground_truth, 'train' AS split FROM nation")
def gsm8k_map(spark, d):
    from tracewright.operators.etl import prompt_row

    n = table(spark, d, "nation")
    rows = prompt_row(n, "openai/gsm8k", F.concat(F.lit("What is "), "n_name", F.lit("?")), " Think.", F.col("n_nationkey").cast("string"), "train", "n_nationkey")
    return rows.select(F.col("extra_info.index").alias("k"), "data_source", F.get("prompt", F.lit(0))["content"].alias("content"), F.col("reward_model.ground_truth").alias("ground_truth"), F.col("extra_info.split").alias("split"))


@query("score_dispatch", f"{_GSM} SELECT k, n, p, CASE WHEN regexp_extract(t, '#### (-?[0-9.,]+)', 1) = '' THEN 0.0 WHEN replace(regexp_extract(t, '#### (-?[0-9.,]+)', 1), ',', '') = truth THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM g")
def score_dispatch(spark, d):
    return _gsm(spark, d).select("k", "n", "p", S.dispatch(F.lit("openai/gsm8k"), F.col("t"), F.col("truth")).alias("score"))


@query("place_reward", "WITH t AS (SELECT l_orderkey AS k, list(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS m FROM lineitem GROUP BY 1), p AS (SELECT k, m, list_max([CASE WHEN m[i] = 1 THEN i ELSE 0 END FOR i IN range(1, len(m) + 1)]) AS p FROM t) SELECT k, p AS last_valid, CASE WHEN p > 0 THEN 0.75 ELSE 0 END::DOUBLE AS total FROM p")
def place_reward(spark, d):
    from tracewright.operators.scan import to_arrays
    from tracewright.plans.views import tokens

    a = to_arrays(tokens(spark, d), "row_id", "pos", ["mask"]).select(F.col("row_id").alias("k"), S.place_at_last(F.lit(0.75), F.col("mask")).alias("r"))
    return a.select("k", F.array_position("r", 0.75).alias("last_valid"), F.aggregate("r", F.lit(0.0), lambda x, y: x + y).alias("total"))


@query("action_parse")
def action_parse(spark, d):
    return steps(spark, d).select("traj_id", "cur_step", P.parse_action_strict(F.col("output")).alias("a")).select("traj_id", "cur_step", "a.*")


@query("action_parse_lenient")
def action_parse_lenient(spark, d):
    a = steps(spark, d).select(P.parse_action_lenient(F.col("output")).alias("a"))
    return a.groupBy("a.type", "a.label").agg(F.count(F.lit(1)).alias("n"))


@query("json_clean")
def json_clean(spark, d):
    return steps(spark, d).select("traj_id", "cur_step", P.clean_json(F.col("output")).alias("json"))


_BOX = """WITH b AS (SELECT l_orderkey AS k, l_linenumber, l_partkey, CAST(l_quantity AS INT) AS q, CAST(l_quantity AS INT) + CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END AS t FROM lineitem),
 x AS (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'thus \\boxed{\\frac{' || q || '}{4}}' WHEN 1 THEN 'so \\boxed{x=' || q || '\\%}' ELSE 'Answer: $' || q || '$ dollars' END AS text, CASE WHEN l_linenumber % 3 = 0 THEN t || '/4' ELSE t::VARCHAR END AS truth FROM b)"""


def _boxed(spark, d):
    """Answers in boxes and on answer lines; the truth of every fourth part is another number."""
    n = F.col("l_quantity").cast("int")
    q, t = n.cast("string"), (n + F.when(F.col("l_partkey") % 4 == 0, 1).otherwise(0)).cast("string")
    form = F.col("l_linenumber") % 3
    text = F.when(form == 0, F.concat(F.lit("thus \\boxed{\\frac{"), q, F.lit("}{4}}"))).when(form == 1, F.concat(F.lit("so \\boxed{x="), q, F.lit("\\%}"))).otherwise(F.concat(F.lit("Answer: $"), q, F.lit("$ dollars")))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", text.alias("text"), F.when(form == 0, F.concat(t, F.lit("/4"))).otherwise(t).alias("truth"), q.alias("q"), t.alias("t"), form.alias("form"))


_INNER = r"regexp_replace(regexp_replace(replace(regexp_extract(text, '\\boxed\{(.*)\}$', 1), '\%', ''), '^[a-z]=', ''), '\\frac\{(\d+)\}\{(\d+)\}', '\1/\2')"


@query("math_equiv", f"{_BOX} SELECT k, l_linenumber, l_partkey, CASE WHEN {_INNER} <> '' AND {_INNER} = truth THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM x")
def math_equiv(spark, d):
    return _boxed(spark, d).select("k", "l_linenumber", "l_partkey", P.math_score_udf("text", "truth").alias("score"))


@query("dapo_score", f"{_BOX}, p AS (SELECT *, regexp_extract(text, 'Answer:\\s*\\$(\\d+)\\$', 1) = truth AS acc FROM x) SELECT k, l_linenumber, l_partkey, CASE WHEN acc THEN 1.0 ELSE -1.0 END::DOUBLE AS score, acc FROM p")
def dapo(spark, d):
    return _boxed(spark, d).select("k", "l_linenumber", "l_partkey", P.dapo_score_udf("text", "truth").alias("r")).select("k", "l_linenumber", "l_partkey", "r.score", "r.acc")


@query("answers_equal", f"""{_BOX}, y AS (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN CASE WHEN l_partkey % 4 = 1 THEN '\\frac{{' || 2 * q || '}}{{8}}' ELSE ' \\frac{{' || q || '}}{{4}}.' END WHEN 1 THEN q || '.0' ELSE '(' || q || ', 3)' END AS given,
 CASE WHEN l_linenumber % 3 = 2 THEN '(' || t || ',3)' ELSE truth END AS want FROM x)
 SELECT k, l_linenumber, l_partkey, [z::DOUBLE FOR z IN regexp_extract_all(given, '\\d+(?:\\.\\d+)?')] = [z::DOUBLE FOR z IN regexp_extract_all(want, '\\d+(?:\\.\\d+)?')] AS same FROM y""")
def answers_equal(spark, d):
    b = _boxed(spark, d)
    double = (F.col("q").cast("int") * 2).cast("string")
    frac = F.when(F.col("l_partkey") % 4 == 1, F.concat(F.lit("\\frac{"), double, F.lit("}{8}"))).otherwise(F.concat(F.lit(" \\frac{"), "q", F.lit("}{4}.")))
    given = F.when(F.col("form") == 0, frac).when(F.col("form") == 1, F.concat("q", F.lit(".0"))).otherwise(F.concat(F.lit("("), "q", F.lit(", 3)")))
    want = F.when(F.col("form") == 2, F.concat(F.lit("("), "t", F.lit(",3)"))).otherwise(F.col("truth"))
    return b.select("k", "l_linenumber", "l_partkey", P.answers_equal_udf(given, want).alias("same"))
