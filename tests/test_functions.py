import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewright.functions import parsing as P
from tracewright.functions import scoring as S


def one(spark, col, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("x")).first()[0]


def test_gsm8k(spark):
    a = lambda t, flex=False: one(spark, S.gsm8k_answer(F.col("t"), flex), t=t)
    assert a("so #### 1,234") == "1234" and a("#### -5") == "-5" and a("none") is None and a(None) is None
    assert a("is 7 .", True) == "7" and a("is .", True) == "." and a("", True) is None


def test_qa(spark):
    assert one(spark, S.qa_normal(F.col("t")), t="The  cat, an Owl!") == "cat owl"
    em = lambda t: one(spark, S.qa_em_score(F.col("t"), F.array(F.lit("a cat"))), t=t)
    assert em("<answer>dog</answer> <answer> The Cat. </answer>") == 1.0 and em("cat") == 0.0 and em(None) == 0.0
    assert em("<answer>cat</answer>" * 11) == 0.25
    assert one(spark, S.qa_sub_em_score(F.col("t"), F.array(F.lit("cat"))), t="<answer>cats</answer>") == 1.0


def test_math():
    eq = P.math_equal
    assert eq("\\frac12", "\\frac{1}{2}") and eq("0.5", "1/2") and eq("\\sqrt3", "\\sqrt{3}") and eq("x=5", "5") and eq("5\\text{ cm}", "5") and not eq("6", "5")
    assert P.math_score("so \\boxed{\\frac{a}{b}} ok", "\\frac{a}{b}") == 1.0 and P.math_score("none", "1") == 0.0 and P.math_score(None, "1") == 0.0
    assert P.last_boxed("\\boxed{a{b}c}") == "a{b}c" and P.last_boxed("\\boxed{a") is None


def test_dapo():
    assert P.dapo_score("x\nAnswer: 42", "42")[:2] == (1.0, True)
    assert P.dapo_score("Answer: 42" + "x" * 400, "42")[0] == -1.0
    assert P.dapo_score("Answer: $1,234$ dollars", "1234")[0] == 1.0
    assert P.dapo_score("\\boxed{7}", "7", strict_box=True)[0] == 1.0 and P.dapo_score(None, "7")[0] == -1.0


def test_answers_equal():
    same = P.answers_equal
    assert same("1,000", "1000") and same("50\\%", "0.5") and same("(1, 2)", "(1,2.0)") and same("1/2", "0.5") and not same("(1,2)", "[1,2]") and not same(None, "1")


ACTION = {"observation": "o", "think": "t", "action": {"type": "get_frames", "start": 1, "end": 2, "num": 3}}


@pytest.mark.parametrize(
    ("raw", "code"),
    [
        (json.dumps(ACTION), None), (None, "INVALID_JSON"), ("", "INVALID_JSON"), ("```json\n{}\n```", "INVALID_JSON"), ("{", "INVALID_JSON"), (json.dumps(ACTION) + " {}", "TRAILING_GARBAGE"),
        (json.dumps(ACTION | {"x": 1}), "INVALID_JSON"), (json.dumps({k: v for k, v in ACTION.items() if k != "think"}), "INVALID_JSON"), (json.dumps(ACTION | {"action": {"type": "fly"}}), "UNKNOWN_ACTION_TYPE"),
        (json.dumps(ACTION | {"action": {"type": "get_clip"}}), "CLIP_ARG_TYPE"), (json.dumps(ACTION | {"action": {"type": "get_audio", "start": "1", "end": 2}}), "AUDIO_ARG_TYPE"),
        (json.dumps(ACTION | {"action": {"type": "answer", "content": 1}}), "ANSWER_NOT_STRING"), (json.dumps(ACTION | {"confidence": "high"}), "INVALID_JSON"),
    ],
)
def test_strict_action(raw, code):
    assert P.strict_action(raw)[1] == code


def test_lenient_action():
    labels = [P.lenient_action(x)[1] for x in (None, "none", "{ {", '{"a": 1}', "{'a'}", "```json\n" + json.dumps(ACTION) + "\n```", json.dumps(ACTION) + " tail")]
    assert labels == ["no_output", "no_brace", "unbalanced_braces", "not_action_dict", "json_decode_err", "", ""]
    assert P.cleaned_json("x ```json {\"a\": 1} ```") == '{"a": 1}' and P.cleaned_json("no") is None
    assert P.fenced_code("```python\nx = 1\n``` and ```\ny\n```") == "x = 1" and P.fenced_code(None) is None


def test_scores(spark):
    assert one(spark, S.mcq_score(F.col("a"), F.col("b")), a=" c", b="C. x") == 1.0 and one(spark, S.mcq_score(F.col("a"), F.col("b")), a="c", b=None) == 0.0
    mra = lambda p, t: one(spark, S.mean_relative_accuracy(F.col("p"), F.col("t")), p=p, t=t)
    assert mra(2.0, 2.0) == 1.0 and mra(3.0, 2.0) == pytest.approx(0.0) and mra(2.4, 2.0) == pytest.approx(0.6)
    assert one(spark, S.num_score(F.col("a"), F.col("b")), a="is 2.50 m", b="2.5") == 1.0
    assert one(spark, S.judge_score(F.col("a")), a='{"score": 0.7}') == 0.7 and one(spark, S.judge_score(F.col("a")), a="x" * 1000 + "score: 1") == 0.0


def test_texts(spark):
    assert one(spark, S.url_to_oss(F.col("a")), a="https://b.oss-cn-x.aliyuncs.com/k/v.mp4?e=1") == "oss://b/k/v.mp4"
    assert one(spark, S.local_media_path(F.col("a"), "/m/"), a="see oss://b/agentic_tmp/x y") == "/m/agentic_tmp/x"
    assert one(spark, S.single_frame_text(F.col("a")), a="Frames 1-2 (num=1) Frames 1-2 (num=3)") == "Frame 1-2 (num=1) Frames 1-2 (num=3)"
    assert one(spark, S.capitalize(F.col("a")), a="hELLO World") == "Hello world"
    parts = one(spark, S.media_split(F.col("a")), a="see <image> and <video>")
    assert [tuple(p) for p in parts] == [("text", "see "), ("image", None), ("text", " and "), ("video", None)]


def test_arrays(spark):
    df = spark.sql("SELECT array(1, 2, 9, 4) AS a, array(1, 0, 1, 0) AS m, CAST(array() AS ARRAY<INT>) AS e")
    r = df.select(S.eos_mask(F.col("a"), [9]).alias("eos"), S.pad_to(F.col("a"), 6, F.lit(0)).alias("pad"), S.truncate(F.col("a"), 2, "left").alias("cut"), S.place_at_last(F.lit(0.5), F.col("m")).alias("at"), S.place_at_last(F.lit(0.5), F.col("e")).alias("none"), S.sft_loss_mask(F.col("a"), F.col("m")).alias("sft")).first()
    assert r["eos"] == [1, 1, 1, 0] and r["pad"] == [1, 2, 9, 4, 0, 0] and r["cut"] == [9, 4] and r["at"] == [0, 0, 0.5, 0] and r["none"] == []
    assert r["sft"] == [0, 0, 0, 1, 1, 1, 1, 0]
    with pytest.raises((PySparkException, Py4JJavaError)):
        df.select(S.truncate(F.col("a"), 2, "error")).collect()


def test_dispatch(spark):
    df = spark.createDataFrame([("mcq", "a", "A"), ("num", "1", "1.0")], "s string, t string, g string")
    assert [r[0] for r in df.select(S.dispatch(F.col("s"), F.col("t"), F.col("g"))).collect()] == [1.0, 1.0]
    with pytest.raises((PySparkException, Py4JJavaError)):
        df.select(S.dispatch(F.lit("nope"), F.col("t"), F.col("g"))).collect()


def test_small_functions(spark):
    df = spark.sql(
        "SELECT array(named_struct('title', 'T', 'text', 'x')) AS d, array(named_struct('role', 'assistant', 'n_tokens', 2), named_struct('role', 'user', 'n_tokens', 1)) AS m,"
        " array(named_struct('role', 'user', 'content', '[NOTICE] old'), named_struct('role', 'user', 'content', 'hi')) AS c, array(1, 1, 0) AS a, 'multiple-choice' AS t"
    )
    r = df.select(
        S.retrieval_text(F.col("d")).alias("doc"), S.assistant_mask(F.col("m")).alias("mask"), S.with_notice(F.col("c"), F.lit("new")).alias("n"), S.tail_mask(F.col("a"), 2).alias("tail"), S.question_type_alias(F.col("t")).alias("t"),
        S.frame_count(F.lit(100.0), 2.0, 4, 768).alias("frames"), S.smart_resize(F.lit(480), F.lit(640)).alias("size"), S.flops(F.lit(10.0), F.lit(0.0), 4, 1, 8, 1, 1, 2).alias("flops"),
    ).first()
    assert r["doc"] == "Doc 1 (Title: T) x" and r["mask"] == [1, 1, 0] and [m["content"] for m in r["n"]] == ["hi", "[NOTICE] new"] and r["tail"] == [1, 0] and r["t"] == "MCQ"
    assert r["frames"] == 200 and tuple(r["size"]) == (476, 644)
    weights = 4 * (1 + 2) * 4 + 4 * 4 + 3 * 4 * 2 + 2 * 8 * 4
    assert r["flops"] == 6.0 * weights * 10
    assert P.geo_score("<think>x</think> \\boxed{3}", "3") == pytest.approx(1.0) and P.geo_score(None, "3") == 0.0
