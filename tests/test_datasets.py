import time

import pytest
from pyspark.sql import functions as F

from tracewright.functions import plugins as G
from tracewright.operators import datasets as D


def test_completion_rows(spark):
    df = spark.createDataFrame([(1, "Cook", "He [x] stirs", "THEN eats", ["a [title] b", "c"], "1"), (2, "y", "a", "b", ["c"], "")], "row_id long, activity_label string, ctx_a string, ctx_b string, endings array<string>, label string")
    got = D.completion_choice(df).collect()
    assert len(got) == 1 and got[0]["prompt"][0]["content"] == "Cook: He stirs Then eats" and got[0]["choices"] == ["a. b", "c"] and got[0]["ground_truth"] == 1


def test_search_rows_and_tools(spark):
    df = spark.createDataFrame([("q", "nq", (["a"],), ["b"]), (None, None, None, ["b"])], "question string, data_source string, reward_model struct<ground_truth: array<string>>, golden_answers array<string>")
    got = D.search_row(df, "sys", "Ask: \n", "train").collect()
    assert [r["data_source"] for r in got] == ["searchR1_nq", "searchR1_"] and [r["ground_truth"] for r in got] == [["a"], ["b"]] and got[0]["prompt"][1]["content"] == "Ask: q"
    base = spark.createDataFrame([(("train", 1), "42", "q")], "extra_info struct<split: string, index: int>, a string, q string")
    info = D.with_tools(base, "calc", F.col("a"), F.col("q")).first()["extra_info"]
    assert info["need_tools_kwargs"] and info["tools_kwargs"]["calc"]["create_kwargs"]["ground_truth"] == "42" and info["index"] == 1
    img = D.with_images(spark.createDataFrame([(["a"],), (None,)], "images array<string>"), "images").collect()
    assert bytes(img[0]["images"][0]["bytes"]) == b"a" and img[1]["images"] == []


def test_token_rows(spark):
    df = spark.sql("SELECT array(1, 2) AS p, array(3, 4) AS r, array(5) AS x")
    got = df.select(D.sft_row(F.col("p"), F.col("r"), 6, 0).alias("s"), D.reward_pair(F.col("p"), F.col("r"), F.col("x"), 4, 9).alias("w")).first()
    assert got["s"]["ids"] == [1, 2, 3, 4, 0, 0] and got["s"]["attention"] == [1, 1, 1, 1, 0, 0] and got["s"]["loss"] == [0, 1, 1, 0, 0, 0] and got["s"]["position"] == [0, 1, 2, 3, 0, 0]
    assert got["w"] == [[1, 2, 3, 4], [1, 2, 5, 9]]


def test_memory(spark):
    chat = [("user", [("text", "Frames 1s-2s"), ("text", "Frame 1.5s:"), ("image", None)]), ("assistant", [("text", "ok")]), ("user", [("text", "Audio"), ("audio", None)]), ("user", [("image", None)])]
    df = spark.createDataFrame([(chat,)], "h array<struct<role: string, content: array<struct<type: string, text: string>>>>")
    one = df.select(D.keep_recent_media(F.col("h"), 1).alias("x")).first()["x"]
    assert [len(m["content"]) for m in one] == [1, 1, 1, 1]
    assert one[0]["content"][0]["text"] == "Frames 1s-2s Timestamps: [1.50s] [MEDIA OMITTED - Refer to your Observation]" and one[2]["content"][0]["text"].startswith("Audio [MEDIA") and one[3]["content"][0]["type"] == "image"
    assert df.select(D.without_media(F.col("h")).alias("x")).first()["x"][0]["content"] == "Frames 1s-2s\nFrame 1.5s:"


def test_pass_rate_propagates(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, -4), ("a", 2, 1), ("b", 0, 1), ("b", 1, 0), ("c", 0, -3)], "k string, c int, s int")
    assert {r["k"]: r["pass_rate"] for r in D.pass_rate(df, "k", "c", "s").collect()} == {"a": pytest.approx(1 / 3), "b": 0.5, "c": 0.0}


def test_plugins(spark, tmp_path):
    f = tmp_path / "score.py"
    f.write_text("def s(a, b, bonus=0):\n    if a == 'bad':\n        raise ValueError\n    return {'score': float(a == b) + bonus}\ndef t(a, b):\n    return (0.25, 'x')\n")
    df = spark.createDataFrame([("x", "x"), ("x", "y"), ("bad", "y")], "a string, b string")
    assert [r[0] for r in df.select(G.score_udf(G.load_function(str(f), "s", bonus=1))("a", "b")).collect()] == [2.0, 1.0, 0.0]
    assert G.load_function(str(f), "t")(1, 2) == (0.25, "x")
    with pytest.raises(AttributeError):
        G.load_function(str(f), "nope")
    assert G.timed(0.1, "late")(lambda: time.sleep(2))() == "late" and G.timed(1)(lambda: 5)() == 5
