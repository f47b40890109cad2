from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracewright.llm.runs import field_runs, step_runs

T0 = datetime(2025, 1, 1)
SCHEMA = "traj_id string, step int, output string, started_at timestamp, ingested_at timestamp, step_wall_seconds double, k string, b int, e string, rn int"


def row(t, s, out, wall=2.0, ing=0):
    return (t, s, out, T0 + timedelta(seconds=10 * (s or 0)), T0 + timedelta(days=1, seconds=ing), wall, "clash", 1, "clash", 1)


def act(**a):
    import json

    return json.dumps({"observation": "x", "action": a})


def runs(spark, rows, block=4096):
    got = step_runs(spark.createDataFrame(rows, SCHEMA), block).where("n > 1").orderBy("traj_id", "first_pos").collect()
    return [(r["traj_id"], r["first_pos"], r["last_pos"], r["n"], r["seconds"]) for r in got]


def test_near_equal_and_gaps(spark):
    rows = [
        row("a", 1, act(type="get_clip", start=1, end=5.0)), row("a", 2, act(type="Get-Clip", start=1.3, end=5.4)), row("a", 4, act(end=5.2, start=1.7, type=" get_clip")),
        row("a", 5, act(type="get_clip", start=2.2, end=5.2)), row("a", 6, act(type="get_frames", start=1, end=2, num=4)), row("a", 7, act(type="get_frames", start=1, end=2, num=5)),
        row("a", 8, act(type="answer", content="(B) Yes")), row("a", 9, "```json\n" + act(type="answer", content="b yes.") + "\n```"),
    ]
    # 1.7 to 2.2 is exactly half a second, which is no longer near
    want = [("a", 1, 4, 3, 32.0), ("a", 8, 9, 2, 12.0)]
    assert runs(spark, rows) == want
    assert runs(spark, rows, block=2) == want and runs(spark, rows, block=1) == want


def test_redelivery_unreadable_null_ties(spark):
    rows = [
        row("a", 1, "no json #1"), row("a", 1, "no json #1", ing=5), row("a", 2, "no  json\n#1"), row("a", 3, None), row("a", 4, None), row("a", 5, ""), row(None, 1, "x"), row("a", None, "x"),
        row("b", 1, '{"action": {"type"'), row("b", 2, "x" * 300_000), row("b", 3, "x" * 300_000, wall=None),
    ]
    assert [r[:4] for r in runs(spark, rows)] == [("a", 1, 2, 2), ("a", 3, 5, 3), ("b", 2, 3, 2)]
    assert runs(spark, rows + rows) == runs(spark, rows)


def test_hot_trajectory_over_blocks(spark):
    rows = [row("hot", i + 1, "same" if i % 100 else f"other {i}") for i in range(1000)] + [row("c", 1, "x")]
    want = runs(spark, rows)
    assert len(want) == 10 and want[0][1:4] == (2, 100, 99)
    assert runs(spark, rows, block=7) == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert step_runs(empty).count() == 0
    assert field_runs(spark.createDataFrame([], "traj_id string, s string"), "traj_id", "s").count() == 0


def test_field_runs(spark):
    rows = [("a", "get_x, Get-X | getX;answer"), ("a", "get_x, Get-X | getX;answer"), ("b", "x -> x > y"), ("c", None), ("d", " , "), ("e", "one"), (None, "x,x")]
    got = field_runs(spark.createDataFrame(rows, "traj_id string, s string"), "traj_id", "s").where("n > 1").orderBy("traj_id").collect()
    assert [tuple(r)[:4] for r in got] == [("a", 1, 3, 3), ("b", 1, 2, 2)]
    long = spark.createDataFrame([("z", "x," * 50_000 + "y")], "traj_id string, s string")
    assert field_runs(long, "traj_id", "s").agg(F.max("n")).first()[0] == 50_000
