import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewright.operators import etl as E
from tracewright.sources import io
from tracewright.streaming import state as K


def test_json_lines(spark, tmp_path):
    f = tmp_path / "run7" / "log_12.jsonl"
    f.parent.mkdir()
    f.write_text('{"traj_id": "a", "v": 1}\n\nnot json\n{"traj_id": "b"} {"x": 1}\n{"v": 3}\n{"traj_id": "", "uid": "c"}\n')
    got = io.read_trajectories(spark, str(f), ("traj_id", "uid")).select("traj_id").collect()
    assert [r[0] for r in got] == ["a", "c"]
    raw = io.read_raw(spark, str(f))
    assert raw.count() == 5 and raw.where("record IS NULL").count() == 2
    assert tuple(raw.select(io.task_and_step(F.col("file")).alias("t")).first()[0]) == ("run7", 12)
    assert io.by_name(raw, include=["other.jsonl"]).count() == 0 and io.by_name(raw, exclude=["other.jsonl"]).count() == 5
    with pytest.raises((PySparkException, Py4JJavaError)):
        io.read_strict(spark, str(f), "traj_id string").collect()


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 2.5)], "k long, s string, x double")
    io.write_jsonl(df, str(tmp_path / "o.jsonl"))
    assert sorted(io.read_strict(spark, str(tmp_path / "o.jsonl"), df.schema).collect()) == sorted(df.collect())
    df.write.parquet(str(tmp_path / "o.parquet"))
    (tmp_path / "arr.json").write_text(json.dumps([{"k": 3, "s": "c"}]))
    both = io.read_any(spark, [str(tmp_path / "o.parquet"), str(tmp_path / "arr.json")])
    assert both.count() == 3
    with pytest.raises(ValueError):
        io.read_any(spark, "x.xml")
    io.append_rollout(df.withColumn("global_step", F.lit(4)), str(tmp_path / "roll"))
    io.append_rollout(df.withColumn("global_step", F.lit(5)), str(tmp_path / "roll"))
    assert spark.read.text(str(tmp_path / "roll")).groupBy("global_step").count().count() == 2
    io.write_csv([df.select("k"), df.select("k", "x")], str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 4


STEPS = [("a", 0, True, 1.0, False), ("a", 1, False, 5.0, False), ("a", 2, True, 2.0, True), ("a", 3, True, 9.0, False), ("b", 0, False, 0.0, False), ("b", 1, False, 0.0, False), ("b", 2, True, 1.0, True)]
SCHEMA = "traj_id string, cur_step long, valid boolean, reward double, answer boolean"


def test_replay(spark):
    got = {r[0]: tuple(r)[1:] for r in K.replay(spark.createDataFrame(STEPS, SCHEMA), 10, 1).collect()}
    assert got == {"a": (3, 3.0, 1, True, "ANSWER"), "b": (2, 0.0, 2, True, "RETRIES_EXCEEDED")}


def test_stream_equals_replay(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, part in enumerate((STEPS[:2] + STEPS[4:5], STEPS[2:4] + STEPS[5:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(src / f"p{i}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = K.stream_states(stream, 10, 1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).where("reason IS NULL OR reason <> 'ENV_ALREADY_DONE'")
    last = {r[0]: tuple(r)[1:] for r in out.groupBy("traj_id").agg(F.max_by(F.struct("cur_step", "reward", "retries", "done", "reason"), "cur_step").alias("r")).select("traj_id", "r.*").collect()}
    assert last == {"a": (3, 3.0, 1, True, "ANSWER"), "b": (2, 0.0, 2, True, "RETRIES_EXCEEDED")}


def test_state_is_ordered_over_arrow_batches_and_cleared():
    """Two Arrow batches of one key whose steps interleave, and the end of a finished trajectory's memory."""
    import pandas as pd

    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

        def clear(self):
            self.v = None

    timers, value = [], Value()
    handle = type("Handle", (), {"getValueState": lambda self, *a: value, "registerTimer": lambda self, t: timers.append(t)})()
    now = type("Now", (), {"getCurrentProcessingTimeInMs": lambda self: 1000})()
    p = K.TrajectoryState(10, 0, keep_done=500)
    p.init(handle)
    step = lambda *rows: pd.DataFrame(rows, columns=["cur_step", "valid", "reward", "answer"])
    got = pd.concat(p.handleInputRows(("t",), iter([step((2, False, 5.0, False), (0, True, 1.0, False)), step((1, None, None, None), (3, True, 9.0, True))]), now))
    assert got["reason"].tolist() == [None, None, "RETRIES_EXCEEDED", "ENV_ALREADY_DONE"] and got["reward"].tolist() == [1.0] * 4
    assert timers == [1500] and value.exists()
    assert list(p.handleExpiredTimer(("t",), now, None)) == [] and not value.exists()


def test_pool_and_quota():
    rounds = K.alive_pool([2, 1, 0], 2)
    assert rounds == [[0, 1], [0]]
    plan = E.quota_plan({"h": 3, "v": 8, "l": 10, "s": 1, "z": 9}, {"m": {"total": 10, "first": {"h": 4, "v": 4}, "fill": ["l", "s"]}, "t": {"total": 4, "fill": ["z"]}})
    assert plan[0] == {"h": 3, "v": 4, "l": 2, "s": 1, "z": 4}
    assert all(sum(b[x] for x in "hvls") == 10 for b in plan[:1])


def test_best_attempt_and_resume(spark):
    a = spark.createDataFrame([("q", 1, False, 0.2), ("q", 2, True, 0.9), ("q", 3, True, 1.0), ("r", 1, False, 0.4), ("r", 2, False, 0.4)], "k string, a long, won boolean, r double")
    got = {r[0]: tuple(r)[1:] for r in E.best_attempt(a, "k", "a", "won", "r").collect()}
    assert got == {"q": (2, 2, True), "r": (1, 2, False)}
    todo = spark.createDataFrame([(1, "x"), (2, None)], "i long, k string")
    assert [r[0] for r in E.resume(todo, spark.createDataFrame([(None,)], "k string"), ["k"]).collect()] == [1]


def test_entry_queries():
    import __spark_entry__ as entry

    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) > 150


def test_messages_and_oversampling(spark):
    t = spark.sql("SELECT array(1, 2) AS m, array(3) AS n, array(0, 0) AS k, array(1) AS k2")
    assert K.append_messages(t, "m", "n", "k", "k2", 2).select("m", "k").first() == ([1, 2], [0, 0])
    batches = lambda: iter([spark.range(i, i + 3).toDF("u") for i in (0, 3, 6)])
    assert K.sample_until(batches(), lambda x: x, 5, "u", 3).count() == 6
    with pytest.raises(RuntimeError):
        K.sample_until(batches(), lambda x: x, 50, "u", 2)
