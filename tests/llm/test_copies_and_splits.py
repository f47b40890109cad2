import random

from pyspark.sql import functions as F

from tracewright.llm import copies as C
from tracewright.llm import groups as G
from tracewright.llm import splits as S
from tracewright.llm.splits import assign_splits, components, place, recording_components, split_report
from tracewright.llm.text import label_key, loose_path, loose_text, recording_key

SCHEMA = "row_id long, question string, video string, answer string, h1 long, n long, items string, label string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "clash", "clash") for r in rows], SCHEMA)


def pairs(df):
    return sorted(tuple(r) for r in C.copy_groups(df, "row_id", C.sample_items()).where("row_id <> first_row_id").collect())


def test_formatting_copies(spark):
    rows = [
        (9, "What is it?", "videos/A/b.mp4", "B"), (3, "what  IS it", "VIDEOS\\a//B.mp4", "**b**"), (4, "What is it?", "videos/A/b.mp4", "C"), (5, "What is 1.5?", "v", "2.50"), (6, "what is 1.50", "v", " 2.5."),
        (7, "What is 15?", "v", "2.5"), (8, None, "v", "B"), (10, None, "v", "B"), (11, "q", None, "B"), (12, "q", "v", None), (13, "", "", ""), (14, "?", "!", "-"),
        (20, "s", "v", '[{"start": 1.0, "end": 2}, {"start": 3, "end": 4.5}]'), (21, "s", "v", "end=2.0 start=1; End=4.5 Start=3"), (22, "s", "v", '[{"start": 3, "end": 4.5}, {"start": 1, "end": 2}]'), (23, "s", "v", "[[1, 2], [3, 4.5]]"), (24, "s", "v", "( 1.0,2 ), (3, 4.5);"),
        (30, "t", "v", "-5"), (31, "t", "v", "5"),
    ]
    want = [(3, 9), (5, 6), (13, 14), (20, 21), (23, 24)]
    assert pairs(table(spark, rows)) == want


def test_repeats_ties_long_empty(spark):
    rows = [(1, "x" * 200_000, "v", "a")] * 3 + [(2, "X" * 200_000, "v", "A")]
    assert pairs(table(spark, rows)) == [(1, 2)]
    assert pairs(table(spark, [])) == []
    got = {r[0]: r[1] for r in C.collapse_copies(table(spark, rows + [(7, None, "v", "a"), (8, "other", "v", "a")]), "row_id", C.sample_items()).collect()}
    assert got == {1: 4, 7: 1, 8: 1}


def test_hash_collisions_do_not_join(spark, monkeypatch):
    monkeypatch.setattr(C, "multiset_hash", lambda items, seed: F.lit(7).cast("long"))
    rows = [(1, "a", "v", "1"), (2, "b", "v", "1"), (3, "A", "v", "1"), (4, "B", "v", "1"), (5, "c", "v", "1")]
    assert pairs(table(spark, rows)) == [(1, 3), (2, 4)]


def test_hot_group_is_salted(spark, monkeypatch):
    monkeypatch.setattr(G, "ROWS_A_TASK", 50)
    rows = [(i, "same" if i % 3 == 0 else f"q {chr(97 + i % 26)}{i}x", "v", "a") for i in range(600)]
    assert pairs(table(spark, rows)) == [(0, i) for i in range(3, 600, 3)]
    got = recording_components(table(spark, rows), "row_id").where("component <> row_id").count()
    assert got == 599


def test_recordings(spark):
    same = ["videos/A/7fzz0sr.mp4", " /mnt/x/7FZZ0SR.MKV", "oss://b\\v\\7fzz0sr.webm?t=4", "file:///d/7fzz0sr_40_100.mp4#t=1,2", "./7fzz-0sr.00030-00090.mp4", "x/7fzz0sr-0-20.mov "]
    other = ["7fzz0sq.mp4", "a/cam_7_kl3.mp4", "cam_8_kl3.mp4", "538_150_330.mp4", "539_150_330.mp4"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in same + other], "v string").select(recording_key(F.col("v"))).collect()]
    assert set(got[: len(same)]) == {"7fzz0sr"} and len(set(got)) == 6 and got[-2] == "538"
    none = spark.createDataFrame([(None,), ("",), ("/",), ("???",)], "v string").select(recording_key(F.col("v"))).collect()
    assert [r[0] for r in none] == [None] * 4


def test_text_forms(spark):
    df = spark.createDataFrame([("Ａ—b  1.50, x-2",), (None,)], "t string")
    assert [r[0] is None for r in df.select(loose_text(F.col("t"))).collect()] == [False, True]
    a, b = spark.createDataFrame([("1.5 and 10",), ("15 and 1.0",)], "t string").select(loose_text(F.col("t"))).collect()
    assert a != b
    p, q = spark.createDataFrame([("x_5_184",), ("x_51_84",)], "t string").select(loose_path(F.col("t"))).collect()
    assert p != q
    labels = spark.createDataFrame([(" Agent-Traces",), ("agent_traces ",), ("AGENT TRACES",)], "t string").select(label_key(F.col("t"))).distinct().count()
    assert labels == 1


def test_components_over_two_entities(spark):
    rows = [(1, "a", "x"), (2, "a", None), (3, "b", "x"), (4, "b", "y"), (5, None, "y"), (6, None, None), (7, "c", "z"), (7, "c", "z")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "row_id long, v string, s string, label string")
    got = {r[0]: r[1] for r in components(df, "row_id", {"v": F.col("v"), "s": F.col("s")}).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7}
    assert components(df.where("false"), "row_id", {"v": F.col("v"), "s": F.col("s")}).count() == 0
    chain = spark.createDataFrame([(i, f"v{i // 2}", f"s{(i + 1) // 2}") for i in range(24)], "row_id long, v string, s string")
    assert {r[1] for r in components(chain, "row_id", {"v": F.col("v"), "s": F.col("s")}).collect()} == {0}


def _roots(edges):
    """Smallest member of each component, by union-find."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r, ents in edges.items():
        for e in ents:
            parent[find(("e", e))] = find(("r", r))
    low = {}
    for r in edges:
        low[find(("r", r))] = min(low.get(find(("r", r)), r), r)
    return {r: low[find(("r", r))] for r in edges}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain longer than any fixed number of rounds, in rising and in shuffled order, and a random graph."""
    rounds = []
    real = S._round
    monkeypatch.setattr(S, "_round", lambda state: rounds.append(1) or real(state))
    rng = random.Random(3)
    for kind in ("rising", "shuffled", "random"):
        rounds.clear()
        ids = list(range(400))
        if kind != "rising":
            rng.shuffle(ids)
        ends = [(i // 2, (i + 1) // 2) for i in range(400)] if kind != "random" else [(rng.randrange(300), rng.randrange(300)) for _ in range(400)]
        rows = [(r, f"v{a}", f"s{b}") for r, (a, b) in zip(ids, ends, strict=True)]
        df = spark.createDataFrame(rows, "row_id long, v string, s string")
        got = {r[0]: r[1] for r in components(df, "row_id", {"v": F.col("v"), "s": F.col("s")}).collect()}
        assert got == _roots({r: (v, s) for r, v, s in rows}) and len(rounds) <= 14, (kind, len(rounds))


def test_placing_counts_every_label():
    goal = {"a": {"x": 50.0, "y": 50.0}, "b": {"x": 50.0, "y": 50.0}}
    groups = [{"a": 40, "b": 1}, {"a": 1, "b": 40}, {"a": 40, "b": 1}, {"a": 1, "b": 40}, {"a": 9}, {"b": 9}, {"a": 9}, {"b": 9}]
    got = place(groups, goal, ["x", "y"])
    for lb in "ab":
        assert sum(g.get(lb, 0) for g, s in zip(groups, got, strict=True) if s == "x") == 50
    assert place([], {}, ["x"]) == []


def test_split_report(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE_ROWS", 60)
    rng = random.Random(8)
    rows = [(i, f"rec{'abcdefghij'[i % 10]}{rng.randrange(60)}x", rng.choice(["MCQ", "TR", "SIZE", None])) for i in range(5000)]
    df = spark.createDataFrame(rows, "row_id long, video string, kind string")
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    got = assign_splits(df, "row_id", recording_components(df, "row_id"), F.col("kind"), shares)
    report = split_report(df, "row_id", got, F.col("kind"), shares).collect()
    assert len(report) == 12 and sum(r["n"] for r in report) == 5000 and max(abs(r["deviation"]) for r in report) < 0.02


def test_split_shares(spark):
    rows = [(i, f"rec{i % 400 if i % 5 else 1}", ["MCQ", "TR", None][i % 3]) for i in range(4000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "row_id long, video string, kind string, n string")
    comp = recording_components(df, "row_id")
    got = assign_splits(df, "row_id", comp, F.col("kind"), {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert got.count() == 4000 and got.groupBy("component").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0
    shares = {r[0]: r[1] / 4000 for r in got.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.8) < 0.03 and abs(shares["test"] - 0.1) < 0.03
    by_kind = got.join(df, "row_id").where("kind = 'TR'").groupBy("split").count().collect()
    total = sum(r[1] for r in by_kind)
    assert abs({r[0]: r[1] / total for r in by_kind}["train"] - 0.8) < 0.06
    empty = df.where("false")
    assert assign_splits(empty, "row_id", recording_components(empty, "row_id"), F.col("kind"), {"a": 0.5, "b": 0.5}).count() == 0
