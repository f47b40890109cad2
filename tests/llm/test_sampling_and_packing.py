import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm.balance import cube_sample, cube_samples, flight, planned_rows
from tracewright.llm.mixing import mix, water_fill
from tracewright.llm.packing import differencing, fill, over_capacity, pack
from tracewright.llm.tokens import VOCABULARY, count_tokens, encoder


@given(st.lists(st.tuples(st.integers(0, 4), st.floats(0.01, 0.99)), max_size=200), st.integers(0, 9))
@settings(max_examples=40, deadline=None)
def test_flight_keeps_balance(items, seed):
    cat, pi = np.array([c for c, _ in items], int), np.array([p for _, p in items])
    out = flight(cat, pi, np.random.default_rng(seed))
    for c in set(cat.tolist()):
        assert out[cat == c].sum() == pytest.approx(pi[cat == c].sum())
        assert ((out[cat == c] > 0) & (out[cat == c] < 1)).sum() <= 1


def test_flight_is_unbiased():
    cat, pi = np.zeros(5, int), np.array([0.1, 0.3, 0.5, 0.7, 0.4])
    mean = np.mean([flight(cat, pi, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert mean == pytest.approx(pi, abs=0.03)


def rows(spark, items):
    return spark.createDataFrame([(i, c, "x", 0.1) for i, c in items], "row_id long, kind string, category string, pi double")


TARGETS = [("kind", "a", 0.5, 5), ("kind", "B-b", 0.3, 5), ("kind", "c", 0.2, 40), ("other", "z", 1.0, 1)]


def targets(spark, t=TARGETS):
    return spark.createDataFrame(t, "field_name string, category string, target_share double, min_rows int")


def test_cube_sample(spark):
    items = [(i, ["a", " B_B", "c", None, "d"][(i * 7) % 5 if i % 10 else 2]) for i in range(2000)]
    df = rows(spark, items).repartition(7)
    sample, report = cube_sample(df, "row_id", "kind", targets(spark))
    rep = {r["category"]: r for r in report.collect()}
    assert set(rep) == {"a", "B-b", "c"}
    for c, want in (("a", 200.0), ("B-b", 120.0), ("c", 80.0)):
        assert rep[c]["wanted"] == pytest.approx(want) and abs(rep[c]["drawn"] - want) < 1 and not rep[c]["short"]
    ids = [r[0] for r in sample.select("row_id").collect()]
    assert len(ids) == len(set(ids)) == sum(r["drawn"] for r in rep.values())


def test_cube_short_and_empty(spark):
    df = rows(spark, [(i, "a" if i % 50 else "c") for i in range(500)])
    rep = {r["category"]: r for r in cube_sample(df, "row_id", "kind", targets(spark))[1].collect()}
    assert rep["c"]["short"] and rep["c"]["drawn"] == rep["c"]["available"] == 10 and rep["B-b"]["short"] and rep["B-b"]["available"] == 0
    sample, report = cube_sample(df.where("false"), "row_id", "kind", targets(spark))
    assert sample.count() == 0 and all(r["short"] for r in report.collect())
    same = rows(spark, [(1, "a")] * 300)
    assert cube_sample(same, "row_id", "kind", targets(spark))[0].count() == 60  # the whole fifth: the other two have no rows


def test_differencing_and_fill():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(0, 2048, int(rng.integers(1, 120))).tolist()
        parts = fill(sizes, 2048)
        assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in p) <= 2048 for p in parts)
    parts = differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) == [14, 16]
    assert differencing([], 3) == [[], [], []] and differencing([5], 1) == [[0]] and fill([0, 0], 10)
    with pytest.raises(ValueError):
        fill([11], 10)


def test_pack(spark):
    texts = [(i, "word " * (i * 13 % 400), "clash") for i in range(300)] + [(1000, "word " * 5000, "x"), (1001, None, "x"), (1002, "", "x"), (1003, "same text", "x"), (1003, "same text", "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string, id string").repartition(3)
    want = {i: count_tokens(t) for i, t, _ in texts}
    got = pack(df, "doc_id", "text", 512, windows=8).toPandas()
    per = got.groupby("container")["tokens"].sum()
    assert per.max() <= 512 and got[got.tokens > 0].groupby("container").tokens.sum().mean() > 440
    assert got[got.doc_id != 1003].groupby("doc_id").tokens.sum().to_dict() == {k: v for k, v in want.items() if k != 1003}
    assert sorted(got[got.doc_id == 1003].occurrence) == [1, 2] and set(got[got.piece > 0].doc_id) == {1000}
    assert (got[got.doc_id != 1000].groupby(["doc_id", "occurrence"]).container.nunique() == 1).all()
    assert [tuple(r) for r in over_capacity(pack(df, "doc_id", "text", 512, windows=8), "doc_id").collect()] == [(1000, got[got.doc_id == 1000].container.nunique(), want[1000])]
    assert pack(df.where("false"), "doc_id", "text").count() == 0


def test_token_counts_of_long_texts():
    million = 1 << 20
    for text in ("The quick brown fox jumps over it. " * (3 * million // 35), "0123456789" * (million // 10 + 2500), "x" * (2 * million), "a\u00a0b " * (million // 2), "!?" * million):
        assert count_tokens(text) == len(encoder(VOCABULARY).encode_ordinary(text)) > 0
    assert count_tokens(None) == count_tokens("") == 0


def test_planned_rows():
    assert planned_rows([1000, 500, 50], [0.5, 0.3, 0.2], [0, 0, 0], 300) == pytest.approx([250 * 0.625, 250 * 0.375, 50])
    assert planned_rows([1000, 500, 50], [0.5, 0.3, 0.2], [0, 0, 40], 100) == pytest.approx([60 * 0.625, 60 * 0.375, 40])
    assert planned_rows([10, 5], [0.5, 0.5], [0, 0], 100) == [10, 5] and planned_rows([0, 0], [0.5, 0.5], [3, 0], 0) == [0, 0]
    assert planned_rows([100, 45], [0.5, 0.5], [0, 0], 100) == pytest.approx([55, 45]) and planned_rows([], [], [], 10) == []


def test_results_do_not_depend_on_files(spark):
    items = [(i, ["a", " B_B", "c", None, "d"][(i * 7) % 5 if i % 10 else 2]) for i in range(3000)]
    docs = spark.createDataFrame([(i % 900, "word " * (i * 7 % 300), ["x", "y", None][i % 3]) for i in range(1000)], "doc_id long, text string, source string")
    tg = spark.createDataFrame([("x", 0.7, 2), ("y", 0.3, 3)], "source string, target_weight double, max_repeats int")
    got = []
    for n in (1, 8):
        df = rows(spark, items).repartition(n)
        sample, report = cube_samples(df, "row_id", ["kind"], targets(spark))
        packed = pack(docs.repartition(n), "doc_id", "text", 512, windows=8)
        mixed, _ = mix(docs.repartition(n), "doc_id", "text", "source", tg)
        got.append([sorted(map(tuple, x.collect()), key=str) for x in (sample, report, packed, mixed)])
    assert got[0] == got[1] and all(got[0])


def test_sample_keeps_its_size(spark, monkeypatch):
    import tracewright.llm.balance as B

    monkeypatch.setattr(B, "NODE_ROWS", 40)
    monkeypatch.setattr(B, "FAN_IN", 4)
    items = [(i, "a" if i % 3 else "b-b" if i % 2 else "c") for i in range(4000)]
    t = [("kind", "a", 0.37, 5), ("kind", "b_b", 0.213, 5), ("kind", "c", 0.4, 40), ("kind", "none", 0.017, 1)]
    sample, report = cube_samples(rows(spark, items).repartition(6), "row_id", ["kind"], targets(spark, t))
    rep = {r["category"]: r for r in report.collect()}
    assert sample.count() == 800 == sum(r["drawn"] for r in rep.values())
    assert all(abs(r["residual"]) < 1 for r in rep.values()) and [c for c, r in rep.items() if r["short"]] == ["none"]


def test_unused_space_is_small():
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in np.minimum(2040, rng.lognormal(5.6, 0.8, 1500))]
    parts = fill(sizes, 2048)
    assert sorted(i for p in parts for i in p) == list(range(1500)) and max(sum(sizes[i] for i in p) for p in parts) <= 2048
    assert 1 - sum(sizes) / (2048 * len(parts)) < 0.01
    big = fill([1100] * 50, 2048)
    assert len(big) == 50


def test_water_fill():
    got = water_fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10.0, "b": 1000.0, "c": 25.0}, 100)
    assert got == pytest.approx({"a": 10.0, "b": 65.0, "c": 25.0})
    assert water_fill({"a": 0.6, "b": 0.4}, {"a": 5.0, "b": 5.0}, 100) == {"a": 5.0, "b": 5.0}
    assert water_fill({"a": 1.0, "b": 0.0}, {"a": 0.0, "b": 9.0}, 10) == {"a": 0.0, "b": 0.0}
    assert water_fill({}, {}, 10) == {}


@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.floats(0.01, 1), st.floats(0, 100)), min_size=1), st.floats(1, 300))
@settings(max_examples=80, deadline=None)
def test_water_fill_is_feasible(sources, total):
    w, caps = {s: x[0] for s, x in sources.items()}, {s: x[1] for s, x in sources.items()}
    got = water_fill(w, caps, total)
    assert all(got[s] <= caps[s] + 1e-6 for s in w)
    assert sum(got.values()) == pytest.approx(min(total, sum(caps.values())), abs=1e-6)


def test_mix(spark):
    docs = [(i, "word " * 100, ["Big", "small-one", None, "unlisted"][0 if i % 10 else 1 + i % 3], "clash") for i in range(2000)] + [(9999, None, "Big", "x"), (9998, "", "Big", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, key string").repartition(5)
    tg = spark.createDataFrame([("big", 0.7, 2), ("small_one", 0.2, 3), ("absent", 0.1, 4)], "source string, target_weight double, max_repeats int")
    records, report = mix(df, "doc_id", "text", "source", tg)
    rep = {r["source"]: r for r in report.collect()}
    assert rep["absent"]["short"] and rep["small_one"]["short"] == (rep["small_one"]["available"] * 3 < rep["small_one"]["wanted"]) and not rep["big"]["short"]
    assert sum(r["actual_share"] for r in rep.values()) == pytest.approx(1.0)
    assert abs(rep["big"]["actual"] - rep["big"]["given"]) <= 101
    caps = {"big": 2, "small_one": 3}
    assert all(r["copies"] <= caps[r["source"]] for r in records.collect())
    records, report = mix(df.where("false"), "doc_id", "text", "source", tg)
    assert records.count() == 0 and report.count() == 3
    with pytest.raises(ValueError):
        mix(df, "doc_id", "text", "source", tg.unionByName(tg))
