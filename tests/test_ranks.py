import math
import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions.parsing import answers_equal
from tracewright.operators import etl as E
from tracewright.operators import ranks as R


@pytest.fixture
def tight(monkeypatch):
    """Ranges so few and small that every way through the search is taken."""
    monkeypatch.setattr(R, "SMALL", 3)
    monkeypatch.setattr(R, "SKETCH", 10)
    monkeypatch.setattr(R, "SPREAD", 0.1)


@pytest.mark.parametrize("kind", ["ties", "wide", "odd", "close"])
def test_kth_against_sorting(spark, tight, kind):
    rng = random.Random(kind)
    make = {
        "even": lambda i: rng.random(), "ties": lambda i: float(rng.randrange(4)), "wide": lambda i: 10 ** rng.uniform(-300, 299), "same": lambda i: 2.5, "odd": lambda i: rng.choice([None, math.nan, math.inf, -math.inf, 0.0, 1.0]),
        "close": lambda i: 1.0 + rng.randrange(3) * 2**-52,
    }[kind]
    rows = [(make(i), rng.randrange(5), i) for i in range(120)]
    df = spark.createDataFrame(rows, "v double, a int, row_id long").coalesce(1).cache()
    place = lambda v: -1e300 if v is None or v == -math.inf else 1e300 if math.isnan(v) or v == math.inf else v
    order = sorted((place(v), a, i) for v, a, i in rows)
    keys = [R.ordered("v"), F.col("a"), F.col("row_id")]
    assert R.kth(df, keys, 57) == order[56] and R.kth(df, keys, 120) == order[119]
    got = {r[0] for r in df.where(R.first_ranks(df, keys, 31)).select("row_id").collect()}
    assert got == {i for _, _, i in order[:31]}


def test_ranks_that_are_not(spark):
    df = spark.range(9)
    keys = [F.col("id")]
    assert R.kth(df, keys, 0) is None and R.kth(df, keys, 10) is None and R.kth(df.where("false"), keys, 1) is None
    assert df.where(R.first_ranks(df, keys, 0)).count() == 0 and df.where(R.first_ranks(df, keys, 500)).count() == 9


def test_kth_of_hashes(spark, tight):
    df = spark.range(300).coalesce(1)
    h = F.xxhash64("id")
    order = sorted(r[0] for r in df.select(h).collect())
    assert [R.kth(df, [h], k)[0] for k in (1, 150)] == [order[0], order[149]]
    rows = spark.createDataFrame([(i % 40,) for i in range(200)], "id long")
    assert E.hash_sample(rows, "id", 33).count() == 33 and E.hash_sample(rows, "id", 500).count() == 200 and E.hash_sample(rows, "id", 0).count() == 0


def test_quantile(spark, tight):
    import numpy as np

    rng = random.Random(1)
    values = [rng.gauss(0, 50) for _ in range(90)] + [7.0] * 20
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").coalesce(1).cache()
    for p in (0.37, 1.0):
        assert R.quantile(df, "x", p) == pytest.approx(np.quantile(values, p))
    assert R.quantile(df.where("false"), "x", 0.5) is None


def test_pairs_below(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, 3.5, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, g string, v double")
    low = lambda v: -1.0 if v is None else v
    got = {r["row_id"]: r["below"] for r in E.all_pairs_score(df, "g", "v").collect()}
    assert got == {i: sum(1 for _, h, w in rows if h == g and low(w) < low(v)) for i, g, v in rows}


def test_quota_segments():
    classes = {"x": {"total": 10, "first": {"a": 2}, "fill": ["b", "c"]}, "y": {"total": 3, "fill": ["d"]}}
    sizes = {"a": 10**9, "b": 4 * 10**9, "c": 3 * 10**9, "d": 10**12}
    plan = E.quota_segments(sizes, classes)
    assert len(plan) < 12 and all(sum(v for k, v in b.items() if k != "d") == 10 and b["d"] == 3 for b, _ in plan)
    used = {k: sum(b.get(k, 0) * n for b, n in plan) for k in sizes}
    assert all(used[k] <= sizes[k] for k in sizes) and sum(sizes[k] - used[k] for k in "abc") < 10


CASES = [
    ("\\frac{1}{2}", "1/2", True), ("\\frac{2}{4}", "\\frac{1}{2}", False), ("0.5", "\\frac{1}{2}", True), ("2", "2.5", False), ("1,000", "1000", True), ("(1,2)", "(1, 2)", True), ("[1,2)", "(1,2)", False), ("(1,2,3)", "(1,2)", False),
    ("x+1", "1+x", True), ("2x", "x+x", True), ("(x+1)^2", "x^2+2x+1", True), ("x+1", "x+2", False), ("\\sqrt{8}", "2\\sqrt{2}", True), ("\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "\\begin{pmatrix}1&2\\\\3&5\\end{pmatrix}", False),
    ("50\\%", "0.5", True), ("50", "0.5", False), ("3.0", "3", True), ("", "1", False), ("y", "x", False), ("\\pi/2", "0.5\\pi", True), ("1/0", "2/0", False), (None, "1", False), ("-\\frac{3}{4}", "\\frac{-3}{4}", True), ("hello world", "hello there", False),
    ("x^{1000}", "1+x^{1000}", False), ("(" * 3000, "1", False), ("\\sqrt[3]{27}", "3", False), ("10,000", "10000.0", True), ("5", "x", False),
]


@pytest.mark.parametrize("given,truth,same", CASES)
def test_answers(given, truth, same):
    assert answers_equal(given, truth) is same
