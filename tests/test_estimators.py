import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewright.operators import advantage as A
from tracewright.operators import filters as X
from tracewright.operators import losses as L
from tracewright.operators import partition as B
from tracewright.operators import reports as R
from tracewright.operators import scan as S


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id long, uid string, traj_uid string, score double, n_tokens long, ignored boolean")


ROWS = [(0, "a", "t0", 1.0, 3, False), (1, "a", "t0", 9.0, 2, False), (2, "a", "t1", 3.0, 1, False), (3, "a", "t2", 5.0, 4, True), (4, "b", "t3", 2.0, 2, False), (5, None, "t4", 4.0, 1, False), (6, None, "t5", 6.0, 1, False)]


def adv(df):
    return {r[0]: r[1] for r in df.select("row_id", "advantage").collect()}


def test_grpo(spark):
    got = adv(A.grpo(frame(spark, ROWS), ignore="ignored"))
    m, s = 2.0, np.std([1.0, 3.0], ddof=1)
    assert got[0] == pytest.approx((1 - m) / (s + 1e-6)) and got[1] == pytest.approx((9 - m) / (s + 1e-6))
    assert got[3] == 5.0 and got[4] == pytest.approx(2.0 / (1 + 1e-6))
    assert got[5] == pytest.approx(-1 / (np.sqrt(2) + 1e-6))


def test_passk_and_singletons(spark):
    two = frame(spark, [(0, "a", "x", 2.0, 1, False), (1, "a", "y", 2.0, 1, False), (2, "a", "z", 1.0, 1, False)])
    assert adv(A.grpo_passk(two, by_std=False)) == {0: 0.0, 1: 0.0, 2: 0.0}
    with pytest.raises((PySparkException, Py4JJavaError)):
        A.grpo_passk(frame(spark, ROWS)).collect()
    assert adv(A.rloo(frame(spark, ROWS)))[4] == 2.0 and adv(A.rloo_vectorized(frame(spark, ROWS)))[4] == 0.0
    assert adv(A.opo(frame(spark, ROWS)))[4] == 2.0


def test_hot_group_and_empty(spark):
    rows = [(i, "hot" if i % 3 else f"u{i}", f"t{i}", float(i % 7), 1, False) for i in range(3000)]
    got = adv(A.rloo(frame(spark, rows)))
    hot = np.array([r[3] for r in rows if r[1] == "hot"])
    assert got[1] == pytest.approx((1.0 - hot.mean()) * len(hot) / (len(hot) - 1))
    assert A.grpo(frame(spark, [])).count() == 0


def test_registries():
    with pytest.raises(ValueError):
        A.register_estimator("grpo")(lambda df: df)
    with pytest.raises(ValueError):
        A.get_estimator("nope")
    with pytest.raises(ValueError):
        L.register_loss("vanilla")(lambda df: df)
    assert A.register_estimator("grpo")(A.grpo) is A.grpo


def test_gae_against_loop(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for i in range(20):
        n = int(rng.integers(1, 30))
        r, v, m = rng.normal(size=n), rng.normal(size=n), (rng.random(n) > 0.3).astype(float)
        nv = gl = 0.0
        out = []
        for t in reversed(range(n)):
            last = r[t] + 0.99 * nv - v[t] + 0.99 * 0.95 * gl
            nv, gl = v[t] * m[t] + (1 - m[t]) * nv, last * m[t] + (1 - m[t]) * gl
            out.append(gl)
        rows.append((i, r.tolist(), v.tolist(), m.astype(int).tolist()))
        want[i] = out[::-1]
    df = spark.createDataFrame(rows, "row_id long, reward array<double>, value array<double>, mask array<int>")
    for row in S.gae(df, gamma=0.99, lam=0.95).collect():
        assert row["advantage_raw"] == pytest.approx(want[row["row_id"]])


def test_spans(spark):
    df = spark.sql("SELECT array(named_struct('s', 1d, 'e', 3d), named_struct('s', 2d, 'e', 6d), named_struct('s', 5d, 'e', 9d)) AS a, CAST(array() AS ARRAY<STRUCT<s: DOUBLE, e: DOUBLE>>) AS n")
    got = df.select(S.merge_spans(F.col("a")).alias("m"), S.span_iou(F.col("a"), F.col("a")).alias("one"), S.span_iou(F.col("a"), F.col("n")).alias("zero"), S.span_iou(F.col("n"), F.col("n")).alias("both")).first()
    assert [tuple(x) for x in got["m"]] == [(1.0, 9.0)]
    assert (got["one"], got["zero"], got["both"]) == (pytest.approx(1.0), 0.0, 1.0)


def test_masked_edges(spark):
    t = spark.createDataFrame([(1, 1.0, 0), (1, 2.0, 0)], "row_id long, x double, mask int")
    assert t.agg(L.mmean(F.col("x"), F.col("mask")).alias("m")).first()[0] == 0.0
    with pytest.raises((PySparkException, Py4JJavaError)):
        t.select(L.mvar(t, "x")).collect()
    with pytest.raises(NotImplementedError):
        L.kl(F.col("x"), F.col("x"), "full")
    with pytest.raises(ValueError):
        L.agg_loss(t, F.col("x"), mode="nope")


def test_balancing_round_trip():
    rng = np.random.default_rng(0)
    for equal in (False, True):
        for _ in range(20):
            sizes = rng.integers(1, 300, 20).tolist()
            for fn in (B.balanced_parts, B.greedy_parts):
                parts = fn(sizes, 4, equal)
                assert sorted(i for p in parts for i in p) == list(range(20))
                assert not equal or {len(p) for p in parts} == {5}
    sums = [sum(sizes[i] for i in p) for p in B.balanced_parts(sizes, 4)]
    assert max(sums) - min(sums) <= max(sizes)
    with pytest.raises(ValueError):
        B.balanced_parts([1], 2)


def test_bootstrap(spark):
    at = B.bootstrap_indices(5, 3, 100)
    vals = np.arange(1.0, 6.0)[at]
    assert abs(vals.mean() - 3) < 0.3 and 3.5 < vals.max(1).mean() < 5
    df = spark.createDataFrame([(0, "s1", "p1", 0.8, "A"), (1, "s1", "p1", 0.9, "A"), (2, "s2", "p2", 0.7, "B")], "row_id long, src string, prompt string, score double, pred string")
    got = {(r[0], r[1]): r[2] for r in B.validation_metrics(df, "src", "prompt", "score", "pred").collect()}
    assert got["s1", "mean@2"] == pytest.approx(0.85) and ("s1", "maj@2/mean") in got and got["s2", "mean@1"] == 0.7
    votes, v = np.array([[0, 1, 0], [1, 0, 0]]), np.array([[0.9, 0.8, 0.7], [0.1, 0.2, 0.3]])
    assert B._majority(votes, v).tolist() == [0.9, 0.2]


def test_resample_total(spark):
    s = frame(spark, ROWS)
    drawn = B.resample(B.reweights(s))
    assert drawn.agg(F.sum("copies")).first()[0] == len(ROWS)


def test_timing_and_reduce(spark):
    got = R.timing_metrics({"gen": 0.5, "ref": 0.3, "step": 2}, 6, 12)
    assert got["per_token_ms/gen"] == pytest.approx(0.5 * 1000 / 6) and got["per_token_ms/ref"] == pytest.approx(25.0)
    assert R.timing_metrics({"step": 2}, 1, 600)["throughput"] == 300 and R.timing_metrics({"step": 2}, 1, 600, 2)["throughput"] == 150
    df = spark.createDataFrame([("loss", 1.0), ("loss", 3.0), ("x/max", 1.0), ("x/max", 4.0), ("timing", 2.0), ("timing", 5.0)], "metric string, value double")
    assert {r[0]: r[1] for r in R.reduce_metrics(df).collect()} == {"loss": 2.0, "x/max": 4.0, "timing": 2.0}


def test_filters_fallback(spark):
    same = frame(spark, [(0, "a", "x", 1.0, 1, False), (1, "a", "y", 1.0, 1, False)])
    assert X.differing_groups(same).count() == 2
    assert X.spread_groups(same).count() == 0
    assert X.differing_groups(frame(spark, [])).count() == 0


def test_kl_control():
    c = S.kl_controller("adaptive", 0.2, 6.0, 100)
    assert c.update(12.0, 10) == pytest.approx(0.2 * 1.02)
    assert S.kl_controller("fixed", 0.1).update(9.0, 5) == 0.1
    with pytest.raises(NotImplementedError):
        S.kl_controller("nope", 0.1)
