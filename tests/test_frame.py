import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewright.operators import frame as P


def col(df, name):
    return [r[0] for r in df.orderBy("row_id").select(name).collect()]


@pytest.fixture()
def six(spark):
    return P.from_columns(spark, {"obs": [1, 2, 3, 4, 5, 6], "labels": list("abcdef")})


def test_reorder_and_index(six):
    got = P.reorder(six, [3, 4, 2, 0, 1, 5])
    assert col(got, "obs") == [4, 5, 3, 1, 2, 6] and col(got, "labels") == list("decabf")
    assert col(P.index(six, [-1, 0, 0]), "obs") == [6, 1, 1]
    with pytest.raises(IndexError):
        P.index(six, [6])


def test_chunk_concat(six):
    with pytest.raises(ValueError):
        P.chunk(six, 5)
    parts = [P.slice_rows(six, 0, 3), P.slice_rows(six, 3)]
    assert [col(p, "obs") for p in parts] == [[1, 2, 3], [4, 5, 6]]
    assert col(P.concat(parts), "obs") == [1, 2, 3, 4, 5, 6]
    assert [r[0] for r in P.chunk(six, 4, padded=True).orderBy("row_id").select("chunk").collect()] == [0, 0, 1, 1, 2, 2]


def test_repeat(spark):
    df = P.from_columns(spark, {"labels": ["a", "b", "c"], "k": [3, 1, 2], "z": [0, 2, None]})
    assert col(P.repeat(df, 2), "labels") == list("aabbcc")
    assert col(P.repeat(df, 2, interleave=False), "labels") == list("abcabc")
    assert P.repeat(df, 0).count() == 0
    assert col(P.sample_repeat(df, "k"), "labels") == list("aaabcc")
    assert col(P.sample_repeat(df, "z"), "labels") == list("bb")


@pytest.mark.parametrize(("divisor", "labels", "added"), [(2, "abca", 1), (3, "abc", 0), (7, "abcabca", 4)])
def test_pad_unpad(spark, divisor, labels, added):
    df = P.from_columns(spark, {"labels": ["a", "b", "c"]})
    padded, n = P.pad_to_divisor(df, divisor)
    assert col(padded, "labels") == list(labels) and n == added
    assert col(P.unpad(padded, n), "labels") == list("abc")


def test_padding_fold_unfold(spark):
    df = P.from_columns(spark, {"labels": ["a", "b", "c"]})
    assert col(P.padding(df, 2), "labels") == list("abccc")
    assert col(P.padding(df, 2, "first"), "labels") == list("abcaa")
    folded = P.fold(P.repeat(df, 2), 2)
    assert col(P.unfold(P.reorder(folded, [1, 2, 0]), 2), "labels") == list("bbccaa")


def test_column_chunks(spark):
    df = P.from_columns(spark, {"obs1": [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12]], "obs2": [[1, 2], [5, 6], [9, 10]]})
    got = P.unfold_chunks(df, 2, ["obs1"])
    assert col(got, "obs1") == [[1, 2], [3, 4], [5, 6], [7, 8], [9, 10], [11, 12]]
    assert col(got, "obs2") == [[1, 2], [1, 2], [5, 6], [5, 6], [9, 10], [9, 10]]


def test_zip_union(spark):
    a = P.from_columns(spark, {"x": [1.0, float("nan"), None]})
    same = a.withColumn("y", F.lit(1))
    assert col(P.zip_union(a, same), "y") == [1, 1, 1]
    with pytest.raises((PySparkException, Py4JJavaError)):
        P.zip_union(a, a.withColumn("x", F.lit(2.0))).collect()


def test_select_pop_rename_meta(six):
    with pytest.raises(KeyError):
        P.select(six, ["nope"])
    assert P.select(six, ["obs"], ["nope"]).columns == ["row_id", "obs"]
    popped, rest = P.pop(six, ["obs"])
    assert popped.columns == ["row_id", "obs"] and rest.columns == ["row_id", "labels"]
    with pytest.raises(ValueError):
        P.rename(six, ["obs"], [])
    assert P.merge_meta({"a": 1}, {"b": 2}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        P.merge_meta({"a": 1}, {"a": 2})


@pytest.mark.parametrize("n", range(4, 20))
def test_auto_padding_sizes(spark, n):
    df = P.from_columns(spark, {"x": list(range(n))})
    padded, _ = P.pad_to_divisor(df, 4)
    sizes = {r[1] for r in P.chunk(padded, 4).groupBy("chunk").count().collect()}
    assert sizes == {-(-n // 4)}


def test_order_and_adjust(spark, tmp_path):
    df = P.from_columns(spark, {"x": list(range(10))})
    assert sorted(col(P.hash_order(df, 3), "rank")) == list(range(10))
    assert col(P.hash_order(df, 3), "rank") == col(P.hash_order(df, 3), "rank")
    more = P.adjust_size(df, 7, "copy")
    assert more.count() == 14 and len(set(col(more, "x"))) == 10
    assert P.adjust_size(df, 7, "delete").count() == 7
    P.save(df, str(tmp_path / "f"))
    assert col(P.load(spark, str(tmp_path / "f")), "x") == list(range(10))
    with pytest.raises(ValueError):
        P.from_columns(spark, {"a": [1], "b": []})
