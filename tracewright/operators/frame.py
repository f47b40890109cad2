"""Ordered-frame verbs over an explicit dense ``row_id`` (0, 1, ...): select, slice, zip, concat, repeat, chunk, pad, reorder.

Frames are immutable: every verb returns a new frame whose ``row_id`` is dense again where the verb defines an order. Row
counts are the only values that reach the driver. Empty frames give empty frames unless a verb says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.session import materialize

ROW = "row_id"


def from_columns(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A frame from equally long lists; unequal lengths are an error."""
    sizes = {len(v) for v in columns.values()}
    if len(sizes) > 1:
        raise ValueError(f"columns of different lengths: { {k: len(v) for k, v in columns.items()} }")
    rows = [(i, *r) for i, r in enumerate(zip(*columns.values(), strict=True))]
    if not rows:
        return spark.createDataFrame([], ", ".join([f"{ROW} long", *[f"`{c}` string" for c in columns]]))
    return spark.createDataFrame(rows, [ROW, *columns])


def number(df: DataFrame, order: list[str], name: str = ROW) -> DataFrame:
    """A dense row id in the given order without a one-task window: ranges, their sizes, then ranks within them.

    The ranges come from a sample, so they are written once: sizes and ranks must be of the same ranges.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_rank", rank).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_rank") - 1).drop("_part", "_rank", "_before")


def check_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    """An error where the array columns of a row differ in length; else the frame unchanged."""
    same = F.lit(True)
    for c in columns[1:]:
        same = same & F.size(columns[0]).eqNullSafe(F.size(c))
    return df.where(F.coalesce(F.assert_true(same, F.lit("columns of different lengths")).isNull(), F.lit(True)))


def index(df: DataFrame, positions: list[int]) -> DataFrame:
    """The rows at ``positions`` in that order, duplicates kept; negative positions count from the end, others out of range are errors."""
    n = df.count()
    at = [p + n if p < 0 else p for p in positions]
    if any(p < 0 or p >= n for p in at):
        raise IndexError(f"position out of range for {n} rows")
    want = df.sparkSession.createDataFrame(list(enumerate(at)), "_new long, _old long")
    return df.join(F.broadcast(want), df[ROW] == want["_old"]).drop(ROW, "_old").withColumnRenamed("_new", ROW)


def mask(df: DataFrame, keep: str) -> DataFrame:
    """Rows whose boolean column holds; row ids are kept. Null counts as false."""
    return df.where(F.col(keep))


def slice_rows(df: DataFrame, start: int | None = None, end: int | None = None, step: int | None = None) -> DataFrame:
    """Slice with the semantics of Python for a positive step; the row ids become dense."""
    step = 1 if step is None else step
    if step < 1:
        raise ValueError("the step must be positive")
    n = df.count()
    s, e, _ = slice(start, end, step).indices(n)
    kept = df.where((F.col(ROW) >= s) & (F.col(ROW) < e) & ((F.col(ROW) - s) % step == 0))
    return kept.withColumn(ROW, F.floor((F.col(ROW) - s) / step))


def select(df: DataFrame, batch: list[str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """Columns by name: a missing ``batch`` column is an error, a missing ``extra`` column is left out."""
    batch, extra = batch or [], extra or []
    missing = [c for c in batch if c not in df.columns]
    if missing:
        raise KeyError(missing)
    return df.select(ROW, *batch, *[c for c in extra if c in df.columns])


def pop(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(popped, rest)``; a missing column is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(missing)
    return df.select(ROW, *columns), df.drop(*columns)


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def zip_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of two frames side by side by row id; a column of both must be equal in every row (NaN equals NaN, null null)."""
    both = [c for c in a.columns if c in b.columns and c != ROW]
    renamed = b.withColumnsRenamed({c: f"_r_{c}" for c in both})
    out = a.join(renamed, ROW)
    for c in both:
        out = out.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(a.schema[c].dataType))).drop(f"_r_{c}")
    return out


def merge_meta(a: dict, b: dict) -> dict:
    """Union of two small dictionaries; a common key must have equal values."""
    for k in a.keys() & b.keys():
        if a[k] != b[k]:
            raise ValueError(f"meta key {k} differs")
    return a | b


def concat(frames: list[DataFrame]) -> DataFrame:
    """Rows of the frames one after another; the columns must be the same."""
    names = {tuple(sorted(f.columns)) for f in frames}
    if len(names) > 1:
        raise ValueError("frames with different columns")
    out, at = None, 0
    for f in frames:
        moved = f.withColumn(ROW, F.col(ROW) + at)
        out = moved if out is None else out.unionByName(moved)
        at += f.count()
    return out


def chunk(df: DataFrame, n: int, padded: bool = False) -> DataFrame:
    """``chunk`` of each row: ``n`` equal runs of rows. Uneven lengths are an error unless ``padded`` (then of size ceil(N/n))."""
    rows = df.count()
    if rows % n and not padded:
        raise ValueError(f"{rows} rows do not divide into {n} chunks")
    size = max(1, -(-rows // n))
    return df.withColumn("chunk", F.floor(F.col(ROW) / size))


def repeat(df: DataFrame, times: int, interleave: bool = True) -> DataFrame:
    """Every row ``times`` times: each row's copies together, or the whole frame over and over."""
    rep = df.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.withColumn("_rep", F.lit(0)).limit(0)
    if interleave:
        new = F.col(ROW) * times + F.col("_rep")
    else:
        new = F.col("_rep") * F.lit(df.count()) + F.col(ROW)
    return rep.withColumn(ROW, new).drop("_rep")


def sample_repeat(df: DataFrame, times: str) -> DataFrame:
    """Row i as often as its count column says (0 drops it, null counts as 0), in order."""
    rep = df.withColumn("_rep", F.explode(F.expr(f"CASE WHEN coalesce({times}, 0) > 0 THEN sequence(1, CAST({times} AS INT)) ELSE CAST(array() AS ARRAY<INT>) END")))
    return number(rep, [ROW, "_rep"], "_new").drop(ROW, "_rep").withColumnRenamed("_new", ROW)


def unfold_chunks(df: DataFrame, n: int, split: list[str]) -> DataFrame:
    """Array columns cut into ``n`` pieces of equal length, a row each; the other columns are repeated."""
    parts = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for c in split:
        w = (F.size(c) / n).cast("int")
        parts = parts.withColumn(c, F.when(F.size(c) % n == 0, F.slice(F.col(c), F.col("_k") * w + 1, w)).otherwise(F.raise_error(F.lit(f"{c} does not divide")).cast(df.schema[c].dataType)))
    return parts.withColumn(ROW, F.col(ROW) * n + F.col("_k")).drop("_k")


def fold(df: DataFrame, size: int) -> DataFrame:
    """``size`` consecutive rows as one row of arrays."""
    cols = [c for c in df.columns if c != ROW]
    g = df.groupBy(F.floor(F.col(ROW) / size).alias(ROW)).agg(F.array_sort(F.collect_list(F.struct(F.col(ROW).alias("_o"), *cols))).alias("_g"))
    return g.select(ROW, *[F.transform("_g", _get(c)).alias(c) for c in cols])


def _get(name: str):
    return lambda x: x[name]


def unfold(df: DataFrame, size: int) -> DataFrame:
    """The inverse of :func:`fold`."""
    cols = [c for c in df.columns if c != ROW]
    out = df.select(ROW, F.posexplode(F.arrays_zip(*cols)).alias("_k", "_g"))
    return out.select((F.col(ROW) * size + F.col("_k")).alias(ROW), *[F.col(f"_g.{c}").alias(c) for c in cols])


def reorder(df: DataFrame, positions: list[int]) -> DataFrame:
    """Rows in the order of ``positions``; rows that are not named are dropped."""
    return index(df, positions)


def reorder_by(df: DataFrame, permutation: DataFrame) -> DataFrame:
    """Rows by a permutation frame ``(row_id, new_id)``; rows that it lacks are dropped."""
    return df.join(permutation, ROW).drop(ROW).withColumnRenamed("new_id", ROW)


def pad_to_divisor(df: DataFrame, divisor: int) -> tuple[DataFrame, int]:
    """Rows from the start again (cycling) until the count divides; and how many were added."""
    n = df.count()
    if n == 0:
        raise ValueError("an empty frame cannot be padded")
    extra = -n % divisor
    if not extra:
        return df, 0
    add = df.sparkSession.range(extra).select((F.col("id") + n).alias("_new"), (F.col("id") % n).alias("_old"))
    more = df.join(F.broadcast(add), df[ROW] == add["_old"]).drop(ROW, "_old").withColumnRenamed("_new", ROW)
    return df.unionByName(more), extra


def unpad(df: DataFrame, added: int) -> DataFrame:
    return slice_rows(df, 0, df.count() - added) if added else df


def padding(df: DataFrame, n: int, which: str = "") -> DataFrame:
    """``n`` copies of the first row (``"first"``) or of the last one (any other value) at the end."""
    rows = df.count()
    at = 0 if which == "first" else rows - 1
    if not n or not rows:
        return df
    return df.unionByName(df.where(F.col(ROW) == at).withColumn(ROW, F.explode(F.sequence(F.lit(rows), F.lit(rows + n - 1)))))


def mini_batches(df: DataFrame, size: int, epochs: int = 1, seed: int = 0) -> DataFrame:
    """``(epoch, batch)`` of every row and epoch, in seeded hash order; the rows must divide by ``size``."""
    n = df.count()
    if n % size:
        raise ValueError(f"{n} rows do not divide into batches of {size}")
    out = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("_h", F.xxhash64(ROW, "epoch", F.lit(seed)))
    return number(out, ["epoch", "_h", ROW], "_at").withColumn("batch", F.floor((F.col("_at") - F.col("epoch") * n) / size)).drop("_h", "_at")


def hash_order(df: DataFrame, seed: int, name: str = "rank") -> DataFrame:
    """A dense rank in seeded hash order: the reproducible shuffle of this library."""
    return number(df.withColumn("_h", F.xxhash64(ROW, F.lit(seed))), ["_h", ROW], name).drop("_h")


def adjust_size(df: DataFrame, divisor: int, how: str = "copy", seed: int = 0) -> DataFrame:
    """The count made a multiple: ``copy`` adds whole copies and then random rows once each, ``delete`` drops random rows."""
    n = df.count()
    if how == "delete":
        drop = n % divisor
        ranked = hash_order(df, seed)
        return number(ranked.where(F.col("rank") >= drop).drop("rank"), [ROW], "_new").drop(ROW).withColumnRenamed("_new", ROW)
    if how != "copy":
        raise ValueError(how)
    add = -n % divisor
    whole, rest = divmod(add, n) if n else (0, 0)
    parts = [df] + [df] * whole
    if rest:
        parts.append(number(hash_order(df, seed).where(F.col("rank") < rest).drop("rank"), [ROW], "_new").drop(ROW).withColumnRenamed("_new", ROW))
    return concat(parts)


def drop_last(df: DataFrame, batch: int) -> DataFrame:
    """Whole batches only, with their number."""
    n = df.count() // batch
    return df.withColumn("batch", F.floor(F.col(ROW) / batch)).where(F.col("batch") < n)


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
