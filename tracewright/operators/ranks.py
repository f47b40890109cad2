"""Ranks over a whole frame without ordering it: rows are counted in ranges, and only the range that holds the rank is looked at again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 20_000
SKETCH = 10_000
SPREAD = 2 / SKETCH
_EDGE = 1e300


def ordered(c: Column | str) -> Column:
    """A number as a double that has a place in every range: null and -infinity first, infinity and NaN last."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(x.isNull(), -_EDGE).when(F.isnan(x), _EDGE).otherwise(F.greatest(F.least(x, F.lit(_EDGE)), F.lit(-_EDGE)))


def kth(df: DataFrame, keys: list[Column], rank: int) -> tuple | None:
    """The key at ``rank`` (from 1) in ascending order of ``keys``, as a tuple of numbers; None if there is no such rank.

    Keys are numbers without nulls (:func:`ordered`, or whole numbers). A mergeable sketch gives two values of the first key close to the rank
    on either side; exact counts below, between and above them tell which part holds it, and that part is looked at again, until it has
    ``SMALL`` rows or one value; then the next key decides. A part is about a thousandth of the one before. So the driver sees a few numbers
    a round and no task holds more than ``SMALL`` rows, whatever the rank.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    cur = df.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)])
    n = cur.count()
    if rank < 1 or rank > n:
        return None
    for name in names:
        x = F.col(name)
        lo = hi = None
        while n > SMALL:
            if lo is None:
                lo, hi = cur.agg(F.min(name), F.max(name)).first()
            if lo == hi:
                break
            at = rank / n
            a, b = cur.agg(F.percentile_approx(name, [max(0.0, at - SPREAD), min(1.0, at + SPREAD)], SKETCH)).first()[0]
            # the sketch counts in doubles: what it says of large whole numbers may lie beside all of them
            a, b = min(max(a, lo), hi), min(max(b, lo), hi)
            if a == lo and b == hi:
                a = b = lo  # nothing would be left out: the least value alone against the rest
            parts = [x < F.lit(a), (x >= F.lit(a)) & (x <= F.lit(b)), x > F.lit(b)]
            row = cur.agg(*[f(F.when(part, x)) for part in parts for f in (F.count, F.min, F.max)]).first()
            for i, part in enumerate(parts):
                n, lo, hi = row[3 * i], row[3 * i + 1], row[3 * i + 2]
                if rank <= n:
                    break
                rank -= n
            cur = cur.where(part)
        if n <= SMALL:
            return tuple(cur.orderBy(*names).limit(rank).agg(F.max(F.struct(*names)).alias("k")).first()["k"])
    return tuple(cur.first())


def first_ranks(df: DataFrame, keys: list[Column], n: int) -> Column:
    """The condition that holds for the ``n`` rows that come first by ``keys`` (and for rows that equal the last of them in every key)."""
    at = kth(df, keys, n)
    if at is None:
        return F.lit(n > 0)
    cond = F.lit(True)
    for k, v in reversed(list(zip(keys, at, strict=True))):
        cond = (k < F.lit(v)) | ((k == F.lit(v)) & cond)
    return cond


def quantile(df: DataFrame, col: str, p: float) -> float | None:
    """The linear quantile of a whole column, nulls left out: the values at the two ranks around it by :func:`kth`; None without values."""
    known = df.select(F.col(col).cast("double").alias("_q")).where("_q IS NOT NULL")
    n = known.count()
    if not n:
        return None
    at = (n - 1) * p
    lo = int(at)
    a = kth(known, [ordered("_q")], lo + 1)[0]
    b = a if at == lo else kth(known, [ordered("_q")], lo + 2)[0]
    return a + (b - a) * (at - lo)
