"""Duplicates hidden by formatting: one record each, with the number of its copies.

Each field gives one or more items (name and loose value); items are hashed, and the hashes of a record are added up, so the
order of named fields does not matter (a commutative multiset hash of two 48-bit lanes). Records are grouped by this
fingerprint with hash aggregation only; the members of groups are then held against the items of the group's first record,
and what differs is grouped again by its items themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.expr import let
from tracewright.llm.groups import attach
from tracewright.llm.text import folded, loose_path, loose_text
from tracewright.session import materialize

_NAMED = r"([\p{L}_][\p{L}\p{N}_]*)[\"'”’]?\s*[:=]\s*[\"'“‘]?(-?\d+(?:\.\d+)?|[\p{L}][\p{L}\p{N}_]*)"


def value_items(name: str, x: Column) -> Column:
    """Items of a free value: named members (``a=1``, ``"a": 1``) one by one with their occurrence, the rest as one item."""
    def of(low: Column) -> Column:
        names, vals = F.regexp_extract_all(low, F.lit(_NAMED), 1), F.regexp_extract_all(low, F.lit(_NAMED), 2)

        def items(names: Column) -> Column:
            earlier = lambda n, i: F.size(F.filter(F.slice(names, 1, i), lambda m: m == n)).cast("string")
            return F.transform(F.arrays_zip(names.alias("n"), vals.alias("v")), lambda p, i: F.concat_ws("\x01", F.lit(name), p["n"], earlier(p["n"], i), loose_text(p["v"], signed=True)))

        rest = F.concat_ws("\x01", F.lit(name), loose_text(F.regexp_replace(low, _NAMED, " "), signed=True))
        plain = F.array(F.concat_ws("\x01", F.lit(name), loose_text(low, signed=True)))
        return F.when(low.rlike(_NAMED), F.concat(let(names, items), F.array(rest))).otherwise(plain)

    return let(folded(x), of)


def text_items(name: str, x: Column) -> Column:
    return F.array(F.concat_ws("\x01", F.lit(name), loose_text(x)))


def path_items(name: str, x: Column) -> Column:
    return F.array(F.concat_ws("\x01", F.lit(name), loose_path(x)))


def multiset_hash(items: Column, seed: int) -> Column:
    """Sum of 48-bit hashes of the items: the same for any order, different for another multiplicity."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc + F.xxhash64(x, F.lit(seed)).bitwiseAND(F.lit((1 << 48) - 1)))


def copy_groups(df: DataFrame, row_id: str, items: Column) -> DataFrame:
    """``(first_row_id, row_id, n)`` for every row whose items equal those of another row; rows with null items are no case.

    Repeated row ids count as copies of each other. Empty tables give no rows; other columns of ``df`` are not read.
    """
    # items are made once and kept: normal forms cost more than reading them again
    made = materialize(df.select(F.col(row_id).alias("row_id"), items.alias("items"), F.monotonically_increasing_id().alias("uid")), "items")
    rows = made.where(F.col("items").isNotNull() & F.col("row_id").isNotNull()).withColumns({"h1": multiset_hash(F.col("items"), 1), "h2": multiset_hash(F.col("items"), 2)})
    # fixed-width aggregates and hashed joins: no sort
    counts = rows.groupBy("h1", "h2").agg(F.min("row_id").alias("first_row_id"), F.min("uid").alias("head_uid"), F.count(F.lit(1)).alias("n"))
    groups = materialize(counts, "copies")
    total = groups.agg(F.sum("n")).first()[0] or 0
    members = materialize(attach(rows, groups.where("n > 1"), ["h1", "h2"], "n", "uid", total, hashed=True).select("uid", "row_id", "items", "first_row_id", "head_uid", "n"), "members")
    heads = members.where("uid = head_uid").select("head_uid", F.col("items").alias("head"), "n")
    same = (F.size("items") == F.size("head")) & (F.size(F.array_except("items", "head")) == 0)
    checked = materialize(attach(members.drop("n"), heads, ["head_uid"], "n", "uid", total, hashed=True).select("first_row_id", "row_id", "head_uid", same.alias("same")), "checked")
    if not checked.where("NOT same").limit(1).count():
        return checked.select("first_row_id", "row_id")
    # groups whose members agree in their hashes but not in their items: grouped by the items themselves
    mixed = checked.where("NOT same").select("head_uid").distinct()
    good = checked.join(mixed, "head_uid", "left_anti").select("first_row_id", "row_id")
    key = F.array_join(F.array_sort("items"), "\x02")
    odd = members.join(mixed, "head_uid", "left_semi").select("row_id", key.alias("key"))
    least = odd.groupBy("key").agg(F.min("row_id").alias("first_row_id"), F.count(F.lit(1)).alias("n"))
    return good.unionByName(attach(odd, least.where("n > 1"), ["key"], "n", "row_id", total).select("first_row_id", "row_id"))


def collapse_copies(df: DataFrame, row_id: str, items: Column) -> DataFrame:
    """One row per record with the number of its copies: ``(first_row_id, copies)``. Records with null items stay, alone."""
    pairs = copy_groups(df, row_id, items)
    later = pairs.where("row_id <> first_row_id")
    counts = pairs.groupBy("first_row_id").agg(F.count(F.lit(1)).alias("copies"))
    first = df.select(F.col(row_id).alias("first_row_id")).distinct().join(later.select(F.col("row_id").alias("first_row_id")).distinct(), "first_row_id", "left_anti")
    return first.join(counts, "first_row_id", "left").select("first_row_id", F.coalesce("copies", F.lit(1)).alias("copies"))


def sample_items() -> Column:
    """Items of an RL training sample: question, video and answer; null where one of the three is null."""
    whole = F.col("question").isNotNull() & F.col("video").isNotNull() & F.col("answer").isNotNull()
    return F.when(whole, F.concat(text_items("question", F.col("question")), path_items("video", F.col("video")), value_items("answer", F.col("answer"))))
