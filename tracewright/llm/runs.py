"""Repeated consecutive events: each run of equal events becomes one event with its count and duration.

Only boundary rows (events that differ from their predecessor) are kept; ``lead`` over these starts gives where a run ends.
A sequence is cut into blocks of positions, so that a sequence of any length is never one task: runs are found within
blocks, and only runs that touch an edge of a block (two a block at most) are put together over the whole sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.expr import let
from tracewright.llm.text import folded

BLOCK = 4096
NEAR_SECONDS = 0.5


def collapse_runs(
    df: DataFrame,
    key: str,
    pos: str,
    event: Column,
    same: Callable[[Column, Column], Column],
    start: Column,
    end: Column,
    order: tuple[str, ...] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Maximal runs of equal consecutive events of each ``key`` in order of ``pos``.

    ``event`` is a struct that ``same`` compares for two consecutive rows; ``start`` and ``end`` are timestamps (null allowed).
    Rows with the same ``(key, pos)`` are one event: the first by ``order``. Rows without key or position are left out.
    Returns ``(key, first_pos, last_pos, n, started_at, ended_at, seconds, event)``; an empty table gives no rows. Columns of
    ``df`` that are not named are dropped before anything is shuffled.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(pos).isNotNull()).select(
        F.col(key).alias("k"), F.col(pos).cast("long").alias("p"), event.alias("e"), start.alias("t0"), end.alias("t1"),
        F.struct(*[F.col(c) for c in order] or [F.lit(0)]).alias("o"),
    ).withColumn("b", F.floor(F.col("p") / block))
    w = W.partitionBy("k", "b").orderBy("p", "o")
    once = rows.withColumn("again", F.coalesce(F.lag("p").over(w) == F.col("p"), F.lit(False)))
    once = once.where(~F.col("again")).drop("again")
    near = once.withColumns({
        "rn": F.row_number().over(w), "pe": F.lag("e").over(w), "pp": F.lag("p").over(w), "pt": F.lag("t1").over(w), "tail": F.lead("p").over(w).isNull(),
    })
    near = near.withColumn("head", (F.col("rn") == 1) | ~F.coalesce(same(F.col("pe"), F.col("e")), F.lit(False)))
    kept = near.where(F.col("head") | F.col("tail"))
    nxt = lambda c: F.lead(c).over(w)
    kept = kept.withColumns({"nh": nxt("head"), "n_rn": nxt("rn"), "n_p": nxt("p"), "n_pp": nxt("pp"), "n_t1": nxt("t1"), "n_pt": nxt("pt"), "n_pe": nxt("pe"), "n_e": nxt("e")})
    by_next = lambda alone, before, tail: F.when(F.col("nh").isNull(), alone).when(F.col("nh"), before).otherwise(tail)
    runs = kept.where("head").select(
        "k", "b", F.col("p").alias("first_pos"), by_next(F.col("p"), F.col("n_pp"), F.col("n_p")).alias("last_pos"),
        by_next(F.lit(1), F.col("n_rn") - F.col("rn"), F.col("n_rn") - F.col("rn") + 1).cast("long").alias("n"),
        F.col("t0").alias("started_at"), by_next(F.col("t1"), F.col("n_pt"), F.col("n_t1")).alias("ended_at"),
        F.col("e").alias("event"), by_next(F.col("e"), F.col("n_pe"), F.col("n_e")).alias("last_event"),
        (F.col("rn") == 1).alias("at_head"), (F.col("nh").isNull() | ~F.col("nh")).alias("at_tail"),
    )
    edge = (F.col("at_head") & (F.col("b") > 0)) | F.col("at_tail")
    inner = runs.where(~edge)
    we = W.partitionBy("k").orderBy("first_pos")
    edges = runs.where(edge).withColumns({
        "pl": F.lag("last_event").over(we), "p_tail": F.lag("at_tail").over(we), "pp": F.lag("last_pos").over(we), "pt": F.lag("ended_at").over(we),
        "sum": F.sum("n").over(we.rowsBetween(W.unboundedPreceding, 0)), "final": F.lead("n").over(we).isNull(),
    })
    joins = F.col("at_head") & F.coalesce(F.col("p_tail"), F.lit(False)) & F.coalesce(same(F.col("pl"), F.col("event")), F.lit(False))
    edges = edges.withColumn("head", ~joins).where(F.col("head") | F.col("final"))
    nxe = lambda c: F.lead(c).over(we)
    edges = edges.withColumns({"nh": nxe("head"), "n_pp": nxe("pp"), "n_pt": nxe("pt"), "n_last": nxe("last_pos"), "n_end": nxe("ended_at"), "n_sum": nxe("sum"), "n_n": nxe("n")})
    merged = edges.where("head").select(
        "k", "first_pos", by_next(F.col("last_pos"), F.col("n_pp"), F.col("n_last")).alias("last_pos"),
        by_next(F.col("n"), F.col("n_sum") - F.col("n_n") - F.col("sum") + F.col("n"), F.col("n_sum") - F.col("sum") + F.col("n")).alias("n"),
        "started_at", by_next(F.col("ended_at"), F.col("n_pt"), F.col("n_end")).alias("ended_at"), "event",
    )
    both = inner.select(*merged.columns).unionByName(merged)
    return both.select(
        F.col("k").alias(key), F.col("first_pos").cast("int").alias("first_pos"), F.col("last_pos").cast("int").alias("last_pos"), "n", "started_at", "ended_at",
        ((F.unix_micros("ended_at") - F.unix_micros("started_at")) / F.lit(1e6)).alias("seconds"), "event",
    )


def action_event(output: Column) -> Column:
    """What an output asks for, as ``STRUCT<kind, text, num, start, end>``.

    Readable outputs (a JSON object with ``action.type``, in a code fence or not) give type, numbers and loose answer content.
    Others give the kind ``?`` and a digest of the text without white space. Null gives the digest of an empty text.
    """
    body = F.when(F.contains(output, F.lit("```")), F.regexp_replace(output, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", "")).otherwise(output)
    v = let(body, lambda b: F.try_parse_json(F.when(b.rlike(r"^\s*\{") & b.rlike(r"\}\s*$"), b)))
    raw = F.md5(F.regexp_replace(F.coalesce(output, F.lit("")), r"[\s 　]+", "").cast("binary"))

    def asked(v: Column) -> Column:
        get = lambda path, kind: F.try_variant_get(v, path, kind)
        kind = F.regexp_replace(folded(get("$.action.type", "string")), r"[^\p{L}\p{N}]", "")
        content = F.regexp_replace(folded(get("$.action.content", "string")), r"(?<!\d)\.|\.(?!\d)|[^\p{L}\p{N}.]", "")
        return F.struct(kind.alias("kind"), F.coalesce(content, F.lit("")).alias("text"), get("$.action.num", "double").alias("num"), get("$.action.start", "double").alias("start"), get("$.action.end", "double").alias("end"))

    none = F.lit(None).cast("double")
    unread = F.struct(F.lit("?").alias("kind"), raw.alias("text"), none.alias("num"), none.alias("start"), none.alias("end"))
    return let(let(v, asked), lambda e: F.when(F.coalesce(e["kind"], F.lit("")) != "", e).otherwise(unread))


def same_action(a: Column, b: Column) -> Column:
    """Whether two action events ask for the same: type, ``num`` and content equal, ``start`` and ``end`` under half a second apart."""
    near = lambda f: F.coalesce(F.abs(a[f] - b[f]) < NEAR_SECONDS, a[f].isNull() & b[f].isNull())
    return (a["kind"] == b["kind"]) & (a["text"] == b["text"]) & a["num"].eqNullSafe(b["num"]) & near("start") & near("end")


def step_runs(steps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Runs of equal actions in the trajectories of a step log; redelivered rows (same trajectory and step) count once."""
    ended = F.timestamp_micros(F.unix_micros("started_at") + (F.coalesce("step_wall_seconds", F.lit(0.0)) * 1e6).cast("long"))
    return collapse_runs(steps, "traj_id", "step", action_event(F.col("output")), same_action, F.col("started_at"), ended, ("ingested_at",), block)


def field_runs(df: DataFrame, key: str, column: str) -> DataFrame:
    """Runs of equal entries in a separated field: ``(key, first_pos, last_pos, n, event)``; positions count from 1.

    Entries are compared by letters and digits only, without case. Equal rows give their runs once; null and blank fields none.
    The boundary rows are found inside the row, as array positions whose entry differs from the one before.
    """
    cut = F.split(F.regexp_replace(F.col(column), r"^[\s,;|>/]+|[\s,;|>/]+$", ""), r"\s*(?:->|=>|→|[,;|>/\n])\s*")
    rows = df.where(F.col(key).isNotNull() & F.col(column).rlike(r"[\p{L}\p{N}]")).select(F.col(key).alias("k"), F.transform(cut, lambda x: F.regexp_replace(folded(x), r"[^\p{L}\p{N}]", "")).alias("a"))
    rows = rows.distinct().withColumn("starts", F.filter(F.sequence(F.lit(1), F.size("a")), lambda i: (i == 1) | (F.get("a", i - 1) != F.get("a", i - 2))))
    runs = F.transform("starts", lambda s, j: F.struct(s.alias("first_pos"), (F.coalesce(F.get("starts", j + 1), F.size("a") + 1) - 1).alias("last_pos"), F.get("a", s - 1).alias("event")))
    out = rows.select("k", F.inline(F.filter(runs, lambda r: r["last_pos"] >= r["first_pos"])))
    return out.select(F.col("k").alias(key), "first_pos", "last_pos", (F.col("last_pos") - F.col("first_pos") + 1).cast("long").alias("n"), "event")
