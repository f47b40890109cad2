"""Trajectory ETL: filters, duplicates, exports, enrichment, quota merge. Order within a file is the explicit ``line`` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.grouping import with_group_stats
from tracewright.operators.ranks import kth
from tracewright.session import materialize

STEP_LIMIT, TOKEN_LIMIT = "STEP_LIMIT_REACHED", "TOKEN_LIMIT_EXCEEDED"
# Error codes of the environment itself.
ENV_ERRORS = ["FFMPEG_AUDIO_FAIL", "FFMPEG_CLIP_FAIL", "FFMPEG_FRAME_FAIL"]


def winning_trajectories(steps: DataFrame, traj: str = "traj_id", min_steps: int = 2, reward: float = 0.5) -> DataFrame:
    """Step rows of trajectories with a win flag, a best episode reward over ``reward`` and at least ``min_steps`` steps."""
    per = steps.groupBy(traj).agg(F.coalesce(F.bool_or("won"), F.lit(False)).alias("w"), F.max("episode_reward").alias("r"), F.max("cur_step").alias("n"))
    kept = per.where(F.col("w") & (F.col("r") > reward) & (F.col("n") + 1 >= min_steps)).select(traj)
    return steps.join(kept, traj, "left_semi")


def best_per_sample(steps: DataFrame, sample: list[str], traj: str = "traj_id", line: str = "line") -> DataFrame:
    """``(traj)`` of the trajectory kept per sample: the last that won, else the last; order is that of the first line."""
    t = steps.groupBy(traj).agg(F.min(line).alias("first"), F.coalesce(F.max_by("won", line), F.lit(False)).alias("won"), *[F.min_by(c, line).alias(c) for c in sample])
    return t.groupBy(*sample).agg(F.max_by(traj, F.struct("won", "first")).alias(traj)).select(traj)


def sft_export(steps: DataFrame, sample: list[str], max_steps: int, traj: str = "traj_id", line: str = "line") -> DataFrame:
    """Clean steps (no error code) of the kept trajectories that won within ``max_steps`` steps, errors counted in the length."""
    kept = best_per_sample(steps, sample, traj, line)
    per = steps.groupBy(traj).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max_by("won", line), F.lit(False)).alias("won"))
    good = per.where(F.col("won") & (F.col("n") <= max_steps)).join(kept, traj, "left_semi").select(traj)
    return steps.join(good, traj, "left_semi").where(F.coalesce("error_code", F.lit("")) == "")


def rl_negatives(steps: DataFrame, fields: list[str], exclude: list[str], traj: str = "traj_id", line: str = "line") -> DataFrame:
    """One row per lost trajectory whose last error is not excluded: its last fields and the reason (default LOGIC_WRONG_ANSWER)."""
    last = steps.groupBy(traj).agg(F.max_by(F.struct("won", "error_code", *fields), line).alias("r")).select(traj, "r.*")
    err = F.coalesce("error_code", F.lit(""))
    lost = last.where(~F.coalesce("won", F.lit(False)) & ~err.isin(exclude))
    return lost.select(traj, *fields, F.when(err == "", "LOGIC_WRONG_ANSWER").otherwise(err).alias("error_reason"))


def purge_incomplete(results: DataFrame, mcq: Column, n_options: Column, attempts: str = "attempts", win: str = "win") -> DataFrame:
    """Results that are complete: won, or with as many attempts as allowed (options + 1 for choices, else 5)."""
    allowed = F.when(mcq, F.coalesce(n_options, F.lit(0)) + 1).otherwise(F.lit(5))
    return results.where(~((F.col(attempts) < allowed) & (F.col(win) == F.lit(False))))


def first_line_per(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in order; rows without a key are all kept."""
    cols = [c for c in df.columns if c != key]
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return first.select(key, "_r.*").unionByName(df.where(F.col(key).isNull()))


def resume(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows not done yet; null keys match null keys."""
    d = done.select(*key).distinct().withColumnsRenamed({k: f"_{k}" for k in key})
    cond = None
    for k in key:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        cond = c if cond is None else cond & c
    return todo.join(d, cond, "left_anti")


def enrich(df: DataFrame, meta: DataFrame, keys: list[str], value: str, order: str, default: str = "UNKNOWN") -> DataFrame:
    """``value`` of the metadata by trimmed keys, the last duplicate wins, ``default`` where there is none."""
    m = meta.groupBy(*[F.trim(F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(value, order).alias(f"_{value}"))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & (F.trim(df[k]) == m[f"_k{i}"])
    out = df.join(m, cond, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    return out.withColumn(value, F.coalesce(F.col(f"_{value}"), F.lit(default))).drop(f"_{value}")


def ranked_trajectories(steps: DataFrame, n: int, which: str = "top", traj: str = "traj_id", line: str = "line") -> DataFrame:
    """Rows of the first or last ``n`` trajectories by first appearance, or of ``n`` evenly spaced ones (``even``).

    The order is over trajectories, not rows, and only the ``n`` chosen ones are collected into a join.
    """
    first = steps.groupBy(traj).agg(F.min(line).alias("_first"))
    if which in ("top", "bottom"):
        kept = first.orderBy(F.asc("_first") if which == "top" else F.desc("_first")).limit(n).select(traj)
    elif which == "even":
        from tracewright.operators.frame import number

        total = first.count()
        at = [int(i * total / n) for i in range(min(n, total))]
        ids = steps.sparkSession.createDataFrame([(i,) for i in sorted(set(at))], "row_id long")
        kept = number(first, ["_first", traj]).join(F.broadcast(ids), "row_id", "left_semi").select(traj)
    else:
        raise ValueError(which)
    return steps.join(kept, traj, "left_semi")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in seeded hash order of the key: the reproducible sample.

    The hash of rank ``n`` is found by counting in ranges; rows of a smaller one are in, and of those that share it as many, in order of the
    key, as are left. So one task holds the rows of a single hash at most.
    """
    h = F.xxhash64(key, F.lit(seed))
    at = kth(df, [h], n)
    if at is None:
        return df if n > 0 else df.where(F.lit(False))
    edge = F.lit(at[0])
    under = df.where(h < edge)
    return under.unionByName(df.where(h == edge).orderBy(key).limit(n - under.count()))


def best_attempt(df: DataFrame, key: str, attempt: str, won: str, reward: str) -> DataFrame:
    """One row per key: the first attempt that won, else the best reward (first of equal ones); and the attempts counted up to a win."""
    first_win = F.min(F.when(F.col(won), F.col(attempt)))
    best = F.max_by(F.col(attempt), F.struct(F.col(reward), -F.col(attempt)))
    return df.groupBy(key).agg(F.coalesce(first_win, best).alias("attempt"), F.coalesce(first_win, F.count(F.lit(1))).cast("long").alias("attempts"), F.coalesce(F.bool_or(won), F.lit(False)).alias("win"))


def first_pass(df: DataFrame, traj: str, retries: str, won: str, reward: str) -> DataFrame:
    """Success and reward that count only without retries."""
    clean = F.coalesce(F.col(retries), F.lit(0)) == 0
    return df.withColumns({"first_pass": F.when(clean, F.col(won)).otherwise(F.lit(False)), "first_pass_reward": F.when(clean, F.col(reward)).otherwise(F.lit(0.0))})


def quota_segments(sizes: dict[str, int], classes: dict[str, dict]) -> list[tuple[dict[str, int], int]]:
    """What each batch takes from each bucket, as ``(rows per bucket, batches of that kind in a row)``.

    Batches are alike until a bucket runs short, so the plan is a few segments however many batches there are. The buckets' sizes are
    all that is needed.

    A class has a ``total`` per batch, ``first`` (bucket: fixed share) and up to two ``fill`` buckets that halve the rest, one
    standing in for the other. Batches end when a class has fewer rows left than a batch needs.
    """
    left = dict(sizes)
    plan: list[tuple[dict[str, int], int]] = []

    def take(b: str, n: int) -> int:
        got = min(left.get(b, 0), max(n, 0))
        left[b] = left.get(b, 0) - got
        return got

    while all(sum(left.get(b, 0) for b in [*c.get("first", {}), *c.get("fill", [])]) >= c["total"] for c in classes.values()) and classes:
        batch: dict[str, int] = {}
        for c in classes.values():
            for b, n in c.get("first", {}).items():
                batch[b] = take(b, min(n, c["total"]))
            gap = c["total"] - sum(batch.get(b, 0) for b in c.get("first", {}))
            fill = c.get("fill", [])
            if len(fill) == 1:
                batch[fill[0]] = take(fill[0], gap)
            elif len(fill) == 2:
                a, b = fill
                batch[a], batch[b] = take(a, gap // 2), take(b, gap - gap // 2)
                if batch[a] < gap // 2:
                    batch[b] += take(b, gap // 2 - batch[a])
                elif batch[b] < gap - gap // 2:
                    batch[a] += take(a, gap - gap // 2 - batch[b])
        # as long as every bucket still holds what it has just given, and no more was asked of it than it had, the next batch is the same
        more = min((left[b] // n for b, n in batch.items() if n), default=0)
        if more and all(sum(left[b] for b in [*c.get("first", {}), *c.get("fill", [])]) >= c["total"] for c in classes.values()):
            more = min(more, *((sum(left[b] for b in [*c.get("first", {}), *c.get("fill", [])])) // c["total"] for c in classes.values()))
            for b, n in batch.items():
                left[b] -= n * more
        else:
            more = 0
        if plan and plan[-1][0] == batch:
            plan[-1] = (batch, plan[-1][1] + 1 + more)
        else:
            plan.append((batch, 1 + more))
        if not any(batch.values()):
            break
    return plan


def quota_plan(sizes: dict[str, int], classes: dict[str, dict]) -> list[dict[str, int]]:
    """The batches of :func:`quota_segments` one by one."""
    return [batch for batch, n in quota_segments(sizes, classes) for _ in range(n)]


def quota_merge(df: DataFrame, bucket: str, row: str, classes: dict[str, dict], seed: int = 42) -> DataFrame:
    """``batch`` of every row that a whole batch takes, rows of a bucket in seeded hash order, shuffled within the batch by hash.

    Ranks are dense per bucket. Within a segment of like batches a rank's batch is a quotient, so the plan is a short list a bucket.
    """
    from tracewright.operators.frame import number

    sizes = {r[0]: r[1] for r in df.groupBy(bucket).count().where(F.col(bucket).isin([b for c in classes.values() for b in [*c.get("first", {}), *c.get("fill", [])]])).collect()}
    segments: dict[str, list[tuple[int, int, int, int]]] = {}
    done = 0
    for batch, times in quota_segments(sizes, classes):
        for b, n in batch.items():
            if n:
                own = segments.setdefault(b, [])
                lo = own[-1][1] if own else 0
                own.append((lo, lo + n * times, n, done))
        done += times
    if not segments:
        return df.withColumn("batch", F.lit(None).cast("long")).where(F.lit(False))
    # numbers are dense over the buckets in their order, so a bucket starts where those before it end
    rows, start = [], 0
    for b in sorted(segments, key=lambda b: b.encode()):
        rows.append((b, start, segments[b]))
        start += sizes[b]
    plan = df.sparkSession.createDataFrame(rows, f"`{bucket}` string, _start long, _segs array<struct<lo: long, hi: long, n: long, first: long>>")
    ranked = number(df.where(F.col(bucket).isin(list(segments))).withColumn("_h", F.xxhash64(row, F.lit(seed))), [bucket, "_h", row], "_n")
    ranked = ranked.join(F.broadcast(plan), bucket).withColumn("_rank", F.col("_n") - F.col("_start"))  # one row a bucket of the plan
    ranked = ranked.withColumn("_seg", F.get(F.filter("_segs", lambda s: (s["lo"] <= F.col("_rank")) & (F.col("_rank") < s["hi"])), F.lit(0))).where("_seg IS NOT NULL")
    return ranked.withColumn("batch", F.col("_seg.first") + F.floor((F.col("_rank") - F.col("_seg.lo")) / F.col("_seg.n")).cast("long")).drop("_n", "_h", "_start", "_segs", "_rank", "_seg")


def all_pairs_score(df: DataFrame, group: str, value: str) -> DataFrame:
    """Each row with how many rows of its group are under it: what an all-pairs comparison counts, without the pairs."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    # equal values are counted before they are put in order, so a hot group brings its distinct values only; a group of very many is
    # cut into ranges by value, whose sizes come first
    from pyspark.sql import Window as W

    ranged = materialize(counts.repartitionByRange(group, value).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(group, "_part").agg(F.sum("_n").alias("_m"))
    before = sizes.select(F.col(group).alias("_bg"), F.col("_part").alias("_bp"), (F.sum("_m").over(W.partitionBy(group).orderBy("_part")) - F.col("_m")).alias("_before"))
    run = F.sum("_n").over(W.partitionBy("_part", group).orderBy(value)) - F.col("_n")
    below = ranged.withColumn("_run", run).join(before, F.col(group).eqNullSafe(F.col("_bg")) & (F.col("_part") == F.col("_bp"))).select(F.col(group).alias("_g"), F.col(value).alias("_v"), (F.col("_before") + F.col("_run")).alias("below"))
    return df.join(below, df[group].eqNullSafe(below["_g"]) & df[value].eqNullSafe(below["_v"])).drop("_g", "_v")


def adjacent_pairs(df: DataFrame, row: str, score: str, fields: list[str]) -> DataFrame:
    """Rows 2k and 2k+1 as chosen and rejected by score; the first wins a tie."""
    key = F.struct(F.col(score), -F.col(row))
    g = df.groupBy(F.floor(F.col(row) / 2).alias("pair")).agg(F.max_by(F.struct(row, *fields), key).alias("chosen"), F.min_by(F.struct(row, *fields), key).alias("rejected"), F.count(F.lit(1)).alias("_n"))
    return g.where("_n = 2").drop("_n")


def chosen_rejected_rows(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """Two rows per pair: the chosen text with label 1, the rejected one with 0."""
    both = F.array(F.struct(F.col(chosen).alias("text"), F.lit(1).alias("label")), F.struct(F.col(rejected).alias("text"), F.lit(0).alias("label")))
    return df.withColumn("_x", F.explode(both)).select("*", "_x.text", "_x.label").drop("_x", chosen, rejected)


def group_share(df: DataFrame, key: str) -> DataFrame:
    """Each row with the size of its group."""
    return with_group_stats(df, [key], {"group_n": F.count(F.lit(1))})


def prompt_row(df: DataFrame, source: str, question: Column, suffix: str, answer: Column, split: str, row: str, ability: str = "math") -> DataFrame:
    """A prepared dataset row: data source, prompt messages, ability, reward model and extra info, from a question and its truth."""
    return df.select(
        F.lit(source).alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), F.concat(question, F.lit(suffix)).alias("content"))).alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), answer.alias("ground_truth")).alias("reward_model"), F.struct(F.lit(split).alias("split"), F.col(row).alias("index")).alias("extra_info"),
    )
