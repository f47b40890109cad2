"""Replayable per-trajectory state: the same rules as a stream operator and as an ordered batch fold."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "traj_id string, cur_step long, reward double, retries long, done boolean, reason string"


def step_rule(state: tuple[int, float, int, bool], valid: bool, reward: float, answer: bool, max_steps: int, max_retries: int) -> tuple[int, float, int, bool, str | None]:
    """One step: ``(steps, reward, retries, done, reason)``. A finished trajectory rejects further steps; an invalid one is a retry."""
    steps, total, retries, done = state
    if done:
        return steps, total, retries, True, "ENV_ALREADY_DONE"
    steps += 1
    if not valid:
        retries += 1
        if retries > max_retries:
            return steps, total, retries, True, "RETRIES_EXCEEDED"
    else:
        total += reward
    if answer and valid:
        return steps, total, retries, True, "ANSWER"
    if steps >= max_steps:
        return steps, total, retries, True, "STEP_LIMIT_REACHED"
    return steps, total, retries, False, None


class TrajectoryState(StatefulProcessor):
    """Stream form, keyed by trajectory; the rows of a batch are taken in order of their step, over all their Arrow batches.

    With ``keep_done`` (milliseconds of processing time) a finished trajectory is remembered for that long, in which later steps of it
    are rejected; then its state is cleared, so that state does not grow with the trajectories that have been. Without it
    finished trajectories are remembered for good, which is for streams that end.
    """

    def __init__(self, max_steps: int = 52, max_retries: int = 3, keep_done: int | None = None):
        self.max_steps, self.max_retries, self.keep_done = max_steps, max_retries, keep_done

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "steps long, reward double, retries long, done boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else (0, 0.0, 0, False)
        was_done = state[3]
        batch = pd.concat(list(rows), ignore_index=True).sort_values("cur_step", kind="stable")
        out = []
        for valid, reward, answer in zip(batch["valid"], batch["reward"], batch["answer"], strict=True):
            *new, reason = step_rule(state, valid is None or pd.isna(valid) or bool(valid), 0.0 if reward is None or pd.isna(reward) else float(reward), not (answer is None or pd.isna(answer)) and bool(answer), self.max_steps, self.max_retries)
            state = tuple(new)
            out.append((key[0], *state, reason))
        self.state.update(state)
        if state[3] and not was_done and self.keep_done is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_done)
        yield pd.DataFrame(out, columns=["traj_id", "cur_step", "reward", "retries", "done", "reason"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """The mark of a finished trajectory ends."""
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_states(steps: DataFrame, max_steps: int = 52, max_retries: int = 3, keep_done: int | None = None) -> DataFrame:
    """A streaming frame ``(traj_id, cur_step, valid, reward, answer)`` to its states; state outlives batches and restarts.

    ``keep_done`` is how long, in milliseconds of processing time, a finished trajectory is remembered; such a stream runs on until it is
    stopped, since its timers are due whether rows come or not.
    """
    own = TrajectoryState(max_steps, max_retries, keep_done)
    return steps.groupBy("traj_id").transformWithStateInPandas(statefulProcessor=own, outputStructType=STATE, outputMode="Append", timeMode="None" if keep_done is None else "ProcessingTime")


def replay(steps: DataFrame, max_steps: int = 52, max_retries: int = 3) -> DataFrame:
    """Batch form: the final state of each trajectory by an ordered fold over its steps (a trajectory's steps are one row)."""
    item = F.struct("cur_step", F.coalesce("valid", F.lit(True)).alias("v"), F.coalesce("reward", F.lit(0.0)).alias("r"), F.coalesce("answer", F.lit(False)).alias("a"))
    per = steps.groupBy("traj_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    zero = F.struct(F.lit(0).cast("long").alias("steps"), F.lit(0.0).alias("reward"), F.lit(0).cast("long").alias("retries"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("reason"))

    def fold(s, x):
        steps_, retries = s["steps"] + 1, s["retries"] + F.when(x["v"], 0).otherwise(1)
        total = s["reward"] + F.when(x["v"], x["r"]).otherwise(0.0)
        reason = F.when(~x["v"] & (retries > max_retries), "RETRIES_EXCEEDED").when(x["v"] & x["a"], "ANSWER").when(steps_ >= max_steps, "STEP_LIMIT_REACHED")
        new = F.struct(steps_.alias("steps"), total.alias("reward"), retries.alias("retries"), reason.isNotNull().alias("done"), reason.alias("reason"))
        return F.when(s["done"], s).otherwise(new)

    return per.select("traj_id", F.aggregate("s", zero, fold).alias("f")).select("traj_id", "f.*")


def alive_pool(traj_steps: list[int], world: int) -> list[list[int]]:
    """Which trajectories run in each round: those still alive, in chunks of ``world``; a trajectory leaves when its steps are used."""
    left = list(traj_steps)
    rounds = []
    while any(left):
        alive = [i for i, n in enumerate(left) if n]
        rounds += [alive[i : i + world] for i in range(0, len(alive), world)]
        for i in alive:
            left[i] -= 1
    return rounds


def sample_until(batches: Iterator[DataFrame], keep, groups: int, uid: str, tries: int) -> DataFrame:
    """Filtered batches gathered until there are enough groups; too many tries are an error. Only group counts reach the driver."""
    got, out = 0, None
    for _ in range(tries):
        batch = keep(next(batches))
        out = batch if out is None else out.unionByName(batch)
        got += batch.select(uid).distinct().count()
        if got >= groups:
            return out
    raise RuntimeError(f"{got} of {groups} groups after {tries} tries")


def append_messages(df: DataFrame, messages: str, new: str, mask: str, new_mask: str, max_len: int) -> DataFrame:
    """Token ids and loss mask extended by a new message and cut to the model length."""
    return df.withColumns({messages: F.slice(F.concat(messages, new), 1, max_len), mask: F.slice(F.concat(mask, new_mask), 1, max_len)})


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` per window and keys; with ``late`` a watermark drops what is later (streams)."""
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, ts: str, width: str, slide: str) -> DataFrame:
    return events.groupBy(F.window(ts, width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    """Sessions of a key: stretches without a gap as long as ``gap``."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("start"), "n", "total")


def dedupe_stream(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Each key once within the watermark: append-and-resume without reading the log again."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
