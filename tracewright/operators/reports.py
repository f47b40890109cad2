"""Reports over trajectories, runs and evaluation results.

A step log has one row per delivered step; :func:`canonical_steps` counts a redelivered step once. Reports aggregate steps to
trajectories and trajectories to the report with hash aggregation, so a hot question or run is combined before it is shuffled.
Null validity counts as valid, a null or blank error code as none. Empty logs give empty reports or one row of nulls and zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators.ranks import quantile
from tracewright.session import materialize

STEP_FIELDS = ["run_id", "question_id", "action_type", "output", "step_reward", "episode_reward", "generation_seconds", "env_step_seconds", "step_wall_seconds", "video", "question_type", "won", "valid", "error_code", "duration"]


def canonical_steps(steps: DataFrame) -> DataFrame:
    """``(traj_id, cur_step, ...)``: each step of a trajectory once, the first delivered; steps count from 0.

    The deliveries of a step are numbered by one window over its key: one shuffle and one sort, and fields which a report does not use
    are neither read nor shuffled. Of deliveries at the same time any one counts.
    """
    x = F.col("extra_info")
    nested = {"video": "video", "question_type": "question_type", "won": "won", "valid": "is_action_valid", "error_code": "error_code", "duration": "duration_seconds"}
    flat = steps.where(F.col("traj_id").isNotNull() & F.col("step").isNotNull()).select(
        "traj_id", (F.col("step") - 1).alias("cur_step"), "ingested_at", *[x[nested[f]].alias(f) if f in nested else F.col(f) for f in STEP_FIELDS]
    )
    delivery = F.row_number().over(W.partitionBy("traj_id", "cur_step").orderBy("ingested_at"))
    return flat.withColumn("_delivery", delivery).where("_delivery = 1").drop("_delivery", "ingested_at")


def has_error() -> Column:
    return F.coalesce(F.col("error_code"), F.lit("")) != ""


def is_valid() -> Column:
    return F.coalesce(F.col("valid"), F.lit(True)) & ~has_error()


def trajectories(steps: DataFrame) -> DataFrame:
    """One row per trajectory: last step's outcome, validity over all steps, first invalid step."""
    last = lambda c: F.max_by(c, "cur_step")
    return steps.groupBy("traj_id").agg(
        (F.max("cur_step") + 1).alias("n_steps"), F.count(F.lit(1)).alias("n_rows"), F.coalesce(last(F.coalesce("won", F.lit(False))), F.lit(False)).alias("won"),
        last(F.coalesce("episode_reward", F.lit(0.0))).alias("reward"), last("error_code").alias("final_error"), last(is_valid()).alias("valid_last"), F.bool_and(is_valid()).alias("all_valid"),
        F.min(F.when(~is_valid(), F.col("cur_step"))).alias("first_invalid"), last("question_type").alias("question_type"), last("run_id").alias("run_id"), last("question_id").alias("question_id"), last("duration").alias("duration"), last("video").alias("video"),
    )


def share(cond: Column) -> Column:
    """Share of rows for which the condition holds."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def traj_report(steps: DataFrame) -> DataFrame:
    """One row: accuracy, mean reward, validity with and without step-limited trajectories, accuracy of valid ones, step statistics, coverage."""
    t = materialize(trajectories(steps), "trajectories")
    limited = F.coalesce(F.col("final_error") == "STEP_LIMIT_REACHED", F.lit(False))
    stats = t.agg(F.avg("n_steps").alias("m"), F.coalesce(F.stddev_samp("n_steps"), F.lit(0.0)).alias("s"))
    bound = stats.select(F.col("m") + F.col("s")).scalar()
    n_valid = F.count_if("all_valid")
    return t.agg(
        F.count(F.lit(1)).alias("trajectories"), F.count_if("won").alias("wins"), share(F.col("won")).alias("accuracy"), F.avg("reward").alias("avg_reward"), share(F.col("all_valid")).alias("valid_ratio"),
        (n_valid / F.nullif(F.count(F.lit(1)) - F.count_if(limited), F.lit(0))).alias("valid_ratio_excl_limit"), (F.count_if(F.col("all_valid") & F.col("won")) / F.greatest(n_valid, F.lit(1))).alias("accuracy_valid"),
        F.avg("n_steps").alias("steps_mean"), F.coalesce(F.stddev_samp("n_steps"), F.lit(0.0)).alias("steps_std"), F.median("n_steps").alias("steps_median"), share(F.col("n_steps") <= bound).alias("coverage"),
    )


def step_buckets(steps: DataFrame) -> DataFrame:
    """Per number of steps: trajectories, wins, accuracy, share, valid last steps, mean reward."""
    t = materialize(trajectories(steps), "trajectories")
    total = t.agg(F.count(F.lit(1)).cast("double")).scalar()
    return t.groupBy("n_steps").agg(F.count(F.lit(1)).alias("trajectories"), F.count_if("won").alias("wins"), share(F.col("won")).alias("accuracy"), F.count_if("valid_last").alias("valid_last"), F.avg("reward").alias("avg_reward")).withColumn("share", F.col("trajectories") / total)


def action_name(c: Column) -> Column:
    """An action type without case, blanks and separators; null is 'unknown'."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), F.lit("")), F.lit("unknown"))


def action_distribution(steps: DataFrame) -> DataFrame:
    """Total, valid and invalid steps per action type."""
    return steps.groupBy(action_name(F.col("action_type")).alias("action")).agg(F.count(F.lit(1)).alias("total"), F.count_if(is_valid()).alias("valid"), F.count_if(~is_valid()).alias("invalid"))


def action_body(output: Column) -> Column:
    """The JSON text of an output, code fence off."""
    return F.regexp_replace(output, r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "")


def evidence(steps: DataFrame) -> DataFrame:
    """Per trajectory with valid evidence: frames asked for, clip and audio seconds (negative spans count 0)."""
    v = F.try_parse_json(F.when(F.col("body").rlike(r"\}\s*$"), F.col("body")))
    e = steps.where(is_valid()).select("traj_id", action_body(F.col("output")).alias("body")).select("traj_id", v.alias("v"))
    get = lambda p, t: F.try_variant_get("v", f"$.action.{p}", t)
    e = e.select("traj_id", action_name(get("type", "string")).alias("a"), get("num", "double").alias("num"), F.greatest(F.lit(0.0), F.coalesce(get("end", "double"), F.lit(0.0)) - F.coalesce(get("start", "double"), F.lit(0.0))).alias("sec"))
    e = e.where(F.col("a").isin("getframes", "getclip", "getaudio"))
    one = lambda a, x: F.sum(F.when(F.col("a") == a, x).otherwise(0.0))
    return e.groupBy("traj_id").agg(one("getframes", F.coalesce("num", F.lit(0.0))).alias("frames"), one("getclip", F.col("sec")).alias("clip"), one("getaudio", F.col("sec")).alias("audio"))


def first_invalid_steps(steps: DataFrame) -> DataFrame:
    return trajectories(steps).where(~F.col("all_valid")).groupBy("first_invalid").agg(F.count(F.lit(1)).alias("trajectories"))


def final_errors(steps: DataFrame) -> DataFrame:
    """Trajectories per error code of the last step."""
    return trajectories(steps).where(F.coalesce("final_error", F.lit("")) != "").groupBy(F.col("final_error").alias("error_code")).agg(F.count(F.lit(1)).alias("trajectories"))


def macro_accuracy(steps: DataFrame) -> DataFrame:
    """Mean over question types of their accuracy and reward."""
    per = trajectories(steps).groupBy("question_type").agg(share(F.col("won")).alias("a"), F.avg("reward").alias("r"))
    return per.agg(F.count(F.lit(1)).alias("types"), F.avg("a").alias("macro_accuracy"), F.avg("r").alias("macro_reward"))


def calibration(steps: DataFrame) -> DataFrame:
    """Per confidence of the final step (two decimals, halves to even): trajectories and accuracy; no confidence, no row."""
    last = steps.groupBy("traj_id").agg(F.max_by(F.struct("output", "won"), "cur_step").alias("r"))
    body = action_body(F.col("r.output"))
    c = F.try_variant_get(F.try_parse_json(F.when(body.rlike(r"\}\s*$"), body)), "$.confidence", "double")
    rows = last.select(F.bround(c, 2).alias("confidence"), F.coalesce("r.won", F.lit(False)).alias("won")).where("confidence IS NOT NULL")
    return rows.groupBy("confidence").agg(F.count(F.lit(1)).alias("trajectories"), share(F.col("won")).alias("accuracy"))


def duration_buckets(steps: DataFrame, minutes: float = 2.0) -> DataFrame:
    t = trajectories(steps).where("duration IS NOT NULL")
    return t.groupBy(F.floor(F.col("duration") / (60 * minutes)).alias("bucket")).agg(F.count(F.lit(1)).alias("trajectories"), share(F.col("won")).alias("accuracy"), F.avg("n_steps").alias("avg_steps"))


def step_report(steps: DataFrame, max_steps: int | None = None) -> DataFrame:
    """One row over all steps, or those under ``max_steps``: rows, valid, invalid, won, and trajectories that failed at their limit."""
    t = trajectories(steps)
    failed = t.agg(F.count_if(~F.col("won") & (F.coalesce("final_error", F.lit("")) == "STEP_LIMIT_REACHED"))).scalar()
    rows = steps if max_steps is None else steps.where(F.col("cur_step") < max_steps)
    return rows.agg(F.count(F.lit(1)).alias("n_steps"), F.count_if(is_valid()).alias("valid"), F.count_if(~is_valid()).alias("invalid"), F.count_if(F.coalesce("won", F.lit(False))).alias("won")).withColumn("failed_at_limit", failed)


def validity_by_step(steps: DataFrame) -> DataFrame:
    """Records and valid records per step."""
    v = F.coalesce("valid", F.lit(True))
    return steps.groupBy("cur_step").agg(F.count(F.lit(1)).alias("total"), F.count_if(v).alias("valid_rows"), share(v).alias("ratio"))


def validity_by_step_over_runs(steps: DataFrame) -> DataFrame:
    """Share of wholly valid trajectories per step and run, averaged over the runs that have the step."""
    v = F.coalesce("valid", F.lit(True))
    per = steps.where("run_id IS NOT NULL").groupBy("run_id", "traj_id").agg(F.bool_and(v).alias("ok"), F.collect_set("cur_step").alias("steps"))
    rows = per.select("run_id", "ok", F.explode("steps").alias("cur_step")).groupBy("run_id", "cur_step").agg(share(F.col("ok")).alias("r"))
    return rows.groupBy("cur_step").agg(F.avg("r").alias("avg_ratio"), F.count(F.lit(1)).alias("runs"))


def run_table(steps: DataFrame) -> DataFrame:
    """Per run: trajectories, valid ones, wins, ratios."""
    v = F.coalesce("valid", F.lit(True))
    t = steps.where("run_id IS NOT NULL").groupBy("run_id", "traj_id").agg(F.bool_and(v).alias("ok"), F.coalesce(F.max_by("won", "cur_step"), F.lit(False)).alias("won"))
    return t.groupBy("run_id").agg(F.count(F.lit(1)).alias("trajectories"), F.count_if("ok").alias("valid_trajectories"), F.count_if("won").alias("wins"), share(F.col("ok")).alias("valid_ratio"), share(F.col("won")).alias("accuracy"))


def run_success(steps: DataFrame, key: str = "run_id") -> DataFrame:
    """Success per run with the sort key of its name's number (missing: 2^60), and the macro mean of all runs."""
    t = trajectories(steps).where(F.col(key).isNotNull())
    per = t.groupBy(key).agg(F.count(F.lit(1)).alias("trajectories"), share(F.col("won")).alias("accuracy"), F.avg("n_steps").alias("avg_steps"))
    macro = per.agg(F.avg("accuracy")).scalar()
    number = F.coalesce(F.nullif(F.regexp_extract(key, r"(\d+)", 1), F.lit("")).cast("long"), F.lit(1 << 60))
    return per.withColumns({"order_key": number, "macro_accuracy": macro})


def union_accuracy(results: DataFrame, run: str, question: str, reward: str, threshold: float = 0.5) -> DataFrame:
    """One row: questions in any run, right in any run, in every run, right in every run, and the rates."""
    ok = F.col(reward) >= threshold
    runs = results.agg(F.count_distinct(run)).scalar()
    q = results.groupBy(question).agg(F.bool_or(ok).alias("any_ok"), F.count_distinct(run).alias("n"), F.count_distinct(F.when(ok, F.col(run))).alias("n_ok")).withColumn("runs", runs)
    every = F.col("n") == F.col("runs")
    all_ok = F.col("n_ok") == F.col("runs")
    return q.agg(
        F.count(F.lit(1)).alias("questions"), F.count_if("any_ok").alias("correct_any"), share(F.col("any_ok")).alias("union_accuracy"), F.count_if(every).alias("in_every"), F.count_if(all_ok).alias("correct_every"),
        (F.count_if(all_ok) / F.nullif(F.count_if(every), F.lit(0))).alias("all_correct_ratio"), ((F.count_if(every) - F.count_if(all_ok)) / F.nullif(F.count_if(every), F.lit(0))).alias("inconsistent_rate"),
    )


def run_difference(results: DataFrame, run: str, question: str, reward: str, a: str, b: str, threshold: float = 0.5) -> DataFrame:
    """Questions that both runs have and that only one has right."""
    one = lambda r, n: results.where(F.col(run) == r).groupBy(question).agg(F.max(reward).alias(n))
    both = one(a, "reward_a").join(one(b, "reward_b"), question)
    return both.where((F.col("reward_a") >= threshold) != (F.col("reward_b") >= threshold))


def log_stats(steps: DataFrame, strict: bool = False) -> DataFrame:
    """One row: lines, trajectories, mean, least and largest duration of the first record per trajectory (0 counts as unset unless strict)."""
    first = steps.groupBy("traj_id").agg(F.min_by("duration", "cur_step").alias("d"), F.count(F.lit(1)).alias("n"))
    d = F.col("d") if strict else F.coalesce("d", F.lit(0.0))
    least = F.min(F.when(F.col("d") > 0, F.col("d")))
    return first.agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("trajectories"), F.avg(d).alias("mean_duration"), least.alias("min_duration"), F.max("d").alias("max_duration"))


def type_histogram(steps: DataFrame) -> DataFrame:
    """Trajectories per question type of their first record, with percentages."""
    first = steps.groupBy("traj_id").agg(F.min_by("question_type", "cur_step").alias("question_type"))
    total = first.agg(F.count(F.lit(1)).cast("double")).scalar()
    return first.groupBy("question_type").agg(F.count(F.lit(1)).alias("trajectories")).withColumn("percent", F.col("trajectories") * 100 / total)


def run_totals(steps: DataFrame) -> DataFrame:
    """Per run turns, valid turns and trajectories; the trajectories of all runs are counted once, not summed."""
    everything = steps.agg(F.count_distinct("traj_id")).scalar()
    per = steps.where("run_id IS NOT NULL").groupBy("run_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.coalesce("valid", F.lit(True))).alias("valid_turns"), F.count_distinct("traj_id").alias("trajectories"))
    return per.withColumn("all_trajectories", everything)


def size_stats(df: DataFrame, col: str, limit: int) -> DataFrame:
    """Min, truncated mean and median, three largest values, share over the limit. The median is found by ranks, not by one sorted column."""
    c = F.col(col).cast("double")
    top = df.select(c.alias("c")).where("c IS NOT NULL").orderBy(F.desc("c")).limit(3).agg(F.sort_array(F.collect_list("c"), False)).scalar()
    out = df.agg(F.min(c).alias("least"), F.max(c).alias("largest"), F.floor(F.avg(c)).alias("mean"), F.floor(F.lit(quantile(df, col, 0.5))).cast("long").alias("median"), share(c > limit).alias("over_limit"))
    return out.withColumn("top", top).select("least", "largest", "mean", "median", "over_limit", *[F.get("top", F.lit(i)).alias(f"top{i + 1}") for i in range(3)])


def most_common(df: DataFrame, col: str, k: int, first: str) -> DataFrame:
    """The ``k`` most frequent values; of equal counts the one seen first (least ``first``)."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("_f")).orderBy(F.desc("n"), "_f").limit(k).drop("_f")


def offline_eval(df: DataFrame, scores: str, source: str) -> DataFrame:
    """Mean score of each row's responses, then the mean of rows per source."""
    x = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) / F.nullif(F.size(scores), F.lit(0))
    return df.select(source, x.alias("s")).groupBy(source).agg(F.avg("s").alias("score"), F.count(F.lit(1)).alias("rows"))


def reduce_metrics(df: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """Per metric name: max if the name contains 'max', min if it contains 'min', else the mean."""
    return df.groupBy(name).agg(F.when(F.first(name).contains("max"), F.max(value)).when(F.first(name).contains("min"), F.min(value)).otherwise(F.avg(value)).alias("value"))


def data_metrics(tokens: DataFrame) -> DataFrame:
    """Sequence score and reward, token advantage, return and value means and extremes, explained variance, lengths."""
    m = F.col("mask") > 0
    seq = tokens.groupBy("row_id").agg(F.sum("reward").alias("score"), F.sum("mask").alias("n"))
    s = seq.agg(F.struct(F.avg("score").alias("score_mean"), F.max("score").alias("score_max"), F.min("score").alias("score_min"), F.avg("n").alias("length_mean"), F.max("n").cast("double").alias("length_max"), F.min("n").cast("double").alias("length_min"), share(F.col("n") == 0).alias("empty_ratio"))).scalar()
    only = lambda c: F.when(m, F.col(c))
    ret = F.col("value") + F.col("adv")
    t = tokens.agg(
        *[f(only("adv")).alias(f"adv_{n}") for f, n in ((F.avg, "mean"), (F.max, "max"), (F.min, "min"))], *[f(only("value")).alias(f"value_{n}") for f, n in ((F.avg, "mean"), (F.max, "max"), (F.min, "min"))],
        (1 - F.var_samp(F.when(m, ret - F.col("value"))) / (F.var_samp(F.when(m, ret)) + 1e-5)).alias("explained_var"),
    ).withColumn("_s", s)
    return t.select("*", "_s.*").drop("_s")


def timing_metrics(times: dict[str, float], response_tokens: int, all_tokens: int, devices: int = 1) -> dict[str, float]:
    """Milliseconds per token (``gen`` over response tokens, the rest over all) and throughput per device; numbers of one step."""
    out = {f"per_token_ms/{k}": v * 1000 / (response_tokens if k == "gen" else all_tokens) for k, v in times.items() if k != "step"}
    if "step" in times:
        out["throughput"] = all_tokens / (times["step"] * devices)
    return out


def latency_summary(steps: DataFrame, key: str = "traj_id") -> DataFrame:
    """Per episode: total, mean and linear percentiles of the step times (nulls count as 0)."""
    g, e, w = (F.coalesce(c, F.lit(0.0)) for c in ("generation_seconds", "env_step_seconds", "step_wall_seconds"))
    pct = lambda c, p: F.percentile(c, F.lit(p))
    return steps.groupBy(key).agg(
        F.sum(g).alias("generation_total"), F.sum(e).alias("env_total"), F.sum(w).alias("wall_total"), F.avg(g).alias("generation_avg"), F.avg(e).alias("env_avg"),
        *[pct(g, p).alias(f"generation_p{int(p * 100)}") for p in (0.5, 0.9, 0.95)], *[pct(e, p).alias(f"env_p{int(p * 100)}") for p in (0.5, 0.9, 0.95)],
    )


def tool_latency(steps: DataFrame) -> DataFrame:
    """Environment time per action type."""
    e = F.coalesce("env_step_seconds", F.lit(0.0))
    return steps.groupBy(action_name(F.col("action_type")).alias("action")).agg(F.count(F.lit(1)).alias("n"), F.sum(e).alias("env_total"), F.avg(e).alias("env_avg"))


def breakdown(results: DataFrame, fields: list[str], metrics: dict[str, Column]) -> DataFrame:
    """``(field, value, metrics...)``: the same metrics by each field in one pass of grouping sets; a blank value is 'UNKNOWN'."""
    keyed = results.select(*[F.coalesce(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")), F.lit("UNKNOWN")).alias(f"_k_{f}") for f in fields], *[c for c in results.columns])
    keys = [F.col(f"_k_{f}") for f in fields]
    out = keyed.groupingSets([[k] for k in keys], *keys).agg(F.grouping_id(*keys).alias("_g"), *[c.alias(n) for n, c in metrics.items()])
    field, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    full = (1 << len(fields)) - 1
    for i, f in enumerate(fields):
        here = F.col("_g") == full - (1 << (len(fields) - 1 - i))
        field, value = F.when(here, F.lit(f)).otherwise(field), F.when(here, F.col(f"_k_{f}")).otherwise(value)
    return out.select(field.alias("field"), value.alias("value"), *metrics)


def eval_breakdown(results: DataFrame, fields: list[str], values: list[str], status: str = "status", correct: str = "correct", ok: str = "ok") -> DataFrame:
    """The metrics of an evaluation by each field: ``(field, value, num_samples, num_success, num_error, success_rate, accuracy, avg_<value>...)``.

    Only rows of status ``ok`` feed accuracy and means; a value that is missing counts as 0, and so does a mean without such rows. A blank field
    value is 'UNKNOWN'. ``values`` may be as many columns as the results have (tokens, seconds, calls, percentiles a step): all are one pass.
    """
    good = F.coalesce(F.col(status) == ok, F.lit(False))
    n_ok = F.count_if(good)
    metrics = {
        "num_samples": F.count(F.lit(1)), "num_success": n_ok, "num_error": F.count(F.lit(1)) - n_ok, "success_rate": share(good),
        "accuracy": F.coalesce(F.count_if(good & F.coalesce(correct, F.lit(False))) / F.nullif(n_ok, F.lit(0)), F.lit(0.0)),
    }
    metrics |= {f"avg_{v}": F.coalesce(F.avg(F.when(good, F.coalesce(F.col(v).cast("double"), F.lit(0.0)))), F.lit(0.0)) for v in values}
    return breakdown(results, fields, metrics)


def episode_values(steps: DataFrame) -> DataFrame:
    """Per trajectory what an evaluation averages of its steps: counts, seconds and calls, of all steps and of valid and invalid ones, and percentiles."""
    times = {"generation": "generation_seconds", "env_step": "env_step_seconds", "step_wall": "step_wall_seconds"}
    sec = {k: F.coalesce(c, F.lit(0.0)) for k, c in times.items()}
    name = action_name(F.col("action_type"))
    aggs = {"valid_step_count": F.count_if(is_valid()), "invalid_step_count": F.count_if(~is_valid())}
    for k, c in sec.items():
        aggs |= {f"total_{k}_seconds": F.sum(c), f"avg_{k}_seconds_per_step": F.avg(c), f"valid_{k}_seconds": F.sum(F.when(is_valid(), c).otherwise(0.0)), f"invalid_{k}_seconds": F.sum(F.when(~is_valid(), c).otherwise(0.0))}
    for k in ("generation", "env_step"):
        aggs |= {f"p{int(p * 100)}_{k}_seconds_per_step": F.percentile(sec[k], F.lit(p)) for p in (0.5, 0.9, 0.95)}
    aggs |= {f"{c}_calls": F.count_if(name == a) for c, a in (("frame", "getframes"), ("clip", "getclip"), ("audio", "getaudio"), ("answer", "answer"))}
    return steps.groupBy("traj_id").agg(*[c.alias(n) for n, c in aggs.items()])


def success_by_type(steps: DataFrame) -> DataFrame:
    """Success and mean reward overall ('ALL') and per question type, over last steps."""
    t = trajectories(steps)
    per = t.rollup("question_type").agg(F.grouping("question_type").alias("g"), share(F.col("won")).alias("success"), F.avg("reward").alias("reward"), F.count(F.lit(1)).alias("n"))
    return per.select(
        F.when(F.col("g") == 1, "ALL").otherwise(F.coalesce("question_type", F.lit("UNKNOWN"))).alias("question_type"), "success", "reward", "n")


def episode_extent(steps: DataFrame) -> DataFrame:
    """Every step row with the mean, least and largest episode reward and length over trajectories."""
    t = trajectories(steps)
    g = t.agg(F.struct(F.avg("reward").alias("reward_mean"), F.min("reward").alias("reward_min"), F.max("reward").alias("reward_max"), F.avg("n_rows").alias("length_mean"), F.min("n_rows").alias("length_min"), F.max("n_rows").alias("length_max"))).scalar()
    return steps.withColumn("_g", g).select("traj_id", "cur_step", "_g.*")


def action_metrics(steps: DataFrame) -> DataFrame:
    """One row: share of steps with an error, of valid actions, of final steps that are valid; linear p95 of wall time over known values."""
    t = trajectories(steps)
    final = t.agg(share(F.col("valid_last"))).scalar()
    steps = steps.select("error_code", "valid", "step_wall_seconds")
    return steps.agg(share(has_error()).alias("error_ratio"), share(F.coalesce("valid", F.lit(True))).alias("valid_ratio"), F.lit(quantile(steps, "step_wall_seconds", 0.95)).cast("double").alias("wall_p95"), F.avg("step_wall_seconds").alias("wall_mean")).withColumn("final_valid_ratio", final)


def nearest_rank(values: Column, p: float) -> Column:
    """Nearest-rank percentile of a column, ranks rounded half to even. An aggregate for groups that are small by nature
    (the steps of an episode): a group's values are one array. For a whole frame there is :func:`nearest_rank_of`."""
    s = F.array_sort(F.collect_list(values))
    return F.get(s, F.rint(F.lit(p) * (F.size(s) - 1)).cast("int"))


def nearest_rank_of(df: DataFrame, col: str, p: float) -> DataFrame:
    """The nearest-rank percentile of a whole column as a one-row frame: rows are numbered by ranges and one is taken."""
    from tracewright.operators.frame import number

    known = df.select(col).where(F.col(col).isNotNull())
    rank = round(p * max(0, known.count() - 1))
    return number(known, [col], "_rank").where(F.col("_rank") == rank).select(col)


def exclusive_quantile(values: Column, i: int, n: int) -> Column:
    """The i-th of n-1 exclusive quantile cuts (as statistics.quantiles gives them); one value gives itself.

    For groups that are small by nature, as :func:`nearest_rank`."""
    s = F.array_sort(F.collect_list(values))
    m = F.size(s) + 1
    j = F.greatest(F.lit(1), F.least(F.size(s) - 1, F.floor(m * i / n).cast("int")))
    d = m * i - j * n
    return F.when(F.size(s) == 1, F.get(s, F.lit(0))).otherwise((F.get(s, j - 1) * (n - d) + F.get(s, j) * d) / n)
