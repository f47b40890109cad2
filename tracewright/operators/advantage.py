"""Group-relative advantage estimators over sequence rows (one row a response) and their registry.

Every estimator takes a frame with a group column ``uid`` and a sequence score and adds ``advantage``: the scalar that is then
multiplied by the response mask. Null groups form one group. Empty frames stay empty. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators.grouping import EPS, mean_or_zero, scalar, std_or_one, with_group_stats

Estimator = Callable[..., DataFrame]
ESTIMATORS: dict[str, Estimator] = {}


def register_estimator(name: str) -> Callable[[Estimator], Estimator]:
    """Register under ``name``; another function under a taken name is an error."""

    def add(fn: Estimator) -> Estimator:
        if name in ESTIMATORS and ESTIMATORS[name] is not fn:
            raise ValueError(f"estimator {name!r} is already registered")
        ESTIMATORS[name] = fn
        return fn

    return add


def get_estimator(name: str) -> Estimator:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name!r}; known: {sorted(ESTIMATORS)}")
    return ESTIMATORS[name]


@register_estimator("grpo")
def grpo(df: DataFrame, uid: str = "uid", traj: str = "traj_uid", score: str = "score", order: str = "row_id", ignore: str | None = None, by_std: bool = True, all_rows: bool = False, eps: float = EPS) -> DataFrame:
    """Z-score within the group over the first row of each (group, trajectory); ignored rows keep their raw score.

    A group of one row has mean 0 and deviation 1. ``all_rows`` counts every row instead of one per trajectory.
    """
    s = F.col(score)
    base = df if ignore is None else df.where(~F.coalesce(F.col(ignore), F.lit(False)))
    if not all_rows:
        base = base.groupBy(uid, traj).agg(F.min_by(score, order).alias(score))
    out = with_group_stats(df, [uid], {"_m": mean_or_zero(s), "_s": std_or_one(s)}, base)
    z = (s - F.col("_m")) / (F.col("_s") + eps) if by_std else s - F.col("_m")
    if ignore is not None:
        z = F.when(F.coalesce(F.col(ignore), F.lit(False)), s).otherwise(z)
    return out.withColumn("advantage", z).drop("_m", "_s")


@register_estimator("grpo_vectorized")
def grpo_vectorized(df: DataFrame, uid: str = "uid", score: str = "score", by_std: bool = True, eps: float = EPS) -> DataFrame:
    """Z-score over all rows of the group, variance not under ``eps``."""
    s = F.col(score)
    std = F.when(F.count(s) > 1, F.sqrt(F.greatest(F.var_samp(s), F.lit(eps)))).otherwise(F.lit(1.0))
    out = with_group_stats(df, [uid], {"_m": mean_or_zero(s), "_s": std})
    z = (s - F.col("_m")) / (F.col("_s") + eps) if by_std else s - F.col("_m")
    return out.withColumn("advantage", z).drop("_m", "_s")


@register_estimator("grpo_passk")
def grpo_passk(df: DataFrame, uid: str = "uid", score: str = "score", order: str = "row_id", by_std: bool = True, eps: float = EPS) -> DataFrame:
    """Best minus second best for the best row of the group (the first of equal ones), 0 for the others; a group of one is an error."""
    s = F.col(score)
    top = F.max(F.struct(s.alias("s"), (-F.col(order)).alias("o")))
    out = with_group_stats(df, [uid], {"_top": top, "_n": F.count(s), "_s": F.stddev_samp(s)})
    # the second best is the best of the rows that are not the best row
    others = out.where((s != F.col("_top.s")) | (F.col(order) != -F.col("_top.o"))).select(uid, score)
    out = with_group_stats(out, [uid], {"_second": F.max(s)}, others)
    gap = F.col("_top.s") - F.col("_second")
    gap = gap / (F.col("_s") + eps) if by_std else gap
    best = (s == F.col("_top.s")) & (F.col(order) == -F.col("_top.o"))
    adv = F.when(F.col("_n") < 2, F.raise_error(F.lit("pass@k needs at least two rows a group")).cast("double")).when(best, gap).otherwise(F.lit(0.0))
    return out.withColumn("advantage", adv).drop("_top", "_n", "_s", "_second")


@register_estimator("reinforce_plus_plus_baseline")
def rfpp_baseline(df: DataFrame, uid: str = "uid", score: str = "score", tokens: str = "n_tokens") -> DataFrame:
    """Group mean subtracted, then whitened over all tokens of the frame (a score counts once a token)."""
    s, n = F.col("_c"), F.col(tokens)
    out = with_group_stats(df, [uid], {"_m": mean_or_zero(F.col(score))}).withColumn("_c", F.col(score) - F.col("_m"))
    mean = scalar(out.agg(F.sum(s * n) / (F.sum(n) + 1e-8)))
    centred = out.withColumn("_mean", mean)
    count = scalar(out.agg(F.sum(n).cast("double")))
    var = scalar(centred.agg(F.sum(n * (s - F.col("_mean")) ** 2) / (F.sum(n) + 1e-8)))
    bessel = count / (count - 1)
    return centred.withColumn("advantage", (s - F.col("_mean")) / F.sqrt(var * bessel + 1e-8)).drop("_c", "_m", "_mean")


@register_estimator("rloo")
def rloo(df: DataFrame, uid: str = "uid", score: str = "score") -> DataFrame:
    """Leave-one-out baseline, n/(n-1) * (score - mean); a single row keeps its score."""
    s = F.col(score)
    out = with_group_stats(df, [uid], {"_n": F.count(s), "_m": F.avg(s)})
    return out.withColumn("advantage", F.when(F.col("_n") > 1, (s - F.col("_m")) * F.col("_n") / (F.col("_n") - 1)).otherwise(s)).drop("_n", "_m")


@register_estimator("rloo_vectorized")
def rloo_vectorized(df: DataFrame, uid: str = "uid", score: str = "score") -> DataFrame:
    """Leave-one-out baseline; a single row gets 0."""
    s = F.col(score)
    out = with_group_stats(df, [uid], {"_n": F.count(s), "_t": F.sum(s)})
    return out.withColumn("advantage", F.when(F.col("_n") > 1, (F.col("_n") * s - F.col("_t")) / (F.col("_n") - 1)).otherwise(F.lit(0.0))).drop("_n", "_t")


@register_estimator("opo")
def opo(df: DataFrame, uid: str = "uid", score: str = "score", tokens: str = "n_tokens") -> DataFrame:
    """Length-weighted group baseline; 0 for a single row."""
    base = F.when(F.count(score) > 1, F.sum(F.col(score) * F.col(tokens)) / F.sum(tokens)).otherwise(F.lit(0.0))
    return with_group_stats(df, [uid], {"_b": base}).withColumn("advantage", F.col(score) - F.col("_b")).drop("_b")


@register_estimator("gpg")
def gpg(df: DataFrame, uid: str = "uid", score: str = "score", f_norm: float = 1.0) -> DataFrame:
    """Group-centred score scaled by rows over non-zero scores of the whole frame."""
    alpha = scalar(df.agg(F.count(F.lit(1)) / F.greatest(F.count_if(F.col(score) != 0), F.lit(1))))
    out = with_group_stats(df, [uid], {"_m": mean_or_zero(F.col(score))})
    return out.withColumn("advantage", alpha * (F.col(score) - F.col("_m")) / f_norm).drop("_m")


@register_estimator("gigpo")
def gigpo(df: DataFrame, uid: str = "uid", traj: str = "traj_uid", score: str = "score", step_score: str = "step_score", anchor: str = "anchor", order: str = "row_id", weight: float = 1.0, by_std: bool = False, all_rows: bool = True, eps: float = EPS) -> DataFrame:
    """Episode norm within the group plus ``weight`` times the step norm within rows of the group with the same anchor.

    Episode: single rows have mean 0 and deviation 1. Step: single rows keep their own mean, deviation 1.
    """
    out = grpo(df, uid, traj, score, order, None, by_std, all_rows, eps).withColumnRenamed("advantage", "_e")
    out = with_step_groups(out, uid, anchor)
    s = F.col(step_score)
    out = with_group_stats(out, [uid, "step_group"], {"_m": F.avg(s), "_s": std_or_one(s)})
    step = (s - F.col("_m")) / (F.col("_s") + eps) if by_std else s - F.col("_m")
    return out.withColumn("advantage", F.col("_e") + weight * step).drop("_e", "_m", "_s", "step_group")


def with_step_groups(df: DataFrame, uid: str = "uid", anchor: str = "anchor") -> DataFrame:
    """``step_group``: rows of one group with the same anchor observation share it; the group column is part of the key."""
    return df.withColumn("step_group", F.sha2(F.coalesce(F.col(anchor).cast("string"), F.lit("\x00")), 256))


def step_group_sizes(df: DataFrame, uid: str = "uid", anchor: str = "anchor") -> DataFrame:
    """Count of step groups by size: ``(group_size, groups)``."""
    per = with_step_groups(df, uid, anchor).groupBy(uid, "step_group").agg(F.count(F.lit(1)).alias("group_size"))
    return per.groupBy("group_size").agg(F.count(F.lit(1)).alias("groups"))


def entropy_weights(df: DataFrame, uid: str = "uid", entropy_sum: str = "entropy_sum", tokens: str = "n_tokens", eps: float = 1e-8) -> DataFrame:
    """Mean token entropy of a turn over the mean of its group, as ``weight``."""
    out = df.withColumn("_h", F.col(entropy_sum) / (F.col(tokens) + eps))
    out = with_group_stats(out, [uid], {"_hs": F.sum("_h"), "_n": F.count(F.lit(1))})
    return out.withColumn("weight", F.col("_h") / (F.col("_hs") / (F.col("_n") + eps) + eps)).drop("_h", "_hs", "_n")


def soft_entropy_weights(df: DataFrame, uid: str = "uid", x: str = "x", tau: float = 1.0, eps: float = 1e-8) -> DataFrame:
    """Softmax of ``x / tau`` within the group, minus 1/n, plus 1, as ``weight``."""
    out = with_group_stats(df, [uid], {"_mx": F.max(x), "_n": F.count(F.lit(1))}).withColumn("_e", F.exp((F.col(x) - F.col("_mx")) / tau))
    out = with_group_stats(out, [uid], {"_t": F.sum("_e")})
    return out.withColumn("weight", F.col("_e") / (F.col("_t") + eps) - F.lit(1.0) / F.col("_n") + 1.0).drop("_mx", "_n", "_e", "_t")


def prime_rloo(df: DataFrame, samples: int, reward: str = "score", order: str = "row_id") -> DataFrame:
    """Leave-one-out within consecutive blocks of ``samples`` rows of a dense row id; one reward source."""
    out = df.withColumn("_b", F.floor(F.col(order) / samples))
    out = with_group_stats(out, ["_b"], {"_n": F.count(F.lit(1)), "_m": F.avg(reward)})
    n = F.col("_n")
    return out.withColumn("advantage", F.when(n > 1, (F.col(reward) - F.col("_m")) * n / (n - 1)).otherwise(F.col(reward))).drop("_b", "_n", "_m")


def sppo_advantage(df: DataFrame, reward: str = "score", beta: float = 1.0) -> DataFrame:
    """Reward minus the soft mean of the whole frame: log(mean(exp(beta * r))) / beta, in a form that cannot overflow."""
    top = scalar(df.agg(F.max(F.col(reward) * beta)))
    centred = df.withColumn("_t", top)
    soft = scalar(centred.agg((F.log(F.avg(F.exp(F.col(reward) * beta - F.col("_t")))) + F.max("_t")) / beta))
    return df.withColumn("advantage", F.col(reward) - soft)


def last_step(df: DataFrame, traj: str, step: str, line: str, value: list[str], first_on_tie: bool = False) -> DataFrame:
    """One row per trajectory: the row of its largest step, the last (or first) line of equal ones."""
    tie = -F.col(line) if first_on_tie else F.col(line)
    row = F.max_by(F.struct(*value), F.struct(F.col(step), tie))
    return df.groupBy(traj).agg(row.alias("_r")).select(traj, "_r.*")


def common_prefix(df: DataFrame, key: str, order: str, tokens: str) -> DataFrame:
    """Length of the common prefix of a row's tokens with those of the row before it, as ``prefix``; null for the first row."""
    prev = F.lag(tokens).over(W.partitionBy(key).orderBy(order))
    n = F.least(F.size(tokens), F.size("_p"))
    differs = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get("_p", i).eqNullSafe(F.get(tokens, i)))
    prefix = F.when(F.col("_p").isNull(), None).when(n <= 0, 0).otherwise(F.coalesce(F.get(differs, F.lit(0)), n))
    return df.withColumn("_p", prev).withColumn("prefix", prefix).drop("_p")


def masked_by(df: DataFrame, advantage: str = "advantage", weight: str | None = None, keep: str | None = None) -> DataFrame:
    """The advantage times an entropy weight and a keep mask, where given."""
    out = F.col(advantage)
    out = out * F.col(weight) if weight else out
    out = out * F.col(keep).cast("double") if keep else out
    return df.withColumn(advantage, out)


def estimate(name: str, df: DataFrame, weight: str | None = None, keep: str | None = None, **options: object) -> DataFrame:
    """Dispatch by name, then weight and mask."""
    return masked_by(get_estimator(name)(df, **options), "advantage", weight, keep)


def masked_scalar(col: Column, mask: Column) -> Column:
    """Masked mean with the 1e-8 in its count, as an aggregate."""
    return F.sum(col * mask) / (F.sum(mask) + 1e-8)
