"""Masked aggregates, policy losses, KL estimators and off-policy correction over token rows ``(row_id, ..., mask)``.

Token rows hold forward values only. Every loss gives one row: the loss and its metrics. A frame without a valid token gives
null or zero metrics as stated; the masks are 0/1 numbers and never null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators.grouping import scalar, with_group_stats
from tracewright.operators.ranks import first_ranks, ordered

SAFE = 20.0
LOSSES: dict[str, Callable[..., DataFrame]] = {}


def register_loss(name: str) -> Callable:
    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in LOSSES and LOSSES[name] is not fn:
            raise ValueError(f"loss {name!r} is already registered")
        LOSSES[name] = fn
        return fn

    return add


def get_loss(name: str) -> Callable[..., DataFrame]:
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}; known: {sorted(LOSSES)}")
    return LOSSES[name]


def clamp(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    x = F.greatest(x, F.lit(lo)) if lo is not None else x
    return F.least(x, F.lit(hi)) if hi is not None else x


def msum(x: Column, m: Column) -> Column:
    return F.sum(x * m)


def mmean(x: Column, m: Column) -> Column:
    """Masked mean with 1e-8 in the count."""
    return F.sum(x * m) / (F.sum(m) + 1e-8)


def mvar(df: DataFrame, x: str, m: str = "mask") -> Column:
    """Masked variance with Bessel's correction, as a subquery; a mask sum of 0 or 1 is an error."""
    mean = scalar(df.agg(mmean(F.col(x), F.col(m))))
    d = df.withColumn("_m", mean)
    n = F.sum(m)
    var = F.sum(F.col(m) * (F.col(x) - F.col("_m")) ** 2) / (n + 1e-8)
    return scalar(d.agg(F.when(n <= 1, F.raise_error(F.lit("the mask needs at least two valid tokens")).cast("double")).otherwise(var * n / (n - 1))))


def agg_loss(df: DataFrame, loss: Column, mask: str = "mask", mode: str = "token-mean", row: str = "row_id", width: int | None = None) -> DataFrame:
    """One row ``loss``: token-mean, seq-mean-token-sum, seq-mean-token-mean or seq-mean-token-sum-norm (over padded ``width``)."""
    m = F.col(mask).cast("double")
    if mode == "token-mean":
        return df.agg(mmean(loss, m).alias("loss"))
    per = df.groupBy(row).agg(F.sum(loss * m).alias("s"), F.sum(m).alias("n"))
    live = F.when(F.col("n") > 0, 1.0).otherwise(0.0)
    if mode == "seq-mean-token-sum":
        return per.agg(mmean(F.col("s"), live).alias("loss"))
    if mode == "seq-mean-token-mean":
        return per.agg(mmean(F.col("s") / (F.col("n") + 1e-8), live).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        if width is None:
            raise ValueError("seq-mean-token-sum-norm needs the padded width")
        return per.agg((F.sum("s") / width).alias("loss"))
    raise ValueError(f"unknown mode {mode!r}")


def kl(lp: Column, ref: Column, kind: str) -> Column:
    """KL estimator of a token: k1/kl, abs, k2/mse, k3/low_var_kl; a trailing '+' has the same forward value."""
    base = kind.removesuffix("+")
    if base in ("kl", "k1"):
        return lp - ref
    if base == "abs":
        return F.abs(lp - ref)
    if base in ("mse", "k2"):
        return (lp - ref) * (lp - ref) * 0.5
    if base in ("low_var_kl", "k3"):
        d = clamp(ref - lp, -20.0, 20.0)
        return clamp(F.exp(d) - d - 1, -10.0, 10.0)
    raise NotImplementedError(kind)


def kl_in_reward(df: DataFrame, beta: float, kind: str = "k1", reward: str = "reward", lp: str = "old_lp", ref: str = "lp", mask: str = "mask") -> DataFrame:
    """``token_reward``: the reward less ``beta`` times the masked KL."""
    return df.withColumn("token_reward", F.col(reward) - beta * kl(F.col(lp), F.col(ref), kind) * F.col(mask))


def mean_kl(df: DataFrame, kind: str = "k1", lp: str = "old_lp", ref: str = "lp", mask: str = "mask", row: str = "row_id") -> DataFrame:
    """Sequence means of the masked KL, then their mean, as ``kl``."""
    per = df.groupBy(row).agg(mmean(kl(F.col(lp), F.col(ref), kind), F.col(mask)).alias("k"))
    return per.agg(F.avg("k").alias("kl"))


def _with_mode(df: DataFrame, mask: str, metrics: dict[str, Column], mode: str, loss: str, width: int | None) -> DataFrame:
    """Loss of ``mode`` and metrics in one row."""
    if mode == "token-mean":
        return df.agg(mmean(F.col(loss), F.col(mask).cast("double")).alias("loss"), *[c.alias(n) for n, c in metrics.items()])
    value = scalar(agg_loss(df, F.col(loss), mask, mode, width=width))
    return df.agg(*[c.alias(n) for n, c in metrics.items()]).select(value.alias("loss"), *metrics)


@register_loss("vanilla")
def ppo_loss(df: DataFrame, low: float = 0.2, high: float = 0.2, c: float = 3.0, mode: str = "token-mean", width: int | None = None, weight: str | None = None, mask: str = "mask", keep: str | None = None) -> DataFrame:
    """Dual-clip policy loss with its metrics; ``keep`` multiplies the loss mask only."""
    if c <= 1:
        raise ValueError("the lower bound of the ratio must be greater than 1")
    a, m = F.col("adv"), F.col(mask)
    d = df.withColumn("_nk", clamp(F.col("lp") - F.col("old_lp"), -20.0, 20.0)).withColumn("_r", F.exp("_nk"))
    d = d.withColumn("_l1", -a * F.col("_r")).withColumn("_l2", -a * clamp(F.col("_r"), 1 - low, 1 + high)).withColumn("_c1", F.greatest("_l1", "_l2")).withColumn("_l3", -a * c)
    d = d.withColumn("_loss", F.when(a < 0, F.least("_l3", "_c1")).otherwise(F.col("_c1")))
    if weight:
        d = d.withColumn("_loss", F.col("_loss") * F.col(weight))
    d = d.withColumn("_mask", m * F.col(keep) if keep else m)
    one = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    metrics = {
        "clipfrac": mmean(one(F.col("_l2") > F.col("_l1")), m), "ppo_kl": mmean(-F.col("_nk"), m), "clipfrac_lower": mmean(one((F.col("_c1") > F.col("_l3")) & (a < 0)), m),
        "ratio_min": F.min(F.when(m > 0, F.col("_r"))), "ratio_max": F.max(F.when(m > 0, F.col("_r"))), "ratio_mean": F.avg(F.when(m > 0, F.col("_r"))),
    }
    return _with_mode(d, "_mask", metrics, mode, "_loss", width)


@register_loss("gspo")
def gspo_loss(df: DataFrame, low: float = 0.2, high: float = 0.2, weight: str | None = None) -> DataFrame:
    """Sequence-ratio loss; the aggregation is always seq-mean-token-mean."""
    nk, m, a = F.col("lp") - F.col("old_lp"), F.col("mask"), F.col("adv")
    d = with_group_stats(df.withColumn("_nk", nk), ["row_id"], {"_k": F.sum(nk * m) / F.greatest(F.sum(m), F.lit(1))})
    d = d.withColumn("_r", F.exp(clamp(F.col("_k"), hi=10.0))).withColumn("_l1", -a * F.col("_r")).withColumn("_l2", -a * clamp(F.col("_r"), 1 - low, 1 + high))
    d = d.withColumn("_loss", F.greatest("_l1", "_l2") * (F.col(weight) if weight else 1))
    metrics = {"clipfrac": mmean(F.when(F.col("_l2") > F.col("_l1"), 1.0).otherwise(0.0), m), "ppo_kl": mmean(-F.col("_nk"), m)}
    return _with_mode(d, "mask", metrics, "seq-mean-token-mean", "_loss", None)


@register_loss("gpg")
def gpg_loss(df: DataFrame, mode: str = "token-mean", width: int | None = None, weight: str | None = None) -> DataFrame:
    loss = -F.col("lp") * F.col("adv") * (F.col(weight) if weight else 1)
    return agg_loss(df, loss, "mask", mode, width=width)


@register_loss("geo_mean")
def geo_mean_loss(df: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """Geometric-mean policy loss: clipped log ratios averaged per sequence, then the mean over sequences."""
    a, m, nk = F.col("adv"), F.col("mask"), F.col("lp") - F.col("old_lp")
    sgn, cl = F.signum(a), clamp(nk, -low, high)
    d = df.withColumn("_k", sgn * F.least(sgn * nk, sgn * cl)).withColumn("_nk", nk).withColumn("_cut", (nk != cl).cast("double"))
    per = d.groupBy("row_id").agg((F.sum(F.col("_k") * m) / (F.sum(m) + 1e-8)).alias("k"), (F.sum(a * m) / (F.sum(m) + 1e-8)).alias("a"))
    loss = scalar(per.agg(F.avg(-F.col("a") * F.exp("k"))))
    return d.agg(
        mmean(F.col("_cut") * (a > 0).cast("double"), m).alias("clipfrac"), mmean(F.col("_cut") * (a < 0).cast("double"), m).alias("clipfrac_lower"), mmean(-F.col("_nk"), m).alias("ppo_kl")
    ).select(loss.alias("loss"), "clipfrac", "clipfrac_lower", "ppo_kl")


def _covariance(df: DataFrame) -> DataFrame:
    """``_cov``: (adv - mean) * (lp - mean) with masked means."""
    m = F.col("mask")
    means = scalar(df.agg(F.struct(mmean(F.col("adv"), m).alias("a"), mmean(F.col("lp"), m).alias("l"))))
    return df.withColumn("_g", means).withColumn("_cov", (F.col("adv") - F.col("_g.a")) * (F.col("lp") - F.col("_g.l"))).drop("_g")


@register_loss("clip_cov")
def clip_cov_loss(df: DataFrame, ratio: float = 0.0002, low: float = 0.2, high: float = 0.2, lb: float = 1.0, ub: float = 5.0, order: tuple[str, ...] = ("row_id", "pos"), seed: int = 1) -> DataFrame:
    """Tokens of a seeded random part of the covariance band drop out of the clipped loss.

    The part is ``max(1, int(ratio * valid tokens))`` tokens, taken by hash order; the threshold hash is found by counting in ranges.
    """
    a, m = F.col("adv"), F.col("mask")
    d = _covariance(df).withColumn("_r", F.exp(F.col("lp") - F.col("old_lp"))).withColumn("_l1", -a * F.col("_r")).withColumn("_l2", -a * clamp(F.col("_r"), 1 - low, 1 + high))
    d = d.withColumn("_h", F.xxhash64(*order, F.lit(seed))).withColumn("_in", (F.col("_cov") < ub) & (F.col("_cov") > lb) & (m > 0) & ~(F.col("_l2") > F.col("_l1")))
    n = max(1, int(ratio * (df.agg(F.sum("mask")).first()[0] or 0)))
    d = d.withColumn("_drop", F.coalesce(F.col("_in") & first_ranks(d.where("_in"), [F.col("_h")], n), F.lit(False)))
    loss = F.when(F.col("_drop"), 0.0).otherwise(F.greatest("_l1", "_l2"))
    return d.agg(mmean(loss, m).alias("loss"), mmean(F.col("_drop").cast("double"), m).alias("clipfrac"), mmean(F.col("old_lp") - F.col("lp"), m).alias("ppo_kl"))


@register_loss("kl_cov")
def kl_cov_loss(df: DataFrame, ratio: float = 0.0002, coef: float = 1.0, order: tuple[str, ...] = ("row_id", "pos")) -> DataFrame:
    """The tokens of largest covariance get a KL term: the top ``max(1, int(n * ratio))`` of the valid ones, ties by position."""
    a, m = F.col("adv"), F.col("mask")
    valid = df.where(m > 0)
    n = max(1, int(valid.count() * ratio))
    d = _covariance(df)
    top = first_ranks(d.where(m > 0), [ordered(-F.col("_cov")), *[F.col(c) for c in order]], n)
    nk = F.col("lp") - F.col("old_lp")
    loss = -a * F.exp(nk) + F.when((m > 0) & top, coef * F.abs(nk)).otherwise(0.0)
    return d.agg(mmean(loss, m).alias("loss"), mmean(F.abs(nk), m).alias("ppo_kl"))


def value_loss(df: DataFrame, clip: float = 0.5, pred: str = "vpred", ret: str = "returns", value: str = "value", mask: str = "mask") -> DataFrame:
    """Half the masked mean of the larger squared error of plain and clipped predictions, and the clipped share."""
    p, r, v, m = F.col(pred), F.col(ret), F.col(value), F.col(mask)
    q = F.greatest(F.least(p, v + clip), v - clip)
    l1, l2 = (p - r) ** 2, (q - r) ** 2
    return df.agg((0.5 * mmean(F.greatest(l1, l2), m)).alias("loss"), mmean(F.when(l2 > l1, 1.0).otherwise(0.0), m).alias("clipfrac"))


def entropy_loss(df: DataFrame, entropy: str = "entropy", mode: str = "token-mean", width: int | None = None) -> DataFrame:
    return agg_loss(df, F.col(entropy), "mask", mode, width=width)


def is_weights(df: DataFrame, level: str = "token", threshold: float = 2.0, normalize: bool = False, name: str = "is_weight") -> DataFrame:
    """Truncated importance weights of training over rollout policy, per token or per sequence, times the mask."""
    if level not in ("token", "sequence"):
        raise ValueError(f"unknown level {level!r}")
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    m, lr = F.col("mask"), F.col("old_lp") - F.col("rollout_lp")
    if level == "token":
        d = df.withColumn("_raw", F.exp(clamp(lr, -SAFE, SAFE)) * m)
    else:
        d = with_group_stats(df, ["row_id"], {"_t": F.sum(lr * m)}).withColumn("_raw", F.exp(clamp(F.col("_t"), -SAFE, SAFE)) * m).drop("_t")
    d = d.withColumn(name, clamp(F.col("_raw"), hi=threshold))
    if normalize:
        if level == "token":
            mean = scalar(d.agg(mmean(F.col(name), m)))
        else:
            mean = scalar(d.groupBy("row_id").agg(mmean(F.col(name), m).alias("w")).agg(F.avg("w")))
        d = d.withColumn("_mean", mean).withColumn(name, F.when(F.col("_mean") > 1e-8, F.col(name) / F.col("_mean")).otherwise(F.col(name))).drop("_mean")
    return d.drop("_raw")


def rejection_mask(df: DataFrame, level: str = "token", upper: float = 2.0, lower: float | None = None, veto: float | None = None, name: str = "rs_mask") -> DataFrame:
    """The mask times acceptance of the ratio within [lower, upper] (lower defaults to 1/upper) per token, sequence or geometric mean.

    With ``veto`` a sequence with a valid token whose ratio is under it is rejected as a whole.
    """
    lower = 1.0 / upper if lower is None else lower
    m, lr = F.col("mask"), F.col("old_lp") - F.col("rollout_lp")
    stats = {}
    if level == "sequence":
        stats["_t"] = F.sum(lr * m)
    elif level == "geometric":
        stats["_t"] = mmean(lr, m)
    elif level != "token":
        raise ValueError(f"unknown level {level!r}")
    if veto is not None:
        stats["_v"] = F.max(F.when((m > 0) & (clamp(lr, -SAFE, SAFE) < F.log(F.lit(veto))), 1).otherwise(0))
    d = with_group_stats(df, ["row_id"], stats) if stats else df
    w = F.exp(clamp(lr if level == "token" else F.col("_t"), -SAFE, SAFE))
    ok = F.when((w >= lower) & (w <= upper), 1).otherwise(0)
    if veto is not None:
        ok = ok * (1 - F.col("_v"))
    return d.withColumn(name, m * ok).drop("_t", "_v")


def ratio_metrics(df: DataFrame, level: str = "token", upper: float = 2.0, lower: float | None = None) -> DataFrame:
    """Mean, extremes, clamped deviation, effective sample size, shares over the bounds, and sequence figures of the ratios."""
    lower = 1.0 / upper if lower is None else lower
    m, lr = F.col("mask"), F.col("old_lp") - F.col("rollout_lp")
    stats = {"sequence": {"_t": F.sum(lr * m)}, "geometric": {"_t": mmean(lr, m)}}.get(level, {})
    d = with_group_stats(df, ["row_id"], stats) if stats else df.withColumn("_t", lr)
    d = d.withColumn("_w", F.exp(clamp(F.col("_t"), -SAFE, SAFE)))
    cw = clamp(F.col("_w"), lower, upper)
    mean_c = mmean(cw, m)
    std = F.sqrt(F.greatest(mmean(cw * cw, m) - mean_c * mean_c, F.lit(0.0)))
    # mean of (w / (c + 1e-8))^2 is mean(w^2) / (c + 1e-8)^2
    ess = (mean_c + 1e-8) * (mean_c + 1e-8) / mmean(cw * cw, m)
    high, low = F.when(F.col("_w") > upper, 1.0).otherwise(0.0), F.when(F.col("_w") < lower, 1.0).otherwise(0.0)
    tok = d.agg(mmean(F.col("_w"), m).alias("mean"), F.max(F.when(m > 0, F.col("_w"))).alias("max"), F.min(F.when(m > 0, F.col("_w"))).alias("min"), F.when(F.sum(m) > 1, std).otherwise(0.0).alias("std"), ess.alias("ess"), mmean(high, m).alias("high"), mmean(low, m).alias("low"))
    per = d.groupBy("row_id").agg(mmean(F.col("_w"), m).alias("w"))
    seq = per.agg(F.struct(F.avg("w").alias("mean"), F.coalesce(F.stddev_samp("w"), F.lit(0.0)).alias("std"), F.max("w").alias("max"), F.min("w").alias("min"), F.max(F.abs(F.col("w") - 1)).alias("dev"), F.avg((F.col("w") > upper).cast("double")).alias("high"), F.avg((F.col("w") < lower).cast("double")).alias("low")))
    return tok.withColumn("_s", scalar(seq)).select("*", *[F.col(f"_s.{x}").alias(f"seq_{x}") for x in ("mean", "std", "max", "min", "dev", "high", "low")]).drop("_s")


def off_policy_metrics(df: DataFrame) -> DataFrame:
    """Perplexities of both policies, their differences, KL, k3 and chi-square at token and sequence level."""
    m, o, r = F.col("mask"), F.col("old_lp"), F.col("rollout_lp")
    lr = o - r
    tok = df.agg(mmean(r - o, m).alias("kl"), mmean(F.exp(lr) - lr - 1, m).alias("k3_kl"), (mmean(F.exp(clamp(lr, -SAFE, SAFE)) ** 2, m) - 1).alias("chi2_token"))
    per = df.groupBy("row_id").agg(mmean(o, m).alias("t"), mmean(r, m).alias("u"), F.sum(lr * m).alias("s"))
    diff = F.col("u") - F.col("t")
    cols = {
        "training_ppl": F.avg(F.exp(-F.col("t"))), "training_log_ppl": F.avg(-F.col("t")), "rollout_ppl": F.avg(F.exp(-F.col("u"))), "rollout_log_ppl": F.avg(-F.col("u")), "log_ppl_diff": F.avg(diff), "log_ppl_abs_diff": F.avg(F.abs(diff)),
        "log_ppl_diff_max": F.max(diff), "log_ppl_diff_min": F.min(diff), "ppl_ratio": F.avg(F.exp(diff)), "chi2_seq": F.avg(F.exp(2 * clamp(F.col("s"), -SAFE, SAFE))) - 1,
    }
    return tok.withColumn("_s", scalar(per.agg(F.struct(*[c.alias(n) for n, c in cols.items()])))).select("kl", "k3_kl", "chi2_token", *[F.col(f"_s.{n}").alias(n) for n in cols])


def rollout_correction(df: DataFrame, level: str | None = "token", threshold: float = 2.0, rs: str | None = None, rs_upper: float = 2.0, veto: float | None = None, normalize: bool = False) -> DataFrame:
    """Batch glue: weights from the original mask, and ``mask`` overwritten by the rejected one where rejection is on."""
    d = is_weights(df, level, threshold, normalize) if level else df
    if rs or veto is not None:
        d = rejection_mask(d, rs or "token", rs_upper if rs else 1e30, 0.0 if not rs else None, veto).withColumn("mask", F.col("rs_mask")).drop("rs_mask")
    return d


@register_loss("rollout_correction")
def rollout_correction_loss(df: DataFrame, level: str | None = "token", threshold: float = 2.0, rs: str | None = None, rs_upper: float = 2.0, mode: str = "token-mean", scale: float = 1.0, width: int | None = None) -> DataFrame:
    """-A * log p * w over the accepted tokens; ``old_lp`` of the correction is the current policy."""
    d = rollout_correction(df.withColumn("old_lp", F.col("lp")), level, threshold, rs, rs_upper)
    loss = -F.col("adv") * F.col("lp") * (F.col("is_weight") if level else 1)
    out = agg_loss(d, loss, "mask", mode, width=width)
    return out.select((F.col("loss") * scale).alias("loss"))


def prob_difference(df: DataFrame, a: str = "rollout_lp", b: str = "old_lp") -> DataFrame:
    """Max, mean and sample deviation of the probability difference over valid tokens."""
    d = F.abs(F.exp(a) - F.exp(b))
    return df.where("mask > 0").agg(F.max(d).alias("max"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"))


def dpo_loss(df: DataFrame, beta: float = 0.1, kind: str = "sigmoid", smoothing: float = 0.0) -> DataFrame:
    """Preference loss over rows ``(pc, pr, rc, rr)``: policy and reference log-probabilities of chosen and rejected; DPO or IPO."""
    logits = F.col("pc") - F.col("pr") - (F.col("rc") - F.col("rr"))
    log_sig = lambda x: -F.log1p(F.exp(-x))
    if kind == "ipo":
        loss = (logits - 1 / (2 * beta)) ** 2
    elif kind == "sigmoid":
        loss = -log_sig(logits * beta) * (1 - smoothing) - log_sig(-logits * beta) * smoothing
    else:
        raise ValueError(f"unknown loss {kind!r}")
    return df.agg(F.avg(loss).alias("loss"), F.avg(beta * (F.col("pc") - F.col("rc"))).alias("chosen_reward"), F.avg(beta * (F.col("pr") - F.col("rr"))).alias("rejected_reward"))


def sequence_logps(df: DataFrame, lp: str = "lp", average: bool = False) -> DataFrame:
    """Masked sum (or mean) of token log-probabilities per sequence, as ``logp``."""
    m = F.col("mask")
    x = F.sum(F.col(lp) * m)
    return df.groupBy("row_id").agg((x / F.sum(m) if average else x).alias("logp"))


def sppo_loss(df: DataFrame, eta: float = 1.0) -> DataFrame:
    """Squared distance of the masked log-ratio sum from ``eta`` times the sequence advantage, mean over sequences."""
    per = df.groupBy("row_id").agg(F.sum((F.col("lp") - F.col("old_lp")) * F.col("mask")).alias("d"), (F.sum(F.col("adv") * F.col("mask")) / (F.sum("mask") + 1e-8)).alias("a"))
    return per.agg(F.avg((F.col("d") - eta * F.col("a")) ** 2).alias("loss"))


def prime_ce_loss(df: DataFrame, beta: float = 0.05) -> DataFrame:
    """Binary cross-entropy of sigmoid(beta * masked score sum) against the label, over rows ``(score_sum, label)``."""
    p = 1 / (1 + F.exp(-beta * F.col("score_sum")))
    return df.agg(F.avg(-F.col("label") * F.log(p) - (1 - F.col("label")) * F.log(1 - p)).alias("loss"))


def pair_accuracy(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """Share of pairs of a group with different labels whose scores are ordered alike, pairs counted without listing them.

    Ranks give, for each row of the higher label, how many rows of the lower label score less; equal scores count as wrong.
    """
    w = W.partitionBy(group).orderBy(score)
    below = F.sum((F.col(label) == 0).cast("long")).over(w.rangeBetween(W.unboundedPreceding, W.currentRow)) - F.sum((F.col(label) == 0).cast("long")).over(W.partitionBy(group, score))
    d = df.withColumn("_b", below)
    per = d.groupBy(group).agg(F.sum(F.when(F.col(label) > 0, F.col("_b")).otherwise(0)).alias("good"), (F.sum((F.col(label) > 0).cast("long")) * F.sum((F.col(label) == 0).cast("long"))).alias("pairs"))
    return per.agg((F.sum("good") / F.sum("pairs")).alias("accuracy"), F.sum("pairs").alias("pairs"))


def logits_entropy(logits: Column) -> Column:
    """Entropy of the softmax of an array of logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    z = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.log(z) + top - F.aggregate(F.zip_with(e, logits, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x) / z


def logprob_from_logits(logits: Column, label: Column) -> Column:
    """Log-probability of the label (index from 0)."""
    top = F.array_max(logits)
    z = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.get(logits, label) - top - F.log(z)
