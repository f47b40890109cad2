"""Queries of losses, KL estimators, off-policy correction and ordered scans on ``lineitem`` as token rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import losses as L
from tracewright.operators import scan as S
from tracewright.plans.registry import query
from tracewright.plans.views import TOKENS_SQL, r6, token_rows, tokens

_T = f"WITH {TOKENS_SQL}"
_MM = lambda x: f"sum(({x}) * mask) / (sum(mask) + 1e-8)"


def _round(df):
    return df.select(*[r6(c) for c in df.columns])


def _sql(names: dict[str, str], source: str = "tok", ctes: str = "") -> str:
    return f"{_T}{ctes} SELECT " + ", ".join(f"round({x}, 6) AS {n}" for n, x in names.items()) + f" FROM {source}"


@query("masked_stats", _sql({"total": "sum(reward * mask)", "mean": _MM("reward"), "var": "max(v)"}, "tok, vv", f", mm AS (SELECT {_MM('reward')} AS mu FROM tok), vv AS (SELECT sum(mask * (reward - mu) ^ 2) / (sum(mask) + 1e-8) * sum(mask) / (sum(mask) - 1) AS v FROM tok, mm)"))
def q_masked(spark, d):
    t = token_rows(spark, d)
    m = F.col("mask")
    return _round(t.agg(L.msum(F.col("reward"), m).alias("total"), L.mmean(F.col("reward"), m).alias("mean")).withColumn("var", L.mvar(t, "reward")))


_PER = ", per AS (SELECT row_id, sum(entropy * mask) AS s, sum(mask) AS n FROM tok GROUP BY 1)"


@query("agg_loss_modes", _sql({
    "token_mean": f"(SELECT {_MM('entropy')} FROM tok)", "seq_sum": "sum(CASE WHEN n > 0 THEN s ELSE 0 END) / (count(*) FILTER (n > 0) + 1e-8)",
    "seq_mean": "sum(CASE WHEN n > 0 THEN s / (n + 1e-8) ELSE 0 END) / (count(*) FILTER (n > 0) + 1e-8)", "seq_norm": "sum(s) / 16"}, "per", _PER))
def q_agg_modes(spark, d):
    t = token_rows(spark, d)
    modes = {"token_mean": "token-mean", "seq_sum": "seq-mean-token-sum", "seq_mean": "seq-mean-token-mean", "seq_norm": "seq-mean-token-sum-norm"}
    frames = {n: L.entropy_loss(t, mode=m, width=16) for n, m in modes.items()}
    out = frames["token_mean"].withColumnRenamed("loss", "token_mean")
    for n in ("seq_sum", "seq_mean", "seq_norm"):
        out = out.withColumn(n, L.scalar(frames[n]))
    return _round(out)


_K3 = "greatest(-10, least(10, exp(greatest(-20, least(20, lp - old_lp))) - greatest(-20, least(20, lp - old_lp)) - 1))"


@query("kl_estimators", _sql({"k1": _MM("old_lp - lp"), "abs": _MM("abs(old_lp - lp)"), "k2": _MM("0.5 * (old_lp - lp) ^ 2"), "k3": _MM(_K3)}))
def q_kl(spark, d):
    o, p, m = F.col("old_lp"), F.col("lp"), F.col("mask")
    return _round(token_rows(spark, d).agg(*[L.mmean(L.kl(o, p, k), m).alias(k.rstrip("+")) for k in ("k1", "abs", "k2", "k3+")]))


@query("kl_in_reward", _sql({"reward": _MM("reward - 0.1 * (old_lp - lp) * mask"), "kl": "(SELECT avg(k) FROM (SELECT sum((old_lp - lp) * mask) / (sum(mask) + 1e-8) AS k FROM tok GROUP BY row_id))"}))
def q_kl_reward(spark, d):
    t = token_rows(spark, d)
    out = L.kl_in_reward(t, 0.1).agg(L.mmean(F.col("token_reward"), F.col("mask")).alias("reward"))
    return _round(out.withColumn("kl", L.scalar(L.mean_kl(t))))


_PPO = """, a AS (SELECT *, greatest(-20, least(20, lp - old_lp)) AS nk FROM tok), b AS (SELECT *, exp(nk) AS r, -adv * exp(nk) AS l1, -adv * greatest(0.99, least(1.01, exp(nk))) AS l2, -adv * 3 AS l3 FROM a),
 c AS (SELECT *, greatest(l1, l2) AS c1 FROM b), e AS (SELECT *, CASE WHEN adv < 0 THEN least(l3, c1) ELSE c1 END AS loss FROM c)"""
_PPO_METRICS = {
    "clipfrac": _MM("CASE WHEN l2 > l1 THEN 1 ELSE 0 END"), "ppo_kl": _MM("-nk"), "clipfrac_lower": _MM("CASE WHEN c1 > l3 AND adv < 0 THEN 1 ELSE 0 END"),
    "ratio_min": "min(r) FILTER (mask > 0)", "ratio_max": "max(r) FILTER (mask > 0)", "ratio_mean": "avg(r) FILTER (mask > 0)"}


@query("ppo_loss", _sql({"loss": _MM("loss"), **_PPO_METRICS}, "e", _PPO))
def q_ppo(spark, d):
    return _round(L.get_loss("vanilla")(token_rows(spark, d), 0.01, 0.01))


@query("ppo_loss_seq", _sql({"loss": "(SELECT sum(CASE WHEN n > 0 THEN s ELSE 0 END) / (count(*) FILTER (n > 0) + 1e-8) FROM (SELECT sum(loss * mask) AS s, sum(mask) AS n FROM e GROUP BY row_id))", **_PPO_METRICS}, "e", _PPO))
def q_ppo_seq(spark, d):
    return _round(L.ppo_loss(token_rows(spark, d), 0.01, 0.01, mode="seq-mean-token-sum"))


_GSPO = """, k AS (SELECT row_id, sum((lp - old_lp) * mask) / greatest(sum(mask), 1) AS k FROM tok GROUP BY 1), b AS (SELECT *, exp(least(10, k)) AS r FROM tok JOIN k USING (row_id)),
 c AS (SELECT *, -adv * r AS l1, -adv * greatest(0.99, least(1.01, r)) AS l2 FROM b), p AS (SELECT sum(greatest(l1, l2) * mask) / (sum(mask) + 1e-8) AS s, sum(mask) AS n FROM c GROUP BY row_id)"""


@query("gspo_loss", _sql({"loss": "(SELECT sum(CASE WHEN n > 0 THEN s ELSE 0 END) / (count(*) FILTER (n > 0) + 1e-8) FROM p)", "clipfrac": _MM("CASE WHEN l2 > l1 THEN 1 ELSE 0 END"), "ppo_kl": _MM("old_lp - lp")}, "c", _GSPO))
def q_gspo(spark, d):
    return _round(L.get_loss("gspo")(token_rows(spark, d), 0.01, 0.01))


@query("gpg_loss", _sql({"loss": _MM("-lp * adv")}))
def q_gpg_loss(spark, d):
    return _round(L.get_loss("gpg")(token_rows(spark, d)))


_GEO = """, a AS (SELECT *, lp - old_lp AS nk, greatest(-0.01, least(0.01, lp - old_lp)) AS cl FROM tok), b AS (SELECT *, sign(adv) * least(sign(adv) * nk, sign(adv) * cl) AS k FROM a),
 p AS (SELECT sum(k * mask) / (sum(mask) + 1e-8) AS k, sum(adv * mask) / (sum(mask) + 1e-8) AS a FROM b GROUP BY row_id)"""


@query("geo_mean_loss", _sql({"loss": "(SELECT avg(-a * exp(k)) FROM p)", "clipfrac": _MM("CASE WHEN nk <> cl AND adv > 0 THEN 1 ELSE 0 END"), "clipfrac_lower": _MM("CASE WHEN nk <> cl AND adv < 0 THEN 1 ELSE 0 END"), "ppo_kl": _MM("-nk")}, "b", _GEO))
def q_geo(spark, d):
    return _round(L.get_loss("geo_mean")(token_rows(spark, d), 0.01, 0.01))


_COV = f", g AS (SELECT {_MM('adv')} AS ma, {_MM('lp')} AS ml FROM tok), c AS (SELECT *, (adv - ma) * (lp - ml) AS cov FROM tok, g)"


@query("kl_cov_loss", _sql({"loss": _MM("-adv * exp(lp - old_lp) + CASE WHEN rn <= (SELECT greatest(1, floor(sum(mask) * 0.01)) FROM tok) AND mask > 0 THEN abs(lp - old_lp) ELSE 0 END"), "ppo_kl": _MM("abs(lp - old_lp)")}, "q", _COV + ", q AS (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY cov DESC, row_id, pos) AS rn FROM c)"))
def q_kl_cov(spark, d):
    return _round(L.get_loss("kl_cov")(tokens(spark, d), ratio=0.01))


@query("clip_cov_band", _sql({"n": "count(*)", "cov": "sum(cov)"}, "c WHERE mask > 0 AND cov < 5.0 AND cov > 0.01 AND NOT (-adv * greatest(0.99, least(1.01, exp(lp - old_lp))) > -adv * exp(lp - old_lp))", _COV))
def q_clip_cov_band(spark, d):
    t = L._covariance(token_rows(spark, d))
    a, r = F.col("adv"), F.exp(F.col("lp") - F.col("old_lp"))
    band = t.where((F.col("mask") > 0) & (F.col("_cov") < 5.0) & (F.col("_cov") > 0.01) & ~(-a * L.clamp(r, 0.99, 1.01) > -a * r))
    return _round(band.agg(F.count(F.lit(1)).alias("n"), F.sum("_cov").alias("cov")))


@query("clip_cov_loss")
def q_clip_cov(spark, d):
    return _round(L.get_loss("clip_cov")(tokens(spark, d), ratio=0.01, low=0.01, high=0.01, lb=0.01))


_W = "least(2, exp(greatest(-20, least(20, old_lp - rollout_lp))) * mask)"


@query("is_weights_token", _sql({"row_id": "row_id", "n": "count(*)", "weight": f"sum({_W})"}, "tok GROUP BY row_id").replace("round(row_id, 6)", "row_id").replace("round(count(*), 6)", "count(*)"))
def q_is_token(spark, d):
    return L.is_weights(token_rows(spark, d)).groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("is_weight"), "weight"))


@query("is_weights_seq", _sql({"weight": f"{_MM('w / mw')}"}, "n, z", ", s AS (SELECT row_id, least(1.05, exp(greatest(-20, least(20, sum((old_lp - rollout_lp) * mask))))) AS w FROM tok GROUP BY 1), n AS (SELECT tok.*, w * mask AS w FROM tok JOIN s USING (row_id)), z AS (SELECT avg(x) AS mw FROM (SELECT sum(w * mask) / (sum(mask) + 1e-8) AS x FROM n GROUP BY row_id))"))
def q_is_seq(spark, d):
    t = L.is_weights(token_rows(spark, d), "sequence", 1.05, normalize=True)
    return _round(t.agg(L.mmean(F.col("is_weight"), F.col("mask")).alias("weight")))


_RS = ", s AS (SELECT row_id, sum((old_lp - rollout_lp) * mask) AS t, sum((old_lp - rollout_lp) * mask) / (sum(mask) + 1e-8) AS g, max(CASE WHEN mask > 0 AND old_lp - rollout_lp < ln(0.992) THEN 1 ELSE 0 END) AS v FROM tok GROUP BY 1), j AS (SELECT * FROM tok JOIN s USING (row_id))"


@query("rejection_masks", _sql({
    "token": "sum(CASE WHEN exp(old_lp - rollout_lp) BETWEEN 1 / 1.005 AND 1.005 THEN mask ELSE 0 END)", "sequence": "sum(CASE WHEN exp(t) BETWEEN 1 / 1.005 AND 1.005 THEN mask ELSE 0 END)",
    "geometric": "sum(CASE WHEN exp(g) BETWEEN 1 / 1.005 AND 1.005 THEN mask ELSE 0 END)", "veto": "sum(CASE WHEN exp(g) BETWEEN 1 / 1.005 AND 1.005 THEN mask * (1 - v) ELSE 0 END)"}, "j", _RS))
def q_rs(spark, d):
    t = token_rows(spark, d)
    for level in ("token", "sequence", "geometric"):
        t = L.rejection_mask(t, level, 1.005, name=level)
    t = L.rejection_mask(t, "geometric", 1.005, veto=0.992, name="veto")
    return _round(t.agg(*[F.sum(x).alias(x) for x in ("token", "sequence", "geometric", "veto")]))


def _ratio_sql(w: str, source: str, ctes: str, lo: str = "(1 / 1.01)", hi: str = "1.01") -> str:
    c = f"greatest({lo}, least({hi}, {w}))"
    ctes += f", y AS (SELECT *, {w} AS w, {c} AS c FROM {source}), p AS (SELECT sum(w * mask) / (sum(mask) + 1e-8) AS w FROM y GROUP BY row_id), q AS (SELECT avg(w) AS a, stddev_samp(w) AS b, max(w) AS c, min(w) AS d, max(abs(w - 1)) AS e, avg(CASE WHEN w > {hi} THEN 1.0 ELSE 0 END) AS f, avg(CASE WHEN w < {lo} THEN 1.0 ELSE 0 END) AS g FROM p)"
    one = {
        "mean": _MM("w"), "max": "max(w) FILTER (mask > 0)", "min": "min(w) FILTER (mask > 0)", "std": f"sqrt(greatest({_MM('y.c * y.c')} - ({_MM('y.c')}) ^ 2, 0))", "ess": f"1 / ({_MM('y.c * y.c')} / ({_MM('y.c')} + 1e-8) ^ 2)",
        "high": _MM(f"CASE WHEN w > {hi} THEN 1 ELSE 0 END"), "low": _MM(f"CASE WHEN w < {lo} THEN 1 ELSE 0 END"), **{f"seq_{n}": f"max(q.{x})" for n, x in zip(("mean", "std", "max", "min", "dev", "high", "low"), "abcdefg", strict=True)}}
    return _sql(one, "y, q", ctes)


@query("ratio_metrics_token", _ratio_sql("exp(old_lp - rollout_lp)", "tok", ""))
def q_ratio_token(spark, d):
    return _round(L.ratio_metrics(token_rows(spark, d), "token", 1.01))


@query("ratio_metrics_geometric", _ratio_sql("exp(g)", "j", _RS))
def q_ratio_geo(spark, d):
    return _round(L.ratio_metrics(token_rows(spark, d), "geometric", 1.01))


_OFF = ", p AS (SELECT sum(old_lp * mask) / (sum(mask) + 1e-8) AS t, sum(rollout_lp * mask) / (sum(mask) + 1e-8) AS u, sum((old_lp - rollout_lp) * mask) AS s FROM tok GROUP BY row_id), q AS (SELECT avg(exp(-t)) AS a, avg(-t) AS b, avg(exp(-u)) AS c, avg(-u) AS d, avg(u - t) AS e, avg(abs(u - t)) AS f, max(u - t) AS g, min(u - t) AS h, avg(exp(u - t)) AS i, avg(exp(2 * greatest(-20, least(20, s)))) - 1 AS k FROM p)"


@query("off_policy", _sql({
    "kl": _MM("rollout_lp - old_lp"), "k3_kl": _MM("exp(old_lp - rollout_lp) - (old_lp - rollout_lp) - 1"), "chi2_token": _MM("exp(old_lp - rollout_lp) ^ 2") + " - 1",
    **{n: f"max({x})" for n, x in zip(("training_ppl", "training_log_ppl", "rollout_ppl", "rollout_log_ppl", "log_ppl_diff", "log_ppl_abs_diff", "log_ppl_diff_max", "log_ppl_diff_min", "ppl_ratio", "chi2_seq"), "abcdefghik", strict=True)}}, "tok, q", _OFF))
def q_off_policy(spark, d):
    return _round(L.off_policy_metrics(token_rows(spark, d)))


@query("rollout_correction_loss", _sql({"loss": f"0.5 * sum(-adv * lp * least(2, exp(lp - rollout_lp)) * CASE WHEN exp(lp - rollout_lp) BETWEEN 1 / 1.02 AND 1.02 THEN mask ELSE 0 END) / (sum(CASE WHEN exp(lp - rollout_lp) BETWEEN 1 / 1.02 AND 1.02 THEN mask ELSE 0 END) + 1e-8)"}))
def q_rc_loss(spark, d):
    return _round(L.get_loss("rollout_correction")(token_rows(spark, d), "token", 2.0, "token", 1.02, scale=0.5))


@query("prob_difference", _sql({"max": "max(abs(exp(rollout_lp) - exp(old_lp)))", "mean": "avg(abs(exp(rollout_lp) - exp(old_lp)))", "std": "stddev_samp(abs(exp(rollout_lp) - exp(old_lp)))"}, "tok WHERE mask > 0"))
def q_prob_diff(spark, d):
    return _round(L.prob_difference(token_rows(spark, d)))


@query("value_loss", _sql({
    "loss": f"0.5 * {_MM('greatest((entropy - reward) ^ 2, (greatest(least(entropy, value + 0.2), value - 0.2) - reward) ^ 2)')}",
    "clipfrac": _MM("CASE WHEN (greatest(least(entropy, value + 0.2), value - 0.2) - reward) ^ 2 > (entropy - reward) ^ 2 THEN 1 ELSE 0 END")}))
def q_value_loss(spark, d):
    t = token_rows(spark, d).withColumns({"vpred": F.col("entropy"), "returns": F.col("reward")})
    return _round(L.value_loss(t, 0.2))


_PAIR = """WITH p AS (SELECT o_orderkey // 2 AS k, max(CASE WHEN o_orderkey % 2 = 0 THEN -o_totalprice / 100003.7 END) AS pc, max(CASE WHEN o_orderkey % 2 = 1 THEN -o_totalprice / 100003.7 END) AS pr,
 max(CASE WHEN o_orderkey % 2 = 0 THEN -o_totalprice / 90007.1 END) AS rc, max(CASE WHEN o_orderkey % 2 = 1 THEN -o_totalprice / 90007.1 END) AS rr FROM orders GROUP BY 1), q AS (SELECT *, pc - pr - (rc - rr) AS l FROM p WHERE pc IS NOT NULL AND pr IS NOT NULL)"""


def _pairs(spark, d):
    from tracewright.session import table

    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    one = lambda odd, by: F.max(F.when(k % 2 == odd, -F.col("o_totalprice") / by))
    p = o.groupBy(F.floor(k / 2).alias("k")).agg(one(0, 100003.7).alias("pc"), one(1, 100003.7).alias("pr"), one(0, 90007.1).alias("rc"), one(1, 90007.1).alias("rr"))
    return p.where("pc IS NOT NULL AND pr IS NOT NULL")


@query("dpo_loss", f"{_PAIR} SELECT round(avg(ln(1 + exp(-0.1 * l)) * 0.9 + ln(1 + exp(0.1 * l)) * 0.1), 6) AS loss, round(avg(0.1 * (pc - rc)), 6) AS chosen_reward, round(avg(0.1 * (pr - rr)), 6) AS rejected_reward FROM q")
def q_dpo(spark, d):
    return _round(L.dpo_loss(_pairs(spark, d), 0.1, "sigmoid", 0.1))


@query("ipo_loss", f"{_PAIR} SELECT round(avg((l - 1 / 0.2) ^ 2), 6) AS loss, round(avg(0.1 * (pc - rc)), 6) AS chosen_reward, round(avg(0.1 * (pr - rr)), 6) AS rejected_reward FROM q")
def q_ipo(spark, d):
    return _round(L.dpo_loss(_pairs(spark, d), 0.1, "ipo"))


@query("sequence_logps", _sql({"row_id": "row_id", "logp": "sum(lp * mask)"}, "tok GROUP BY row_id").replace("round(row_id, 6)", "row_id"))
def q_logps(spark, d):
    return L.sequence_logps(token_rows(spark, d)).select("row_id", r6("logp"))


@query("sppo_loss", _sql({"loss": "avg((d - a) ^ 2)"}, "p", ", p AS (SELECT sum((lp - old_lp) * mask) AS d, sum(adv * mask) / (sum(mask) + 1e-8) AS a FROM tok GROUP BY row_id)"))
def q_sppo_loss(spark, d):
    return _round(L.sppo_loss(token_rows(spark, d)))


@query("prime_ce_loss", _sql({"loss": "avg(-y * ln(1 / (1 + exp(-0.05 * s))) - (1 - y) * ln(1 - 1 / (1 + exp(-0.05 * s))))"}, "p", ", p AS (SELECT sum(adv * mask) AS s, row_id % 2 AS y FROM tok GROUP BY row_id)"))
def q_prime_ce(spark, d):
    p = token_rows(spark, d).groupBy("row_id").agg(F.sum(F.col("adv") * F.col("mask")).alias("score_sum")).withColumn("label", F.col("row_id") % 2)
    return _round(L.prime_ce_loss(p))


@query("pair_accuracy", """WITH s AS (SELECT o_custkey AS g, o_totalprice AS x, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders), p AS (SELECT a.g, count(*) AS n, count(*) FILTER (a.x > b.x) AS good FROM s a JOIN s b ON a.g = b.g AND a.y = 1 AND b.y = 0 GROUP BY 1)
 SELECT round(sum(good) / sum(n), 6) AS accuracy, CAST(sum(n) AS BIGINT) AS pairs FROM p""")
def q_pair_accuracy(spark, d):
    from tracewright.session import table

    s = table(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_totalprice").alias("x"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"))
    return L.pair_accuracy(s, "g", "x", "y").select(r6("accuracy"), "pairs")


@query("logits_stats", """WITH e AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v, label FROM embeddings), z AS (SELECT *, list_max(v) AS m, list_sum([exp(x - list_max(v)) FOR x IN v]) AS s FROM e)
 SELECT vec_id, round(ln(s) + m - list_sum([x * exp(x - m) / s FOR x IN v]), 6) AS entropy, round(v[1 + label % len(v)] - m - ln(s), 6) AS logprob FROM z""")
def q_logits(spark, d):
    from tracewright.session import table

    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    label = F.col("label") % F.nullif(F.size("v"), F.lit(0))
    return e.select("vec_id", r6(L.logits_entropy(F.col("v")), "entropy"), r6(L.logprob_from_logits(F.col("v"), label), "logprob"))


_COLS = ["reward", "value", "mask"]
_GAE = """, RECURSIVE_MARK x AS (SELECT row_id, pos, r, v, m, CAST(0 AS DOUBLE) AS nv, CAST(0 AS DOUBLE) AS gl FROM (SELECT row_id, max(pos) + 1 AS pos, CAST(0 AS DOUBLE) AS r, CAST(0 AS DOUBLE) AS v, 0 AS m FROM tok GROUP BY row_id)
 UNION ALL SELECT t.row_id, t.pos, t.reward, t.value, t.mask, t.value * t.mask + (1 - t.mask) * x.nv, (t.reward + x.nv - t.value + 0.95 * x.gl) * t.mask + (1 - t.mask) * x.gl FROM x JOIN tok t ON t.row_id = x.row_id AND t.pos = x.pos - 1)"""


@query("gae", _T.replace("WITH ", "WITH RECURSIVE ") + _GAE.replace("RECURSIVE_MARK ", "") + " SELECT row_id, pos, round(gl, 6) AS advantage, round(gl + v, 6) AS returns FROM x WHERE pos <= (SELECT max(pos) FROM tok t WHERE t.row_id = x.row_id)")
def q_gae(spark, d):
    arr = S.gae(S.to_arrays(tokens(spark, d), "row_id", "pos", _COLS))
    return S.to_rows(arr, "row_id", "pos", ["advantage_raw", "returns"]).select("row_id", F.col("pos").cast("long").alias("pos"), r6("advantage_raw", "advantage"), r6("returns"))


_GAE_ALL = _T.replace("WITH ", "WITH RECURSIVE ") + _GAE.replace("RECURSIVE_MARK ", "")


@query("gae_white", _GAE_ALL + """, a AS (SELECT x.row_id, x.pos, gl, mask FROM x JOIN tok t ON t.row_id = x.row_id AND t.pos = x.pos), g AS (SELECT sum(gl * mask) / (sum(mask) + 1e-8) AS mu, sum(mask) AS n FROM a),
 v AS (SELECT sum(mask * (gl - mu) ^ 2) / (max(n) + 1e-8) * max(n) / (max(n) - 1) AS var FROM a, g) SELECT row_id, pos, round((gl - mu) / sqrt(var + 1e-8), 6) AS advantage FROM a, g, v""")
def q_gae_white(spark, d):
    arr = S.gae(S.to_arrays(tokens(spark, d), "row_id", "pos", _COLS))
    rows = S.to_rows(arr, "row_id", "pos", ["advantage_raw", "mask"])
    return S.whiten(rows, "advantage_raw", "mask", "advantage").select("row_id", F.col("pos").cast("long").alias("pos"), r6("advantage"))


_RET = """, x AS (SELECT row_id, max(pos) + 1 AS pos, CAST(0 AS DOUBLE) AS run, CAST(0 AS DOUBLE) AS ret FROM tok GROUP BY row_id UNION ALL SELECT t.row_id, t.pos, (t.reward + 0.99 * x.run) * t.mask, t.reward + 0.99 * x.run FROM x JOIN tok t ON t.row_id = x.row_id AND t.pos = x.pos - 1)"""


@query("rfpp_returns", _T.replace("WITH ", "WITH RECURSIVE ") + _RET + " SELECT x.row_id, x.pos, round(ret, 6) AS returns FROM x JOIN tok t ON t.row_id = x.row_id AND t.pos = x.pos")
def q_rfpp(spark, d):
    arr = S.discounted(S.to_arrays(tokens(spark, d), "row_id", "pos", _COLS))
    return S.to_rows(arr, "row_id", "pos", ["returns"]).select("row_id", F.col("pos").cast("long").alias("pos"), r6("returns"))


@query("discounted_returns", f"{_T} SELECT a.row_id, a.pos, round(sum(b.reward * 0.9 ^ (b.pos - a.pos)), 6) AS returns FROM tok a JOIN tok b ON a.row_id = b.row_id AND b.pos >= a.pos GROUP BY 1, 2")
def q_discounted(spark, d):
    arr = S.discounted(S.to_arrays(tokens(spark, d), "row_id", "pos", ["reward"]), mask=None, gamma=0.9)
    return S.to_rows(arr, "row_id", "pos", ["returns"]).select("row_id", F.col("pos").cast("long").alias("pos"), r6("returns"))


@query("remax", f"{_T}, x AS (SELECT *, sum(reward * mask) OVER (PARTITION BY row_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS ret FROM tok) SELECT row_id, pos, round(ret, 6) AS returns, round(ret - value * mask, 6) AS advantage FROM x")
def q_remax(spark, d):
    t = S.remax(tokens(spark, d).withColumn("baseline", F.col("value")))
    return t.select("row_id", F.col("pos").cast("long").alias("pos"), r6("returns"), r6("advantage"))


@query("whiten", f"{_T}, g AS (SELECT {_MM('reward')} AS mu, sum(mask) AS n FROM tok), v AS (SELECT sum(mask * (reward - mu) ^ 2) / (max(n) + 1e-8) * max(n) / (max(n) - 1) AS var FROM tok, g) SELECT row_id, pos, round((reward - mu) / sqrt(var + 1e-8), 6) AS white FROM tok, g, v")
def q_whiten(spark, d):
    return S.whiten(tokens(spark, d), "reward", "mask", "white").select("row_id", F.col("pos").cast("long").alias("pos"), r6("white"))


@query("top_entropy_tokens", f"{_T}, r AS (SELECT *, row_number() OVER (ORDER BY entropy DESC, row_id, pos) AS rn, sum(mask) OVER () AS n FROM tok WHERE mask > 0) SELECT count(*) AS kept, round(min(entropy), 6) AS least, round(sum(entropy), 6) AS total FROM r WHERE rn <= floor(n * 0.2 + 0.9999)")
def q_top_entropy(spark, d):
    from tracewright.operators.filters import top_entropy_tokens

    kept = top_entropy_tokens(tokens(spark, d), 0.2)
    return kept.agg(F.count(F.lit(1)).alias("kept"), r6(F.min("entropy"), "least"), r6(F.sum("entropy"), "total"))
