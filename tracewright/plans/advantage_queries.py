"""Queries of the advantage estimators on ``orders`` as groups of responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import advantage as A
from tracewright.plans.registry import query
from tracewright.plans.views import SEQS_SQL, r6, seqs

_W = "OVER (PARTITION BY uid)"


def _sql(adv: str, source: str = "seq", extra: str = "") -> str:
    return f"WITH {SEQS_SQL}{extra} SELECT row_id, uid, round({adv}, 6) AS advantage FROM {source}"


def _out(df):
    return df.select("row_id", "uid", r6("advantage"))


_MEAN = f"CASE WHEN count(*) {_W} > 1 THEN avg(score) {_W} ELSE 0 END"
_STD = f"CASE WHEN count(*) {_W} > 1 THEN stddev_samp(score) {_W} ELSE 1 END"

_FIRST = """, firsts AS (SELECT uid, traj_uid, arg_min(score, row_id) AS s FROM seq WHERE NOT ignored GROUP BY 1, 2),
 st AS (SELECT uid, CASE WHEN count(*) > 1 THEN avg(s) ELSE 0 END AS m, CASE WHEN count(*) > 1 THEN stddev_samp(s) ELSE 1 END AS d FROM firsts GROUP BY 1)"""


@query("grpo", _sql("CASE WHEN ignored THEN score ELSE (score - m) / (d + 1e-6) END", "seq LEFT JOIN st USING (uid)", _FIRST))
def q_grpo(spark, d):
    return _out(A.estimate("grpo", seqs(spark, d), ignore="ignored"))


@query("grpo_no_std", _sql(f"score - ({_MEAN})"))
def q_grpo_no_std(spark, d):
    return _out(A.grpo(seqs(spark, d), by_std=False, all_rows=True))


@query("grpo_vec", _sql(f"(score - ({_MEAN})) / ((CASE WHEN count(*) {_W} > 1 THEN sqrt(greatest(var_samp(score) {_W}, 1e-6)) ELSE 1 END) + 1e-6)"))
def q_grpo_vec(spark, d):
    return _out(A.estimate("grpo_vectorized", seqs(spark, d)))


_TWO = ", two AS (SELECT * FROM seq WHERE uid IN (SELECT uid FROM seq GROUP BY 1 HAVING count(*) > 1)), rk AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, row_id) AS rn, lead(score) OVER (PARTITION BY uid ORDER BY score DESC, row_id) AS nxt, stddev_samp(score) OVER (PARTITION BY uid) AS sd FROM two)"


@query("passk", _sql("CASE WHEN rn = 1 THEN (score - nxt) / (sd + 1e-6) ELSE 0 END", "rk", _TWO))
def q_passk(spark, d):
    s = seqs(spark, d)
    more = s.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("uid")
    return _out(A.estimate("grpo_passk", s.join(more, "uid", "left_semi")))


_WHITE = f", c AS (SELECT *, score - ({_MEAN}) AS x FROM seq), g AS (SELECT sum(x * n_tokens) / (sum(n_tokens) + 1e-8) AS m, sum(n_tokens) AS n FROM c), v AS (SELECT sum(n_tokens * (x - m) ^ 2) / (max(n) + 1e-8) * max(n) / (max(n) - 1) AS var FROM c, g)"


@query("rfpp_baseline", _sql("(x - m) / sqrt(var + 1e-8)", "c, g, v", _WHITE))
def q_rfpp_baseline(spark, d):
    return _out(A.estimate("reinforce_plus_plus_baseline", seqs(spark, d)))


@query("rloo", _sql(f"CASE WHEN count(*) {_W} > 1 THEN (score - avg(score) {_W}) * count(*) {_W} / (count(*) {_W} - 1) ELSE score END"))
def q_rloo(spark, d):
    return _out(A.estimate("rloo", seqs(spark, d)))


@query("rloo_vec", _sql(f"CASE WHEN count(*) {_W} > 1 THEN (count(*) {_W} * score - sum(score) {_W}) / (count(*) {_W} - 1) ELSE 0 END"))
def q_rloo_vec(spark, d):
    return _out(A.estimate("rloo_vectorized", seqs(spark, d)))


@query("opo", _sql(f"score - CASE WHEN count(*) {_W} > 1 THEN sum(score * n_tokens) {_W} / sum(n_tokens) {_W} ELSE 0 END"))
def q_opo(spark, d):
    return _out(A.estimate("opo", seqs(spark, d)))


@query("gpg", _sql(f"(SELECT count(*) / greatest(count(*) FILTER (score <> 0), 1) FROM seq) * (score - ({_MEAN}))"))
def q_gpg(spark, d):
    return _out(A.estimate("gpg", seqs(spark, d)))


_WS = "OVER (PARTITION BY uid, anchor)"


@query("gigpo", _sql(f"score - ({_MEAN}) + step_score - avg(step_score) {_WS}"))
def q_gigpo(spark, d):
    return _out(A.estimate("gigpo", seqs(spark, d)))


@query("gigpo_std", _sql(f"(score - ({_MEAN})) / (({_STD}) + 1e-6) + (step_score - avg(step_score) {_WS}) / ((CASE WHEN count(*) {_WS} > 1 THEN stddev_samp(step_score) {_WS} ELSE 1 END) + 1e-6)"))
def q_gigpo_std(spark, d):
    return _out(A.estimate("gigpo", seqs(spark, d), by_std=True))


@query("step_group_sizes", f"WITH {SEQS_SQL}, g AS (SELECT uid, anchor, count(*) AS group_size FROM seq GROUP BY 1, 2) SELECT group_size, count(*) AS groups FROM g GROUP BY 1")
def q_step_group_sizes(spark, d):
    return A.step_group_sizes(seqs(spark, d))


@query("taura_weight", f"WITH {SEQS_SQL}, h AS (SELECT *, step_score / (n_tokens + 1e-8) AS h FROM seq) SELECT row_id, round(h / (sum(h) {_W} / (count(*) {_W} + 1e-8) + 1e-8), 6) AS weight FROM h")
def q_taura(spark, d):
    return A.entropy_weights(seqs(spark, d), entropy_sum="step_score").select("row_id", r6("weight"))


@query("soft_weight", f"WITH {SEQS_SQL}, h AS (SELECT *, exp(score - max(score) {_W}) AS e FROM seq) SELECT row_id, round(e / (sum(e) {_W} + 1e-8) - 1.0 / count(*) {_W} + 1, 6) AS weight FROM h")
def q_soft(spark, d):
    return A.soft_entropy_weights(seqs(spark, d), x="score").select("row_id", r6("weight"))


@query("weighted_advantage", f"WITH {SEQS_SQL} SELECT row_id, uid, round(CASE WHEN ignored THEN 0 ELSE (CASE WHEN count(*) {_W} > 1 THEN (score - avg(score) {_W}) * count(*) {_W} / (count(*) {_W} - 1) ELSE score END) * step_score END, 6) AS advantage FROM seq")
def q_weighted(spark, d):
    return _out(A.estimate("rloo", seqs(spark, d).withColumn("keep", ~F.col("ignored")), weight="step_score", keep="keep"))


@query("prime_rloo", f"WITH {SEQS_SQL}, b AS (SELECT *, row_id // 4 AS blk FROM seq) SELECT row_id, uid, round(CASE WHEN count(*) OVER (PARTITION BY blk) > 1 THEN (score - avg(score) OVER (PARTITION BY blk)) * count(*) OVER (PARTITION BY blk) / (count(*) OVER (PARTITION BY blk) - 1) ELSE score END, 6) AS advantage FROM b")
def q_prime(spark, d):
    return _out(A.prime_rloo(seqs(spark, d), 4))


@query("sppo_advantage", f"WITH {SEQS_SQL} SELECT row_id, uid, round(score - (SELECT ln(avg(exp(score))) FROM seq), 6) AS advantage FROM seq")
def q_sppo(spark, d):
    return _out(A.sppo_advantage(seqs(spark, d)))


@query("advantage_explosion", f"""WITH {SEQS_SQL}, z AS (SELECT row_id, (score - avg(score) {_W}) / (stddev_samp(score) {_W} + 1e-6) AS a, (score - avg(score) {_W}) / (stddev_pop(score) {_W} + 1e-6) AS b, count(*) {_W} AS n FROM seq)
 SELECT count(*) AS n_rows, count(*) FILTER (abs(a) > 1.5) AS wild, round(max(abs(a)), 6) AS max_fixed, round(max(abs(b)), 6) AS max_biased, round(avg(abs(greatest(-5, least(5, b)))), 6) AS mean_clamped FROM z WHERE n > 1""")
def q_explosion(spark, d):
    from tracewright.operators.grouping import with_group_stats

    s = with_group_stats(seqs(spark, d), ["uid"], {"m": F.avg("score"), "a": F.stddev_samp("score"), "b": F.stddev_pop("score"), "n": F.count(F.lit(1))}).where("n > 1")
    a, b = (F.abs((F.col("score") - F.col("m")) / (F.col(x) + 1e-6)) for x in "ab")
    signed = (F.col("score") - F.col("m")) / (F.col("b") + 1e-6)
    clamped = F.abs(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), signed)))
    return s.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(a > 1.5).alias("wild"), r6(F.max(a), "max_fixed"), r6(F.max(b), "max_biased"), r6(F.avg(clamped), "mean_clamped"))
