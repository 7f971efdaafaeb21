"""Queries over embeddings and pairs: scores, labels, reject curves, DET, quadrants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import correlation, norm, ratio, unit
from ..functions.storage import kept
from ..operators import evaluation as ev
from ..operators import labels as lb
from ..operators import pairs as pr
from ..operators import vectors as vx
from ..operators.order import average_ranks, percentiles
from ..sources import tables as src
from .registry import query, rounded

E = """e AS (SELECT vec_id AS row_idx, label AS speaker, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT row_idx, speaker, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e)"""
PROVIDERS = """pv AS (SELECT 'P1' AS provider, row_idx, speaker, v[1:22] AS v FROM e UNION ALL SELECT 'P2', row_idx, speaker, v[23:43] FROM e
UNION ALL SELECT 'P3', row_idx, speaker, v[44:64] FROM e),
pu AS (SELECT provider, row_idx, speaker, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM pv)"""
CENTROIDS = """cx AS (SELECT speaker, pos, avg(x) AS m, count(*) AS n FROM (SELECT speaker, unnest(u) AS x, unnest(range(1, len(u) + 1)) AS pos FROM u) GROUP BY speaker, pos),
cm AS (SELECT speaker, list(m ORDER BY pos) AS m, max(n) AS n FROM cx GROUP BY speaker),
c AS (SELECT speaker, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c, n FROM cm)"""
LOO = """l AS (SELECT row_idx, u.speaker, u, list_transform(list_zip(c, u), lambda z: (z[1] * n - z[2]) / greatest(n - 1, 1)) AS r, n FROM u JOIN c USING (speaker)),
loo AS (SELECT row_idx, speaker, u, CASE WHEN n > 1 THEN list_dot_product(u, r) / sqrt(list_dot_product(r, r)) END AS raw FROM l)"""
COHORT_U = """k AS (SELECT u AS k FROM u WHERE row_idx % 10 = 0),
su AS (SELECT row_idx, avg(list_dot_product(u, k)) AS mu, greatest(stddev_pop(list_dot_product(u, k)), 1e-8) AS sd FROM u, k GROUP BY row_idx)"""
COHORT = f"""{COHORT_U},
sc AS (SELECT speaker, avg(list_dot_product(c, k)) AS mu, greatest(stddev_pop(list_dot_product(c, k)), 1e-8) AS sd FROM c, k GROUP BY speaker)"""
PAIRS = """p AS (SELECT a.row_idx AS i, b.row_idx AS j, (a.speaker = b.speaker)::INT AS genuine, round(list_dot_product(a.u, b.u), 9) AS score
FROM u a JOIN u b ON a.row_idx < b.row_idx)"""
QUALITY = """q AS (SELECT vec_id AS row_idx, vec_id * 37 % 101 AS q_s, (vec_id * 53 + 11) % 101 AS q_v FROM embeddings),
pq AS (SELECT p.*, least(a.q_s, b.q_s) AS p_s, least(a.q_v, b.q_v) AS p_v FROM p JOIN q a ON i = a.row_idx JOIN q b ON j = b.row_idx)"""
STRATEGIES = """st AS (SELECT 's_only' AS strategy, genuine, score, p_s AS q FROM pq UNION ALL SELECT 'v_only', genuine, score, p_v FROM pq
UNION ALL SELECT 'reject_if_either', genuine, score, least(p_s, p_v) FROM pq UNION ALL SELECT 'reject_if_both', genuine, score, greatest(p_s, p_v) FROM pq)"""


def curve_sql(source: str, keys: str, fnmr: float) -> str:
    """E4 as the definition says it: every threshold against every pair."""
    k = f"{keys}, " if keys else ""
    on = f"USING ({keys})" if keys else "ON true"
    group = f"GROUP BY {keys}" if keys else ""
    return f"""tau AS (SELECT {k}round(quantile_cont(score, {fnmr}), 9) AS tau FROM {source} WHERE genuine = 1 {group}),
allp AS (SELECT {k}count(*) AS n FROM {source} {group}),
cv AS (SELECT {k}t, count(*) FILTER (q >= t AND genuine = 1) AS n_gen, count(*) FILTER (q >= t AND genuine = 0) AS n_imp,
  1 - count(*) FILTER (q >= t) / count(*)::DOUBLE AS reject_frac,
  avg((score < tau)::INT) FILTER (q >= t AND genuine = 1) AS fnmr, avg((score >= tau)::INT) FILTER (q >= t AND genuine = 0) AS fmr
  FROM {source} JOIN tau {on} CROSS JOIN (SELECT unnest(range(101)) AS t) GROUP BY {k}t)"""


def cohort(e: DataFrame) -> DataFrame:
    return e.where(F.col("row_idx") % 10 == 0)


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """``row_idx, speaker, v, q_s, q_v``: vectors and qualities of the recordings that are paired."""
    return src.embeddings(spark, folder).join(src.qualities(spark, folder), "row_idx").select("row_idx", "speaker", "v", "q_s", "q_v")


ID = ["row_idx", "speaker"]


PROVIDER_PAIRS = """p AS (SELECT a.provider, a.row_idx AS i, b.row_idx AS j, (a.speaker = b.speaker)::INT AS genuine, round(list_dot_product(a.u, b.u), 9) AS score,
least(a.row_idx * 37 % 101, b.row_idx * 37 % 101) AS q FROM pu a JOIN pu b ON a.provider = b.provider AND a.row_idx < b.row_idx)"""


@query(f"WITH {E} SELECT row_idx, round(sqrt(list_dot_product(u, u)), 6) AS norm, len(u)::INT AS dims, round(list_sum(u), 6) AS total FROM u")
def l0_unit_vectors(spark, folder):
    """Normalised valid embeddings."""
    u = vx.valid(src.embeddings(spark, folder)).select("row_idx", unit(F.col("v")).alias("u"))
    return rounded(u.select("row_idx", norm(F.col("u")).alias("norm"), F.size("u").alias("dims"), F.aggregate("u", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query(f"WITH {E}, {CENTROIDS} SELECT speaker, n, round(unnest(c), 6) AS value, unnest(range(len(c)))::INT AS pos FROM c")
def a1_centroids(spark, folder):
    """A1: one row per speaker and dimension."""
    c = vx.centroids(src.embeddings(spark, folder), "speaker")
    return rounded(c.select("speaker", "n", F.posexplode("centroid").alias("pos", "value")))


@query(f"WITH {E}, k AS (SELECT label AS speaker, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || '|' || 7), vec_id) AS r, vec_id FROM embeddings), s AS (SELECT u.* FROM u JOIN k ON k.vec_id = u.row_idx WHERE r <= 30), "
       "cx AS (SELECT speaker, pos, avg(x) AS m FROM (SELECT speaker, unnest(u) AS x, unnest(range(1, len(u) + 1)) AS pos FROM s) GROUP BY 1, 2) SELECT speaker, round(sqrt(sum(m * m)), 6) AS length, (SELECT count(*) FROM s t WHERE t.speaker = cx.speaker) AS n FROM cx GROUP BY speaker")  # fmt: skip
def a2_cohort_means(spark, folder):
    """A2: cohort speaker means over at most 30 recordings each, chosen by a portable hash; their length before scaling."""
    from pyspark.sql import Window as W

    from ..functions.semantics import portable_hash

    e = src.embeddings(spark, folder).withColumn("h", portable_hash(F.col("row_idx"), F.lit(7)))
    kept = e.withColumn("r", F.row_number().over(W.partitionBy("speaker").orderBy("h", "row_idx"))).where("r <= 30")
    means = kept.select("speaker", F.posexplode(unit(F.col("v"))).alias("pos", "x")).groupBy("speaker", "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return rounded(means.groupBy("speaker").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("length"), F.max("n").alias("n")))


@query(f"WITH {E}, {CENTROIDS}, {LOO} SELECT row_idx, speaker, round(raw, 6) AS genuine_raw FROM loo")
def l1_leave_one_out(spark, folder):
    """L1: genuine scores."""
    e = src.embeddings(spark, folder)
    return rounded(vx.leave_one_out(e, vx.centroids(e, "speaker"), "speaker").select("row_idx", "speaker", "genuine_raw"))


SNORM = f"WITH {E}, {CENTROIDS}, {LOO}, {COHORT}, g AS (SELECT row_idx, speaker, raw, ((raw - su.mu) / su.sd + (raw - sc.mu) / sc.sd) / 2 AS nrm FROM loo JOIN su USING (row_idx) JOIN sc USING (speaker))"


@query(f"{SNORM} SELECT row_idx, speaker, round(raw, 6) AS genuine_raw, round(nrm, 6) AS genuine_norm FROM g")
def l2_snorm(spark, folder):
    """Genuine scores with symmetric normalisation."""
    e = src.embeddings(spark, folder)
    return rounded(vx.genuine_scores(e, cohort(e)))


IMPOSTOR = f"""WITH {E}, {CENTROIDS}, {COHORT}, im AS (SELECT a.speaker AS spk_a, b.speaker AS spk_b, list_dot_product(a.c, b.c) AS raw,
((list_dot_product(a.c, b.c) - sa.mu) / sa.sd + (list_dot_product(a.c, b.c) - sb.mu) / sb.sd) / 2 AS norm
FROM c a JOIN c b ON a.speaker < b.speaker JOIN sc sa ON sa.speaker = a.speaker JOIN sc sb ON sb.speaker = b.speaker)"""


@query(f"{IMPOSTOR} SELECT spk_a, spk_b, round(raw, 6) AS raw, round(norm, 6) AS norm FROM im")
def l2b_impostor_scores(spark, folder):
    """All speaker pairs."""
    e = src.embeddings(spark, folder)
    return rounded(vx.impostor_scores(e, cohort(e)))


@query(f"WITH {E}, {COHORT_U}, {PAIRS} SELECT i, j, genuine, round(((score - a.mu) / a.sd + (score - b.mu) / b.sd) / 2, 6) AS score_norm FROM p JOIN su a ON i = a.row_idx JOIN su b ON j = b.row_idx")
def l2c_pair_snorm(spark, folder):
    """Normalised pair scores."""
    e = src.embeddings(spark, folder)
    stats = vx.cohort_stats(e.select("row_idx", unit(F.col("v")).alias("u")), "u", cohort(e), "utt")
    return pr.scores(stats.drop("u").join(e, "row_idx"), normalised=True)


@query(f"{SNORM} SELECT 'raw' AS kind, count(*) AS n, count(*) - count(raw) AS n_missing, round(avg(raw), 6) AS mean, round(stddev_pop(raw), 6) AS std, round(min(raw), 6) AS min, round(max(raw), 6) AS max FROM g UNION ALL SELECT 'norm', count(*), count(*) - count(nrm), round(avg(nrm), 6), round(stddev_pop(nrm), 6), round(min(nrm), 6), round(max(nrm), 6) FROM g")
def a8_score_statistics(spark, folder):
    """Statistics of raw and normalised genuine scores."""
    e = src.embeddings(spark, folder)
    g = vx.genuine_scores(e, cohort(e))
    rows = g.select(F.explode(F.array(F.struct(F.lit("raw").alias("kind"), F.col("genuine_raw").alias("x")), F.struct(F.lit("norm").alias("kind"), F.col("genuine_norm").alias("x")))).alias("r")).select("r.kind", "r.x")
    return rounded(lb.score_statistics(rows, "x", ["kind"]))


@query(f"{SNORM} SELECT round(avg(raw), 6) AS mean_raw, round(avg(nrm), 6) AS mean_norm, round(avg(nrm) - avg(raw), 6) AS shift FROM g")
def r4_snorm_shift(spark, folder):
    """How far normalisation moves the mean."""
    e = src.embeddings(spark, folder)
    return rounded(vx.genuine_scores(e, cohort(e)).agg(F.avg("genuine_raw").alias("mean_raw"), F.avg("genuine_norm").alias("mean_norm"), (F.avg("genuine_norm") - F.avg("genuine_raw")).alias("shift")))


@query(f"WITH {E}, d AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS pos FROM e) GROUP BY pos), n AS (SELECT sqrt(list_dot_product(v, v)) AS n FROM e) "
       "SELECT count(*) AS n_rows, round(min(n), 6) AS norm_min, round(max(n), 6) AS norm_max, round(avg(n), 6) AS norm_mean, round(stddev_pop(n), 6) AS norm_std, count(*) FILTER (n <= 1e-6) AS n_zero, (SELECT round(min(m), 6) FROM d) AS dim_mean_min, (SELECT round(max(m), 6) FROM d) AS dim_mean_max, (SELECT round(min(s), 6) FROM d) AS dim_std_min, (SELECT round(max(s), 6) FROM d) AS dim_std_max FROM n")  # fmt: skip
def r16_embedding_qa(spark, folder):
    """Quality of the embeddings."""
    return rounded(vx.embedding_qa(src.embeddings(spark, folder)))


@query("SELECT label AS speaker, count(*) AS n, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM embeddings GROUP BY label")
def j10_genuine_pairs(spark, folder):
    """Exhaustive genuine pairs of each speaker, from the scored pairs."""
    e = src.embeddings(spark, folder)
    a = e.select(F.col("row_idx").alias("i"), "speaker")
    b = e.select(F.col("row_idx").alias("j"), "speaker")
    found = a.join(b, "speaker").where("i < j").groupBy("speaker").agg(F.count("*").alias("pairs"))
    return e.groupBy("speaker").agg(F.count("*").alias("n")).join(found, "speaker", "left").select("speaker", "n", F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"))


@query(f"WITH {E}, m AS (SELECT a.row_idx AS key_a, b.row_idx AS key_b, round(list_dot_product(a.u, b.u), 9) AS s FROM u a, u b WHERE a.row_idx % 2 = 0 AND b.row_idx % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY key_a ORDER BY s DESC, key_b) AS ra, row_number() OVER (PARTITION BY key_b ORDER BY s DESC, key_a) AS rb FROM m) SELECT key_a, key_b, round(s, 6) AS score FROM r WHERE ra = 1 AND rb = 1 AND s >= 0.3")
def j11_mutual_best(spark, folder):
    """Recordings of two sessions that are each other's best match."""
    u = src.embeddings(spark, folder).select("row_idx", unit(F.col("v")).alias("u"))
    a = u.where("row_idx % 2 = 0").withColumnRenamed("row_idx", "key_a")
    b = u.where("row_idx % 2 = 1").withColumnRenamed("row_idx", "key_b")
    return rounded(vx.mutual_best(a, b, 0.3))


def _genuine_scores(spark, folder):
    e = src.provider_embeddings(spark, folder)
    g = vx.leave_one_out(e, vx.centroids(e, "provider", "speaker"), "provider", "speaker")
    return g.select("provider", "row_idx", "speaker", F.round("genuine_raw", 9).alias("score"))


def _impostor_scores(spark, folder):
    c = vx.centroids(src.provider_embeddings(spark, folder), "provider", "speaker")
    return vx.pair_products(c, ["provider"], "speaker", "centroid").withColumn("score", F.round("score", 9))


def _provider_scores(spark, folder):
    """Genuine and impostor scores, for one reading of each."""
    return _genuine_scores(spark, folder), _impostor_scores(spark, folder)


def _limits(spark, folder):
    """Thresholds, whose percentiles read their scores several times: both are written."""
    return lb.thresholds(*(kept(df, name) for df, name in zip(_provider_scores(spark, folder), ("genuine", "impostor"), strict=True)))


PROVIDER_SCORES = f"""WITH {E}, {PROVIDERS},
cx AS (SELECT provider, speaker, pos, avg(x) AS m, count(*) AS n FROM (SELECT provider, speaker, unnest(u) AS x, unnest(range(1, len(u) + 1)) AS pos FROM pu) GROUP BY ALL),
cm AS (SELECT provider, speaker, list(m ORDER BY pos) AS m, max(n) AS n FROM cx GROUP BY ALL),
c AS (SELECT provider, speaker, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c, n FROM cm),
l AS (SELECT provider, row_idx, speaker, u, list_transform(list_zip(c, u), lambda z: (z[1] * n - z[2]) / greatest(n - 1, 1)) AS r, n FROM pu JOIN c USING (provider, speaker)),
gs AS (SELECT provider, row_idx, speaker, CASE WHEN n > 1 THEN round(list_dot_product(u, r) / sqrt(list_dot_product(r, r)), 9) END AS score FROM l),
im AS (SELECT a.provider, a.speaker AS a, b.speaker AS b, round(list_dot_product(a.c, b.c), 9) AS score FROM c a JOIN c b ON a.provider = b.provider AND a.speaker < b.speaker),
th AS (SELECT provider, round(quantile_cont(gs.score, 0.9), 9) AS percentile_90, (SELECT round(quantile_cont(im.score, 0.999), 9) FROM im WHERE im.provider = gs.provider) AS fmr_001 FROM gs GROUP BY provider)"""
WIDE = """, w AS (SELECT row_idx, max(score) FILTER (provider = 'P1') AS score_P1, max(score) FILTER (provider = 'P2') AS score_P2, max(score) FILTER (provider = 'P3') AS score_P3, row_idx * 29 % 97 / 10.0 - 1 AS duration FROM gs GROUP BY row_idx),
lim AS (SELECT max(percentile_90) FILTER (provider = 'P1') AS h1, max(percentile_90) FILTER (provider = 'P2') AS h2, max(percentile_90) FILTER (provider = 'P3') AS h3, max(fmr_001) FILTER (provider = 'P1') AS l1, max(fmr_001) FILTER (provider = 'P2') AS l2, max(fmr_001) FILTER (provider = 'P3') AS l3 FROM th),
lab AS (SELECT w.*, CASE WHEN coalesce(score_P1 < l1 AND score_P2 < l2 AND score_P3 < l3, false) OR coalesce(duration < 1.5, false) THEN 0 WHEN score_P1 >= h1 AND score_P2 >= h2 AND score_P3 >= h3 AND duration >= 3 THEN 1 END AS label,
CASE WHEN score_P1 < l1 AND score_P2 < l2 AND score_P3 < l3 THEN 0 WHEN score_P1 >= h1 AND score_P2 >= h2 AND score_P3 >= h3 THEN 1 END AS label_v FROM w, lim)"""
P123 = ["P1", "P2", "P3"]


def _wide(spark, folder):
    return lb.wide_scores(_genuine_scores(spark, folder), P123).withColumn("duration", F.col("row_idx") * 29 % 97 / 10.0 - 1)


@query(f"{PROVIDER_SCORES} SELECT provider, round(percentile_90, 6) AS percentile_90, round(fmr_001, 6) AS fmr_001 FROM th")
def a5_thresholds(spark, folder):
    """Label thresholds of three systems."""
    return rounded(_limits(spark, folder))


@query(f"{PROVIDER_SCORES} {WIDE} SELECT row_idx, round(score_P1, 6) AS \"score_P1\", round(score_P2, 6) AS \"score_P2\", round(score_P3, 6) AS \"score_P3\" FROM w")
def j1_wide_scores(spark, folder):
    """Scores of all systems by recording."""
    return rounded(_wide(spark, folder).drop("duration"))


@query(f"{PROVIDER_SCORES} {WIDE} SELECT row_idx, label FROM lab WHERE label IS NOT NULL")
def l3_labels(spark, folder):
    """Training labels; excluded rows are dropped."""
    return lb.label(_wide(spark, folder), _limits(spark, folder), P123).where("label is not null").select("row_idx", "label")


@query(f"{PROVIDER_SCORES} {WIDE} SELECT row_idx, label_v AS label FROM lab")
def l3b_validation_labels(spark, folder):
    """Labels without the duration rule, null where unlabelled."""
    return lb.label(_wide(spark, folder), _limits(spark, folder), P123, use_duration=False).select("row_idx", "label")


@query(f"{PROVIDER_SCORES} {WIDE} SELECT count(*) AS total, count(*) FILTER (label IS NULL) AS excluded, count(label) AS labelled, count(*) FILTER (label = 1) AS class_1, count(*) FILTER (label = 0) AS class_0, round(count(label) / count(*), 6) AS labelled_share FROM lab")
def r6_label_funnel(spark, folder):
    """How many recordings each step of labelling leaves."""
    x = lb.label(_wide(spark, folder), _limits(spark, folder), P123)
    return rounded(x.agg(F.count("*").alias("total"), (F.count("*") - F.count("label")).alias("excluded"), F.count("label").alias("labelled"), ev.count_if(F.col("label") == 1).alias("class_1"), ev.count_if(F.col("label") == 0).alias("class_0"), ratio(F.count("label"), F.count("*")).alias("labelled_share")))


FISHER = f"{PROVIDER_SCORES}, f AS (SELECT g.provider, g.speaker, (avg(g.score) - any_value(mu)) / (coalesce(stddev_samp(g.score), 0) + any_value(sigma)) AS fisher FROM gs g JOIN (SELECT provider, avg(score) AS mu, stddev_pop(score) AS sigma FROM im GROUP BY provider) USING (provider) GROUP BY g.provider, g.speaker)"


@query(f"{FISHER} SELECT provider, speaker, round(fisher, 6) AS fisher FROM f")
def a3_fisher(spark, folder):
    """A3: discriminability of each speaker."""
    return rounded(lb.fisher(*_provider_scores(spark, folder)))


@query(f"{FISHER} SELECT row_idx, label AS speaker, round(m, 6) AS fisher_mean FROM (SELECT vec_id AS row_idx, label FROM embeddings) JOIN (SELECT speaker, avg(fisher) AS m FROM f GROUP BY speaker) ON speaker = label")
def j2_fisher_by_row(spark, folder):
    """The speaker's mean over systems on each of its recordings."""
    f = lb.fisher_mean(lb.fisher(*_provider_scores(spark, folder)))
    return rounded(src.embeddings(spark, folder).select("row_idx", "speaker").join(f, "speaker"))


@query(f"{FISHER}, s AS (SELECT speaker, avg(score) AS m FROM gs WHERE provider = 'P1' GROUP BY speaker), x AS (SELECT m, fisher FROM s JOIN f USING (speaker) WHERE provider = 'P1') SELECT count(*) AS n, round(corr(m, fisher), 6) AS r FROM x")
def r5_mean_vs_fisher(spark, folder):
    """Correlation of a speaker's mean score with its discriminability."""
    genuine, impostor = _provider_scores(spark, folder)
    one = genuine.where("provider = 'P1'")
    m = one.groupBy("speaker").agg(F.avg("score").alias("m"))
    return rounded(m.join(lb.fisher(one, impostor), "speaker").agg(F.count("*").alias("n"), correlation(F.col("m"), F.col("fisher")).alias("r")))


@query(f"{PROVIDER_SCORES} {WIDE}, m AS (SELECT row_idx, (score_P1 + score_P2 + score_P3) / 3 AS fused FROM w) SELECT row_idx, round(least(greatest((fused - lo) / (hi - lo), 0), 1), 6) AS target FROM m, (SELECT min(fused) AS lo, max(fused) AS hi FROM m)")
def l5_regression_target(spark, folder):
    """Fused and scaled target."""
    return rounded(lb.regression_target(_wide(spark, folder), [f"score_{p}" for p in P123]))


@query(f"{PROVIDER_SCORES} {WIDE}, m AS (SELECT row_idx, (score_P1 + score_P2 + score_P3) / 3 AS x FROM w), dv AS (SELECT x - avg(x) OVER () AS d, x FROM m) SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, round(median(x), 6) AS median, round(avg(d ** 3) / avg(d ** 2) ** 1.5, 6) AS skew, round(avg(d ** 4) / avg(d ** 2) ** 2 - 3, 6) AS kurt FROM dv")
def a9_target_statistics(spark, folder):
    """Moments of the fused score."""
    w = _wide(spark, folder).withColumn("fused", (F.col("score_P1") + F.col("score_P2") + F.col("score_P3")) / 3)
    return rounded(lb.target_statistics(w, "fused"))


_PAIRWISE = [("P1", "P2"), ("P1", "P3"), ("P2", "P3")]


@query(f"{PROVIDER_SCORES} {WIDE}, k AS (SELECT *, rank() OVER (ORDER BY score_P1) + (count(*) OVER (PARTITION BY score_P1) - 1) / 2 AS k1, rank() OVER (ORDER BY score_P2) + (count(*) OVER (PARTITION BY score_P2) - 1) / 2 AS k2, rank() OVER (ORDER BY score_P3) + (count(*) OVER (PARTITION BY score_P3) - 1) / 2 AS k3 FROM w) "
       "SELECT 'P1' AS a, 'P2' AS b, round(corr(score_P1, score_P2), 6) AS pearson, round(corr(k1, k2), 6) AS spearman FROM k UNION ALL SELECT 'P1', 'P3', round(corr(score_P1, score_P3), 6), round(corr(k1, k3), 6) FROM k UNION ALL SELECT 'P2', 'P3', round(corr(score_P2, score_P3), 6), round(corr(k2, k3), 6) FROM k")  # fmt: skip
def r1_provider_correlation(spark, folder):
    """Pearson and Spearman between systems, complete rows."""
    w = _wide(spark, folder).dropna()
    long = average_ranks(w.unpivot(["row_idx"], [f"score_{p}" for p in P123], "provider", "x"), ["provider"], "x", "k")
    by = long.groupBy("row_idx").agg(*[F.max(F.when(F.col("provider") == f"score_{p}", F.col(c))).alias(f"{c}{p}") for p in P123 for c in "xk"])
    one = by.agg(*[correlation(F.col(f"{c}{a}"), F.col(f"{c}{b}")).alias(f"{c}{a}{b}") for a, b in _PAIRWISE for c in "xk"])
    return rounded(one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"x{a}{b}").alias("pearson"), F.col(f"k{a}{b}").alias("spearman")) for a, b in _PAIRWISE])).alias("r")).select("r.*"))


@query(f"{PROVIDER_SCORES} {WIDE} SELECT count(*) AS n, round(avg(score_P1 - score_P2), 6) AS bias, round(avg(score_P1 - score_P2) - 1.96 * stddev_pop(score_P1 - score_P2), 6) AS low, round(avg(score_P1 - score_P2) + 1.96 * stddev_pop(score_P1 - score_P2), 6) AS high FROM w WHERE score_P1 IS NOT NULL AND score_P2 IS NOT NULL")
def r2_limits_of_agreement(spark, folder):
    """R2: bias and 95 % limits of the difference of two systems, over rows that have both."""
    d = F.col("score_P1") - F.col("score_P2")
    w = _wide(spark, folder).where(d.isNotNull())
    return rounded(w.agg(F.count("*").alias("n"), F.avg(d).alias("bias"), (F.avg(d) - 1.96 * F.stddev_pop(d)).alias("low"), (F.avg(d) + 1.96 * F.stddev_pop(d)).alias("high")))


@query(f"{PROVIDER_SCORES}, mu AS (SELECT avg(score) AS m, stddev_pop(score) AS s FROM im WHERE provider = 'P1') SELECT speaker % 3 AS dataset, count(*) AS n, round(CASE WHEN count(*) < 10 THEN 0 ELSE (avg(score) - any_value(m)) / (stddev_pop(score) + any_value(s)) END, 6) AS dprime FROM gs, mu WHERE provider = 'P1' GROUP BY 1")
def r3_dprime_by_dataset(spark, folder):
    """Separation of each dataset's genuine scores from all impostor scores; 0 below 10 rows."""
    genuine, impostor = _provider_scores(spark, folder)
    mu = impostor.where("provider = 'P1'").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    g = genuine.where("provider = 'P1'").groupBy((F.col("speaker") % 3).alias("dataset")).agg(F.count("*").alias("n"), F.avg("score").alias("gm"), F.stddev_pop("score").alias("gs"))
    d = F.when(F.col("n") < 10, 0.0).otherwise(ratio(F.col("gm") - F.col("m"), F.col("gs") + F.col("s")))
    return rounded(g.crossJoin(F.broadcast(mu)).select("dataset", "n", d.alias("dprime")))


ERC = f"WITH {E}, {PAIRS}, {QUALITY}, one AS (SELECT genuine, score, p_s AS q FROM pq), {curve_sql('one', '', 0.1)}"


@query(f"{ERC} SELECT t::INT AS t, n_gen, n_imp, round(reject_frac, 6) AS reject_frac, round(fnmr, 6) AS fnmr, round(fmr, 6) AS fmr FROM cv")
def e4_reject_curve(spark, folder):
    """The error-versus-reject curve at a start FNMR of 10 %."""
    return rounded(_curve(spark, folder).drop("k"))


def _curve_of(cells: DataFrame, quality: str, keys: list[str]) -> DataFrame:
    """A curve by ``keys`` of pairs counted by quality, class and side of the threshold."""
    at = lambda g, b: ev.total_if(F.col("n"), (F.col("genuine") == g) & F.col("below").isin(b))
    counts = cells.groupBy(*keys, F.col(quality).cast("int").alias("t")).agg(at(1, [0, 1]).alias("g"), at(0, [0, 1]).alias("i"), at(1, [1]).alias("ge"), at(0, [0]).alias("ie"))
    return ev.curve_of(counts, cells.select(*keys).distinct(), keys)


def _curve(spark, folder, fnmr: float = 0.1) -> DataFrame:
    """A curve without keys: one constant key."""
    return _curve_of(kept(pr.quality_cells(recordings(spark, folder), [], ["q_s"], fnmr), "cells").withColumn("k", F.lit(0)), "q_s", ["k"])


def _strategy_curves(spark, folder) -> DataFrame:
    cells = kept(pr.quality_cells(recordings(spark, folder), [], ["q_s", "q_v"], 0.1), "cells").withColumn("score", F.lit(0.0))
    return _curve_of(ev.strategies(cells, "q_s", "q_v", ["below", "n"]), "q", ["strategy"])


_REDUCTION = """g AS (SELECT unnest([0.1, 0.2, 0.3])::DOUBLE AS target), rk AS (SELECT {k} target, t, fnmr, reject_frac, row_number() OVER (PARTITION BY {k} target ORDER BY round(abs(reject_frac - target), 9), t) AS r FROM cv, g),
b AS (SELECT {k} fnmr AS base FROM cv WHERE t = 0)"""


@query(f"{ERC}, {_REDUCTION.format(k='')} SELECT target, round(coalesce(CASE WHEN base = 0 THEN NULL ELSE (1 - fnmr / base) * 100 END, 0), 6) AS reduction, round(reject_frac, 6) AS actual_reject_frac FROM rk, b WHERE r = 1")
def e5_fnmr_reduction(spark, folder):
    """E5: reduction of the FNMR at 10, 20 and 30 % rejection."""
    return rounded(ev.fnmr_reduction(_curve(spark, folder), ["k"]).drop("k"))


@query(f"{ERC}, {_REDUCTION.format(k='')} SELECT target, round(CASE WHEN base = 0 THEN NULL ELSE (base - fnmr) / base * 100 END, 6) AS reduction FROM rk, b WHERE r = 1")
def e5b_relative_reduction(spark, folder):
    """The reduction with missing errors left missing."""
    return rounded(ev.relative_reduction(_curve(spark, folder), ["k"]).drop("k"))


COMBINED = f"WITH {E}, {PAIRS}, {QUALITY}, {STRATEGIES}, {curve_sql('st', 'strategy', 0.1)}"


@query(f"{COMBINED} SELECT strategy, t::INT AS t, n_gen, n_imp, round(reject_frac, 6) AS reject_frac, round(fnmr, 6) AS fnmr, round(fmr, 6) AS fmr FROM cv")
def e9_combined_curves(spark, folder):
    """Curves of four ways to use two qualities."""
    return rounded(_strategy_curves(spark, folder))


@query(f"{COMBINED}, {_REDUCTION.format(k='strategy,')} SELECT strategy, target, round(coalesce(CASE WHEN base = 0 THEN NULL ELSE (1 - fnmr / base) * 100 END, 0), 6) AS reduction, round(reject_frac, 6) AS actual_reject_frac FROM rk JOIN b USING (strategy) WHERE r = 1")
def e9b_combined_summary(spark, folder):
    """Reductions of the four strategies."""
    return rounded(ev.fnmr_reduction(_strategy_curves(spark, folder), ["strategy"]))


@query(f"WITH {E}, {PAIRS} SELECT round(avg((score < 0.1)::INT) FILTER (genuine = 1), 6) AS fnmr, round(avg((score >= 0.1)::INT) FILTER (genuine = 0), 6) AS fmr FROM p")
def e1_error_rates(spark, folder):
    """FNMR and FMR at one threshold."""
    c = pr.error_counts(src.embeddings(spark, folder), ID, 0.1)
    n = lambda g, b: F.sum(F.when((F.col("genuine") == g) & F.col("below").isin(b), F.col("n")))
    rate = lambda g, b: ratio(F.coalesce(n(g, [b]), F.lit(0)), n(g, [0, 1]))
    return rounded(c.agg(rate(1, 1).alias("fnmr"), rate(0, 0).alias("fmr")))


def det_sql(source: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    on = f"USING ({keys})" if keys else "ON true"
    group = f"GROUP BY {keys}" if keys else ""
    return f"""ends AS (SELECT {k}min(score) AS lo, max(score) AS hi FROM {source} {group}),
dt AS (SELECT {k}ix AS i, lo + ix * ((hi - lo) / 499) AS threshold, avg((score >= lo + ix * ((hi - lo) / 499))::INT) FILTER (genuine = 0) AS fmr, avg((score < lo + ix * ((hi - lo) / 499))::INT) FILTER (genuine = 1) AS fnmr
FROM {source} JOIN ends {on} CROSS JOIN (SELECT unnest(range(500)) AS ix) GROUP BY {k}ix, lo, hi)"""


@query(f"WITH {E}, {PAIRS}, {det_sql('p', '')} SELECT i::INT AS i, round(threshold, 6) AS threshold, round(fmr, 6) AS fmr, round(fnmr, 6) AS fnmr FROM dt")
def e6_det(spark, folder):
    """The detection error tradeoff at 500 thresholds."""
    return rounded(_tradeoff(spark, folder).drop("grp"))


def _tradeoff(spark, folder) -> DataFrame:
    ends, cells, _ = pr.tradeoffs(src.embeddings(spark, folder), ID, pr.one_group())
    return ev.det_of(ends, cells, ["grp"])


@query(f"WITH {E}, {PAIRS}, {det_sql('p', '')}, r AS (SELECT *, row_number() OVER (ORDER BY round(abs(fmr - fnmr), 9), i) AS r FROM dt) SELECT round((fmr + fnmr) / 2, 6) AS eer, round(threshold, 6) AS threshold FROM r WHERE r = 1")
def e6_equal_error(spark, folder):
    """The equal error rate."""
    return rounded(ev.equal_error(_tradeoff(spark, folder), ["grp"]).drop("grp"))


@query(f"WITH {E}, {PAIRS}, f AS (SELECT unnest([0.01, 0.001]) AS f), t AS (SELECT f, round(quantile_cont(score, 0.99), 9) AS a, round(quantile_cont(score, 0.999), 9) AS b FROM p, f WHERE genuine = 0 GROUP BY f) SELECT f::DOUBLE AS target_fmr, round(CASE WHEN f = 0.01 THEN a ELSE b END, 6) AS tau, round(avg((score < CASE WHEN f = 0.01 THEN a ELSE b END)::INT) FILTER (genuine = 1), 6) AS fnmr FROM p, t GROUP BY f, a, b")
def e7_fnmr_at_fmr(spark, folder):
    """FNMR where the FMR is 1 and 0.1 %."""
    return rounded(pr.tradeoffs(src.embeddings(spark, folder), ID, pr.one_group(), 0, (0.01, 0.001))[2].drop("grp"))


RANKED = f"WITH {E}, {PAIRS}, {QUALITY}, rk AS (SELECT genuine, score, CASE WHEN p_s < lo THEN 'bottom' WHEN p_s > hi THEN 'top' ELSE 'middle' END AS grp FROM pq, (SELECT quantile_cont(p_s, 0.15) AS lo, quantile_cont(p_s, 0.85) AS hi FROM pq)), {det_sql('rk', 'grp')}"


@query(f"{RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(abs(fmr - fnmr), 9), i) AS r FROM dt) SELECT grp, round((fmr + fnmr) / 2, 6) AS eer, round(threshold, 6) AS threshold FROM r WHERE r = 1")
def e8_ranked_det(spark, folder):
    """Equal error rates of the lowest, middle and highest pair qualities."""
    e = recordings(spark, folder)
    counts = pr.quality_counts(e, "q_s").groupBy("q").agg(F.sum("n").alias("n"))
    edges = pr.counted_percentiles(counts, [], "q", "n", [0.15, 0.85]).head()["pct"]

    bits = lambda x: (x["q_s"] >= edges[0]) + np.int64(2) * (x["q_s"] > edges[1])
    ends, cells, _ = pr.tradeoffs(e, [*ID, "q_s"], pr.Groups(3, bits, bits, np.array([0, 1, 1, 2])))
    name = F.element_at(F.array(*map(F.lit, ("bottom", "middle", "top"))), F.col("grp") + 1)
    return rounded(ev.equal_error(ev.det_of(ends, cells, ["grp"]), ["grp"]).withColumn("grp", name))


@query("WITH q AS (SELECT vec_id * 37 % 101 AS s, (vec_id * 53 + 11) % 101 AS v, vec_id AS row_idx FROM embeddings), m AS (SELECT median(s) AS ms, median(v) AS mv FROM q) SELECT row_idx, CASE WHEN s >= ms AND v >= mv THEN 1 WHEN s < ms AND v >= mv THEN 2 WHEN s < ms AND v < mv THEN 3 ELSE 4 END AS quadrant FROM q, m")
def e10_quadrants(spark, folder):
    """Quadrants of recordings at the medians."""
    q = src.qualities(spark, folder)
    m = percentiles(q, [], "q_s", [0.5]).select(F.col("pct")[0].alias("ms")).crossJoin(percentiles(q, [], "q_v", [0.5]).select(F.col("pct")[0].alias("mv")))
    return q.crossJoin(F.broadcast(m)).select("row_idx", ev.quadrant(F.col("q_s"), F.col("q_v"), F.col("ms"), F.col("mv")).alias("quadrant"))


QUADRANTS = f"WITH {E}, {PAIRS}, {QUALITY}, m AS (SELECT genuine, median(p_s) AS ms, median(p_v) AS mv FROM pq GROUP BY genuine), qd AS (SELECT pq.genuine, score, CASE WHEN p_s >= ms AND p_v >= mv THEN 1 WHEN p_s < ms AND p_v >= mv THEN 2 WHEN p_s < ms AND p_v < mv THEN 3 ELSE 4 END AS quadrant FROM pq JOIN m ON m.genuine = pq.genuine)"


def _pair_quadrants(e: DataFrame) -> pr.Groups:
    """Pairs' quadrants, from 0, at the medians of each class: the smaller quality reaches one where both do."""
    mid = np.full((2, 2), np.inf)
    for k, q in enumerate(("q_s", "q_v")):
        for r in pr.counted_percentiles(pr.quality_counts(e, q), ["genuine"], "q", "n", [0.5]).collect():
            mid[r["genuine"], k] = r["pct"][0]
    other, own = (lambda x, m=m: (x["q_s"] >= m[0]) + np.int64(2) * (x["q_v"] >= m[1]) for m in mid)
    return pr.Groups(4, own, other, np.array([2, 3, 1, 0]))


PAIRED = [*ID, "q_s", "q_v"]


@query(f"{QUADRANTS} SELECT quadrant, genuine, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM qd GROUP BY ALL")
def e10b_pair_quadrants(spark, folder):
    """Pairs by quadrant, at medians of each class of its own."""
    e = recordings(spark, folder)
    quadrants = _pair_quadrants(e)

    def code(a, b):
        own = pr.genuine(a, b)
        bits = (f(a)[:, None] & f(b)[None, :] for f in (quadrants.own, quadrants.other))
        return quadrants.of[np.where(own, *bits)] * 2 + own

    m = pr.score_moments(e, PAIRED, 8, code)
    return rounded(m.select((F.floor(F.col("code") / 2) + 1).cast("int").alias("quadrant"), (F.col("code") % 2).alias("genuine"), "n", "mean", "std"))


@query(f"{QUADRANTS}, {det_sql('qd', 'quadrant')}, r AS (SELECT *, row_number() OVER (PARTITION BY quadrant ORDER BY round(abs(fmr - fnmr), 9), i) AS r FROM dt), tf AS (SELECT quadrant, round(quantile_cont(score, 0.99) FILTER (genuine = 0), 9) AS tau, round(quantile_cont(score, 0.999) FILTER (genuine = 0), 9) AS tau2 FROM qd GROUP BY quadrant), fn AS (SELECT quadrant, avg((score < tau)::INT) FILTER (genuine = 1) AS f, avg((score < tau2)::INT) FILTER (genuine = 1) AS f2 FROM qd JOIN tf USING (quadrant) GROUP BY quadrant) SELECT quadrant, round((fmr + fnmr) / 2, 6) AS eer, round(f, 6) AS fnmr_at_1pct, round(f2, 6) AS fnmr_at_01pct FROM r JOIN fn USING (quadrant) WHERE r = 1")
def e11_quadrant_performance(spark, folder):
    """Error rates within each quadrant."""
    e = recordings(spark, folder)
    ends, cells, errors = pr.tradeoffs(e, PAIRED, _pair_quadrants(e), 500, (0.01, 0.001))
    eer = ev.equal_error(ev.det_of(ends, cells, ["grp"]), ["grp"]).select("grp", "eer")
    at = lambda f: F.max(F.when(F.col("target_fmr") == f, F.col("fnmr")))
    rates = errors.groupBy("grp").agg(at(0.01).alias("fnmr_at_1pct"), at(0.001).alias("fnmr_at_01pct"))
    return rounded(eer.join(rates, "grp").select((F.col("grp") + 1).alias("quadrant"), "eer", "fnmr_at_1pct", "fnmr_at_01pct"))


CROSS = f"WITH {E}, {PROVIDERS}, {PROVIDER_PAIRS}, {curve_sql('p', 'provider', 0.1)}"


@query(f"{CROSS}, {_REDUCTION.format(k='provider,')}, s AS (SELECT provider, t, fnmr, lag(fnmr) OVER w AS prev, first_value(fnmr) OVER w AS f FROM cv WHERE fnmr IS NOT NULL WINDOW w AS (PARTITION BY provider ORDER BY t)), m AS (SELECT provider, bool_and(coalesce(fnmr <= prev + 0.02 * f, true)) AS monotone FROM s GROUP BY provider) SELECT provider, monotone, round(coalesce(CASE WHEN base = 0 THEN NULL ELSE (1 - fnmr / base) * 100 END, 0), 6) AS reduction FROM rk JOIN b USING (provider) JOIN m USING (provider) WHERE r = 1 AND target = 0.2")
def e13_cross_system(spark, folder):
    """Per system whether the curve is monotone and what 20 % rejection brings."""
    q = src.qualities(spark, folder).select("row_idx", "q_s")
    e = src.provider_embeddings(spark, folder).join(q, "row_idx").select("provider", *ID, "v", "q_s")
    curve = _curve_of(kept(pr.quality_cells(e, ["provider"], ["q_s"], 0.1), "cells"), "q_s", ["provider"])
    return rounded(ev.monotone(curve, "t", "fnmr", ["provider"]).join(ev.fnmr_reduction(curve, ["provider"], (0.2,)).select("provider", "reduction"), "provider"))
