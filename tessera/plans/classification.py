"""Queries over labelled samples with scores: confusion, ranking, calibration, agreement, verdicts."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import mapped_score, ratio
from ..operators import evaluation as ev
from ..operators import labels as lb
from ..operators.order import percentiles, running
from ..sources import tables as src
from .registry import query, rounded

L = "l AS (SELECT doc_id AS row_idx, source AS dataset, quality AS label, n_chars * 7 % 101 AS score, n_chars * 13 % 101 AS score_v, n_chars * 7 % 101 / 100.0::DOUBLE AS p FROM labels JOIN documents USING (doc_id))"
PER = "per AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM l GROUP BY score), roc AS (SELECT score, p, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS ps, sum(n) OVER () AS ns FROM per WINDOW w AS (ORDER BY score DESC))"


def rows(spark, folder):
    return src.labelled(spark, folder).withColumn("p", F.col("score") / 100.0)


@query(f"WITH {L}, c AS (SELECT count(*) FILTER (score >= 50 AND label = 1) AS tp, count(*) FILTER (score >= 50 AND label = 0) AS fp, count(*) FILTER (score < 50 AND label = 1) AS fn, count(*) FILTER (score < 50 AND label = 0) AS tn FROM l) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def e14_confusion(spark, folder):
    """Confusion at a score of 50."""
    return rounded(ev.confusion(rows(spark, folder), 50))


@query(f"WITH {L}, k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM l), n AS (SELECT count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 0) AS b, sum(r) FILTER (label = 1) AS s FROM k) SELECT round((s - a * (a + 1) / 2) / (a * b), 6) AS auc FROM n")
def e15_roc_auc(spark, folder):
    """Area under the ROC curve."""
    return rounded(ev.roc_auc(rows(spark, folder), []))


@query(f"WITH {L}, k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM l) SELECT round(sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2, 6) AS u, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM k")
def e25_mann_whitney(spark, folder):
    """Mann-Whitney U from average ranks."""
    return rounded(ev.mann_whitney(rows(spark, folder)))


@query(f"WITH {L}, {PER} SELECT score AS threshold, round(tp / ps - fp / ns, 6) AS j FROM roc ORDER BY round(tp / ps - fp / ns, 9) DESC, score DESC LIMIT 1")
def e16_youden(spark, folder):
    """The threshold of the largest tpr - fpr."""
    return rounded(ev.youden(ev.roc_points(rows(spark, folder).withColumn("k", F.lit(0)), ["k"])))


@query(f"WITH {L}, {PER} SELECT (SELECT round(sum(tp / (tp + fp) * p / ps), 6) FROM roc) AS auc_pr, (SELECT round(avg((p - label) ** 2), 6) FROM l) AS brier")
def e17_average_precision_brier(spark, folder):
    """Average precision and Brier score."""
    r = rows(spark, folder)
    points = ev.roc_points(r.withColumn("k", F.lit(0)), ["k"])
    brier = r.agg(F.avg((F.col("p") - F.col("label")) * (F.col("p") - F.col("label"))).alias("brier"))
    return rounded(ev.average_precision(points).crossJoin(brier))


@query(f"WITH {L}, {PER} SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / ps, 6) AS tpr, round(fp / ns, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM roc")
def r11_roc_points(spark, folder):
    """ROC and precision-recall points."""
    return rounded(ev.roc_points(rows(spark, folder).withColumn("k", F.lit(0)), ["k"]).select("score", "tp", "fp", "tpr", "fpr", "precision"))


BINS10 = "b AS (SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS mean_p, avg(label::DOUBLE) AS share FROM l GROUP BY 1)"


@query(f"WITH {L}, {BINS10} SELECT bin, n, round(mean_p, 6) AS mean_p, round(share, 6) AS share FROM b")
def e19_reliability(spark, folder):
    """Reliability diagram, 10 bins."""
    return rounded(ev.calibration_bins(rows(spark, folder)))


@query(f"WITH {L}, {BINS10} SELECT round(sum(abs(mean_p - share) * n) / sum(n), 6) AS ece, round(max(abs(mean_p - share)), 6) AS mce FROM b")
def e18_calibration_error(spark, folder):
    """Calibration error with a closed last bin."""
    return rounded(ev.calibration_error(ev.calibration_bins(rows(spark, folder))))


@query(f"WITH {L}, b AS (SELECT floor(p * 10)::INT AS bin, count(*) AS n, avg(p) AS mean_p, avg(label::DOUBLE) AS share FROM l WHERE p < 1 GROUP BY 1) SELECT round(sum(abs(mean_p - share) * n) / sum(n), 6) AS ece, round(max(abs(mean_p - share)), 6) AS mce FROM b")
def e18b_calibration_error_open(spark, folder):
    """The variant whose last bin is open, so that p = 1 is left out."""
    return rounded(ev.calibration_error(ev.calibration_bins(rows(spark, folder), last_closed=False)))


NAMED = "CASE WHEN score <= 20 THEN 'very_low' WHEN score <= 40 THEN 'low' WHEN score <= 60 THEN 'medium' WHEN score <= 80 THEN 'high' ELSE 'very_high' END"


@query(f"WITH {L} SELECT {NAMED} AS bin, count(*) AS n, round(avg(label), 6) AS share, round(avg(score_v), 6) AS mean_v FROM l GROUP BY 1")
def l7_quality_bins(spark, folder):
    """Samples by named quality bin."""
    return rounded(rows(spark, folder).groupBy(ev.quality_bin(F.col("score")).alias("bin")).agg(F.count("*").alias("n"), F.avg("label").alias("share"), F.avg("score_v").alias("mean_v")))


@query(f"WITH {L} SELECT row_idx, {NAMED} AS bin, score_v, round(row_number() OVER w / count(*) OVER (PARTITION BY {NAMED}), 6) AS cdf FROM l WINDOW w AS (PARTITION BY {NAMED} ORDER BY score_v, row_idx)")
def w4_ecdf(spark, folder):
    """Empirical distribution of the second score in each quality bin."""
    r = rows(spark, folder).withColumn("bin", ev.quality_bin(F.col("score")))
    return rounded(ev.ecdf(r, "bin", "score_v", "row_idx"))


@query(f"WITH {L}, m AS (SELECT avg(score_v) FILTER ({NAMED} = 'very_high') AS hi, avg(score_v) FILTER ({NAMED} = 'very_low') AS lo FROM l) SELECT coalesce(hi > lo, false) AS shifted FROM m")
def e20_cdf_shift(spark, folder):
    """Whether the best bin's mean is above the worst one's; false where either is empty."""
    r = rows(spark, folder).withColumn("bin", ev.quality_bin(F.col("score")))
    mean = lambda b: F.avg(F.when(F.col("bin") == b, F.col("score_v")))
    return r.agg(F.coalesce(mean("very_high") > mean("very_low"), F.lit(False)).alias("shifted"))


QUART = "q AS (SELECT quantile_cont(score, 0.25) AS a, quantile_cont(score, 0.5) AS b, quantile_cont(score, 0.75) AS c FROM l), g AS (SELECT l.*, CASE WHEN score <= a THEN 1 WHEN score <= b THEN 2 WHEN score <= c THEN 3 ELSE 4 END AS quartile FROM l, q)"


@query(f"WITH {L}, {QUART} SELECT row_idx, quartile, score_v, round(row_number() OVER (PARTITION BY quartile ORDER BY score_v, row_idx) / count(*) OVER (PARTITION BY quartile), 6) AS cdf FROM g")
def r9_quartile_cdf(spark, folder):
    """Distribution of the second score by quartile of the first."""
    r = rows(spark, folder)
    q = percentiles(r, [], "score", [0.25, 0.5, 0.75]).withColumnRenamed("pct", "q")
    x = r.crossJoin(F.broadcast(q)).withColumn("quartile", F.when(F.col("score") <= F.col("q")[0], 1).when(F.col("score") <= F.col("q")[1], 2).when(F.col("score") <= F.col("q")[2], 3).otherwise(4))
    return rounded(ev.ecdf(x, "quartile", "score_v", "row_idx"))


@query(f"WITH {L}, d AS (SELECT score, sum(count(*) FILTER (label = 1)) OVER w AS a, sum(count(*) FILTER (label = 0)) OVER w AS b FROM l GROUP BY score WINDOW w AS (ORDER BY score)) SELECT round(max(abs(a / (SELECT count(*) FROM l WHERE label = 1) - b / (SELECT count(*) FROM l WHERE label = 0))), 6) AS ks FROM d")
def e25_ks(spark, folder):
    """Kolmogorov-Smirnov statistic."""
    return rounded(ev.ks_statistic(rows(spark, folder)))


@query(f"WITH {L}, o AS (SELECT label, (score >= 50)::INT AS y, count(*) AS n FROM l GROUP BY ALL), t AS (SELECT sum(n) AS n FROM o), e AS (SELECT a.label, b.y, a.n * b.n / t.n AS e FROM (SELECT label, sum(n) AS n FROM o GROUP BY 1) a, (SELECT y, sum(n) AS n FROM o GROUP BY 1) b, t) SELECT round(sum((coalesce(o.n, 0) - e) ** 2 / e), 6) AS chi2 FROM e LEFT JOIN o USING (label, y)")
def e25_chi_square(spark, folder):
    """Chi-square of label against the decision at 50."""
    o = rows(spark, folder).groupBy("label", (F.col("score") >= 50).cast("int").alias("y")).agg(F.count("*").alias("n"))
    a = o.groupBy("label").agg(F.sum("n").alias("a"))
    b = o.groupBy("y").agg(F.sum("n").alias("b"))
    e = a.crossJoin(b).join(o, ["label", "y"], "left").crossJoin(o.agg(F.sum("n").alias("t"))).withColumn("e", ratio(F.col("a") * F.col("b"), F.col("t")))
    return rounded(e.agg(F.sum((F.coalesce("n", F.lit(0)) - F.col("e")) * (F.coalesce("n", F.lit(0)) - F.col("e")) / F.col("e")).alias("chi2")))


@query(f"WITH {L}, m AS (SELECT label, avg(score) AS m, stddev_pop(score) AS s, var_samp(score) AS v, count(*) AS n FROM l GROUP BY label), x AS (SELECT * FROM m WHERE label = 1), y AS (SELECT * FROM m WHERE label = 0) SELECT round((x.m - y.m) / (x.s + y.s), 6) AS dprime, round((x.m - y.m) / sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2)), 6) AS cohen_d FROM x, y")
def e24_effect_sizes(spark, folder):
    """d' with population deviations and Cohen's d with the pooled sample deviation."""
    m = rows(spark, folder).groupBy("label").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), F.var_samp("score").alias("v"), F.count("*").alias("n"))
    x = m.where("label = 1").select(*[F.col(c).alias(f"x{c}") for c in "msvn"])
    y = m.where("label = 0").select(*[F.col(c).alias(f"y{c}") for c in "msvn"])
    pooled = F.sqrt(((F.col("xn") - 1) * F.col("xv") + (F.col("yn") - 1) * F.col("yv")) / (F.col("xn") + F.col("yn") - 2))
    d = F.col("xm") - F.col("ym")
    return rounded(x.crossJoin(y).select(ratio(d, F.col("xs") + F.col("ys")).alias("dprime"), ratio(d, pooled).alias("cohen_d")))


@F.pandas_udf(T.DoubleType())
def _erfc(x):
    return x.map(math.erfc)


@query(f"WITH {L}, c AS (SELECT count(*) FILTER ((score >= 50) = (label = 1) AND (score_v >= 50) <> (label = 1)) AS n10, count(*) FILTER ((score >= 50) <> (label = 1) AND (score_v >= 50) = (label = 1)) AS n01 FROM l) SELECT n10, n01, round(CASE WHEN n01 + n10 = 0 THEN 0 ELSE (abs(n01 - n10) - 1) ** 2 / (n01 + n10) END, 6) AS chi2 FROM c")
def e21_mcnemar(spark, folder):
    """McNemar's statistic of two classifiers, with continuity correction."""
    a = (F.col("score") >= 50) == (F.col("label") == 1)
    b = (F.col("score_v") >= 50) == (F.col("label") == 1)
    return rounded(mcnemar(rows(spark, folder), a, b).drop("p_value"))


def mcnemar(df, a, b):
    """``n10, n01, chi2, p_value``; 0 and 1 where the two never differ. The tail of one degree of freedom is erfc."""
    c = df.agg(ev.count_if(a & ~b).alias("n10"), ev.count_if(~a & b).alias("n01"))
    d = F.abs(F.col("n01") - F.col("n10")) - 1
    c = c.withColumn("chi2", F.coalesce(ratio(d * d, F.col("n01") + F.col("n10")), F.lit(0.0)))
    return c.withColumn("p_value", F.when(F.col("n01") + F.col("n10") == 0, 1.0).otherwise(_erfc(F.sqrt(F.col("chi2") / 2))))


@query(f"WITH {L}, d AS (SELECT score - score_v AS d FROM l) SELECT count(*) AS n, round(avg(d), 6) AS mean, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, 0.016667::DOUBLE AS alpha FROM d")
def e22_paired_t(spark, folder):
    """Paired t statistic; alpha is Bonferroni's for three comparisons."""
    d = (F.col("score") - F.col("score_v")).cast("double")
    return rounded(rows(spark, folder).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), ratio(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count("*").cast("double"))).alias("t"), F.lit(0.05 / 3).alias("alpha")))


@query(f"WITH {L}, c AS (SELECT avg(((score >= 50) = (score_v >= 50))::INT) AS po, avg((score >= 50)::INT) AS a, avg((score_v >= 50)::INT) AS b FROM l) SELECT round(po, 6) AS agreement, round((po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) AS kappa FROM c")
def e23_kappa(spark, folder):
    """Agreement and Cohen's kappa of two decisions."""
    a, b = (F.col("score") >= 50).cast("int"), (F.col("score_v") >= 50).cast("int")
    c = rows(spark, folder).agg(F.avg((a == b).cast("int")).alias("po"), F.avg(a).alias("a"), F.avg(b).alias("b"))
    pe = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))
    return rounded(c.select(F.col("po").alias("agreement"), ratio(F.col("po") - pe, 1 - pe).alias("kappa")))


@query(f"WITH {L}, v AS (SELECT unnest(range(0, 101, 5)) AS t), x AS (SELECT t, 'reject_if_either' AS strategy, label, score, (score >= t AND score_v >= t) AS ok FROM l, v UNION ALL SELECT t, 'reject_if_both', label, score, (score >= t OR score_v >= t) FROM l, v UNION ALL SELECT t, 's_only', label, score, score >= t FROM l, v UNION ALL SELECT t, 'v_only', label, score, score_v >= t FROM l, v) SELECT strategy, t::INT AS t, count(*) FILTER (ok) AS n_kept, round(1 - count(*) FILTER (ok) / count(*), 6) AS reject_frac, round(avg(((score >= 50) = (label = 1))::INT) FILTER (ok), 6) AS accuracy FROM x GROUP BY 1, 2")
def e9c_sample_rejection(spark, folder):
    """Accuracy of the accepted samples as both, either or one of two scores reject."""
    r = rows(spark, folder)
    ways = {"s_only": F.col("score"), "v_only": F.col("score_v"), "reject_if_either": F.least("score", "score_v"), "reject_if_both": F.greatest("score", "score_v")}
    right = ((F.col("score") >= 50) == (F.col("label") == 1)).cast("int")
    stacked = r.select(right.alias("right"), F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), q.alias("q")) for k, q in ways.items()])).alias("w")).select("right", "w.strategy", "w.q")
    cells = stacked.groupBy("strategy", (F.floor(F.col("q") / 5) * 5).cast("int").alias("t")).agg(F.count("*").alias("n"), F.sum("right").alias("ok"))
    grid = stacked.select("strategy").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(5))))
    above, total = W.partitionBy("strategy").orderBy(F.desc("t")), W.partitionBy("strategy")
    x = grid.join(cells, ["strategy", "t"], "left").fillna(0, ["n", "ok"]).select("strategy", "t", F.sum("n").over(above).alias("n_kept"), F.sum("ok").over(above).alias("ok"), F.sum("n").over(total).alias("all"))
    return rounded(x.select("strategy", "t", "n_kept", (1 - ratio(F.col("n_kept"), F.col("all"))).alias("reject_frac"), ratio(F.col("ok"), F.col("n_kept")).alias("accuracy")))


@query(f"WITH {L} SELECT CASE WHEN score >= 50 AND score_v >= 50 THEN 1 WHEN score < 50 AND score_v >= 50 THEN 2 WHEN score < 50 THEN 3 ELSE 4 END AS quadrant, count(*) AS n, round(avg(label), 6) AS share FROM l GROUP BY 1")
def e11b_sample_quadrants(spark, folder):
    """Labelled samples by quadrant at 50 / 50."""
    q = ev.quadrant(F.col("score"), F.col("score_v"), F.lit(50), F.lit(50)).alias("quadrant")
    return rounded(rows(spark, folder).groupBy(q).agg(F.count("*").alias("n"), F.avg("label").alias("share")))


@query(f"WITH {L} SELECT row_idx, least(greatest(round_even(p * p * 100, 0), 0), 100)::INT AS mapped FROM l")
def l6_mapped_score(spark, folder):
    """Probability to score, half to even."""
    return rows(spark, folder).select("row_idx", mapped_score(F.col("p") * F.col("p")).alias("mapped"))


@query(f"WITH {L}, k AS (SELECT row_idx, label, md5(row_idx || '|' || 11) AS h FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, row_idx) AS r FROM k) SELECT row_idx, label FROM r WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM l GROUP BY label))")
def x2_balanced_classes(spark, folder):
    """Classes cut to the size of the smallest, by a portable hash."""
    return lb.balanced(rows(spark, folder).select("row_idx", "label"), "label", "row_idx", "11")


@query("WITH d AS (SELECT doc_id AS row_idx, n_chars * 7 % 101 AS s, md5(doc_id || '|' || 3) AS h FROM documents), b AS (SELECT *, least(s // 10, 9)::INT AS bin, row_number() OVER (PARTITION BY least(s // 10, 9) ORDER BY h, row_idx) AS r FROM d), f AS (SELECT *, row_number() OVER (ORDER BY (r > 20)::INT, bin DESC, h, row_idx) AS o FROM b) SELECT row_idx, bin FROM f WHERE r <= 20 OR o <= 200")
def x3_decile_sample(spark, folder):
    """Up to 20 samples of each score decile, padded to 200 from the top decile down."""
    from ..functions.semantics import portable_hash

    d = src.table(spark, folder, "documents").select(F.col("doc_id").alias("row_idx"), F.least(F.floor((F.col("n_chars") * 7 % 101) / 10), F.lit(9)).cast("int").alias("bin"))
    d = d.withColumn("h", portable_hash(F.col("row_idx"), F.lit("3")))
    w = W.partitionBy("bin").orderBy("h", "row_idx")
    ranked = d.withColumn("r", F.row_number().over(w))
    first = ranked.where("r <= 20").select("row_idx", "bin")
    missing = first.agg((F.lit(200) - F.count("*")).alias("missing"))
    rest = ranked.where("r > 20 and r <= 220").withColumn("o", F.row_number().over(W.orderBy(F.desc("bin"), "h", "row_idx")))
    return first.unionAll(rest.crossJoin(F.broadcast(missing)).where("o <= missing").select("row_idx", "bin"))


@query(f"WITH {L} SELECT dataset, count(*) FILTER (label = 0) AS class_0, count(*) FILTER (label = 1) AS class_1 FROM l GROUP BY dataset")
def a11_dataset_by_label(spark, folder):
    """Datasets against labels."""
    x = rows(spark, folder).groupBy("dataset").pivot("label", [0, 1]).count().fillna(0)
    return x.select("dataset", F.col("0").alias("class_0"), F.col("1").alias("class_1"))


@query(f"WITH {L} SELECT dataset, round(avg(p), 6) AS p, round(avg(p) - 1.96 * sqrt(avg(p) * (1 - avg(p)) / count(*)), 6) AS low, round(avg(p) + 1.96 * sqrt(avg(p) * (1 - avg(p)) / count(*)), 6) AS high FROM (SELECT dataset, label AS p FROM l) GROUP BY dataset")
def r14_normal_interval(spark, folder):
    """Normal interval of a share."""
    x = rows(spark, folder).groupBy("dataset").agg(F.avg(F.col("label").cast("double")).alias("p"), F.count("*").alias("n"))
    half = 1.96 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return rounded(x.select("dataset", "p", (F.col("p") - half).alias("low"), (F.col("p") + half).alias("high")))


AUCS = "au AS (SELECT dataset, (sum(u) / (sum(p) * sum(n))) AS auc FROM (SELECT dataset, p, n, p * (coalesce(sum(n) OVER (PARTITION BY dataset ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) AS u FROM (SELECT dataset, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM l GROUP BY ALL)) GROUP BY dataset HAVING sum(p) * sum(n) > 0)"


@query(f"WITH {L}, {AUCS}, s AS (SELECT dataset, avg(score) AS erc_s, avg(score_v) AS erc_v FROM l GROUP BY dataset), m AS (SELECT au.*, erc_s + erc_v AS erc FROM au JOIN s USING (dataset)), k AS (SELECT * FROM m WHERE auc >= 0.5 UNION ALL SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m WHERE auc >= 0.5)) SELECT dataset AS winner, round(erc, 6) AS erc FROM k ORDER BY round(erc, 9) DESC, dataset LIMIT 1")
def e27_winner(spark, folder):
    """Of the models past the AUC gate (all where none is), the one with the largest summed benefit."""
    r = rows(spark, folder)
    m = ev.roc_auc(r, ["dataset"]).where("auc is not null").join(r.groupBy("dataset").agg((F.avg("score") + F.avg("score_v")).alias("erc")), "dataset")
    gate = m.withColumn("passed", F.max((F.col("auc") >= 0.5).cast("int")).over(W.partitionBy()))
    best = gate.where("auc >= 0.5 or passed = 0").agg(F.max_by(F.struct("dataset", "erc"), F.struct(F.round("erc", 9), F.lit(0))).alias("b"))
    return rounded(best.select(F.col("b.dataset").alias("winner"), F.col("b.erc").alias("erc")))


@query(f"WITH {L}, {AUCS}, s AS (SELECT dataset, list_transform([avg(score), avg(score_v), avg(score) - avg(score_v) + 20], lambda x: x) AS ercs FROM l GROUP BY dataset) SELECT dataset, round(list_avg(ercs), 6) AS mean_erc, row_number() OVER (ORDER BY round(list_avg(ercs), 9) DESC, dataset) AS place FROM au JOIN s USING (dataset) WHERE auc >= 0.4 AND list_min(ercs) >= 0")
def r15_model_gate(spark, folder):
    """Candidates past every gate, best mean first."""
    r = rows(spark, folder)
    s = r.groupBy("dataset").agg(F.array(F.avg("score"), F.avg("score_v"), F.avg("score") - F.avg("score_v") + 20).alias("ercs"))
    m = ev.roc_auc(r, ["dataset"]).join(s, "dataset").where((F.col("auc") >= 0.4) & F.forall("ercs", lambda x: x >= 0))
    mean = F.aggregate("ercs", F.lit(0.0), lambda a, x: a + x) / F.size("ercs")
    m = m.select("dataset", mean.alias("mean_erc"))
    return rounded(m.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.round("mean_erc", 9)), "dataset")).cast("long")))


def verdict():
    """The ordered tree on accuracies ``both, s, v``, percent that only one side explains and the better
    cross-prediction."""
    gain, least_unique = F.col("both") - F.greatest("s", "v"), F.least("s_unique", "v_unique")
    # The gates of the tree.
    return (
        F.when((gain <= 0.01) & (F.col("cross") > 0.75), "ONE_SUFFICES").when((gain > 0.01) & (least_unique > 2.0), "BOTH_NEEDED").when((gain > 0.01) & (least_unique < 1.0), "MARGINAL_BENEFIT")
        .when(F.col("cross") < 0.65, "TRULY_INDEPENDENT").when(gain > 0.005, "BOTH_RECOMMENDED").otherwise("EITHER_SUFFICIENT")
    )


@query(f"WITH {L}, m AS (SELECT dataset, avg((((score >= 50) OR (score_v >= 50)) = (label = 1))::INT) AS b, avg(((score >= 50) = (label = 1))::INT) AS s, avg(((score_v >= 50) = (label = 1))::INT) AS v, 100 * avg(((score >= 50) = (label = 1) AND (score_v >= 50) <> (label = 1))::INT) AS su, 100 * avg(((score >= 50) <> (label = 1) AND (score_v >= 50) = (label = 1))::INT) AS vu, avg(((score >= 50) = (score_v >= 50))::INT) AS x FROM l GROUP BY dataset) SELECT dataset, CASE WHEN b - greatest(s, v) <= 0.01 AND x > 0.75 THEN 'ONE_SUFFICES' WHEN b - greatest(s, v) > 0.01 AND least(su, vu) > 2 THEN 'BOTH_NEEDED' WHEN b - greatest(s, v) > 0.01 AND least(su, vu) < 1 THEN 'MARGINAL_BENEFIT' WHEN x < 0.65 THEN 'TRULY_INDEPENDENT' WHEN b - greatest(s, v) > 0.005 THEN 'BOTH_RECOMMENDED' ELSE 'EITHER_SUFFICIENT' END AS verdict FROM m")
def e26_verdicts(spark, folder):
    """A verdict for each dataset on whether two scores are needed."""
    s, v, t = F.col("score") >= 50, F.col("score_v") >= 50, F.col("label") == 1
    share = lambda c: F.avg(c.cast("int"))
    m = rows(spark, folder).groupBy("dataset").agg(
        share((s | v) == t).alias("both"), share(s == t).alias("s"), share(v == t).alias("v"), (100 * share((s == t) & (v != t))).alias("s_unique"), (100 * share((s != t) & (v == t))).alias("v_unique"), share(s == v).alias("cross")
    )
    return m.select("dataset", verdict().alias("verdict"))


@query(f"WITH {L}, z AS (SELECT row_idx, (score >= 50) <> (score_v >= 50) AS disagree, unnest([score::DOUBLE, score_v::DOUBLE, (row_idx % 17)::DOUBLE]) AS x, unnest(['score', 'score_v', 'other']) AS feature FROM l), g AS (SELECT feature, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM z GROUP BY feature), a AS (SELECT disagree, feature, avg((x - m) / s) AS z FROM z JOIN g USING (feature) GROUP BY ALL) SELECT disagree, feature, round(z, 6) AS z, row_number() OVER (PARTITION BY disagree ORDER BY round(abs(z), 9) DESC, feature) AS place FROM a")
def a17_disagreement_profile(spark, folder):
    """Standardised feature means where two decisions agree and where they do not, by size."""
    r = rows(spark, folder).withColumn("other", F.col("row_idx") % 17).withColumn("disagree", (F.col("score") >= 50) != (F.col("score_v") >= 50))
    long = r.select("row_idx", "disagree", *[F.col(c).cast("double").alias(c) for c in ("score", "score_v", "other")]).unpivot(["row_idx", "disagree"], ["score", "score_v", "other"], "feature", "x")
    g = long.groupBy("feature").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).withColumn("s", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")))
    a = long.join(F.broadcast(g), "feature").groupBy("disagree", "feature").agg(F.avg((F.col("x") - F.col("m")) / F.col("s")).alias("z"))
    place = F.row_number().over(W.partitionBy("disagree").orderBy(F.desc(F.round(F.abs("z"), 9)), "feature")).cast("long")
    return rounded(a.where("feature is not null").withColumn("place", place))


def bootstrap_mean(df, value: str, key: str, draws: int = 1000, seed: int = 1):
    """Percentile interval of the mean over Poisson bootstrap replicates, seeded by replicate and key.

    Every row is given its number of copies in each replicate by hashed uniforms, so one pass makes all replicates.
    """
    reps = df.select(F.col(value).cast("double").alias("x"), F.col(key).alias("k"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("rep"))
    u = F.pmod(F.xxhash64("k", "rep", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    limits, total, term = [], 0.0, math.exp(-1)
    for i in range(8):
        total += term
        limits.append(total)
        term /= i + 1
    copies = sum((F.when(u >= c, 1).otherwise(0) for c in limits[1:]), F.when(u >= limits[0], 1).otherwise(0))
    means = reps.groupBy("rep").agg(ratio(F.sum(F.col("x") * copies), F.sum(copies)).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.5).alias("mid"), F.percentile("m", 0.975).alias("high"))


@query()
def x6_bootstrap_interval(spark, folder):
    """Bootstrap interval of the mean score; random, so checked by its properties."""
    return bootstrap_mean(rows(spark, folder), "score", "row_idx", 200)


@query()
def x7_random_rejection(spark, folder):
    """FNMR-like error of random rejection at each fraction: a seeded hash ranks the samples of each draw."""
    r = rows(spark, folder)
    wrong = ((F.col("score") >= 50) != (F.col("label") == 1)).cast("int")
    base = r.select("row_idx", wrong.alias("wrong"), F.explode(F.sequence(F.lit(1), F.lit(100))).alias("draw"))
    hashed = base.withColumn("h", F.xxhash64("row_idx", "draw")).withColumn("one", F.lit(1))
    ranked = running(hashed, ["draw"], ["h", "row_idx"], ["one"]).withColumnsRenamed({"upto_one": "r", "all_one": "n"})
    kept = ranked.select("draw", "wrong", F.explode(F.array(*[F.lit(x / 10) for x in range(10)])).alias("fraction"), "r", "n").where(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * (1 - F.col("fraction")))))
    return rounded(kept.groupBy("fraction", "draw").agg(F.avg("wrong").alias("error")).groupBy("fraction").agg(F.avg("error").alias("mean_error"), F.stddev_pop("error").alias("std_error")))
