"""Queries of binary, ranking, calibration and multi-class metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions.signals import clopper_pearson
from lumenfold.operators import metrics as M
from lumenfold.operators.rollup import seed_stats
from lumenfold.plans.fixtures import SCORED, SEGMENTS, query, rounded, scored, segments

_RATES = """
round(CASE WHEN tp+fp+fn+tn = 0 THEN 0.0 ELSE (tp+tn)::DOUBLE/(tp+fp+fn+tn) END, 6) AS accuracy,
round(CASE WHEN tp+fn+tn+fp = 0 THEN 0.0 WHEN tp+fn = 0 THEN tn::DOUBLE/(tn+fp) WHEN tn+fp = 0 THEN tp::DOUBLE/(tp+fn) ELSE (tp::DOUBLE/(tp+fn) + tn::DOUBLE/(tn+fp)) / 2 END, 6) AS balanced_accuracy,
round(CASE WHEN tp+fp = 0 THEN 0.0 ELSE tp::DOUBLE/(tp+fp) END, 6) AS precision,
round(CASE WHEN tp+fn = 0 THEN 0.0 ELSE tp::DOUBLE/(tp+fn) END, 6) AS recall,
round(CASE WHEN tn+fp = 0 THEN 0.0 ELSE tn::DOUBLE/(tn+fp) END, 6) AS specificity,
round(1 - CASE WHEN tn+fp = 0 THEN 0.0 ELSE tn::DOUBLE/(tn+fp) END, 6) AS fpr,
round(CASE WHEN 2*tp+fp+fn = 0 THEN 0.0 ELSE 2.0*tp::DOUBLE/(2*tp+fp+fn) END, 6) AS f1"""
_COUNTS = "count(*) FILTER (WHERE label = 1 AND {h}) AS tp, count(*) FILTER (WHERE label = 0 AND {h}) AS fp, count(*) FILTER (WHERE label = 1 AND NOT ({h})) AS fn, count(*) FILTER (WHERE label = 0 AND NOT ({h})) AS tn"
_CURVE = """
pts AS (SELECT {by} score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM {src} GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER p AS np, sum(neg) OVER p AS nn
        FROM pts WINDOW w AS (PARTITION BY {part} ORDER BY score DESC), p AS (PARTITION BY {part}))"""


@query(f"WITH {SCORED}, c AS (SELECT source, {_COUNTS.format(h='score >= 0.5')} FROM scored GROUP BY source) SELECT source, tp, fp, fn, tn, {_RATES} FROM c")
def metrics_confusion_by_source(spark, sf_dir):
    return rounded(M.threshold_metrics(scored(spark, sf_dir), "label", "score", 0.5, ["source"]))


@query(f"WITH {SCORED}, g AS (SELECT *, label AS one FROM scored), c AS (SELECT one, lang, {_COUNTS.format(h='score >= 0.5')} FROM g GROUP BY ALL) SELECT one, lang, tp, fp, fn, tn, {_RATES} FROM c")
def metrics_one_class_groups(spark, sf_dir):
    """Groups that have rows of one label only."""
    return rounded(M.threshold_metrics(scored(spark, sf_dir).withColumn("one", F.col("label")), "label", "score", 0.5, ["one", "lang"]))


@query(f"WITH {SCORED}, t AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold), c AS (SELECT lang, threshold, {_COUNTS.format(h='score >= threshold')} FROM scored, t GROUP BY lang, threshold) SELECT lang, threshold, tp, fp, fn, tn, {_RATES} FROM c")
def metrics_threshold_grid(spark, sf_dir):
    return rounded(M.threshold_grid(scored(spark, sf_dir), "label", "score", [0.1, 0.3, 0.5, 0.7, 0.9], ["lang"]))


@query(f"""WITH {SCORED}, w AS (SELECT *, 1.0 + doc_id % 5 AS weight FROM scored),
c AS (SELECT lang, coalesce(sum(weight) FILTER (WHERE label = 1 AND score >= 0.5), 0)::DOUBLE AS tp, coalesce(sum(weight) FILTER (WHERE label = 0 AND score >= 0.5), 0)::DOUBLE AS fp,
 coalesce(sum(weight) FILTER (WHERE label = 1 AND score < 0.5), 0)::DOUBLE AS fn, coalesce(sum(weight) FILTER (WHERE label = 0 AND score < 0.5), 0)::DOUBLE AS tn FROM w GROUP BY lang)
SELECT lang, tp, fp, fn, tn, {_RATES} FROM c""")
def metrics_weighted(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("weight", 1.0 + F.col("doc_id") % 5)
    return rounded(M.weighted_metrics(df, "label", F.col("score") >= 0.5, "weight", ["lang"]))


@query(f"""WITH {SCORED}, {_CURVE.format(by='lang,', src='scored', part='lang')}
SELECT lang, max(np)::BIGINT AS positives, max(nn)::BIGINT AS negatives, round(sum(pos * (2 * (nn - fp) + neg))::DOUBLE / (2.0 * max(np) * max(nn)), 6) AS roc_auc FROM cum GROUP BY lang""")
def roc_auc_by_lang(spark, sf_dir):
    return rounded(M.ranking_metrics(scored(spark, sf_dir), "label", "score", ["lang"]).select("lang", "positives", "negatives", "roc_auc"))


@query(f"""WITH {SCORED}, {_CURVE.format(by='lang,', src='scored', part='lang')}
SELECT lang, round(sum(pos * tp::DOUBLE / (tp + fp)) / max(np), 6) AS average_precision FROM cum GROUP BY lang""")
def average_precision(spark, sf_dir):
    return rounded(M.ranking_metrics(scored(spark, sf_dir), "label", "score", ["lang"]).select("lang", "average_precision"))


@query(f"""WITH {SCORED}, {_CURVE.format(by='', src='scored', part='1')},
q AS (SELECT pos, np, tp::DOUBLE / (tp + fp) AS p1, CASE WHEN tp + fp - pos - neg = 0 THEN 1.0 ELSE (tp - pos)::DOUBLE / (tp + fp - pos - neg) END AS p0 FROM cum)
SELECT round(sum(pos * (p0 + p1) / 2) / max(np), 6) AS pr_auc_trapezoid FROM q""")
def pr_auc_trapezoid(spark, sf_dir):
    return rounded(M.ranking_metrics(scored(spark, sf_dir), "label", "score").select("pr_auc_trapezoid"))


@query(f"""WITH {SCORED}, {_CURVE.format(by='lang,', src='scored', part='lang')},
q AS (SELECT lang, (fp - neg)::DOUBLE / nn AS x0, fp::DOUBLE / nn AS x1, (tp - pos)::DOUBLE / np AS y0, tp::DOUBLE / np AS y1 FROM cum),
a AS (SELECT lang, CASE WHEN x0 >= 0.05 THEN 0 WHEN x1 <= 0.05 THEN (x1 - x0) * (y0 + y1) / 2
  ELSE (0.05 - x0) * (y0 + y0 + (y1 - y0) * (0.05 - x0) / (x1 - x0)) / 2 END AS area FROM q)
SELECT lang, round(0.5 * (1 + (sum(area) - 0.00125) / (0.05 - 0.00125)), 6) AS partial_auc FROM a GROUP BY lang""")
def partial_auc(spark, sf_dir):
    return rounded(M.ranking_metrics(scored(spark, sf_dir), "label", "score", ["lang"]).select("lang", "partial_auc"))


@query(f"""WITH {SCORED}, b AS (SELECT least(floor(greatest(score, 1 - score) * 10), 9)::INTEGER AS bin, greatest(score, 1 - score) AS sure, ((score >= 0.5)::INTEGER = label)::INTEGER AS hit FROM scored)
SELECT bin, count(*) AS rows, round(avg(sure), 6) AS confidence, round(avg(hit), 6) AS accuracy FROM b GROUP BY bin""")
def ece_bins(spark, sf_dir):
    return rounded(M.calibration_bins(scored(spark, sf_dir), "label", "score", 10))


@query(f"""WITH {SCORED}, q AS (SELECT lang, label, score, least(greatest(score, 1e-8), 1 - 1e-8) AS p, least(floor(greatest(score, 1 - score) * 15), 14) AS bin, greatest(score, 1 - score) AS sure, ((score >= 0.5)::INTEGER = label)::INTEGER AS hit FROM scored),
e AS (SELECT lang, sum(n * abs(c - a)) / sum(n) AS ece FROM (SELECT lang, bin, count(*) AS n, avg(sure) AS c, avg(hit) AS a FROM q GROUP BY lang, bin) GROUP BY lang)
SELECT q.lang, count(*) AS rows, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS nll, round(avg((score - label) ** 2), 6) AS brier, round(any_value(ece), 6) AS ece
FROM q JOIN e ON q.lang = e.lang GROUP BY q.lang""")
def brier_nll(spark, sf_dir):
    return rounded(M.probability_metrics(scored(spark, sf_dir), "label", "score", 15, ["lang"]))


@query(f"""WITH {SCORED}, z AS (SELECT source, label, (score - 0.5) * 8 / 1.7 AS z FROM scored)
SELECT source, round(avg(greatest(z, 0) + ln(1 + exp(-abs(z))) - label * z), 6) AS nll FROM z GROUP BY source""")
def logit_nll_by_source(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("logit", (F.col("score") - 0.5) * 8)
    return rounded(df.groupBy("source").agg(M.logit_nll("label", "logit", 1.7).alias("nll")))


_CLASSES = """
cls AS (SELECT vec_id, label AS target, CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS guess FROM embeddings)"""


def _classes(spark, sf_dir):
    from lumenfold.runtime import table

    guess = F.when(F.col("vec_id") % 3 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("target"), guess.alias("guess"))


@query(f"""WITH {_CLASSES}, c AS (SELECT target AS class, 1 AS s, 0 AS p, (target = guess)::INTEGER AS h FROM cls UNION ALL SELECT guess, 0, 1, 0 FROM cls),
a AS (SELECT class, sum(s)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h) AS h FROM c GROUP BY class)
SELECT class, support, predicted, round(CASE WHEN predicted = 0 THEN 0.0 ELSE h::DOUBLE / predicted END, 6) AS precision, round(CASE WHEN support = 0 THEN 0.0 ELSE h::DOUBLE / support END, 6) AS recall, round(2.0 * h / (support + predicted), 6) AS f1 FROM a""")
def multiclass_report(spark, sf_dir):
    return rounded(M.class_report(_classes(spark, sf_dir), "target", "guess"))


@query(f"""WITH {_CLASSES}, c AS (SELECT target AS class, 1 AS s, 0 AS p, (target = guess)::INTEGER AS h FROM cls UNION ALL SELECT guess, 0, 1, 0 FROM cls),
a AS (SELECT class, sum(s) AS s, sum(p) AS p, sum(h) AS h FROM c GROUP BY class)
SELECT round(sum(h)::DOUBLE / sum(s), 6) AS accuracy, round(avg(2.0 * h / (s + p)) FILTER (WHERE s > 0), 6) AS macro_f1, round(min(h::DOUBLE / s) FILTER (WHERE s > 0), 6) AS min_recall FROM a""")
def multiclass_summary(spark, sf_dir):
    return rounded(M.class_summary(_classes(spark, sf_dir), "target", "guess"))


@query(f"WITH {_CLASSES} SELECT target, " + ", ".join(f"count(*) FILTER (WHERE guess = {k}) AS p{k}" for k in range(10)) + " FROM cls GROUP BY target")
def confusion_pivot(spark, sf_dir):
    return M.confusion_matrix(_classes(spark, sf_dir), "target", "guess", list(range(10)))


@query(f"""WITH {SCORED}, s AS (SELECT lang, source, avg(((score >= 0.5)::INTEGER = label)::INTEGER) AS share FROM scored WHERE label = 1 GROUP BY lang, source)
SELECT lang, count(*) AS sources, round(avg(share), 6) AS macro, round(min(share), 6) AS worst FROM s GROUP BY lang""")
def source_macro(spark, sf_dir):
    df = scored(spark, sf_dir).where("label = 1")
    return rounded(M.source_macro(df, (F.col("score") >= 0.5).cast("int") == F.col("label"), "source", ["lang"]))


@query(f"""WITH {SCORED} SELECT lang, count(*) AS rows, count(*) FILTER (WHERE score >= 0.9) AS false_positives, round(count(*) FILTER (WHERE score >= 0.9)::DOUBLE / count(*), 6) AS fpr,
round(avg(score), 6) AS mean_score, round(quantile_cont(score, 0.95), 6) AS p95_score, round(count(*) FILTER (WHERE score >= 0.9)::DOUBLE / count(*) * 3600 / 0.5, 6) AS false_alarms_per_hour FROM scored WHERE label = 0 GROUP BY lang""")
def negative_rates(spark, sf_dir):
    return rounded(M.negative_rates(scored(spark, sf_dir).where("label = 0"), "score", 0.9, ["lang"], 0.5))


@query(f"""WITH {SCORED}, h AS (SELECT lang, (score >= 0.5) = (label = 1) AS a, (other >= 0.5) = (label = 1) AS b FROM scored)
SELECT lang, CASE WHEN a AND b THEN 'both_correct' WHEN a THEN 'base_only' WHEN b THEN 'candidate_only' ELSE 'both_wrong' END AS pattern, count(*) AS rows FROM h GROUP BY ALL""")
def paired_error_patterns(spark, sf_dir):
    return M.paired_patterns(scored(spark, sf_dir), "label", F.col("score") >= 0.5, F.col("other") >= 0.5, ["lang"])


@query()
def operating_point(spark, sf_dir):
    """Counts, rates and exact binomial intervals at a threshold."""
    rows = M.threshold_metrics(scored(spark, sf_dir), "label", "score", 0.5, ["lang"])
    return rounded(rows.select("*", clopper_pearson("tp", F.col("tp") + F.col("fn")).alias("ci")).select("lang", "tp", "fp", "fn", "tn", "recall", F.col("ci.low").alias("recall_low"), F.col("ci.high").alias("recall_high")))


@query(f"""WITH {SEGMENTS}, s AS (SELECT role, session, avg(score) AS m FROM seg GROUP BY role, session)
SELECT role, count(*) AS n, round(avg(m), 6) AS mean, round(coalesce(stddev_samp(m), 0), 6) AS sample_std, round(min(m), 6) AS minimum, round(max(m), 6) AS maximum FROM s GROUP BY role""")
def seed_summary(spark, sf_dir):
    rows = segments(spark, sf_dir).groupBy("role", "session").agg(F.avg("score").alias("m"))
    return rounded(seed_stats(rows, ["role"], "m"))
