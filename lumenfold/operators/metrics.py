"""Binary, ranking, calibration and multi-class metrics as grouped aggregates.

Ranking metrics share one curve: scores are pre-aggregated to distinct values, then cumulated in two levels
(ranges of scores, and within a range), so that a group of any size is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of scores: PIECES between approximate quantiles, each in STEPS equal ones.
PIECES, STEPS = 64, 32


def ratio(top: Column, bottom: Column) -> Column:
    """0.0 for an empty denominator."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def _confusion(y: Column, hit: Column) -> list[Column]:
    return [F.count_if((y == 1) & hit).alias("tp"), F.count_if((y == 0) & hit).alias("fp"), F.count_if((y == 1) & ~hit).alias("fn"), F.count_if((y == 0) & ~hit).alias("tn")]


def derived(counts: DataFrame) -> DataFrame:
    """Rates from tp, fp, fn, tn (counts or weights).

    Without negatives the specificity is 0 and the FPR, its complement, 1; the balanced accuracy is the mean
    recall of the classes that occur, so that of the only one. What has no rows at all is 0.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, specificity, precision = ratio(tp, tp + fn), ratio(tn, tn + fp), ratio(tp, tp + fp)
    balanced = F.when(tp + fn == 0, specificity).when(tn + fp == 0, recall).otherwise((recall + specificity) / 2)
    return counts.select(
        "*",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), balanced.alias("balanced_accuracy"), precision.alias("precision"), recall.alias("recall"),
        specificity.alias("specificity"), (1 - specificity).alias("fpr"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def threshold_metrics(df: DataFrame, label: str, score: str, threshold: float, by: list[str] = ()) -> DataFrame:
    """Confusion counts and rates at score >= threshold, by group."""
    return derived(df.groupBy(*by).agg(*_confusion(F.col(label), F.col(score) >= threshold)))


def threshold_grid(df: DataFrame, label: str, score: str, thresholds: list[float], by: list[str] = ()) -> DataFrame:
    """The same for many thresholds in one pass: rows are not multiplied, only counts."""
    y, s = F.col(label), F.col(score)
    each = [F.struct(F.lit(float(t)).alias("threshold"), *_confusion(y, s >= t)) for t in thresholds]
    return derived(df.groupBy(*by).agg(F.array(*each).alias("all")).select(*by, F.explode("all").alias("r")).select(*by, "r.*"))


def weighted_metrics(df: DataFrame, label: str, hit: Column, weight: str, by: list[str] = ()) -> DataFrame:
    """Rates from sums of weights."""
    y, w = F.col(label), F.col(weight)
    zero = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    return derived(df.groupBy(*by).agg(zero((y == 1) & hit).alias("tp"), zero((y == 0) & hit).alias("fp"), zero((y == 1) & ~hit).alias("fn"), zero((y == 0) & ~hit).alias("tn")))


def curve(df: DataFrame, label: str, score: str, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """by, score, pos, neg (at the score), tp, fp (at or above it), positives, negatives (in the group).

    Rows without label or score are left out.
    """
    one = F.col(weight) if weight else F.lit(1)
    y = F.col(label)
    at = df.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(*by, F.col(score).cast("double").alias("score"))
    at = at.agg(F.sum(F.when(y == 1, one).otherwise(one * 0)).alias("pos"), F.sum(F.when(y == 0, one).otherwise(one * 0)).alias("neg"))
    # ranges hold about as many distinct scores each, wherever the scores crowd; any monotone ranges would do
    edges = at.agg(F.percentile_approx("score", [i / PIECES for i in range(PIECES + 1)], 10_000).alias("_edges"))
    at = at.join(F.broadcast(edges), F.lit(True))  # one row
    piece = F.greatest(F.size(F.filter("_edges", lambda e: e <= F.col("score"))) - 1, F.lit(0))
    at = at.withColumn("_piece", piece)
    low, high = F.get("_edges", F.col("_piece")), F.get("_edges", F.col("_piece") + 1)
    step = F.coalesce(F.floor(F.try_divide(STEPS * (F.col("score") - low), high - low)), F.lit(0))
    at = at.withColumn("_range", (F.col("_piece") * STEPS + F.greatest(F.least(step, F.lit(STEPS - 1)), F.lit(0))).cast("long")).drop("_edges", "_piece")
    sums = at.groupBy(*by, "_range").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    down = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    # about PIECES * STEPS rows a group at most
    sums = sums.select(*by, "_range", *[F.coalesce(F.sum(f"_{c}").over(down), F.lit(0)).alias(f"_{c}_above") for c in ("pos", "neg")], F.sum("_pos").over(whole).alias("positives"), F.sum("_neg").over(whole).alias("negatives"))
    keys = [*by, "_range"]
    sums = sums.withColumnsRenamed({k: f"{k}__" for k in keys})
    joined = at.join(sums, [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys])
    within = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(*by, "score", "pos", "neg", (F.col("_pos_above") + F.sum("pos").over(within)).alias("tp"), (F.col("_neg_above") + F.sum("neg").over(within)).alias("fp"), "positives", "negatives")


def joined_by(left: DataFrame, right: DataFrame, by: list[str] = ()) -> DataFrame:
    """left with right's columns of the same group (null groups match); without groups both have one row."""
    if not by:
        return left.join(right, F.lit(True), "left")
    named = right.withColumnsRenamed({b: f"{b}__" for b in by})
    return left.join(named, [F.col(b).eqNullSafe(F.col(f"{b}__")) for b in by], "left").drop(*[f"{b}__" for b in by])


def quantiles(df: DataFrame, score: str, shares: dict[str, float], by: list[str] = ()) -> DataFrame:
    """by and one column per name: the exact quantile at its share, linear between neighbouring scores.

    Order statistics of the counts of distinct scores, cumulated in two levels; null scores are left out.
    """
    ones = df.select(*by, F.col(score).cast("double").alias("_s"), F.lit(0).alias("_y"))
    points = curve(ones, "_y", "_s", list(by))
    asked = []
    for i, share in enumerate(shares.values()):
        place = (F.col("negatives") - 1) * F.lit(float(share))
        low = F.floor(place).cast("long")
        for at, weight in ((low, 1 - (place - low)), (F.least(low + 1, F.col("negatives") - 1), place - low)):
            asked.append(F.struct(F.lit(i).alias("i"), (F.col("negatives") - at).alias("rank"), weight.alias("weight")))
    above = F.col("fp") - F.col("neg")
    hits = points.select(*by, "score", F.explode(F.filter(F.array(*asked), lambda a: (a["rank"] > above) & (a["rank"] <= F.col("fp")))).alias("a"))
    part = lambda i: F.sum(F.when((F.col("a.i") == i) & (F.col("a.weight") > 0), F.col("score") * F.col("a.weight")))
    return hits.groupBy(*by).agg(*[part(i).alias(n) for i, n in enumerate(shares)])


def ranking_metrics(df: DataFrame, label: str, score: str, by: list[str] = (), max_fpr: float = 0.05, weight: str | None = None) -> DataFrame:
    """by, positives, negatives, roc_auc, average_precision, pr_auc_trapezoid, partial_auc (standardised, to max_fpr).

    Values are null for a group without both labels.
    """
    tp, fp, pos, neg, p, n = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg", "positives", "negatives"))
    tp0, fp0 = tp - pos, fp - neg
    precision, before = tp / (tp + fp), F.when(tp0 + fp0 == 0, 1.0).otherwise(F.try_divide(tp0, tp0 + fp0))
    x0, x1, y0, y1 = fp0 / n, fp / n, tp0 / p, tp / p
    at_edge = y0 + (y1 - y0) * F.try_divide(max_fpr - x0, x1 - x0)
    area = F.when(x0 >= max_fpr, 0.0).when(x1 <= max_fpr, (x1 - x0) * (y0 + y1) / 2).otherwise((max_fpr - x0) * (y0 + at_edge) / 2)
    points = curve(df, label, score, by, weight)
    both = points.where("positives > 0 and negatives > 0")
    low = max_fpr * max_fpr / 2
    found = both.groupBy(*by).agg(
        (F.sum(F.col("pos") * (2 * (F.col("negatives") - F.col("fp")) + F.col("neg"))) / (2.0 * F.first("positives") * F.first("negatives"))).alias("roc_auc"),
        (F.sum(pos * precision) / F.first("positives")).alias("average_precision"),
        (F.sum(pos * (precision + before) / 2) / F.first("positives")).alias("pr_auc_trapezoid"),
        (0.5 * (1 + (F.sum(area) - low) / (max_fpr - low))).alias("partial_auc"),
    )
    sizes = points.groupBy(*by).agg(F.first("positives").alias("positives"), F.first("negatives").alias("negatives"))
    if not by:
        return sizes.join(found, F.lit(True), "left")  # one row each
    return sizes.join(found.withColumnsRenamed({b: f"_{b}" for b in by}), [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], "left").drop(*[f"_{b}" for b in by])


def bounded(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(1e-8)), F.lit(1 - 1e-8))


def calibration_bins(df: DataFrame, label: str, score: str, bins: int = 15, by: list[str] = ()) -> DataFrame:
    """by, bin, rows, confidence (mean of max(p, 1-p)) and accuracy of equal-width confidence bins, the last closed."""
    p = F.col(score)
    sure = F.greatest(p, 1 - p)
    right = ((p >= 0.5).cast("int") == F.col(label)).cast("double")
    which = F.least(F.floor(sure * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, which.alias("bin")).agg(F.count("*").alias("rows"), F.avg(sure).alias("confidence"), F.avg(right).alias("accuracy"))


def probability_metrics(df: DataFrame, label: str, score: str, bins: int = 15, by: list[str] = ()) -> DataFrame:
    """by, rows, nll, brier, ece."""
    y, p = F.col(label).cast("double"), F.col(score)
    q = bounded(p)
    sums = df.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("nll"), F.avg(F.pow(p - y, 2)).alias("brier"))
    ece = calibration_bins(df, label, score, bins, by).groupBy(*by).agg((F.sum(F.col("rows") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("rows")).alias("ece"))
    return sums.join(ece, list(by)) if by else sums.crossJoin(ece)  # without groups: one row each


def logit_nll(label: str, logit: str, temperature: float = 1.0) -> Column:
    """Mean negative log-likelihood of logits over a temperature, without overflow."""
    z, y = F.col(logit) / temperature, F.col(label)
    return F.avg(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z)


def predicted_class(logits: Column) -> Column:
    """The first index (from 0) of the largest."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def class_report(df: DataFrame, target: str, predicted: str) -> DataFrame:
    """class, support, predicted, precision, recall, f1 of every class that is a target or a prediction."""
    cells = df.groupBy(F.col(target).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    rows = cells.select(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).alias("predicted"), hit.alias("hits"))
    rows = rows.unionByName(cells.select(F.col("p").alias("class"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("hits")))
    sums = rows.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    h, s, p = (F.col(c) for c in ("hits", "support", "predicted"))
    return sums.select("class", "support", "predicted", ratio(h, p).alias("precision"), ratio(h, s).alias("recall"), ratio(2 * h, s + p).alias("f1"))


def class_summary(df: DataFrame, target: str, predicted: str) -> DataFrame:
    """accuracy, macro_f1, min_recall over the classes with support."""
    report = class_report(df, target, predicted)
    supported = F.col("support") > 0
    return report.agg((F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.avg(F.when(supported, F.col("f1"))).alias("macro_f1"), F.min(F.when(supported, F.col("recall"))).alias("min_recall"))


def confusion_matrix(df: DataFrame, target: str, predicted: str, classes: list) -> DataFrame:
    """One row per target, one column per declared class."""
    wide = df.groupBy(F.col(target).alias("target")).pivot(predicted, classes).agg(F.count(F.lit(1)))
    return wide.select("target", *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"p{c}") for c in classes])


def source_macro(df: DataFrame, correct: Column, source: str, by: list[str] = ()) -> DataFrame:
    """Mean and least over sources of the share of correct rows; blank sources don't count."""
    named = F.nullif(F.trim(F.col(source)), F.lit(""))
    rows = df.withColumn("_s", named).where("_s is not null").groupBy(*by, "_s").agg(F.avg(correct.cast("double")).alias("_share"))
    return rows.groupBy(*by).agg(F.count("*").alias("sources"), F.avg("_share").alias("macro"), F.min("_share").alias("worst"))


def negative_rates(df: DataFrame, score: str, threshold: float, by: list[str] = (), unit_seconds: float = 1.0) -> DataFrame:
    """Of negatives: rows, false positives, FPR, mean and 95th percentile of the score, false positives an hour."""
    hit = F.count_if(F.col(score) >= threshold)
    sums = df.groupBy(*by).agg(F.count("*").alias("rows"), hit.alias("false_positives"), (hit / F.count("*")).alias("fpr"), F.avg(score).alias("mean_score"), (hit / F.count("*") * 3600.0 / unit_seconds).alias("false_alarms_per_hour"))
    tops = quantiles(df, score, {"p95_score": 0.95}, by)
    return joined_by(sums, tops, by).select(*by, "rows", "false_positives", "fpr", "mean_score", "p95_score", "false_alarms_per_hour")


def paired_patterns(df: DataFrame, label: str, base_hit: Column, candidate_hit: Column, by: list[str] = ()) -> DataFrame:
    """Rows by pattern of the pair's correctness."""
    y = F.col(label) == 1
    a, b = base_hit == y, candidate_hit == y
    pattern = F.when(a & b, "both_correct").when(a, "base_only").when(b, "candidate_only").otherwise("both_wrong")
    return df.groupBy(*by, pattern.alias("pattern")).agg(F.count("*").alias("rows"))
