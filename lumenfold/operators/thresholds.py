"""Decision thresholds from order statistics, curves and sources.

A threshold "just above b" is stored as its boundary b with the strict test score > b, which is the same for
every score; ``just_above`` gives the next double where a number is wanted.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenfold.operators.metrics import curve, ratio


@F.pandas_udf(T.DoubleType())
def just_above(boundary: pd.Series) -> pd.Series:
    """The next larger double."""
    return pd.Series(np.nextafter(boundary.to_numpy(float), np.inf))


def kth_largest(df: DataFrame, score: str, rank: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, boundary: the score at the (1-based, descending) rank given per group, with rank's other columns.

    Works on counts of distinct scores, cumulated in two levels: no group is sorted as a whole.
    """
    ones = df.select(*by, F.col(score).cast("double").alias("_s"), F.lit(0).alias("_y"))
    points = curve(ones, "_y", "_s", list(by)).select(*by, "score", (F.col("fp") - F.col("neg")).alias("above"), F.col("fp").alias("upto"))
    points = points.withColumnsRenamed({b: f"{b}__" for b in by})
    join = [F.col(f"{b}__").eqNullSafe(F.col(b)) for b in by] if by else F.lit(True)
    hit = points.join(F.broadcast(rank) if not by else rank, join)
    hit = hit.where((F.col("rank") > F.col("above")) & (F.col("rank") <= F.col("upto")))
    return hit.select(*rank.columns, F.col("score").alias("boundary"))


def fpr_boundary(df: DataFrame, score: str, target_fpr: float, by: list[str] = ()) -> DataFrame:
    """by, negatives, allowed, rank, boundary: score > boundary lets at most floor(target * negatives) of df's rows pass."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("negatives")).withColumn("allowed", F.floor(F.col("negatives") * F.lit(target_fpr)).cast("long"))
    return kth_largest(df, score, sizes.withColumn("rank", F.col("allowed") + 1), by)


def source_thresholds(df: DataFrame, source: str, score: str, target_fpr: float) -> DataFrame:
    """The boundary of each source, its place in ascending order (ties by source) and the number of sources."""
    local = fpr_boundary(df, score, target_fpr, [source])
    # one row a source
    return local.withColumn("place", F.row_number().over(Window.orderBy("boundary", source))).withColumn("sources", F.count("*").over(Window.partitionBy()))


def source_block(df: DataFrame, source: str, score: str, target_fpr: float, delta: float) -> DataFrame:
    """One row: the source-block boundary at rank ceil((S+1)(1-delta)), the pooled one, their FPRs, and the range
    of the boundary when any one source is left out. Too few sources are an error."""
    places = source_thresholds(df, source, score, target_fpr)
    rank = F.ceil((F.col("sources") + 1) * F.lit(1.0 - delta)).cast("int")
    rank1 = F.ceil(F.col("sources") * F.lit(1.0 - delta)).cast("int")  # of S-1 sources
    ordered = places.select("boundary", "place", "sources", rank.alias("rank"), rank1.alias("rank1"))
    # without the source at place j, the k-th of the rest is the k-th, or the (k+1)-th where j <= k
    picks = ordered.agg(
        F.first("sources").alias("sources"), F.first("rank").alias("rank"), F.max(F.when(F.col("place") == F.col("rank"), F.col("boundary"))).alias("boundary"),
        F.max(F.when((F.col("rank1") <= F.col("sources") - 1) & (F.col("place") == F.col("rank1")), F.col("boundary"))).alias("loo_minimum"),
        F.max(F.when((F.col("rank1") <= F.col("sources") - 1) & (F.col("place") == F.col("rank1") + 1), F.col("boundary"))).alias("loo_maximum"),
    )
    picks = picks.withColumn("boundary", F.when(F.col("rank") <= F.col("sources"), F.col("boundary")).otherwise(F.raise_error(F.lit("too few sources to certify the requested coverage")).cast("double")))
    pooled = fpr_boundary(df, score, target_fpr).select(F.col("boundary").alias("pooled_boundary"), "negatives")
    one = picks.crossJoin(pooled)
    rates = df.select(F.col(source).alias("_s"), F.col(score).alias("_p")).join(F.broadcast(one.select("boundary")), F.lit(True)).groupBy("_s").agg(F.count("*").alias("n"), F.count_if(F.col("_p") > F.col("boundary")).alias("hits"))
    sums = rates.agg((F.sum("hits") / F.sum("n")).alias("pooled_fpr"), F.avg(F.col("hits") / F.col("n")).alias("macro_fpr"), F.max(F.col("hits") / F.col("n")).alias("worst_fpr"))
    return one.crossJoin(sums).withColumn("coverage_bound", F.col("rank") / (F.col("sources") + 1))


def source_quantile(df: DataFrame, source: str, score: str, target_fpr: float, coverage: float) -> DataFrame:
    """One row: the larger of the pooled boundary and the source boundary at rank ceil((S+1) coverage)."""
    places = source_thresholds(df, source, score, target_fpr)
    rank = F.ceil((F.col("sources") + 1) * F.lit(coverage)).cast("int")
    pick = places.agg(F.first("sources").alias("sources"), F.first(rank).alias("rank"), F.max(F.when(F.col("place") == rank, F.col("boundary"))).alias("source_boundary"))
    pick = pick.withColumn("source_boundary", F.when(F.col("rank") <= F.col("sources"), F.col("source_boundary")).otherwise(F.raise_error(F.lit("the requested coverage cannot be estimated")).cast("double")))
    pooled = fpr_boundary(df, score, target_fpr).select(F.col("boundary").alias("pooled_boundary"))
    return pick.crossJoin(pooled).withColumn("boundary", F.greatest("source_boundary", "pooled_boundary"))


def leave_one_source_out(df: DataFrame, source: str, score: str, target_fpr: float) -> DataFrame:
    """source, rows, boundary, false_positives, fpr: each source under the threshold fitted without it.

    The fit takes the largest source boundary of the rest (all that their number can certify) or their pooled
    boundary. Both come from order statistics: of the boundaries the two largest, of the pooled scores only
    the top rows that any fit can reach.
    """
    places = source_thresholds(df, source, score, target_fpr)
    top = places.agg(F.max("boundary").alias("first"), F.max(F.when(F.col("place") == F.col("sources") - 1, F.col("boundary"))).alias("second"), F.max_by(source, "place").alias("who"))
    sizes = df.groupBy(source).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    ones = df.select(F.lit(0).alias("_y"), F.col(score).cast("double").alias("_s"))
    points = curve(ones, "_y", "_s").select("score", F.col("fp").alias("upto"))
    # rows of the rest above a score = all above it - own above it; own rows are cumulated per source
    own = curve(df.select(source, F.lit(0).alias("_y"), F.col(score).cast("double").alias("_s")), "_y", "_s", [source]).select(source, F.col("score").alias("s"), F.col("fp").alias("own_upto"))
    largest = sizes.agg(F.max("n").alias("largest"))
    grid = points.crossJoin(F.broadcast(total.crossJoin(largest))).where(F.col("upto") - F.lit(0) <= F.floor(F.col("total") * F.lit(target_fpr)) + 1 + F.col("largest")).select("score", "upto")
    edge = points.crossJoin(F.broadcast(total.crossJoin(largest))).where(F.col("upto") > F.floor(F.col("total") * F.lit(target_fpr)) + 1 + F.col("largest")).agg(F.max("score").alias("score"), F.min("upto").alias("upto")).where("score is not null")
    grid = grid.unionByName(edge)
    pairs = F.broadcast(sizes).crossJoin(grid)  # sources x top scores
    with_own = pairs.join(own.withColumnRenamed(source, "_src"), (F.col(source) == F.col("_src")) & (F.col("s") == F.col("score")), "left")
    fill = Window.partitionBy(source).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = with_own.withColumn("own", F.coalesce(F.max("own_upto").over(fill), F.lit(0))).crossJoin(F.broadcast(total))
    need = F.floor((F.col("total") - F.col("n")) * F.lit(target_fpr)) + 1
    pooled = rest.where(F.col("upto") - F.col("own") >= need).groupBy(source, "n").agg(F.max("score").alias("pooled"))
    fitted = pooled.crossJoin(F.broadcast(top)).withColumn("boundary", F.greatest("pooled", F.when(F.col(source) == F.col("who"), F.col("second")).otherwise(F.col("first"))))
    hits = df.select(F.col(source).alias("_k"), F.col(score).alias("_p")).join(F.broadcast(fitted.select(F.col(source).alias("_f"), "boundary")), F.col("_k") == F.col("_f")).groupBy("_k").agg(F.count_if(F.col("_p") > F.col("boundary")).alias("false_positives"))
    return fitted.join(hits, F.col(source) == F.col("_k")).select(source, F.col("n").alias("rows"), "boundary", "false_positives", (F.col("false_positives") / F.col("n")).alias("fpr"))


def sweep(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """Confusion counts and rates at every distinct score, and at 0 and 1, in one pass."""
    ends = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    added = ends.select(*by, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("_s")).select(*by, F.col("_s").alias(score), F.lit(2).alias(label))
    rows = df.select(*by, F.col(score).cast("double").alias(score), F.col(label).cast("int").alias(label)).unionByName(added)
    points = curve(rows, label, score, list(by))
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "positives", "negatives"))
    recall, specificity = ratio(tp, p), ratio(n - fp, n)
    return points.select(*by, F.col("score").alias("threshold"), "tp", "fp", (p - tp).alias("fn"), (n - fp).alias("tn"), recall.alias("recall"), specificity.alias("specificity"), ((recall + specificity) / 2).alias("balanced_accuracy"), ratio(2 * tp, tp + fp + p).alias("f1"))


def best_threshold(df: DataFrame, label: str, score: str, target_recall: float, target_specificity: float, by: list[str] = ()) -> DataFrame:
    """by, threshold, feasible, f1, balanced_accuracy: the first threshold with the best F1 (then balanced accuracy)
    among those that meet both targets; where none does, that with the best smaller ratio to the targets."""
    meets = (F.col("recall") >= target_recall) & (F.col("specificity") >= target_specificity)
    share = F.least(F.least(F.col("recall") / target_recall, F.lit(1.0)) if target_recall else F.lit(1.0), F.least(F.col("specificity") / target_specificity, F.lit(1.0)) if target_specificity else F.lit(1.0))
    key = F.struct(meets.alias("a"), F.when(meets, 1.0).otherwise(share).alias("b"), F.col("f1").alias("c"), F.col("balanced_accuracy").alias("d"), (-F.col("threshold")).alias("e"))
    return sweep(df, label, score, by).groupBy(*by).agg(F.max_by(F.struct("threshold", meets.alias("feasible"), "f1", "balanced_accuracy"), key).alias("r")).select(*by, "r.*")


def known_boundary(df: DataFrame, score: str, minimum: float, larger_is_known: bool = True, by: list[str] = ()) -> DataFrame:
    """by, rows, rank, boundary: the order statistic ceil(minimum * n) that accepts that share of known rows (>= or <=)."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("rows")).withColumn("rank", F.greatest(F.ceil(F.col("rows") * F.lit(minimum)), F.lit(1)).cast("long"))
    signed = df.select(*by, (F.col(score) if larger_is_known else -F.col(score)).alias("_s"))
    out = kth_largest(signed, "_s", sizes, by)
    return out if larger_is_known else out.withColumn("boundary", -F.col("boundary"))


def open_set_threshold(df: DataFrame, known: str, distance: str, minimum: float, by: list[str] = ()) -> DataFrame:
    """by, threshold, known_acceptance, unknown_recall, balanced: the largest balanced accuracy of distance <= threshold
    among thresholds at known rows' or unknown rows' distances that accept the minimum of known rows; ties go to the larger
    unknown recall, then the larger acceptance, then the smaller threshold."""
    points = curve(df.select(*by, F.col(known).cast("int").alias("_y"), (-F.col(distance)).alias("_s")), "_y", "_s", list(by))
    acceptance, recall = ratio(F.col("tp"), F.col("positives")), 1 - ratio(F.col("fp"), F.col("negatives"))
    rows = points.select(*by, (-F.col("score")).alias("threshold"), acceptance.alias("known_acceptance"), recall.alias("unknown_recall"), ((acceptance + recall) / 2).alias("balanced"))
    rows = rows.where(F.col("known_acceptance") >= minimum - 1e-12)
    key = F.struct(F.round("balanced", 12).alias("b"), F.round("unknown_recall", 12).alias("u"), "known_acceptance", (-F.col("threshold")).alias("t"))
    return rows.groupBy(*by).agg(F.max_by(F.struct("threshold", "known_acceptance", "unknown_recall", "balanced"), key).alias("r")).select(*by, "r.*")


def class_thresholds(df: DataFrame, predicted: str, known: str, distance: str, minimum: float, known_support: int = 5, unknown_support: int = 3) -> DataFrame:
    """predicted, supports, threshold, fallback: per predicted class; with too little support the global threshold,
    raised to the class's own minimum-acceptance order statistic."""
    everywhere = open_set_threshold(df, known, distance, minimum).select(F.col("threshold").alias("_all"))
    support = df.groupBy(predicted).agg(F.count_if(F.col(known)).alias("known_support"), F.count_if(~F.col(known)).alias("unknown_support"))
    own = open_set_threshold(df, known, distance, minimum, [predicted]).select(predicted, F.col("threshold").alias("_own"))
    guard = known_boundary(df.where(F.col(known)), distance, minimum, False, [predicted]).select(predicted, F.col("boundary").alias("_guard"))
    rows = support.join(own, predicted, "left").join(guard, predicted, "left").crossJoin(F.broadcast(everywhere))
    enough = (F.col("known_support") >= known_support) & (F.col("unknown_support") >= unknown_support)
    return rows.select(predicted, "known_support", "unknown_support", F.when(enough, F.col("_own")).otherwise(F.greatest("_all", F.coalesce("_guard", "_all"))).alias("threshold"), (~enough).alias("fallback"))


def first_passing(df: DataFrame, label: str, score: str, seed: str, thresholds: list[float], maximum_fpr: float, minimum_recall: float) -> DataFrame:
    """threshold: the least of the grid at which every seed meets both gates (null if none does)."""
    y, s = F.col(label), F.col(score)
    each = df.groupBy(seed).agg(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n"), F.array(*[F.struct(F.lit(float(t)).alias("t"), F.count_if((y == 1) & (s >= t)).alias("tp"), F.count_if((y == 0) & (s >= t)).alias("fp")) for t in thresholds]).alias("all"))
    rows = each.select("p", "n", F.explode("all").alias("r"))
    fine = (ratio(F.col("r.fp"), F.col("n")) <= maximum_fpr) & (ratio(F.col("r.tp"), F.col("p")) >= minimum_recall)
    return rows.groupBy(F.col("r.t").alias("t")).agg(F.bool_and(fine).alias("ok")).agg(F.min(F.when(F.col("ok"), F.col("t"))).alias("threshold"))


def fit_temperature(df: DataFrame, label: str, logit: str, low: float = -5.0, high: float = 5.0, passes: int = 9, points: int = 9) -> float:
    """The temperature of least negative log-likelihood, exp(x) for x in [low, high].

    The likelihood is convex in 1/T, so each pass evaluates a grid in one aggregate and narrows to the
    neighbours of its best point.
    """
    z, y = F.col(logit), F.col(label)
    for _ in range(passes):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        losses = [F.avg(F.greatest(z * math.exp(-x), F.lit(0.0)) + F.log1p(F.exp(-F.abs(z * math.exp(-x)))) - y * z * math.exp(-x)) for x in grid]
        row = df.agg(*losses).first()
        best = min(range(points), key=lambda i: row[i])
        low, high = grid[max(0, best - 1)], grid[min(points - 1, best + 1)]
    return math.exp((low + high) / 2)
