"""Bootstrap intervals from cluster sums: rows are read once, replicates multiply clusters only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.identity import seeded_rank, unit_interval
from lumenfold.operators.metrics import ratio


def replicates(clusters: DataFrame, key: str, samples: int, seed: int, kind: str = "poisson") -> DataFrame:
    """clusters with replicate and weight: Poisson(1) counts or Exp(1) weights from a seeded digest of replicate and key."""
    rows = clusters.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    u = unit_interval(seeded_rank(seed, F.col("replicate"), F.col(key)))
    if kind == "exponential":
        return rows.withColumn("weight", -F.log(F.greatest(u, F.lit(2.0**-64))))
    cdf, p, bounds = 0.0, 2.718281828459045**-1, []
    for k in range(12):
        cdf += p
        bounds.append(cdf)
        p /= k + 1
    return rows.withColumn("weight", sum(((u > b).cast("int") for b in bounds), F.lit(0)))


def interval(df: DataFrame, value: str, by: list[str] = (), level: float = 0.95) -> DataFrame:
    """by, low, high of the replicates' values."""
    tail = (1 - level) / 2
    return df.groupBy(*by).agg(F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"))


def binary_metrics_ci(df: DataFrame, label: str, score: str, threshold: float, cluster: str, samples: int, seed: int) -> DataFrame:
    """metric, low, high by resampling clusters within each label."""
    y, hit = F.col(label), F.col(score) >= threshold
    sums = df.groupBy(F.concat_ws("|", y.cast("string"), F.col(cluster).cast("string")).alias("k")).agg(F.count_if((y == 1) & hit).alias("tp"), F.count_if((y == 0) & hit).alias("fp"), F.count_if((y == 1) & ~hit).alias("fn"), F.count_if((y == 0) & ~hit).alias("tn"))
    reps = replicates(sums, "k", samples, seed)
    total = reps.groupBy("replicate").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("tp", "fp", "fn", "tn")])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    values = {"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2}
    each = total.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in values.items()])).alias("r")).select("r.*")
    return interval(each, "v", ["metric"])


def paired_rate_delta(df: DataFrame, cluster: str, base_hit: Column, candidate_hit: Column, samples: int, seed: int) -> DataFrame:
    """One row: the delta of hit rates (candidate less base), its two-sided interval and its upper one-sided bound."""
    sums = df.groupBy(cluster).agg(F.count("*").alias("n"), F.count_if(base_hit).alias("a"), F.count_if(candidate_hit).alias("b"))
    point = sums.agg(((F.sum("b") - F.sum("a")) / F.sum("n")).alias("delta"))
    w = F.col("weight")
    reps = replicates(sums, cluster, samples, seed).groupBy("replicate").agg((F.sum(F.col("b") * w) - F.sum(F.col("a") * w)).alias("d"), F.sum(F.col("n") * w).alias("m")).where("m > 0")
    bounds = reps.select((F.col("d") / F.col("m")).alias("v")).agg(F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"), F.percentile("v", F.lit(0.95)).alias("upper"))
    return point.crossJoin(bounds)  # one row each


def mean_ci(df: DataFrame, key: str, value: str, samples: int, seed: int) -> DataFrame:
    """One row: mean, low, high of the values, resampled by key."""
    sums = df.groupBy(key).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    reps = replicates(sums, key, samples, seed).groupBy("replicate").agg((F.sum(F.col("s") * F.col("weight")) / F.nullif(F.sum(F.col("n") * F.col("weight")), F.lit(0))).alias("v")).where("v is not null")
    return df.agg(F.avg(value).alias("mean")).crossJoin(interval(reps, "v"))


def multiway_delta(df: DataFrame, label: str, base_hit: Column, candidate_hit: Column, fields: list[str], samples: int, seed: int) -> DataFrame:
    """replicate, delta of balanced accuracy under products of Exp(1) weights of every level of every field.

    Rows are first summed to the combinations of levels that occur; a blank level weighs 1.
    """
    y = F.col(label)
    levels = [F.coalesce(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")), F.lit("")).alias(f) for f in fields]
    cells = df.groupBy(y.alias("y"), *levels).agg(F.count("*").alias("n"), F.count_if(base_hit == (y == 1)).alias("a"), F.count_if(candidate_hit == (y == 1)).alias("b"))
    rows = cells.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    w = F.lit(1.0)
    for f in fields:
        u = F.greatest(unit_interval(seeded_rank(seed, F.col("replicate"), F.lit(f), F.col(f))), F.lit(2.0**-64))
        w = w * F.when(F.col(f) == "", 1.0).otherwise(-F.log(u))
    per = rows.withColumn("w", w).groupBy("replicate", "y").agg(((F.sum(F.col("w") * F.col("b")) - F.sum(F.col("w") * F.col("a"))) / F.sum(F.col("w") * F.col("n"))).alias("d"))
    return per.groupBy("replicate").agg(F.avg("d").alias("delta"))
