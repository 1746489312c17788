"""Rules over metric rows: every rule becomes a check row, decisions are conjunctions or disjunctions of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Of one metric in one scope (a split, a scenario, a subgroup): the most it may drop, or the least it may be or gain."""

    scope: str
    metric: str
    max_drop: float | None = None
    floor: float | None = None
    min_delta: float | None = None

    def __post_init__(self) -> None:
        if sum(x is not None for x in (self.max_drop, self.floor, self.min_delta)) != 1:
            raise ValueError("a rule has exactly one of max_drop, floor and min_delta")


def checks(baseline: DataFrame, candidate: DataFrame, rules: list[Rule], tolerance: float = 0.0) -> DataFrame:
    """scope, metric, baseline, candidate, delta, required, passed: metric rows are (scope, metric, value).

    A metric that is missing or not finite on a side that its rule needs doesn't pass.
    """
    spark = baseline.sparkSession
    table = F.broadcast(spark.createDataFrame([(r.scope, r.metric, r.max_drop, r.floor, r.min_delta) for r in rules], "scope string, metric string, max_drop double, floor double, min_delta double"))
    a = baseline.select("scope", "metric", F.col("value").cast("double").alias("baseline"))
    b = candidate.select("scope", "metric", F.col("value").cast("double").alias("candidate"))
    rows = table.join(a, ["scope", "metric"], "left").join(b, ["scope", "metric"], "left")
    required = F.coalesce("floor", F.col("baseline") - F.col("max_drop"), F.col("baseline") + F.col("min_delta"))
    fine = required.isNotNull() & F.col("candidate").isNotNull() & ~F.isnan(required) & ~F.isnan("candidate") & (F.col("candidate") >= required - tolerance)
    return rows.select("scope", "metric", "baseline", "candidate", (F.col("candidate") - F.col("baseline")).alias("delta"), required.alias("required"), F.coalesce(fine, F.lit(False)).alias("passed"))


def all_pass(rows: DataFrame) -> DataFrame:
    """One row: checks, failed, passed; without checks nothing passes."""
    return rows.agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed")).withColumn("passed", (F.col("checks") > 0) & (F.col("failed") == 0))


def promotion(must: DataFrame, any_of: DataFrame, subgroups: DataFrame, ready: DataFrame, ready_required: bool) -> DataFrame:
    """One row: non-inferiority, any improvement, subgroups, readiness (each a table of checks), and the decision."""
    a = must.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("noninferior"))
    b = any_of.agg(F.coalesce(F.bool_or("passed"), F.lit(False)).alias("improved"))
    c = subgroups.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("subgroups"))
    d = ready.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("ready"))
    one = a.crossJoin(b).crossJoin(c).crossJoin(d)  # one row each
    return one.withColumn("passed", F.col("noninferior") & F.col("improved") & F.col("subgroups") & (F.col("ready") | F.lit(not ready_required)))


def metric_rows(df: DataFrame, scope: str, metrics: list[str]) -> DataFrame:
    """(scope, metric, value) from one column per metric."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    return df.select(F.col(scope).cast("string").alias("scope"), each.alias("r")).select("scope", "r.metric", "r.value")


def differing(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Keys whose values differ by more than the tolerance, or that are on one side only."""
    a, b = left.select(*keys, F.col(value).alias("left_value")), right.select(*keys, F.col(value).alias("right_value"))
    both = a.join(b, keys, "full_outer")
    return both.where(F.col("left_value").isNull() | F.col("right_value").isNull() | (F.abs(F.col("left_value") - F.col("right_value")) > tolerance))


def fail_closed(build) -> dict:
    """The report that build() returns, or, whatever it raises, a report that says so and doesn't pass."""
    try:
        return build()
    except Exception as e:  # a gate reports any failure
        return {"passed": False, "error": f"{type(e).__name__}: {e}"}
