"""Constraint suites: every check in one aggregate pass, all violations reported together, fail closed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHA256 = "^[0-9a-f]{64}$"


@dataclass(frozen=True)
class Check:
    """An aggregate of the table, and the least or most it may be."""

    name: str
    value: Column
    at_least: float | None = None
    at_most: float | None = None


class ConstraintError(ValueError):
    """Names what failed; the report is kept."""

    def __init__(self, report: list[dict]):
        self.report = report
        super().__init__("; ".join(f"{r['name']} = {r['value']}" for r in report if not r["passed"]))


def run_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    """(name, value, minimum, maximum, passed) of each check; a null value never passes."""
    row = df.agg(*[c.value.cast("double").alias(f"c{i}") for i, c in enumerate(checks)])
    each = [F.struct(F.lit(c.name).alias("name"), F.col(f"c{i}").alias("value"), F.lit(c.at_least).cast("double").alias("minimum"), F.lit(c.at_most).cast("double").alias("maximum")) for i, c in enumerate(checks)]
    out = row.select(F.explode(F.array(*each)).alias("r")).select("r.*")
    fine = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("minimum").isNull() | (F.col("value") >= F.col("minimum"))) & (F.col("maximum").isNull() | (F.col("value") <= F.col("maximum")))
    return out.withColumn("passed", F.coalesce(fine, F.lit(False)))


def enforce(df: DataFrame, checks: list[Check]) -> list[dict]:
    """The report, or ConstraintError with it."""
    report = [r.asDict() for r in run_checks(df, checks).collect()]
    if not all(r["passed"] for r in report):
        raise ConstraintError(report)
    return report


def none_where(name: str, condition: Column) -> Check:
    """No row may meet the condition (null counts as not meeting it)."""
    return Check(name, F.count_if(F.coalesce(condition, F.lit(False))), at_most=0)


def unique(name: str, *columns: str) -> Check:
    """The columns together name each row once."""
    return Check(name, F.count("*") - F.count_distinct(F.struct(*columns)), at_most=0)


def hash_checks(column: str) -> list[Check]:
    """Lower-case SHA-256 in every row, each once."""
    return [none_where(f"{column} is well formed", ~F.coalesce(F.col(column).rlike(SHA256), F.lit(False))), unique(f"{column} is unique", column)]


def prediction_checks(label: str = "label", score: str = "calibrated_probability", split: str = "ood_split", key: str = "sha256") -> list[Check]:
    """Both labels and nothing else, finite probabilities in [0, 1], one split, unique keys."""
    p = F.col(score).cast("double")
    return [
        none_where("label is 0 or 1", ~F.coalesce(F.col(label).cast("double").isin(0.0, 1.0), F.lit(False))),
        Check("both labels", F.count_distinct(label), at_least=2),
        none_where("probability is in [0, 1]", ~F.coalesce(p.between(0.0, 1.0) & ~F.isnan(p), F.lit(False))),
        Check("one split", F.count_distinct(split), at_least=1, at_most=1),
        unique(f"{key} is unique", key),
    ]


def label_conflicts(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Groups whose label isn't constant."""
    return df.groupBy(group).agg(F.count_distinct(label).alias("labels"), F.count("*").alias("rows")).where("labels > 1")
