"""Sinks: written once, whole or not at all; a target that exists is refused."""

from __future__ import annotations

import json
import os
import tempfile
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), kind: str = "parquet", expected_rows: int | None = None) -> None:
    """Parquet, CSV (with header) or JSON below path, by Spark's commit protocol; with expected_rows, the count is verified."""
    writer = df.write.mode("errorifexists").partitionBy(*partition_by) if partition_by else df.write.mode("errorifexists")
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)
    if expected_rows is not None:
        reader = df.sparkSession.read.schema(df.schema)
        found = (reader.option("header", True) if kind == "csv" else reader).format(kind).load(path).count()
        if found != expected_rows:
            raise ValueError(f"{path} has {found} rows, not {expected_rows}")


def write_report(report: dict, path: str, overwrite: bool = False) -> None:
    """One JSON document, by a temporary file that takes its place; driver side."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(report, f, ensure_ascii=False, indent=2, sort_keys=True)
            f.write("\n")
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise


def report_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row, for a distributed report."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def column_union(frames: list[DataFrame]) -> DataFrame:
    """All rows under the union of the columns, in the order they first appear."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.select("*") for f in frames])


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """The first rows as a Markdown table, for reports."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]])


def write_array_cache(df: DataFrame, path: str, samples: str, size: int, expected: dict[str, int] | None = None, split: str = "split") -> DataFrame:
    """Waveforms as array columns partitioned by split; lengths and, if given, the rows of each split are verified first."""
    checked = df.withColumn(samples, F.when(F.size(samples) == size, F.col(samples)).otherwise(F.raise_error(F.lit(f"a segment isn't {size} samples long")).cast("array<float>")))
    checked.write.mode("errorifexists").partitionBy(split).parquet(path)
    back = df.sparkSession.read.parquet(path)
    if expected is not None:
        found = {r[split]: r["n"] for r in back.groupBy(split).agg(F.count("*").alias("n")).collect()}
        if found != expected:
            raise ValueError(f"expected {expected}, wrote {found}")
    return back
