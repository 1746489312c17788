"""Scans: manifests, registries, hash lists, trees of WAV files, archives, arrays and metric reports.

Everything goes through Spark's readers, so any store Spark reads will do.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.signals import wav
from lumenfold.schema import require_columns


def manifest(spark: SparkSession, path: str, schema: str, split: str | None = None, split_column: str = "split") -> DataFrame:
    """A CSV manifest with a declared schema; malformed rows fail; of one split if given, which mustn't be empty."""
    df = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)
    if split is None:
        return df
    out = require_columns(df, [split_column], "manifest").where(F.col(split_column) == split)
    if out.isEmpty():
        raise ValueError(f"the manifest has no rows of split {split}")
    return out


def corpus(spark: SparkSession, path: str, silence: float = 1e-8) -> DataFrame:
    """Decoded rows of a Parquet corpus (label, audio struct(bytes, path)) with their place: rate, samples, status
    ("kept", "undecodable" or "silent")."""
    df = spark.read.parquet(path)
    where = [F.col("_metadata.file_path").alias("parquet_file"), F.col("_metadata.file_block_start").alias("block_start")]
    rows = df.select("label", "audio.path", *where, wav("audio.bytes").alias("w"))
    top = F.array_max(F.transform("w.samples", lambda x: F.abs(x)))
    status = F.when(F.col("w.samples").isNull(), "undecodable").when(F.coalesce(top, F.lit(0.0)) <= silence, "silent").otherwise("kept")
    return rows.select("label", "path", "parquet_file", "block_start", "w.rate", "w.samples", status.alias("status"))


def corpus_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Distinct SHA-256 of the raw audio of a Parquet corpus; only the bytes are read."""
    return spark.read.parquet(path).select(F.sha2("audio.bytes", 256).alias("sha256")).distinct()


def hash_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct hashes of a text file with one SHA-256 a line; blank lines don't count, malformed ones are errors."""
    line = F.trim("value")
    fine = F.when(line.rlike("^[0-9a-f]{64}$"), line).otherwise(F.raise_error(F.concat(F.lit("not a SHA-256: "), line)).cast("string"))
    return spark.read.text(path).where(line != "").select(fine.alias("sha256")).distinct()


def checksum_list(spark: SparkSession, path: str) -> DataFrame:
    """(digest, path) of lines "digest  path"."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("digest"), F.regexp_replace(parts[1], r"^\*", "").alias("path"))


def manifest_hashes(frames: list[DataFrame], columns: tuple[str, ...] = ("sha256", "cache_sha256")) -> DataFrame:
    """Distinct 64-digit hashes of whichever of the columns each frame has."""
    out = None
    for df in frames:
        for c in columns:
            if c in df.columns:
                part = df.select(F.lower(F.trim(F.col(c).cast("string"))).alias("sha256")).where(F.length("sha256") == 64)
                out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no frame has any of {columns}")
    return out.distinct()


def binary_tree(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """(path, length, content) of all files below root; columns that aren't asked for aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def labelled_tree(spark: SparkSession, root: str, labels: dict[str, int], hash_files: bool = True) -> DataFrame:
    """label, source_group, condition, path, size, sha256 of root/<label>/[<source_group>/[<condition>/]]x.wav."""
    files = binary_tree(spark, root)
    inside = F.split(F.substring_index(F.col("path"), f"{root.rstrip('/')}/", -1), "/")
    label = F.coalesce(*[F.when(inside[0] == k, v) for k, v in labels.items()])
    deep = F.size(inside)
    digest = F.sha2("content", 256) if hash_files else F.lit(None).cast("string")
    return files.select(label.alias("label"), F.when(deep > 2, F.get(inside, F.lit(1))).alias("source_group"), F.when(deep > 3, F.get(inside, F.lit(2))).alias("condition"), "path", F.col("length").alias("size"), digest.alias("sha256")).where("label is not null")


def registered_tree(spark: SparkSession, root: str, labels: dict[str, int], registry: DataFrame) -> DataFrame:
    """labelled_tree with the registry's columns; sources on one side only are errors."""
    files = labelled_tree(spark, root, labels)
    seen, known = files.select("source_group").distinct(), registry.select("source_group").distinct()
    odd = [r[0] for r in seen.join(known, "source_group", "left_anti").unionByName(known.join(seen, "source_group", "left_anti")).limit(20).collect()]
    if odd:
        raise ValueError(f"sources that are only in the tree or only in the registry: {sorted(map(str, odd))}")
    return files.join(registry.drop("label"), "source_group")


_MEMBERS = "path string, member string, content binary"


def _safe(name: str) -> bool:
    p = PurePosixPath(name.replace("\\", "/"))
    return not p.is_absolute() and ".." not in p.parts and ":" not in name.split("/", 1)[0]


def zip_members(spark: SparkSession, root: str, suffix: str = "", pattern: str = "*.zip") -> DataFrame:
    """(path, member, content) of the files in ZIP archives; damaged members and paths that lead outside are errors."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if info.is_dir() or not info.filename.lower().endswith(suffix):
                            continue
                        if not _safe(info.filename):
                            raise ValueError(f"{path} has a member that leads outside: {info.filename}")
                        yield pd.DataFrame({"path": [path], "member": [info.filename], "content": [z.read(info)]})

    return binary_tree(spark, root, pattern).select("path", "content").mapInPandas(read, _MEMBERS)


def unique_basenames(members: DataFrame) -> DataFrame:
    """(path, basename, members) of names that occur more than once in an archive."""
    return members.groupBy("path", F.substring_index("member", "/", -1).alias("basename")).agg(F.count("*").alias("members")).where("members > 1")


def array_rows(spark: SparkSession, root: str) -> DataFrame:
    """(path, cache_index, samples) of the rows of 2-D (or the one row of 1-D) .npy files."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                x = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False)).astype(np.float32)
                for a in range(0, len(x), 1024):
                    yield pd.DataFrame({"path": path, "cache_index": np.arange(a, min(len(x), a + 1024)), "samples": [r.tolist() for r in x[a : a + 1024]]})

    return binary_tree(spark, root, "*.npy").select("path", "content").mapInPandas(read, "path string, cache_index long, samples array<float>")


def metric_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """seed, model_type, best_epoch and one row per threshold of JSON reports (threshold_metrics as an array of rows)."""
    schema = "seed int, model_type string, best_epoch int, elapsed_seconds double, threshold_metrics array<map<string,double>>"
    df = spark.read.schema(schema).json(paths, multiLine=True)
    each = df.select("seed", "model_type", "best_epoch", "elapsed_seconds", F.explode("threshold_metrics").alias("m"))
    return each.select("seed", "model_type", "best_epoch", "elapsed_seconds", F.explode("m").alias("metric", "value"), F.col("m")["threshold"].alias("threshold")).where("metric <> 'threshold'")


def expected_runs(reports: DataFrame, seeds: list[int], identity: list[str] = ()) -> DataFrame:
    """The reports, if they have exactly the seeds and one identity; else ValueError."""
    r = reports.agg(F.array_sort(F.collect_set("seed")).alias("seeds"), F.count_distinct(F.struct(*identity) if identity else F.lit(1)).alias("kinds")).first()
    if r.seeds != sorted(seeds):
        raise ValueError(f"expected the seeds {sorted(seeds)}, found {r.seeds}")
    if r.kinds != 1:
        raise ValueError(f"the runs differ in {', '.join(identity)}")
    return reports


def load_config(path: str) -> dict:
    """A YAML (or, without that library, JSON) file as a dict; driver side."""
    text = open(path, encoding="utf-8").read()
    try:
        import yaml
    except ImportError:
        import json

        out = json.loads(text)
    else:
        out = yaml.safe_load(text)
    if not isinstance(out, dict):
        raise ValueError(f"{path} is not a mapping")
    return out


def windows_of(df: DataFrame, samples: str, size: int, count: int | None = None) -> DataFrame:
    """df with window_index and window: all complete windows, or count evenly spaced ones."""
    n = F.size(samples)
    if count is None:
        starts = F.transform(F.sequence(F.lit(0), F.floor(n / size).cast("int") - 1), lambda k: k * size)
    else:
        room = n - size
        starts = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.floor(k * (room / F.lit(float(max(1, count - 1))))).cast("int"))
    each = df.where(n >= size).select("*", F.posexplode(starts).alias("window_index", "_start"))
    return each.withColumn("window", F.slice(F.col(samples), F.col("_start") + 1, F.lit(size))).drop("_start")


def typed(column: Column, kind: T.DataType) -> Column:
    return column.cast(kind)
