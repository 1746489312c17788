"""The tables that queries run on, made from the driver's tables the same way in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that checks it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


SCORED = """
scored AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality AS label, l.toxic,
         ((d.n_chars * 7919 + d.doc_id * 104729) % 1000)::DOUBLE / 1000 AS score,
         ((d.n_chars * 6007 + d.doc_id * 15485863) % 1000)::DOUBLE / 1000 AS other
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
SEGMENTS = """
seg AS (
  SELECT conv_id, turn, role, conv_id % 2 AS label, conv_id % 7 AS session,
         ((length(text) * 31 + turn * 17) % 1000)::DOUBLE / 1000 AS score
  FROM conversations)"""
REGISTRY = r"""
registry AS (
  SELECT d.doc_id, d.source, d.lang, sha256(d.text) AS content_hash, sha256(regexp_replace(d.text, '[ \t\r\n]+', '', 'g')) AS norm_hash, d.n_chars,
         CASE WHEN d.doc_id % 10 < 7 THEN 'train' WHEN d.doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split,
         (d.doc_id // 7 % 2)::INTEGER AS label
  FROM documents d)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    ell = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), "toxic")
    score = ((F.col("n_chars") * 7919 + F.col("doc_id") * 104729) % 1000).cast("double") / 1000
    other = ((F.col("n_chars") * 6007 + F.col("doc_id") * 15485863) % 1000).cast("double") / 1000
    return d.join(ell, "doc_id").withColumn("score", score).withColumn("other", other)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    score = ((F.length("text") * 31 + F.col("turn") * 17) % 1000).cast("double") / 1000
    return c.select("conv_id", "turn", "role", (F.col("conv_id") % 2).alias("label"), (F.col("conv_id") % 7).alias("session"), score.alias("score"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    r = F.col("doc_id") % 10
    split = F.when(r < 7, "train").when(r < 8, "val").otherwise("test")
    return d.select("doc_id", "source", "lang", F.sha2("text", 256).alias("content_hash"), F.sha2(F.regexp_replace("text", "[ \\t\\r\\n]+", ""), 256).alias("norm_hash"), "n_chars", split.alias("split"), (F.floor(F.col("doc_id") / 7) % 2).cast("int").alias("label"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since sums in another order differ in the last bits."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
