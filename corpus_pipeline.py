"""From raw documents to a tokenised training mixture: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import bpe, exact, minhash, mixing, toxicity
from lumenfold.llm.queries import tokenizer_path
from lumenfold.runtime import BATCH_ROWS, discard, scratch, ship, small_batches, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the lexicon learned from labels rejects."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out())
    return toxicity.keep_clean(docs, toxicity.learn(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship(spark)
    small_batches(spark)
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents so that sources meet their target weights, shuffled."""
    return mixing.mix(docs).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture with its token ids and the words they decode to."""
    ship(spark)
    small_batches(spark)
    return bpe.encoded(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents; what a stage returns is written to the shared folder for the next, the last as well.

    Settings that stages change for their own plans are put back.
    """
    docs = table(spark, sf_dir, "documents")
    where, rows = scratch(spark, "pipeline"), spark.conf.get(BATCH_ROWS)
    before = None
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
            docs = spark.read.parquet(f"{where}/{name}")
            if before:
                discard(spark, before)
            before = f"{where}/{name}"
    finally:
        spark.conf.set(BATCH_ROWS, rows)
    return docs


#: The learned lexicon can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None
