"""The thin opN queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib.util
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import bpe, exact, imatch, lm, minhash, mixing, pii, secrets, toxicity, warc
from lumenfold.runtime import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("token", 256).alias("token_sha256"), F.round("score", 9).alias("score"), "is_secret")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The tokenizer file: LUMENFOLD_TOKENIZER, or word_bpe_49k.json of the installed public_tokenizers."""
    if named := os.environ.get("LUMENFOLD_TOKENIZER"):
        return named
    spec = importlib.util.find_spec("public_tokenizers")
    root = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(root / "word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    lexicon = toxicity.learn(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "hits")


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.with_edits(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_lm_score": op2_lm_score,
    "op3_bpe": op3_bpe,
    "op4_pii": op4_pii,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_imatch": op9_imatch,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op6_mix_sources": mixing.mixture_sql(),
    "op7_warc": warc.ORACLE_SQL,
    "op10_exact_dedup": exact.ORACLE_SQL,
}
