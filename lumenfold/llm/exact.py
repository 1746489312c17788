"""Exact duplicates with a heavy-hitter split, in DataFrame functions only.

Frequent digests are found by Spark's frequent-items aggregate, a mergeable Misra-Gries summary: every task
keeps ``TRACKED`` counters for its rows (when they are full, all are lowered by a middle one and the empty ones
go), the summaries, not the digests, are shuffled and merged, and no counter is off by more than 3.5 / TRACKED
of the rows. So every digest that more than 1 / ``FREQUENT`` of the rows have comes out, and few others. These
candidates are broadcast; their exact counts verify them, and the winners are then resolved on the map side.
The remaining digests are grouped by an ordinary shuffle, which no group larger than n / FREQUENT enters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.runtime import cut

#: Digests with more than this part of all rows are heavy; counters of a summary, a power of two, 14 times as many at least.
FREQUENT, TRACKED = 256, 4096
#: Keys (40 bytes each) of rows to drop that are broadcast; more are shuffled, with the rows.
FEW_KEYS = 250_000
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text) -> F.Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def frequent_candidates(rows: DataFrame, frequent: int = FREQUENT, tracked: int = TRACKED) -> DataFrame:
    """(mark): at most 2 * frequent hashes of digests, among them those of all that more than n / frequent rows have.

    A digest is returned if its count is certainly above the largest error, 3.5 n / tracked; this holds for
    all counts above twice that error, so 14 * frequent <= tracked would do for half as many rows.
    """
    found = rows.select(F.xxhash64("digest").alias("mark")).agg(F.expr(f"approx_top_k(mark, {2 * frequent}, {tracked})").alias("top"))
    return found.select(F.explode("top.item").alias("mark"))


def _best() -> F.Column:
    return F.min(F.struct((-F.col("len")).alias("len"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")


def exact_duplicates(docs: DataFrame, frequent: int = FREQUENT, tracked: int = TRACKED) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs (doc_id, text).

    Texts are equal when identical without [\\x20\\x09-\\x0D]; null counts as empty. Of a group the row with
    the most code points stays, then the smallest doc_id (null last), then the earlier of repeated rows.
    Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id"), F.char_length(text).cast("long").alias("len"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))
    base = cut(base.withColumn("row", F.monotonically_increasing_id()))
    total = base.count()
    candidates = F.broadcast(cut(frequent_candidates(base, frequent, tracked)))
    heavy = base.join(candidates, F.xxhash64("digest") == F.col("mark"), "left_semi").groupBy("digest").agg(F.count("*").alias("group_size"), _best())
    heavy = cut(heavy.where((F.col("group_size") * frequent > total) & (F.col("group_size") > 1)))  # under frequent rows
    done = base.join(F.broadcast(heavy), "digest")
    rest = base.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.count("*").alias("group_size"), _best()).where("group_size > 1")
    rest = rest.join(groups, "digest", "left")
    alone = F.col("best").isNull()
    return done.unionByName(rest).select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were."""
    keys = ["doc_id", "text_sha256"]
    found = cut(exact_duplicates(docs).groupBy(*keys).agg(F.count_if("kept").alias("stay"), F.count_if(~F.col("kept")).alias("go")))
    # whole rows travel in a struct, so that no column of docs meets a name used here
    rows = docs.select(F.struct("*").alias("doc"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha"))

    def match(side: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        other = side.select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_other"))
        return rows.join(F.broadcast(other) if side.count() <= FEW_KEYS else other, F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_other")), how)

    left = match(found.where("stay = 0"), "left_anti", rows)
    repeated = found.where("stay > 0 and go > 0")  # rows that repeat a doc_id and its text: one of them stays
    if not repeated.isEmpty():
        one = Window.partitionBy("doc.doc_id", "sha").orderBy(F.desc(F.char_length("doc.text")))
        first = match(repeated, "left_semi", left).withColumn("first", F.row_number().over(one)).where("first = 1").drop("first")
        left = match(repeated, "left_anti", left).unionByName(first)
    return left.select("doc.*")


ORACLE_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id)
"""
