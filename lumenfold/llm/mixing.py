"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source of n rows with a share w of a target of T rows has the repetition rate w * T / n. Each row draws a
uniform number from a hash of seed and doc_id; the count is the inverse of the Poisson distribution with
that rate at that number, summed up row by row in about as many steps as copies come out: what is sent to the
rows is one rate per source, no table of the distribution. Rows are exploded by their counts and dealt to
partitions and sorted there by a hash of seed, doc_id and copy: one shuffle that no source, however large, can
skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.runtime import cut

SEED = 17
#: The source table (source, rate) is broadcast up to this many rows and bytes of names. Beyond, only the sources
#: with more than 1 / HOT_PARTS of all rows are (as many at most); rows of the others meet theirs by a shuffle.
BROADCAST_SOURCES, BROADCAST_BYTES = 100_000, 16 << 20
HOT_PARTS = 500
#: Columns that mix() adds; they replace columns of these names.
ADDED = ("copy_no", "rate", "shuffle_key")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_inverse(rate: Column, u: Column) -> Column:
    """The least k with P(X <= k) >= u, at most where nothing is left of the distribution in double precision.

    The probabilities are summed up from 0 and nothing but the sum is kept.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.lit(0.0).alias("log_k"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        log_k = acc["log_k"] + F.when(k > 0, F.log(F.greatest(k, F.lit(1)).cast("double"))).otherwise(0.0)
        total = acc["sum"] + F.exp(-rate + F.when(k > 0, k * F.log(rate)).otherwise(0.0) - log_k)
        return F.struct(log_k.alias("log_k"), total.alias("sum"), (acc["n"] + F.when(total < u, 1).otherwise(0)).alias("n"))

    # once the sum has passed u, the remaining steps are skipped
    go_on = lambda acc, k: F.when((k > 0) & (acc["sum"] >= u), acc).otherwise(step(acc, k))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), last), start, go_on)["n"]).otherwise(0)


def rates(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, source: str = "source") -> DataFrame:
    """(source, rows, rate): weights has source and weight; without it the weight is the root of the rows.

    Sources without a weight get the rate 0; a null source is a source of its own. total is the rows to
    expect, as many as docs has unless given.
    """
    sizes = docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("rows"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.sqrt(F.col("rows").cast("double")))
    else:
        given = weights.select(F.col("source").alias("_given"), F.col("weight").cast("double").alias("weight"))
        sizes = sizes.join(given, F.col("_source").eqNullSafe(F.col("_given")), "left").drop("_given")
        sizes = sizes.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    sizes = cut(sizes)  # one row a source
    sums = sizes.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    aim = F.lit(float(sums.rows if total is None else total))
    return sizes.select("_source", "rows", F.coalesce(F.try_divide(F.col("weight") * aim, F.lit(sums.weight) * F.col("rows")), F.lit(0.0)).alias("rate"))


def _with_rates(rows: DataFrame, table: DataFrame, source: Column) -> DataFrame:
    """rows with the rate of their source."""
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("_source").cast("string"))), F.lit(0)).alias("bytes"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    own = source.eqNullSafe(F.col("_source"))
    if size.n <= BROADCAST_SOURCES and size.bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), own)
    hot = F.broadcast(table.where(F.col("rows") * HOT_PARTS > size.rows))
    cold = table.where(F.col("rows") * HOT_PARTS <= size.rows)
    return rows.join(hot, own).unionByName(rows.join(hot, own, "left_anti").join(cold, own))


def mix(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, seed: int = SEED, source: str = "source") -> DataFrame:
    """Every copy of every row, with copy_no (1, 2, ...), rate and shuffle_key; rows come shuffled.

    docs needs doc_id and the source column and keeps all its columns. Repeated rows draw the same count,
    each its own copies; a null doc_id draws as the text "null". An empty table gives no rows.
    """
    table = cut(rates(docs, weights, total, source))
    # whole rows travel in a struct, so that no column of docs meets a name used here
    key = F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("null"))
    rows = docs.select(F.struct("*").alias("doc"))
    joined = _with_rates(rows, table, F.col(f"doc.{source}")).withColumn("u", uniform(F.lit(seed), key))
    counted = joined.withColumn("n", poisson_inverse(F.col("rate"), F.col("u"))).where("n > 0")
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n"))))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), key, F.col("copy_no").cast("string"))))
    own = [F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() not in ADDED]
    return copies.select(*own, *ADDED).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mixture_sql(columns: str = "doc_id, text, lang, source, n_chars", table: str = "documents", seed: int = SEED) -> str:
    """The same rows in DuckDB SQL, with weights as the root of the rows."""
    return f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM {table} GROUP BY source),
rates AS (SELECT source, n, sqrt(n::DOUBLE) * (SELECT sum(n)::DOUBLE FROM sizes) / ((SELECT sum(sqrt(n::DOUBLE)) FROM sizes) * n) AS rate FROM sizes),
pois AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS c, CAST(0 AS DOUBLE) AS log_k FROM rates
  UNION ALL
  SELECT source, rate, k + 1, c + exp(-rate + (k + 1) * ln(rate) - (log_k + ln((k + 1)::DOUBLE))), log_k + ln((k + 1)::DOUBLE)
  FROM pois WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 30)),
drawn AS (SELECT d.*, ('0x' || substr(md5('{seed}:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u FROM {table} d),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, any_value(p.rate) AS rate, count(*) FILTER (WHERE p.c < d.u) AS n
  FROM drawn d JOIN pois p ON d.source IS NOT DISTINCT FROM p.source GROUP BY ALL)
SELECT {columns}, copy_no, round(rate, 9) AS rate, md5('{seed}:' || doc_id || ':' || copy_no) AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1))::INTEGER AS copy_no FROM counted)
"""
