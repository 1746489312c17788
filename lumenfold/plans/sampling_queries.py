"""Queries of splits, allocations and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import identity as I
from lumenfold.operators import sampling as S
from lumenfold.plans.fixtures import REGISTRY, query, registry, rounded
from lumenfold.runtime import table

_RATIOS = {"train": 0.7, "val": 0.15, "test": 0.15}


@query("""WITH u AS (SELECT doc_id, ('0x' || substr(sha256('11:' || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616 AS u FROM documents)
SELECT doc_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM u""")
def hash_split(spark, sf_dir):
    return S.hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", _RATIOS, 11)


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('5:' || source || ':' || doc_id)) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CASE WHEN r <= round_even(n * (0.7 / (0.7 + 0.15 + 0.15)), 0) THEN 'train' WHEN r <= round_even(n * (0.7 / (0.7 + 0.15 + 0.15)), 0) + round_even(n * (0.15 / (0.7 + 0.15 + 0.15)), 0) THEN 'val' ELSE 'test' END AS split FROM r""")
def hash_split_by_group(spark, sf_dir):
    return S.ranked_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source", _RATIOS, 5)


@query("""WITH s AS (SELECT lang, count(*) AS rows FROM documents GROUP BY lang), r AS (SELECT lang, rows, split, i, rows * share AS raw, floor(rows * share)::BIGINT AS base FROM s, (VALUES ('train', 0, 0.7 / (0.7 + 0.15 + 0.15)), ('val', 1, 0.15 / (0.7 + 0.15 + 0.15)), ('test', 2, 0.15 / (0.7 + 0.15 + 0.15))) t(split, i, share))
SELECT lang, split, rows, base + (row_number() OVER (PARTITION BY lang ORDER BY raw - base DESC, i) <= rows - sum(base) OVER (PARTITION BY lang))::BIGINT AS target FROM r""")
def largest_remainder(spark, sf_dir):
    return S.allocate_rows(table(spark, sf_dir, "documents"), ["lang"], _RATIOS)


@query("""WITH k AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('9:' || lang || ':' || source || ':' || doc_id), doc_id) AS k, sha256('9:' || lang || ':' || source) AS o FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k, o, source) AS p FROM k) SELECT lang, source, doc_id FROM p WHERE p <= 30""")
def round_robin_pick(spark, sf_dir):
    return S.round_robin(table(spark, sf_dir, "documents").select("lang", "source", "doc_id"), "source", "doc_id", 30, 9, ["lang"])


@query(f"""WITH {REGISTRY}, s AS (SELECT label, source, count(*) AS n FROM registry GROUP BY ALL), c AS (SELECT label, count(*) AS sources FROM s GROUP BY label)
SELECT s.label, s.source, n AS rows, round(n * 1.0::DOUBLE / ((SELECT count(*) FROM c) * sources * n), 9) AS weight FROM s JOIN c ON s.label = c.label""")
def class_source_weights(spark, sf_dir):
    w = S.balanced_weights(registry(spark, sf_dir), "label", "source")
    return w.groupBy("label", "source").agg(F.count("*").alias("rows"), F.round(F.sum("weight"), 9).alias("weight"))


_QUOTAS = f"""{REGISTRY}, s AS (SELECT label, source, count(*) AS rows FROM registry GROUP BY ALL), r AS (SELECT label, source, rows, round(pow(rows::DOUBLE, 0.5) / sum(pow(rows::DOUBLE, 0.5)) OVER (PARTITION BY label) * 64, 9) AS raw FROM s),
b AS (SELECT *, floor(raw)::BIGINT AS base FROM r),
quotas AS (SELECT label, source, rows, base + (row_number() OVER (PARTITION BY label ORDER BY round(raw - base, 9) DESC, source) <= 64 - sum(base) OVER (PARTITION BY label))::BIGINT AS quota FROM b)"""


@query(f"WITH {_QUOTAS} SELECT label, source, rows, quota FROM quotas")
def tempered_quotas(spark, sf_dir):
    return S.tempered_quotas(registry(spark, sf_dir), "label", "source", 64, 0.5)


@query("""WITH q AS (SELECT * FROM (VALUES ('en', 700), ('de', 90), ('fr', 40)) t(lang, quota)),
p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('2:' || lang || ':' || doc_id)) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents),
d AS (SELECT doc_id, lang, p + n * unnest(range(0, (quota - 1 - p) // n + 1)) AS draw FROM p JOIN q USING (lang) WHERE quota > p)
SELECT doc_id, lang, draw, draw // 20 AS batch FROM d""")
def quota_batches(spark, sf_dir):
    q = spark.createDataFrame([("en", 700), ("de", 90), ("fr", 40)], "lang string, quota long")
    return S.quota_batches(table(spark, sf_dir, "documents"), "doc_id", "lang", q, 20, 2)


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('8:' || lang || ':' || doc_id)) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang FROM r WHERE r <= (SELECT min(n) FROM r)""")
def per_class_sample(spark, sf_dir):
    return S.per_class_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 8)


@query("""WITH e AS (SELECT lang, doc_id, -ln(greatest(('0x' || substr(sha256('6:' || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616, 5.421010862427522e-20)) / n_chars AS e FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY e, doc_id) AS r FROM e) SELECT lang, doc_id FROM r WHERE r <= 25""")
def weighted_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("n_chars > 0").select("lang", "doc_id", "n_chars")
    return S.weighted_sample(d, "doc_id", F.col("n_chars"), 25, 6, ["lang"]).select("lang", "doc_id")


@query("""WITH c AS (SELECT lang AS subtype, source AS event, count(*) AS recordings FROM documents GROUP BY ALL), f AS (SELECT *, recordings = max(recordings) OVER (PARTITION BY subtype) AS full_event FROM c),
g AS (SELECT *, count(*) FILTER (WHERE full_event) OVER (PARTITION BY subtype) AS fulls FROM f), h AS (SELECT *, full_event OR fulls < 2 AS fit FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY subtype ORDER BY fit DESC, sha256('12:' || event)) AS place FROM h)
SELECT subtype, event, CASE WHEN fit AND place = 1 THEN 'validation' WHEN fit AND place = 2 THEN 'test' ELSE 'train' END AS role FROM o""")
def event_roles(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("subtype"), F.col("source").alias("event")).agg(F.count("*").alias("recordings"))
    return S.event_roles(c, "subtype", "event", "recordings", 12)


def _components(spark, sf_dir):
    r = registry(spark, sf_dir)
    comps = I.linked_components(r, "doc_id", ["content_hash", "norm_hash"])
    sized = r.withColumn("doc_id", F.col("doc_id").cast("string")).join(comps, "doc_id")
    return sized.groupBy("component").agg(F.max("label").alias("label"), F.count("*").alias("sources"), F.sum(F.floor(F.col("n_chars") / 500)).alias("windows"))


@query()
def greedy_component_split(spark, sf_dir):
    """Components to splits, largest first."""
    return S.greedy_components(_components(spark, sf_dir), "component", "label", "sources", _RATIOS, 42)


@query()
def balanced_component_split(spark, sf_dir):
    """Components to splits by hash, then balanced on sources and windows."""
    return S.hashed_then_balanced(_components(spark, sf_dir), "component", "label", "sources", "windows", _RATIOS, 42)


@query()
def grouped_tune_split(spark, sf_dir):
    """Sources to tune and holdout."""
    g = registry(spark, sf_dir).groupBy("source", "label").agg(F.count("*").alias("rows"))
    return S.grouped_tune_split(g, "source", "label", "rows", 0.4, 3)


@query()
def canonical_sources(spark, sf_dir):
    """One row per content, from the split that lacks most rows."""
    r = registry(spark, sf_dir).withColumn("label", F.lit(1))
    return S.canonical_sources(r.select("doc_id", "content_hash", "label", "split"), "content_hash", "label", "split", ["doc_id"], ["train", "val", "test"])


@query("""WITH w AS (SELECT doc_id, n_chars::DOUBLE AS w, substr(sha256(doc_id::VARCHAR), 1, 3) AS b FROM documents), c AS (SELECT doc_id, w, sum(w) OVER (ORDER BY b, doc_id) AS upto, sum(w) OVER () AS total FROM w),
d AS (SELECT i AS draw, ('0x' || substr(sha256('4:' || i), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616 AS u FROM range(0, 500) t(i))
SELECT draw, doc_id FROM d JOIN c ON u * total >= upto - w AND u * total < upto""")
def draw_with_replacement(spark, sf_dir):
    """Weighted draws by inverse distribution."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("weight"))
    return rounded(S.draw_with_replacement(d, "doc_id", "weight", 500, 4))
