"""Queries of composite audits and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import audits as A
from lumenfold.operators import overlap as O
from lumenfold.operators import sampling as S
from lumenfold.operators import vectors as V
from lumenfold.plans.fixtures import REGISTRY, SCORED, query, registry, rounded, scored, segments
from lumenfold.runtime import table
from lumenfold.schema import adapt, starts_with_any


@query(f"""WITH {REGISTRY}, s AS (SELECT count(*) FILTER (WHERE split = 'train')::DOUBLE / count(*) AS a, count(*) FILTER (WHERE split = 'val')::DOUBLE / count(*) AS b, count(*) FILTER (WHERE split = 'test')::DOUBLE / count(*) AS c FROM registry),
g AS (SELECT count(*) FILTER (WHERE y > 1) AS y, count(*) FILTER (WHERE s > 1) AS s FROM (SELECT source, count(DISTINCT label) AS y, count(DISTINCT split) AS s FROM registry GROUP BY source)),
o AS (SELECT sum(k * (k - 1) / 2) AS o FROM (SELECT content_hash, count(DISTINCT split) AS k FROM registry GROUP BY content_hash)),
r AS (SELECT 'content_hash is well formed' AS name, 0::DOUBLE AS value, 0::DOUBLE AS maximum UNION ALL SELECT 'norm_hash is well formed', 0, 0 UNION ALL SELECT 'split is known', 0, 0 UNION ALL SELECT 'label is 0 or 1', 0, 0
 UNION ALL SELECT 'largest error of a split''s share', greatest(abs(a - 0.7), abs(b - 0.1), abs(c - 0.2)), 0.001 FROM s UNION ALL SELECT 'one label per group', y, 0 FROM g UNION ALL SELECT 'one split per group', s, 0 FROM g UNION ALL SELECT 'contents in two splits', o, 0 FROM o)
SELECT name, round(value, 6) AS value, NULL::DOUBLE AS minimum, maximum, value <= maximum AS passed FROM r""")
def manifest_report(spark, sf_dir):
    """All checks of a manifest in one table."""
    return rounded(A.manifest_report(registry(spark, sf_dir), {"train": 0.7, "val": 0.1, "test": 0.2}, ["content_hash", "norm_hash"], "source"))


@query(f"""WITH {REGISTRY}, t AS (SELECT * FROM registry WHERE split = 'test'), k AS (SELECT content_hash FROM t GROUP BY content_hash HAVING count(DISTINCT label) > 1)
SELECT count(DISTINCT content_hash) AS unique_hashes, count(content_hash) - count(DISTINCT content_hash) AS duplicate_extra_rows, (SELECT count(*) FROM k) AS cross_label_groups,
 count(*) FILTER (WHERE content_hash IN (SELECT content_hash FROM registry WHERE split = 'train')) AS rows_in_train, count(*) FILTER (WHERE content_hash IN (SELECT content_hash FROM registry WHERE split = 'val')) AS rows_in_val FROM t""")
def hash_audit(spark, sf_dir):
    r = registry(spark, sf_dir)
    return A.hash_audit(r.where("split = 'test'"), "content_hash", "label", {k: r.where(F.col("split") == k).select("content_hash") for k in ("train", "val")})


@query(f"WITH {REGISTRY} SELECT label, split, count(*) AS rows, count(DISTINCT source) AS sources, count(DISTINCT content_hash) AS contents FROM registry GROUP BY label, split")
def allocation_counts(spark, sf_dir):
    return A.allocation_counts(registry(spark, sf_dir), "label", "split", "source", "content_hash")


@query(f"WITH {REGISTRY} SELECT label, round(greatest(abs(count(*) FILTER (WHERE split = 'train')::DOUBLE / count(*) - 0.7), abs(count(*) FILTER (WHERE split = 'val')::DOUBLE / count(*) - 0.1), abs(count(*) FILTER (WHERE split = 'test')::DOUBLE / count(*) - 0.2)), 6) AS error FROM registry GROUP BY label")
def allocation_error(spark, sf_dir):
    return rounded(A.allocation_error(registry(spark, sf_dir), "label", "split", {"train": 0.7, "val": 0.1, "test": 0.2}))


@query("SELECT source, count(*) AS windows, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def source_table(spark, sf_dir):
    return A.source_table(table(spark, sf_dir, "documents"), "source", "doc_id", ["lang", "n_chars"])


@query("SELECT source, count(*) AS rows, array_to_string(list_sort(list(DISTINCT lang)), '|') AS lang FROM documents GROUP BY source")
def joined_lists(spark, sf_dir):
    return A.joined_lists(table(spark, sf_dir, "documents"), "source", ["lang"])


@query(f"WITH {SCORED}, t AS (SELECT unnest([0.25, 0.5, 0.75, 0.9])::DOUBLE AS threshold) SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS rows FROM scored, t GROUP BY threshold")
def counts_at_or_above(spark, sf_dir):
    return A.counts_at_or_above(scored(spark, sf_dir), "score", [0.25, 0.5, 0.75, 0.9])


@query(f"""WITH {SCORED}, a AS (SELECT lang, avg(score) AS v FROM scored WHERE toxic = 0 GROUP BY lang), b AS (SELECT lang, avg(other) AS v FROM scored GROUP BY lang)
SELECT a.lang, round(a.v, 6) AS external, round(b.v, 6) AS internal, round(a.v - b.v, 6) AS gap, round(a.v / b.v, 6) AS retention FROM a JOIN b ON a.lang = b.lang""")
def retention(spark, sf_dir):
    s = scored(spark, sf_dir)
    return rounded(A.retention(s.where("toxic = 0").groupBy("lang").agg(F.avg("score").alias("v")), s.groupBy("lang").agg(F.avg("other").alias("v")), ["lang"], "v"))


@query(f"""WITH {SCORED}, s AS (SELECT lang, source, count(*) AS n, sum(label) AS p FROM scored GROUP BY ALL)
SELECT lang, sum(n)::BIGINT AS draws, round(sum(p)::DOUBLE / sum(n), 6) AS positive_share, count(*) AS sources, round(max(n)::DOUBLE / sum(n), 6) AS largest_source_share FROM s GROUP BY lang""")
def sampling_audit(spark, sf_dir):
    return rounded(A.sampling_audit(scored(spark, sf_dir), "label", "source", ["lang"]))


@query(f"WITH {SCORED} SELECT round(count(*) FILTER (WHERE label = 0)::DOUBLE / count(*) FILTER (WHERE label = 1), 6) AS positive_weight FROM scored")
def positive_weight(spark, sf_dir):
    return rounded(A.positive_weight(scored(spark, sf_dir), "label"))


@query("SELECT conv_id, turn, min(length(text)) OVER (PARTITION BY conv_id) AS shared_gain FROM conversations")
def shared_gain(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("gain"))
    return A.shared_gain(c, "conv_id", "gain").select("conv_id", "turn", "shared_gain")


@query(f"""WITH {SCORED}, d AS (SELECT source || CASE WHEN source IN ('src1', 'src2') THEN label::VARCHAR ELSE '' END AS domain, label, score >= 0.5 AS hit FROM scored),
c AS (SELECT domain, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n, count(*) FILTER (WHERE label = 1 AND hit) AS tp, count(*) FILTER (WHERE label = 0 AND hit) AS fp FROM d GROUP BY domain)
SELECT domain, CASE WHEN p > 0 AND n > 0 THEN 'binary' WHEN p > 0 THEN 'positive' ELSE 'negative' END AS kind, rows, round(CASE WHEN p > 0 THEN tp::DOUBLE / p END, 6) AS recall, round(CASE WHEN n > 0 THEN fp::DOUBLE / n END, 6) AS fpr, round(CASE WHEN p > 0 AND n > 0 THEN (tp::DOUBLE / p + 1 - fp::DOUBLE / n) / 2 END, 6) AS balanced_accuracy FROM c""")
def domain_report(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("domain", F.concat("source", F.when(F.col("source").isin("src1", "src2"), F.col("label").cast("string")).otherwise("")))
    return rounded(A.domain_report(s, "domain", "label", "score", 0.5))


@query("SELECT page_id AS key, url AS location, 'web' AS dataset FROM pages WHERE url LIKE 'https://%' OR url LIKE 'ftp://%'")
def adapted_rows(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return adapt(p.where(starts_with_any("url", ["https://", "ftp://"])), {"key": "page_id", "location": "url"}, {"dataset": "web"})


@query("SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def one_to_one_join(spark, sf_dir):
    d, ell = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return O.one_to_one(d.join(ell.select("doc_id"), "doc_id", "left_semi"), ell, ["doc_id"])


@query("""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY sha256('14:' || role || ':' || conv_id || '/' || turn)) AS r FROM conversations) SELECT conv_id, turn FROM r WHERE r <= 40""")
def capped_class_sample(spark, sf_dir):
    c = segments(spark, sf_dir).withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    return S.per_class_sample(c, "key", "role", 14, 40).select("conv_id", "turn")


@query()
def linear_outlier_head(spark, sf_dir):
    """Probabilities of a logistic head fitted on vectors."""
    e = table(spark, sf_dir, "embeddings").withColumn("outlier", (F.col("label") >= 7).cast("int"))
    head = V.fit_linear_head(e, "embedding", "outlier")
    return rounded(e.select("vec_id", V.head_score(head, F.col("embedding")).alias("score")), 4)


@query("""WITH l AS (SELECT vec_id, embedding[1:4]::DOUBLE[] AS l FROM embeddings), m AS (SELECT vec_id, [CASE WHEN vec_id % 2 = 0 THEN exp(l[1]) ELSE 0 END, exp(l[2]), CASE WHEN vec_id % 3 = 0 THEN exp(l[3]) ELSE 0 END, exp(l[4])] AS e FROM l)
SELECT vec_id, round(e[1] / list_sum(e), 6) AS p0, round(e[2] / list_sum(e), 6) AS p1, round(e[3] / list_sum(e), 6) AS p2, round(e[4] / list_sum(e), 6) AS p3 FROM m""")
def masked_softmax(spark, sf_dir):
    mask = F.array(F.col("vec_id") % 2 == 0, F.lit(True), F.col("vec_id") % 3 == 0, F.lit(True))
    p = V.masked_softmax(F.slice("embedding", 1, 4), mask)
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p")).select("vec_id", *[F.col("p")[i].alias(f"p{i}") for i in range(4)]))
