"""Queries of joins, set operations, the firewall, identity, components and near-duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold import checks as C
from lumenfold.operators import firewall as W
from lumenfold.operators import identity as I
from lumenfold.operators import overlap as O
from lumenfold.operators import vectors as V
from lumenfold.plans.fixtures import REGISTRY, SCORED, query, registry, rounded, scored
from lumenfold.runtime import table


@query(f"WITH {REGISTRY} SELECT doc_id, content_hash, count(*) OVER (PARTITION BY content_hash) AS group_size, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1 AS kept FROM registry")
def canonical_dedup(spark, sf_dir):
    return I.canonical_rows(registry(spark, sf_dir).select("doc_id", "content_hash"), "content_hash", ["doc_id"])


@query(f"""WITH {REGISTRY}, g AS (SELECT content_hash, count(*) AS group_size, count(DISTINCT split) > 1 AS cross_split FROM registry GROUP BY content_hash)
SELECT doc_id, r.content_hash, split, group_size, cross_split, row_number() OVER (PARTITION BY r.content_hash ORDER BY doc_id) = 1 AS kept FROM registry r JOIN g ON r.content_hash = g.content_hash WHERE group_size > 1""")
def duplicate_listing(spark, sf_dir):
    return I.duplicate_listing(registry(spark, sf_dir).select("doc_id", "content_hash", "split"), "content_hash", "split", ["doc_id"])


@query(f"""WITH {REGISTRY} SELECT 'norm_hash' AS layer, norm_hash AS value FROM registry GROUP BY norm_hash HAVING count(DISTINCT label) > 1
UNION ALL SELECT 'content_hash', content_hash FROM registry GROUP BY content_hash HAVING count(DISTINCT label) > 1""")
def cross_label_conflicts(spark, sf_dir):
    return I.cross_label_keys(registry(spark, sf_dir), ["norm_hash", "content_hash"], "label")


@query(f"WITH {REGISTRY} SELECT doc_id, label FROM registry WHERE norm_hash NOT IN (SELECT norm_hash FROM registry GROUP BY norm_hash HAVING count(DISTINCT label) > 1)")
def drop_cross_label(spark, sf_dir):
    return I.drop_cross_label(registry(spark, sf_dir), ["norm_hash", "content_hash"], "label").select("doc_id", "label")


@query(f"""WITH {REGISTRY}, s AS (SELECT DISTINCT split, norm_hash FROM registry), p AS (SELECT * FROM (VALUES ('train', 'val'), ('train', 'test'), ('train', 'spare'), ('val', 'test'), ('val', 'spare'), ('test', 'spare')) t(a, b))
SELECT a AS left_split, b AS right_split, (SELECT count(*) FROM s x JOIN s y ON x.norm_hash = y.norm_hash WHERE x.split = a AND y.split = b) AS overlap FROM p""")
def split_overlap_matrix(spark, sf_dir):
    return O.split_overlaps(registry(spark, sf_dir), "split", "norm_hash", ["train", "val", "test", "spare"])


@query(f"WITH {REGISTRY} SELECT count(*) AS overlap FROM (SELECT norm_hash FROM registry WHERE split = 'train' INTERSECT SELECT norm_hash FROM registry WHERE split = 'test')")
def exact_overlap(spark, sf_dir):
    r = registry(spark, sf_dir)
    return O.exact_overlap(r.where("split = 'train'"), "norm_hash", r.where("split = 'test'"), "norm_hash")


@query(r"SELECT page_id, url FROM pages WHERE regexp_matches(regexp_replace(lower(url), '[^a-z0-9]', '', 'g'), 'examplenet|page2')")
def firewall_tokens(spark, sf_dir):
    return W.locked_rows(table(spark, sf_dir, "pages").select("page_id", "url"), ["example.net", "Page=2"], ["url"])


@query(f"WITH {REGISTRY} SELECT doc_id FROM registry WHERE split <> 'train' AND content_hash IN (SELECT content_hash FROM registry WHERE split = 'train')")
def firewall_hash_semi(spark, sf_dir):
    r = registry(spark, sf_dir)
    return W.forbidden_rows(r.where("split <> 'train'"), "content_hash", r.where("split = 'train'").select(F.col("content_hash").alias("sha256"))).select("doc_id")


@query(f"WITH {REGISTRY} SELECT doc_id FROM registry WHERE split <> 'train' AND content_hash NOT IN (SELECT content_hash FROM registry WHERE split = 'train')")
def anti_join_clean(spark, sf_dir):
    r = registry(spark, sf_dir)
    return W.allowed_rows(r.where("split <> 'train'"), "content_hash", r.where("split = 'train'").select(F.col("content_hash").alias("sha256"))).select("doc_id")


@query(f"""WITH {REGISTRY}, f AS (SELECT content_hash FROM registry WHERE split = 'train'), t AS (SELECT * FROM registry WHERE split = 'test')
SELECT count(*) AS rows, count(*) FILTER (WHERE regexp_matches(source, '^src1$')) AS locked_rows, count(*) FILTER (WHERE content_hash IN (SELECT * FROM f)) AS forbidden_rows FROM t""")
def firewall_audit(spark, sf_dir):
    r = registry(spark, sf_dir)
    asked = r.where("split = 'test'").select(F.concat("source", F.lit("end")).alias("source"), "content_hash")
    return W.audit_rows(asked, ["src1 end"], r.where("split = 'train'").select(F.col("content_hash").alias("sha256")))


@query(f"""WITH {REGISTRY}, a AS (SELECT doc_id, label FROM registry), b AS (SELECT doc_id, quality AS label FROM labels UNION ALL SELECT 1000000000 + item_id, 1 FROM benchmark)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'left_missing' WHEN b.doc_id IS NULL THEN 'right_missing' ELSE 'different' END AS problem
FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.label IS DISTINCT FROM b.label""")
def identity_full_outer(spark, sf_dir):
    """Documents against labels and benchmark items: missing on either side, or of another label."""
    b = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    b = b.unionByName(table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("doc_id"), F.lit(1).alias("label")))
    return O.identity_mismatches(registry(spark, sf_dir).select("doc_id", "label"), b, "doc_id", ["label"])


@query(f"""WITH {REGISTRY}, a AS (SELECT * FROM registry WHERE split = 'test'), b AS (SELECT * FROM registry WHERE split = 'val')
SELECT a.doc_id, b.doc_id AS right_doc_id, 'content_hash' AS match_layer FROM a JOIN b ON a.content_hash = b.content_hash UNION ALL SELECT a.doc_id, b.doc_id, 'norm_hash' FROM a JOIN b ON a.norm_hash = b.norm_hash""")
def identity_layers_union(spark, sf_dir):
    r = registry(spark, sf_dir)
    return O.layered_matches(r.where("split = 'test'"), r.where("split = 'val'"), "doc_id", "doc_id", ["content_hash", "norm_hash"])


_COMPONENTS = f"""WITH RECURSIVE {REGISTRY},
e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM registry a JOIN registry b ON a.content_hash = b.content_hash OR a.norm_hash = b.norm_hash),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)"""


@query(f"{_COMPONENTS} SELECT u::VARCHAR AS doc_id, min(v::VARCHAR) AS component FROM r GROUP BY u")
def connected_components(spark, sf_dir):
    return I.linked_components(registry(spark, sf_dir), "doc_id", ["content_hash", "norm_hash"])


@query(f"""{_COMPONENTS}, m AS (SELECT u, list_sort(list(v::VARCHAR)) AS members FROM r GROUP BY u)
SELECT u::VARCHAR AS doc_id, 'component:' || sha256('["' || array_to_string(members, '","') || '"]') AS component FROM m""")
def component_digests(spark, sf_dir):
    comps = I.linked_components(registry(spark, sf_dir), "doc_id", ["content_hash", "norm_hash"])
    return I.component_digests(comps, "doc_id", "component:")


@query(f"WITH {REGISTRY} SELECT CASE WHEN doc_id % 97 = 0 THEN doc_id END AS doc_id FROM registry WHERE doc_id % 97 = 0")
def hash_verification(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    expected = F.when(F.col("doc_id") % 97 == 0, F.lit("0" * 64)).otherwise(F.sha2("text", 256))
    return I.verify_hashes(d.select("doc_id", "text", expected.alias("sha256")), "text", "sha256").select("doc_id")


@query("""WITH x AS (SELECT DISTINCT source FROM documents), y AS (SELECT 'src' || i AS source FROM range(10, 24) t(i))
SELECT source, 'unregistered' AS side FROM x WHERE source NOT IN (SELECT source FROM y) UNION ALL SELECT source, 'unobserved' FROM y WHERE source NOT IN (SELECT source FROM x)""")
def set_differences(spark, sf_dir):
    known = spark.range(10, 24).select(F.concat(F.lit("src"), "id").alias("source"))
    return O.set_differences(table(spark, sf_dir, "documents"), known, "source")


@query("SELECT role, count(*) AS rows, count(lang) AS with_lang FROM (SELECT 'docs' AS role, lang FROM documents UNION ALL SELECT 'bench', NULL FROM benchmark UNION ALL SELECT 'pages', NULL FROM pages) GROUP BY role")
def heterogeneous_union(spark, sf_dir):
    u = O.named_union({"docs": table(spark, sf_dir, "documents").select("doc_id", "lang"), "bench": table(spark, sf_dir, "benchmark").select("item_id"), "pages": table(spark, sf_dir, "pages").select("page_id")})
    return u.groupBy("role").agg(F.count("*").alias("rows"), F.count("lang").alias("with_lang"))


@query("SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def many_to_one_join(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return O.many_to_one(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), customers, ["o_custkey"]).select("o_orderkey", "c_mktsegment", "o_totalprice")


@query(f"WITH {SCORED} SELECT doc_id, round((score + other + (score + other) / 2) / 3, 6) AS score FROM scored")
def ensemble_three_way(spark, sf_dir):
    s = scored(spark, sf_dir)
    return rounded(O.ensemble_mean([s.select("doc_id", "score"), s.select("doc_id", F.col("other").alias("score")), s.select("doc_id", ((F.col("score") + F.col("other")) / 2).alias("score"))], "doc_id", "score"))


@query("""WITH a AS (SELECT lang, doc_id AS background, row_number() OVER (PARTITION BY lang ORDER BY sha256('3:' || doc_id)) AS pair FROM documents WHERE doc_id % 2 = 0), b AS (SELECT lang, doc_id AS target, row_number() OVER (PARTITION BY lang ORDER BY sha256('4:' || doc_id)) AS pair FROM documents WHERE doc_id % 2 = 1)
SELECT a.lang, pair, background, target, unnest([-5.0, 0.0, 5.0])::DOUBLE AS snr_db FROM a JOIN b USING (lang, pair)""")
def paired_condition_grid(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a = d.where("doc_id % 2 = 0").select("lang", F.col("doc_id").alias("background"))
    b = d.where("doc_id % 2 = 1").select("lang", F.col("doc_id").alias("target"))
    zipped = O.zip_by_rank(a, b, [I.seeded_rank(3, F.col("background"))], [I.seeded_rank(4, F.col("target"))], ["lang"])
    return O.condition_grid(zipped.withColumn("pair", F.col("pair").cast("long")), "snr_db", [-5, 0, 5])


@query("""SELECT * FROM (SELECT 'label is known' AS name, (SELECT count(*) FROM labels WHERE quality NOT IN (0, 1))::DOUBLE AS value, NULL::DOUBLE AS minimum, 0::DOUBLE AS maximum, true AS passed
UNION ALL SELECT 'doc_id is unique', (SELECT count(*) - count(DISTINCT doc_id) FROM labels), NULL, 0, (SELECT count(*) = count(DISTINCT doc_id) FROM labels)
UNION ALL SELECT 'positives', (SELECT count(*) FROM labels WHERE quality = 1), 1000000, NULL, false)""")
def constraint_report(spark, sf_dir):
    rules = [C.none_where("label is known", ~F.col("quality").isin(0, 1)), C.unique("doc_id is unique", "doc_id"), C.Check("positives", F.count_if(F.col("quality") == 1), at_least=1_000_000)]
    return C.run_checks(table(spark, sf_dir, "labels"), rules)


@query(f"WITH {REGISTRY} SELECT source, count(DISTINCT label) AS labels, count(*) AS rows FROM registry GROUP BY source HAVING count(DISTINCT label) > 1")
def group_label_conflicts(spark, sf_dir):
    return C.label_conflicts(registry(spark, sf_dir), "source")


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), r AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id, r.vec_id AS neighbour, list_cosine_similarity(q.e, r.e) AS s FROM q JOIN r ON q.vec_id <> r.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, neighbour) AS place FROM s)
SELECT vec_id, place::INTEGER AS place, neighbour, round(s, 6) AS similarity FROM k WHERE place <= 3""")
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return rounded(V.cosine_topk(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 3))


_ROW = """sha256('["' || doc_id || '","' || content_hash || '","' || split || '"]')"""


@query(f"""WITH {REGISTRY}, r AS (SELECT {_ROW} AS h FROM registry), s AS (SELECT count(*) AS n, {", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT::HUGEINT) AS s{i}" for i in range(4))} FROM r)
SELECT sha256(n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3) AS digest FROM s""")
def table_digest(spark, sf_dir):
    """One digest of all rows, whatever their order."""
    return I.table_digest(registry(spark, sf_dir), ["doc_id", "content_hash", "split"])
