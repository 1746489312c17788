"""Queries that write a table by a sink and read it back by a scan, compared with the table itself."""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
from pyspark.sql import functions as F

from lumenfold.functions import signals as G
from lumenfold.operators import audits as A
from lumenfold.plans.fixtures import REGISTRY, SCORED, query, registry, rounded, scored
from lumenfold.runtime import put_file, scratch, table
from lumenfold.sources import readers, writers


@query(f"WITH {REGISTRY} SELECT doc_id, source, label, split FROM registry WHERE split = 'test'")
def csv_manifest(spark, sf_dir):
    """A manifest as CSV, verified by its rows, and read again under its schema, one split of it."""
    path = f"{scratch(spark, 'csv')}/manifest"
    r = registry(spark, sf_dir).select("doc_id", "source", "label", "split")
    writers.write_table(r, path, kind="csv", expected_rows=r.count())
    return readers.manifest(spark, path, "doc_id long, source string, label int, split string", "test")


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents")
def hash_registry(spark, sf_dir):
    """A list of hashes, one a line."""
    path = f"{scratch(spark, 'hashes')}/list"
    table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("value")).write.text(path)
    return readers.hash_list(spark, path)


@query("SELECT md5(text) AS digest, 'docs/' || source || ' ' || doc_id AS path FROM documents")
def checksum_lines(spark, sf_dir):
    """Lines of digest and path."""
    path = f"{scratch(spark, 'sums')}/list"
    line = F.concat(F.md5("text"), F.lit("  *docs/"), "source", F.lit(" "), "doc_id")
    table(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    return readers.checksum_list(spark, path)


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents UNION SELECT sha256(text) FROM benchmark")
def hash_columns(spark, sf_dir):
    """The hashes of several manifests, under whichever name they have them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.upper(F.sha2("text", 256)).alias("sha256"), F.lit("none").alias("cache_sha256"))
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit(" "), F.sha2("text", 256)).alias("cache_sha256"))
    return readers.manifest_hashes([d, b])


def _wav_corpus(spark, sf_dir):
    path = f"{scratch(spark, 'corpus')}/wav"
    e = table(spark, sf_dir, "embeddings")
    wav = F.when(F.col("label") == 3, F.lit(b"junk")).otherwise(G.encoded_wav(16000)(F.when(F.col("label") == 4, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))))
    e.select("label", F.struct(wav.alias("bytes"), F.col("vec_id").cast("string").alias("path")).alias("audio")).write.parquet(path)
    return path


@query("""WITH e AS (SELECT vec_id, label, round_even(least(greatest(embedding[1]::DOUBLE * 32767, -32768), 32767), 0) / 32768 AS x FROM embeddings)
SELECT vec_id::VARCHAR AS path, label, CASE WHEN label <> 3 THEN 16000 END AS rate, CASE WHEN label <> 3 THEN 64 END AS samples, CASE label WHEN 3 THEN NULL WHEN 4 THEN 0.0 ELSE round(x::FLOAT::DOUBLE, 6) END AS first, CASE label WHEN 3 THEN 'undecodable' WHEN 4 THEN 'silent' ELSE 'kept' END AS status FROM e""")
def wav_corpus(spark, sf_dir):
    """Vectors as 16-bit WAV in a Parquet corpus, decoded again; one class is damaged, one silent."""
    rows = readers.corpus(spark, _wav_corpus(spark, sf_dir))
    return rounded(rows.select("path", "label", "rate", F.when(F.col("rate").isNotNull(), F.size("samples")).alias("samples"), F.col("samples")[0].cast("double").alias("first"), "status"))


@query("SELECT label, count(*) AS rows, CASE WHEN label <> 3 THEN 1 END AS format, CASE WHEN label <> 3 THEN 16 END AS bits, CASE WHEN label <> 3 THEN 64 END AS frames, CASE WHEN label IN (3, 4) THEN 1 ELSE count(DISTINCT list_transform(embedding, lambda x: round_even(least(greatest(x::DOUBLE * 32767, -32768), 32767), 0))) END AS contents FROM embeddings GROUP BY label")
def wav_headers(spark, sf_dir):
    """Headers without decoding, and the distinct raw contents."""
    raw = spark.read.parquet(_wav_corpus(spark, sf_dir)).select("label", G.wav_info("audio.bytes").alias("i"), F.sha2("audio.bytes", 256).alias("h"))
    return raw.groupBy("label", "i.format", "i.bits", "i.frames").agg(F.count("*").alias("rows"), F.count_distinct("h").alias("contents"))


def _contents(spark, sf_dir):
    """A small text for each language and source: a bounded table."""
    d = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("s"))
    return sorted((r.lang, r.source, f"{r.lang}:{r.source}:{r.n}:{r.s}".encode()) for r in d.collect())


_CONTENTS = "c AS (SELECT lang, source, lang || ':' || source || ':' || count(*) || ':' || sum(n_chars) AS t FROM documents GROUP BY lang, source)"


@query(f"WITH {_CONTENTS} SELECT CASE lang WHEN 'en' THEN 1 ELSE 0 END AS label, source AS source_group, lang AS condition, length(t) AS size, sha256(t) AS sha256, 'about ' || source AS provenance FROM c WHERE lang IN ('en', 'de')")
def registered_files(spark, sf_dir):
    """A tree label/source/condition/x.wav against a registry of its sources."""
    root, label = scratch(spark, "tree"), {"en": "yes", "de": "no", "fr": "other", "es": "other"}
    rows = _contents(spark, sf_dir)
    for lang, source, text in rows:
        put_file(spark, f"{root}/{label.get(lang, 'other')}/{source}/{lang}/x.wav", text)
    known = spark.createDataFrame([(s, f"about {s}") for s in sorted({s for lang, s, _ in rows if lang in ("en", "de")})], "source_group string, provenance string")
    return readers.registered_tree(spark, root, {"yes": 1, "no": 0}, known).drop("path")


@query(f"WITH {_CONTENTS} SELECT lang || '.zip' AS archive, source || '/' || 'x.txt' AS member, sha256(t) AS sha256, (SELECT count(*) FROM c x WHERE x.lang = c.lang) AS same_name FROM c")
def archive_members(spark, sf_dir):
    """Members of ZIP archives, with how many of an archive have the same name."""
    root, rows = scratch(spark, "zip"), _contents(spark, sf_dir)
    for lang in sorted({r[0] for r in rows}):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.md", b"x")
            for _, source, text in (r for r in rows if r[0] == lang):
                z.writestr(f"{source}/x.txt", text)
        put_file(spark, f"{root}/{lang}.zip", buffer.getvalue())
    members = readers.zip_members(spark, root, ".txt")
    twice = readers.unique_basenames(members).select("path", F.col("members").alias("same_name"))
    return members.join(twice, "path", "left").select(F.substring_index("path", "/", -1).alias("archive"), "member", F.sha2("content", 256).alias("sha256"), F.coalesce("same_name", F.lit(1).cast("long")).alias("same_name"))


@query("SELECT row_number() OVER (ORDER BY label) - 1 AS cache_index, label::DOUBLE AS first, count(*)::DOUBLE AS second, max(vec_id)::DOUBLE AS third FROM embeddings GROUP BY label")
def array_file(spark, sf_dir):
    """A matrix in a .npy file, row by row."""
    root = scratch(spark, "npy")
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*"), F.max("vec_id")).orderBy("label").collect()  # a row a class
    buffer = io.BytesIO()
    np.save(buffer, np.array([list(r) for r in rows], np.float32))
    put_file(spark, f"{root}/m.npy", buffer.getvalue())
    return readers.array_rows(spark, root).select("cache_index", *[F.col("samples")[i].cast("double").alias(n) for i, n in enumerate(("first", "second", "third"))])


@query(f"""WITH {SCORED}, t AS (SELECT unnest([0.3, 0.6])::DOUBLE AS threshold), s AS (SELECT unnest([41, 42]) AS seed), g AS (SELECT seed, threshold, count(*) FILTER (WHERE (CASE seed WHEN 41 THEN score ELSE other END) >= threshold) AS hits, count(*) AS n FROM scored, t, s GROUP BY ALL)
SELECT seed, 'scored' AS model_type, threshold, 'hits' AS metric, hits::DOUBLE AS value FROM g UNION ALL SELECT seed, 'scored', threshold, 'rows', n::DOUBLE FROM g""")
def seed_reports(spark, sf_dir):
    """JSON reports of two runs, checked for their seeds and read as one row a metric."""
    root = scratch(spark, "reports")
    for seed, column in ((41, "score"), (42, "other")):
        found = A.counts_at_or_above(scored(spark, sf_dir), column, [0.3, 0.6]).collect()
        rows = scored(spark, sf_dir).count()
        report = {"seed": seed, "model_type": "scored", "best_epoch": 1, "threshold_metrics": [{"threshold": r.threshold, "hits": r.rows, "rows": rows} for r in found]}
        put_file(spark, f"{root}/seed_{seed}/metrics.json", json.dumps(report, indent=1).encode())
    reports = readers.metric_reports(spark, f"{root}/*/metrics.json")
    return readers.expected_runs(reports, [41, 42], ["model_type"]).select("seed", "model_type", "threshold", "metric", "value")


@query("SELECT CASE WHEN label < 7 THEN 'train' ELSE 'test' END AS split, count(*) AS rows, sum(vec_id)::BIGINT AS ids, 64 AS samples FROM embeddings GROUP BY ALL")
def array_cache(spark, sf_dir):
    """Waveforms cached by split, their lengths and numbers verified."""
    e = table(spark, sf_dir, "embeddings").withColumn("split", F.when(F.col("label") < 7, "train").otherwise("test"))
    sizes = {r.split: r["count"] for r in e.groupBy("split").count().collect()}
    back = writers.write_array_cache(e, f"{scratch(spark, 'cache')}/arrays", "embedding", 64, sizes)
    return back.groupBy("split").agg(F.count("*").alias("rows"), F.sum("vec_id").alias("ids"), F.max(F.size("embedding")).alias("samples"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), k AS (SELECT vec_id, 'spaced' AS kind, unnest([0, 1, 2]) AS window_index, e FROM e UNION ALL SELECT vec_id, 'complete', unnest([0, 1, 2]), e FROM e),
s AS (SELECT *, CASE kind WHEN 'spaced' THEN window_index * 24 ELSE window_index * 20 END AS a, CASE kind WHEN 'spaced' THEN 16 ELSE 20 END AS n FROM k)
SELECT vec_id, kind, window_index::INTEGER AS window_index, round(list_sum(e[a + 1 : a + n]), 6) AS total FROM s""")
def waveform_windows(spark, sf_dir):
    """Three evenly spaced windows of 16 samples, and all complete ones of 20."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    both = readers.windows_of(e, "embedding", 16, 3).withColumn("kind", F.lit("spaced")).unionByName(readers.windows_of(e, "embedding", 20).withColumn("kind", F.lit("complete")))
    return rounded(both.select("vec_id", "kind", "window_index", F.aggregate("window", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total")))


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN lang = 'fr' AND n_chars % 3 = 0 THEN 'missing' WHEN lang = 'de' AND n_chars % 3 = 0 THEN 'size' ELSE 'sha256' END AS problem FROM documents WHERE n_chars % 3 = 0 AND lang IN ('fr', 'de', 'es')""")
def bundle_verification(spark, sf_dir):
    """Files against expected sizes and hashes, each wrong in a third of a language's rows."""
    d = table(spark, sf_dir, "documents")
    odd = F.col("n_chars") % 3 == 0
    files = d.where(~((F.col("lang") == "fr") & odd)).select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("length"), F.sha2("text", 256).alias("sha256"))
    size = F.octet_length("text") + F.when(odd & (F.col("lang") == "de"), 1).otherwise(0)
    digest = F.when(odd & (F.col("lang") == "es"), F.sha2(F.lit("x"), 256)).otherwise(F.upper(F.sha2("text", 256)))
    return A.verify_bundle(files, d.select(F.col("doc_id").cast("string").alias("path"), size.cast("long").alias("length"), digest.alias("sha256")))


@query("""WITH n AS (SELECT count(*) AS rows, count(DISTINCT source) AS paths FROM documents) SELECT 'rows' AS name, rows::DOUBLE AS value, rows::DOUBLE AS minimum, rows::DOUBLE AS maximum, true AS passed FROM n UNION ALL SELECT 'unique paths', paths, paths + 1, paths + 1, false FROM n
UNION ALL SELECT 'paths that are no file', (SELECT count(DISTINCT source) FROM documents WHERE source > 'src3'), NULL, 0, false""")
def bundle_references(spark, sf_dir):
    """A manifest's rows and distinct paths against expected numbers, and its paths that are no file."""
    d = table(spark, sf_dir, "documents").select("source")
    files = d.where("source <= 'src3'").select(F.col("source").alias("path")).distinct()
    one = d.agg(F.count("*").alias("n"), F.count_distinct("source").alias("k")).first()
    return A.verify_references(d, "source", files, one.n, one.k + 1)
