"""Queries of scalar functions: names, labels, digests, curves, arrays and JSON, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold import schema
from lumenfold.functions import scalars as S
from lumenfold.operators import audits as A
from lumenfold.operators import gates as G
from lumenfold.operators import identity as I
from lumenfold.operators import rollup as R
from lumenfold.operators import segments as W
from lumenfold.operators import vectors as V
from lumenfold.operators.metrics import predicted_class
from lumenfold.plans.fixtures import REGISTRY, SCORED, query, registry, rounded, scored
from lumenfold.runtime import table


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


def _parts(pattern: str, fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"CASE WHEN regexp_matches(name, '{pattern}') THEN regexp_extract(name, '{pattern}', {i + 1})::{kind} END AS {f}" for i, (f, kind) in enumerate(fields))


@query(f"""WITH n AS (SELECT doc_id, (n_chars % 5 + 1) || '-' || doc_id || '-' || CASE WHEN lang = 'en' THEN 'A' WHEN lang = 'de' THEN 'B' ELSE 'x' END || '-' || (n_chars % 50) || '.wav' AS name FROM documents)
SELECT doc_id, {_parts(r'^(\d)-(\d+)-([A-Z])-(\d+)\.wav$', [("fold", "BIGINT"), ("clip", "BIGINT"), ("take", "VARCHAR"), ("target", "BIGINT")])} FROM n""")
def clip_names(spark, sf_dir):
    take = F.when(F.col("lang") == "en", "A").when(F.col("lang") == "de", "B").otherwise("x")
    name = F.concat(F.col("n_chars") % 5 + 1, F.lit("-"), "doc_id", F.lit("-"), take, F.lit("-"), F.col("n_chars") % 50, F.lit(".wav"))
    return _documents(spark, sf_dir).select("doc_id", S.named_parts(name, *S.CLIP).alias("p")).select("doc_id", "p.*")


@query(f"""WITH n AS (SELECT doc_id, lang || CASE WHEN n_chars % 4 = 0 THEN '-' ELSE '_' END || n_chars || '_e' || doc_id AS name FROM documents)
SELECT doc_id, {_parts(r'^([A-Za-z0-9]+)_(\d+)_e(\d+)$', [("subtype", "VARCHAR"), ("speed", "BIGINT"), ("event_index", "BIGINT")])} FROM n""")
def flight_names(spark, sf_dir):
    name = F.concat("lang", F.when(F.col("n_chars") % 4 == 0, "-").otherwise("_"), "n_chars", F.lit("_e"), "doc_id")
    return _documents(spark, sf_dir).select("doc_id", S.named_parts(name, *S.FLIGHT).alias("p")).select("doc_id", "p.*")


@query(f"""WITH n AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'data/hex_hover_' || doc_id || '.mat' WHEN 'de' THEN 'data/cub_flyover_' || doc_id || '.mat' ELSE 'data/notes_' || doc_id || '.txt' END AS name FROM documents),
p AS (SELECT doc_id, {_parts(r'^data/([a-z0-9]+)_(flyover|hover)_([0-9]+)\.mat$', [("vehicle", "VARCHAR"), ("manoeuvre", "VARCHAR"), ("flight", "BIGINT")])} FROM n)
SELECT *, CASE vehicle WHEN 'hex' THEN 1 WHEN 'cub' THEN 0 END AS label, CASE vehicle WHEN 'hex' THEN 'bay' END AS acquisition_group FROM p""")
def flight_members(spark, sf_dir):
    name = F.when(F.col("lang") == "en", F.concat(F.lit("data/hex_hover_"), "doc_id", F.lit(".mat"))).when(F.col("lang") == "de", F.concat(F.lit("data/cub_flyover_"), "doc_id", F.lit(".mat"))).otherwise(F.concat(F.lit("data/notes_"), "doc_id", F.lit(".txt")))
    named = _documents(spark, sf_dir).select("doc_id", name.alias("name"))
    return named.select("doc_id", S.labelled_flight(F.col("name"), {"hex": 1, "cub": 0}, {"hex": "bay"}).alias("p")).select("doc_id", "p.*")


@query("""WITH n AS (SELECT doc_id, lang || '-' || CASE WHEN n_chars % 3 = 0 THEN '' ELSE doc_id::VARCHAR END || CASE WHEN n_chars % 2 = 0 THEN '.wav' ELSE '.WAV' END AS name FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(name, '(?i)^(.*?)(\\d+)\\.wav$') THEN regexp_extract(name, '(?i)^(.*?)(\\d+)\\.wav$', 1) END AS prefix, CASE WHEN regexp_matches(name, '(?i)^(.*?)(\\d+)\\.wav$') THEN regexp_extract(name, '(?i)^(.*?)(\\d+)\\.wav$', 2)::BIGINT END AS number FROM n""")
def numbered_names(spark, sf_dir):
    number = F.when(F.col("n_chars") % 3 == 0, "").otherwise(F.col("doc_id").cast("string"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("-"), number, F.when(F.col("n_chars") % 2 == 0, ".wav").otherwise(".WAV"))
    return _documents(spark, sf_dir).select("doc_id", W.numbered(path).alias("p")).select("doc_id", "p.*")


@query("""WITH n AS (SELECT doc_id, source || '_paperdist_' || n_chars || CASE WHEN n_chars % 3 = 0 THEN '_T07_a' ELSE '_b' END AS stem, lower(text) AS t FROM documents)
SELECT doc_id, split_part(stem, '_paperdist_', 1) AS source_group, CASE WHEN regexp_matches(stem, '_(T\\d{2})_') THEN regexp_extract(stem, '_(T\\d{2})_', 1) ELSE 'unknown' END AS condition,
CASE WHEN contains(t, 'there') THEN 'there' WHEN contains(t, 'un') THEN 'un' ELSE 'other' END AS word FROM n""")
def recording_names(spark, sf_dir):
    path = F.concat(F.lit("in/"), "source", F.lit("_paperdist_"), "n_chars", F.when(F.col("n_chars") % 3 == 0, "_T07_a").otherwise("_b"), F.lit(".wav"))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", S.group_and_condition(path).alias("g"), S.keyword(F.col("text"), ["there", "un"]).alias("word")).select("doc_id", "g.*", "word")


@query(f"""WITH n AS (SELECT doc_id, 'x4_D' || doc_id || '_' || source || CASE WHEN n_chars % 5 = 0 THEN '.tar' ELSE '.ZIP' END AS name FROM documents),
a AS (SELECT doc_id, {_parts(r'(?i)^(X[46])_(D\d+)_(.+)\.zip$', [("rotor", "VARCHAR"), ("drone", "VARCHAR"), ("vehicle", "VARCHAR")])} FROM n),
m AS (SELECT doc_id, 'a_' || (n_chars % 90) || 'm_' || (n_chars % 70) || 'm_240131__' || doc_id || CASE WHEN n_chars % 2 = 0 THEN '_b' ELSE '' END || '.wav' AS name FROM documents),
b AS (SELECT doc_id, {_parts(r'(?i)_(\d+)m_(\d+)m_(\d{6})_+(\d+)(?:_[^.]+)?\.wav$', [("height", "BIGINT"), ("distance", "BIGINT"), ("date", "VARCHAR"), ("measurement", "BIGINT")])} FROM m)
SELECT * FROM a JOIN b USING (doc_id)""")
def archive_names(spark, sf_dir):
    archive = F.concat(F.lit("x4_D"), "doc_id", F.lit("_"), "source", F.when(F.col("n_chars") % 5 == 0, ".tar").otherwise(".ZIP"))
    member = F.concat(F.lit("a_"), F.col("n_chars") % 90, F.lit("m_"), F.col("n_chars") % 70, F.lit("m_240131__"), "doc_id", F.when(F.col("n_chars") % 2 == 0, "_b").otherwise(""), F.lit(".wav"))
    return _documents(spark, sf_dir).select("doc_id", S.named_parts(archive, *S.ARCHIVE).alias("a"), S.named_parts(member, *S.MEMBER).alias("m")).select("doc_id", "a.*", "m.*")


@query("""SELECT page_id, split_part(url, '-', 2) AS second, length(url) - length(replace(url, '-', '')) AS dashes,
CASE WHEN contains(upper(url), 'PAGE=') THEN 'PAGED' WHEN contains(upper(url), 'EXAMPLE.COM') THEN 'COM' ELSE 'unknown' END AS device FROM pages WHERE contains(url, '-') UNION ALL
SELECT page_id, NULL, 0, CASE WHEN contains(upper(url), 'PAGE=') THEN 'PAGED' WHEN contains(upper(url), 'EXAMPLE.COM') THEN 'COM' ELSE 'unknown' END FROM pages WHERE NOT contains(url, '-')""")
def fields_and_devices(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    dashes = F.length("url") - F.length(F.replace("url", F.lit("-"), F.lit("")))
    return p.select("page_id", S.dash_field(F.col("url"), 1).alias("second"), dashes.cast("long").alias("dashes"), S.device(F.col("url"), {"page=": "PAGED", "example.com": "COM"}).alias("device"))


@query("""SELECT doc_id, 'snr_' || CASE WHEN n_chars % 41 >= 20 THEN '+' ELSE '-' END || abs(n_chars % 41 - 20) || '_db' AS snr, source || '|' || lang || '|' || doc_id AS event, 'runs/' || source || '/seed_' || (doc_id % 3) || '/' || source || '.json' AS path FROM documents""")
def labels_and_templates(spark, sf_dir):
    path = S.filled("runs/{source}/seed_{seed}/{source}.json", source=F.col("source"), seed=F.col("doc_id") % 3)
    return _documents(spark, sf_dir).select("doc_id", S.snr_label(F.col("n_chars") % 41 - 20).alias("snr"), F.concat_ws("|", "source", "lang", "doc_id").alias("event"), path.alias("path"))


@query(r"""WITH b AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS basename FROM pages) SELECT page_id, basename, regexp_replace(basename, '(.)\.[^.]*$', '\1') AS stem FROM b""")
def path_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.basename(F.col("url")).alias("basename"), S.stem(F.col("url")).alias("stem"))


@query("""SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha256('7:' || source || ':' || doc_id) AS seeded, sha256('["' || source || '","' || lang || '"]') AS listed, regexp_replace(lower(source || '-' || lang), '[^a-z0-9]', '', 'g') AS compact FROM documents""")
def text_digests(spark, sf_dir):
    from lumenfold.operators.firewall import compacted

    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), I.seeded_rank(7, F.col("source"), F.col("doc_id")).alias("seeded"), I.digest_of(F.col("source"), F.col("lang")).alias("listed"), compacted(F.concat("source", F.lit("-"), "lang")).alias("compact"))


@query(f"""WITH {SCORED}, z AS (SELECT doc_id, score, (score - 0.5) * 900 AS z FROM scored), c AS (SELECT *, least(greatest(score, 1e-8), 1 - 1e-8) AS p FROM z)
SELECT doc_id, round(CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END, 6) AS steep, round(1 / (1 + exp(-(z / 200) / 1.5)), 6) AS scaled, round(ln(p / (1 - p)), 6) AS logit FROM c""")
def logistic_curves(spark, sf_dir):
    z = (F.col("score") - 0.5) * 900
    return rounded(scored(spark, sf_dir).select("doc_id", S.sigmoid(z).alias("steep"), S.sigmoid(z / 200, 1.5).alias("scaled"), S.logit(F.col("score")).alias("logit")))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS peak FROM embeddings)
SELECT vec_id, round(n / 8, 6) AS rms, round(10 * log10(n * n / 64 + 1e-12), 6) AS dbfs, round(peak, 6) AS peak, round(e[3] / peak, 6) AS third_at_peak, round(e[3] / n, 6) AS third_at_unit, (list_position(e, list_max(e)) - 1)::INTEGER AS argmax,
10 * log10(n * n / 64 + 1e-12) > -18 AS loud, peak <= 1e-8 OR list_stddev_pop(e) < 1e-4 AS degenerate FROM e""")
def array_levels(spark, sf_dir):
    e = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", S.rms(e).alias("rms"), S.rms_dbfs(e).alias("dbfs"), S.peak(e).alias("peak"), S.peak_normalised(e)[2].alias("third_at_peak"), V.unit(e)[2].alias("third_at_unit"), predicted_class(e).alias("argmax"), (S.rms_dbfs(e) > -18).alias("loud"), S.degenerate(e).alias("degenerate"))
    return rounded(rows)


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(list_sum(e[11:20]), 6) AS sliced, round(list_sum(e[28:37]), 6) AS centre, round(e[(99 % 64) + 1], 6) AS last_looped, 100 AS looped, round(list_sum(e), 6) AS padded_sum, 80 AS padded FROM e""")
def array_lengths(spark, sf_dir):
    e, total = F.col("embedding"), lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    looped, padded = S.fitted_length(e, 100), S.padded(e, 80)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", total(S.sliced(e, F.lit(10), F.lit(20))).alias("sliced"), total(S.fitted_length(e, 10)).alias("centre"), F.element_at(looped, -1).cast("double").alias("last_looped"), F.size(looped).alias("looped"), total(padded).alias("padded_sum"), F.size(padded).alias("padded"))
    return rounded(rows)


@query("""SELECT doc_id, round(2595.0 * log10(1 + n_chars / 700.0::DOUBLE), 6) AS mel, round(n_chars, 4)::DOUBLE AS hz, (n_chars * 16000 + 44099) // 44100 AS resampled, round(n_chars / 7.0::DOUBLE, 6) AS guarded FROM documents""")
def frequency_scales(spark, sf_dir):
    n = F.col("n_chars")
    d = _documents(spark, sf_dir)
    return rounded(d.select("doc_id", S.hz_to_mel(n).alias("mel"), F.round(S.mel_to_hz(S.hz_to_mel(n)), 4).alias("hz"), S.ceil_scaled(n, 16000, 44100).alias("resampled"), schema.finite(n / 7.0).alias("guarded")))


@query("""WITH l AS (SELECT vec_id, embedding[1:5]::DOUBLE[] AS l FROM embeddings), s AS (SELECT vec_id, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM l), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM s)
SELECT vec_id, round(p[2], 6) AS second, round(-list_sum(list_transform(p, lambda x: x * ln(x))) / ln(5), 6) AS entropy FROM p""")
def softmax_entropy(spark, sf_dir):
    p = V.softmax(F.slice("embedding", 1, 5))
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p")).select("vec_id", F.col("p")[1].alias("second"), V.normalised_entropy(F.col("p")).alias("entropy")))


def _configs(spark, sf_dir, shift: int):
    n = F.col("n_chars")
    inner = F.struct((n - (n % 2) * shift).alias("size"), F.array(F.col("doc_id") % 3, F.lit(2.5)).alias("steps"))
    return _documents(spark, sf_dir).select("doc_id", F.to_json(F.struct(inner.alias("model"), F.length("lang").alias("lang"), F.lit(True).alias("on"))).alias("j"))


@query("""SELECT doc_id, 'model.size' AS path, n_chars::DOUBLE AS value FROM documents UNION ALL SELECT doc_id, 'model.steps[0]', (doc_id % 3)::DOUBLE FROM documents UNION ALL SELECT doc_id, 'model.steps[1]', 2.5 FROM documents UNION ALL SELECT doc_id, 'lang', length(lang)::DOUBLE FROM documents""")
def json_leaves(spark, sf_dir):
    return R.numeric_leaves(_configs(spark, sf_dir, 0), "j", ["doc_id"])


@query("SELECT doc_id, 'model.size' AS path, n_chars::DOUBLE AS left_value, (n_chars - n_chars % 2)::DOUBLE AS right_value FROM documents WHERE n_chars % 2 = 1")
def json_differences(spark, sf_dir):
    a, b = (R.numeric_leaves(_configs(spark, sf_dir, k), "j", ["doc_id"]) for k in (0, 1))
    return G.differing(a, b, ["doc_id", "path"], "value", 1e-9)


@query("SELECT doc_id, quality = 1 AS strict, toxic = 1 AS truthy, quality::BIGINT AS whole FROM labels")
def strict_values(spark, sf_dir):
    q, t = F.col("quality"), F.col("toxic")
    said = F.when(q == 1, " True ").when(q == 0, "FALSE")
    return table(spark, sf_dir, "labels").select("doc_id", schema.strict_bool(said).alias("strict"), S.truthy(F.when(t == 1, "Yes").otherwise("nope")).alias("truthy"), schema.strict_int(F.concat(q.cast("string"), F.lit(".0"))).alias("whole"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN strftime(o_orderdate, '%Y%m%d') WHEN 'O' THEN strftime(o_orderdate, '%y%m%d') END AS date FROM orders""")
def dates_in_names(spark, sf_dir):
    day = F.col("o_orderdate")
    long, short = F.concat(F.lit("20"), F.date_format(day, "yy.MM_dd")), F.date_format(day, "yyMMdd")
    # years before 2000 are none of the pattern's, so the century is set
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("a_"), long, F.lit(".wav"))).when(F.col("o_orderstatus") == "O", F.concat(F.lit("b-"), short, F.lit("_x"))).otherwise("c-12345678x")
    found = S.date_in(name)
    century = F.when(F.col("o_orderstatus") == "P", F.concat(F.date_format(day, "yyyy"), F.substring(found, 5, 4))).otherwise(found)
    return o.select("o_orderkey", century.alias("date"))


@query("SELECT doc_id, n_chars % 5 + 1 AS fold, CASE WHEN n_chars % 5 + 1 = 5 THEN 'guard' ELSE 'train' END AS role, upper(regexp_replace(source || '-' || lang, '[^0-9A-Za-z]', '', 'g')) AS category, CASE WHEN n_chars < 100 THEN 'short' WHEN n_chars < 1000 THEN 'medium' ELSE 'long' END AS bucket FROM documents")
def derived_columns(spark, sf_dir):
    n = F.col("n_chars")
    fold = n % 5 + 1
    return _documents(spark, sf_dir).select("doc_id", fold.alias("fold"), F.when(fold == 5, "guard").otherwise("train").alias("role"), S.category(F.concat("source", F.lit("-"), "lang")).alias("category"), F.when(n < 100, "short").when(n < 1000, "medium").otherwise("long").alias("bucket"))


@query(f"""WITH {REGISTRY}, f AS (SELECT CASE WHEN content_hash < '5' THEN 'low' WHEN content_hash < 'a' THEN 'middle' ELSE 'high' END AS role, content_hash AS v FROM registry UNION ALL SELECT 'forbidden', sha256(text || '#') FROM benchmark), s AS (SELECT DISTINCT role, v FROM f),
p AS (SELECT * FROM (VALUES ('low', 'middle'), ('low', 'high'), ('low', 'forbidden'), ('middle', 'high'), ('middle', 'forbidden'), ('high', 'forbidden')) t(a, b))
SELECT a AS left_split, b AS right_split, (SELECT count(*) FROM s x JOIN s y ON x.v = y.v WHERE x.role = a AND y.role = b) AS overlap FROM p""")
def disjoint_frames(spark, sf_dir):
    r, h = registry(spark, sf_dir), F.col("content_hash")
    frames = {"low": r.where(h < "5"), "middle": r.where((h >= "5") & (h < "a")), "high": r.where(h >= "a")}
    forbidden = table(spark, sf_dir, "benchmark").select(F.sha2(F.concat("text", F.lit("#")), 256).alias("content_hash"))
    return A.assert_disjoint({k: f.select("content_hash") for k, f in frames.items()}, "content_hash", forbidden)
