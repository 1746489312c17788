"""Queries of signal functions and random-hyperplane retrieval over the vectors, with the formulas in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import signals as G
from lumenfold.operators import audits as A
from lumenfold.operators import segments as W
from lumenfold.operators import vectors as V
from lumenfold.plans.fixtures import query, rounded
from lumenfold.runtime import table

_SPECTRUM = """
x AS (SELECT vec_id, unnest(range(0, 64)) AS n, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT vec_id, n, (x - avg(x) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * n / 63)) AS x FROM x),
k AS (SELECT unnest(range(0, 33)) AS k),
p AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * n / 64)) ** 2 + sum(x * sin(2 * pi() * k * n / 64)) ** 2 AS p FROM c, k GROUP BY vec_id, k)"""


@query(f"""WITH {_SPECTRUM}, s AS (SELECT vec_id, sum(p) FILTER (WHERE k * 750 <= 20000) AS total, sum(p) FILTER (WHERE k * 750 < 8000) AS a, coalesce(sum(p) FILTER (WHERE k * 750 >= 8000 AND k * 750 < 12000), 0) AS b, coalesce(sum(p) FILTER (WHERE k * 750 >= 12000 AND k * 750 < 20000), 0) AS c FROM p GROUP BY vec_id)
SELECT vec_id, round(a / total, 6) AS low, round(b / total, 6) AS middle, round(c / total, 6) AS high, round((b + c) / total, 6) AS above, round(10 * log10(greatest((b + c) / total, 1e-15)), 5) AS above_db FROM s""")
def band_shares(spark, sf_dir):
    """Shares of the spectral energy by band, of vectors taken as signals at 48 kHz."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", G.band_energy(48000, (0, 8000, 12000, 20000))("embedding").alias("b"))
    rows = e.select("vec_id", F.col("b.shares")[0].alias("low"), F.col("b.shares")[1].alias("middle"), F.col("b.shares")[2].alias("high"), F.col("b.above").alias("above"), F.round("b.above_db", 5).alias("above_db"))
    return rounded(rows)


@query("""WITH x AS (SELECT vec_id, unnest(range(0, 8)) AS n, unnest(embedding[1:8])::DOUBLE AS x FROM embeddings), k AS (SELECT unnest(range(0, 4)) AS k)
SELECT vec_id, k::INTEGER AS k, round(sum(x * cos(pi() * k * (2 * n + 1) / 16)) * sqrt(2 / 8.0::DOUBLE) * CASE k WHEN 0 THEN sqrt(0.5) ELSE 1 END, 6) AS value FROM x, k GROUP BY vec_id, k""")
def cosine_transform(spark, sf_dir):
    """The first four coefficients of an orthonormal cosine transform of eight numbers."""
    rows = [V.dot(F.array(*[F.lit(float(v)) for v in row]), F.slice("embedding", 1, 8)) for row in G.dct_matrix(4, 8)]
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.array(*rows)).alias("k", "value"))
    return rounded(e)


@query("""WITH m AS (SELECT i, 2595 * log10(1 + 8000 / 700.0::DOUBLE) * i / 21.0::DOUBLE AS mel FROM range(0, 22) t(i)), b AS (SELECT i, floor(513 * (700 * (pow(10, mel / 2595) - 1)) / 16000)::BIGINT AS b FROM m),
f AS (SELECT l.i AS mel, l.b AS l, c.b AS c, r.b AS r FROM b l JOIN b c ON c.i = l.i + 1 JOIN b r ON r.i = l.i + 2 WHERE l.i < 20),
w AS (SELECT mel, k, CASE WHEN k >= l AND k < c THEN (k - l)::DOUBLE / greatest(c - l - 1, 1) WHEN k >= c AND k < r THEN 1 - (k - c)::DOUBLE / greatest(r - c - 1, 1) ELSE 0 END AS w FROM f, range(0, 257) t(k))
SELECT mel::INTEGER AS mel, k::INTEGER AS bin, round(w, 6) AS weight FROM w WHERE w > 0""")
def mel_triangles(spark, sf_dir):
    """The weights of a mel filter bank, those above 0."""
    filters = G.mel_filters(16000, 512, 20)
    rows = [(int(m), int(k), float(filters[m, k])) for m, k in zip(*filters.nonzero(), strict=True)]
    return rounded(spark.createDataFrame(rows, "mel int, bin int, weight double"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS b, list_reverse(embedding::DOUBLE[]) AS t FROM embeddings), l AS (SELECT *, sqrt(list_dot_product(b, b) / 64) + 1e-12 AS lb, sqrt(list_dot_product(t, t) / 64) + 1e-12 AS lt FROM e),
g AS (SELECT *, unnest([-5.0, 0.0, 10.0])::DOUBLE AS snr_db FROM l), m AS (SELECT *, list_transform(list_zip(b, t), lambda z: z[1] + z[2] * (lb / lt * pow(10, snr_db / 20))) AS raw FROM g),
s AS (SELECT *, lb / (sqrt(list_dot_product(raw, raw) / 64) + 1e-12) AS match FROM m), p AS (SELECT *, greatest(list_max(list_transform(raw, lambda z: abs(z))) * match, list_max(list_transform(b, lambda z: abs(z)))) AS peak FROM s),
h AS (SELECT *, least(1.0, 0.99 / max(peak * 4) OVER (PARTITION BY vec_id)) AS gain FROM p)
SELECT vec_id, snr_db, round(raw[1] * match * gain * 4, 6) AS first_mixed, round(b[1] * gain * 4, 6) AS first_background, round(gain, 6) AS gain FROM h""")
def snr_grid(spark, sf_dir):
    """Pairs of a vector and its reverse, four times as loud, at three SNRs under one gain."""
    loud = lambda a: F.transform(a, lambda x: x.cast("double") * 4)
    e = table(spark, sf_dir, "embeddings")
    rows = e.select("vec_id", F.explode(G.mix_grid([-5, 0, 10])(loud("embedding"), loud(F.reverse("embedding")))).alias("g"))
    return rounded(rows.select("vec_id", "g.snr_db", F.col("g.mixed")[0].alias("first_mixed"), F.col("g.background")[0].alias("first_background"), "g.gain"))


_TABLES, _BITS, _SEED = 6, 8, 20260804


def _planes() -> str:
    rows = [f"({t}, {b}, [{', '.join(repr(float(x)) for x in plane)}])" for t, table_ in enumerate(V.planes(_TABLES, _BITS, 64, _SEED)) for b, plane in enumerate(table_)]
    return f"planes AS (SELECT * FROM (VALUES {', '.join(rows)}) x(t, b, plane))"


_SIGNED = f"""{_planes()}, u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
signed AS (SELECT vec_id, t AS "table", sum(CASE WHEN list_dot_product(e, plane) >= 0 THEN 1 << b ELSE 0 END)::BIGINT AS signature FROM u, planes GROUP BY vec_id, t)"""


@query(f'WITH {_SIGNED} SELECT vec_id, "table"::INTEGER AS "table", signature FROM signed')
def lsh_signature_bits(spark, sf_dir):
    """Signatures of all vectors under random hyperplanes."""
    e = table(spark, sf_dir, "embeddings")
    return V.lsh_signatures(e, "vec_id", "embedding", 64, _TABLES, _BITS, _SEED).select("vec_id", "table", "signature")


_NEAREST = """
met AS (SELECT q.vec_id, r.vec_id AS neighbour FROM signed q JOIN signed r ON q."table" = r."table" AND q.signature = r.signature AND {pair}),
sims AS (SELECT met.vec_id, neighbour, count(*) AS n, any_value(list_cosine_similarity(a.e, b.e)) AS s FROM met JOIN u a ON a.vec_id = met.vec_id JOIN u b ON b.vec_id = neighbour GROUP BY met.vec_id, neighbour),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, neighbour) AS place, sum(n) OVER (PARTITION BY vec_id) AS comparisons FROM sims),
top AS (SELECT vec_id, neighbour, s, comparisons FROM best WHERE place = 1)"""


@query(f"""WITH {_SIGNED}, {_NEAREST.format(pair="q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id")}
SELECT u.vec_id, neighbour, round(s, 6) AS similarity, coalesce(comparisons, 0)::BIGINT AS comparisons FROM u LEFT JOIN top ON u.vec_id = top.vec_id WHERE u.vec_id % 50 = 0""")
def lsh_nearest(spark, sf_dir):
    """Approximate neighbours by random hyperplanes among all vectors."""
    e = table(spark, sf_dir, "embeddings")
    return rounded(V.lsh_nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 64, _TABLES, _BITS, _SEED))


_SHARES = {"q0": 0.0, "q50": 0.5, "q90": 0.9, "q95": 0.95, "q99": 0.99, "q100": 1.0}
_QUANTILES = ", ".join(f"round(quantile_cont({{v}}, {s}), 6) AS {n}" for n, s in _SHARES.items())


@query(f"""WITH {_SIGNED}, roles AS (SELECT vec_id, label, CASE vec_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM u),
asked AS (SELECT * FROM signed WHERE vec_id % 4 < 2), {_NEAREST.format(pair="q.vec_id % 4 < 2 AND r.vec_id % 4 >= 2")},
f AS (SELECT a.split, top.s, a.label = b.label AS same, coalesce(top.comparisons, 0) AS comparisons FROM roles a LEFT JOIN top ON a.vec_id = top.vec_id LEFT JOIN roles b ON b.vec_id = top.neighbour WHERE a.split <> 'train')
SELECT split, count(*) AS rows, count(s) AS found, {_QUANTILES.format(v='s')}, count(*) FILTER (WHERE s >= 0.25) AS over_low, count(*) FILTER (WHERE s >= 0.5) AS over_high, sum(comparisons)::BIGINT AS comparisons, count(*) FILTER (WHERE s >= 0.5 AND same) AS same_label FROM f GROUP BY split""")
def near_duplicate_audit(spark, sf_dir):
    """The best training neighbour of every test and validation vector: quantiles, counts and shared labels."""
    part = F.col("vec_id") % 4
    e = table(spark, sf_dir, "embeddings").withColumn("split", F.when(part == 0, "test").when(part == 1, "val").otherwise("train"))
    found = A.near_duplicate_audit(e, "vec_id", "embedding", "split", 64, ["test", "val"], [0.25, 0.5], label="label", tables=_TABLES, bits=_BITS, seed=_SEED)
    return rounded(found.select("split", "rows", "found", *_SHARES, F.col("at_or_above")[0]["rows"].alias("over_low"), F.col("at_or_above")[1]["rows"].alias("over_high"), "comparisons", "same_label"))


_ADJACENT = """n AS (SELECT source, doc_id // 20 AS seq, doc_id, CASE WHEN n_chars % 10 < 7 THEN 'train' ELSE 'test' END AS split, lead(doc_id // 20) OVER w AS next_seq, lead(CASE WHEN n_chars % 10 < 7 THEN 'train' ELSE 'test' END) OVER w AS next_split FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id // 20, doc_id)),
pairs AS (SELECT split, next_split, ((doc_id * 37) % 101) / 100.0::DOUBLE AS v FROM n WHERE next_seq - seq = 1),
roles AS (SELECT 'all' AS role, v FROM pairs UNION ALL SELECT CASE WHEN split = next_split THEN 'within_split' ELSE 'cross_split' END, v FROM pairs UNION ALL SELECT least(split, next_split) || '__' || greatest(split, next_split), v FROM pairs)"""


@query(f"WITH {_ADJACENT} SELECT role, count(*) AS rows, count(v) AS found, {_QUANTILES.format(v='v')}, count(*) FILTER (WHERE v >= 0.9) AS over FROM roles GROUP BY role")
def adjacency_roles(spark, sf_dir):
    """Similarity of consecutive recordings by the splits they lie in."""
    d = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 20).alias("seq"), "doc_id", F.when(F.col("n_chars") % 10 < 7, "train").otherwise("test").alias("split"))
    pairs = W.adjacent_pairs(d, ["source"], "seq", ["doc_id", "split"]).withColumn("v", ((F.col("doc_id") * 37) % 101) / 100.0)
    rows = A.adjacency_audit(pairs, "split", "v", [0.9])
    return rounded(rows.select("role", "rows", "found", *_SHARES, F.col("at_or_above")[0]["rows"].alias("over")))


@query()
def class_knn_projected(spark, sf_dir):
    """The mean cosine to the nearest of the own class in a centred space of principal axes."""
    e = table(spark, sf_dir, "embeddings")
    e = e.select("vec_id", "label", V.projected(V.fit_projection(e, "embedding", 12))("embedding").alias("z"))
    return rounded(V.class_knn(e.where("vec_id % 50 = 0"), e, "vec_id", "label", "label", "z", 5))


@query("""WITH p AS (SELECT DISTINCT 60 + n_chars % 300 AS pitch FROM documents WHERE n_chars IS NOT NULL),
t AS (SELECT pitch, list_transform(range(0, 2000), lambda i: sin(i * pitch * (2 * pi() / 2000)) + 0.5::DOUBLE * sin(i * pitch * (4 * pi() / 2000))) AS x FROM p),
m AS (SELECT pitch, x, list_avg(x) AS m FROM t),
x AS (SELECT pitch, list_transform(x, lambda v: v - m) AS x FROM m),
parts AS (SELECT part, CASE part WHEN 0 THEN 2000 ELSE 500 END AS n, CASE part WHEN 0 THEN 2048 ELSE 512 END AS fft, CASE part WHEN 0 THEN 41 ELSE 10 END AS low, CASE part WHEN 0 THEN 12 ELSE 8 END AS harmonics FROM range(0, 5) t(part)),
cut AS (SELECT pitch, part, n, fft, list_transform(x[greatest(part - 1, 0) * n + 1 : greatest(part - 1, 0) * n + n], lambda v, i: v * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / (n - 1)))) AS x FROM x, parts),
waves AS (SELECT n, fft, k, list_transform(range(0, n), lambda i: cos(2 * pi() * (i * k % fft) / fft)) AS re, list_transform(range(0, n), lambda i: sin(2 * pi() * (i * k % fft) / fft)) AS im FROM (SELECT DISTINCT n, fft FROM parts), range(0, 1025) t(k) WHERE 2 * k <= fft),
s AS (SELECT pitch, part, k, list_dot_product(x, re) ** 2 + list_dot_product(x, im) ** 2 + 1e-12 AS p FROM cut JOIN waves USING (n, fft)),
r AS (SELECT pitch, part, k, log10(p) - sum(log10(p)) OVER (PARTITION BY pitch, part ORDER BY k ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) / 41 AS r FROM s WHERE part = 0
  UNION ALL SELECT pitch, part, k, log10(p) - sum(log10(p)) OVER (PARTITION BY pitch, part ORDER BY k ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) / 21 FROM s WHERE part > 0),
combs AS (SELECT part, low + c AS c, h, (low + c) * h AS k FROM parts, range(0, 472) t(c), range(1, 13) u(h) WHERE h <= harmonics AND (low + c) * 4 <= fft AND (low + c) * h * 2 <= fft),
scores AS (SELECT pitch, part, c, sum(r / sqrt(h)) / sum(1 / sqrt(h)) AS score FROM combs JOIN r USING (part, k) GROUP BY pitch, part, c),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY pitch, part ORDER BY score DESC, c) = 1),
scale AS (SELECT pitch, greatest(stddev_pop(r), 1e-12) AS scale FROM r WHERE part = 0 AND k BETWEEN 20 AND 1023 GROUP BY pitch),
heard AS (SELECT pitch, k, k * 2000 / 2048 AS f, p, sum(p) OVER (PARTITION BY pitch) AS total, sum(p) OVER (PARTITION BY pitch ORDER BY k) AS below FROM s WHERE part = 0 AND k >= 21),
centre AS (SELECT pitch, sum(f * p / total) AS centre FROM heard GROUP BY pitch),
overall AS (SELECT pitch, [log10(any_value(list_dot_product(x.x, x.x)) / 2000 + 1e-12), any_value(centre) / 1000, sqrt(sum((f - centre) ** 2 * p / total)) / 1000, exp(avg(ln(p))) / greatest(avg(p), 1e-12), -sum(p / total * ln(p / total + 1e-12)) / ln(count(*)),
  min(f) FILTER (WHERE below >= 0.5 * total) / 1000, min(f) FILTER (WHERE below >= 0.85 * total) / 1000, min(f) FILTER (WHERE below >= 0.95 * total) / 1000] AS v FROM heard JOIN centre USING (pitch) JOIN x USING (pitch) GROUP BY pitch),
edges AS (SELECT b, 20 * 50 ** (b / 32) AS low, 20 * 50 ** ((b + 1) / 32) AS high FROM range(0, 32) t(b)),
bands AS (SELECT pitch, b, log10(avg(p) + 1e-12) AS v FROM edges JOIN heard ON f >= low AND f < high AND k < 1024 GROUP BY pitch, b),
levels AS (SELECT pitch, list_transform(list(v ORDER BY b), lambda y: y - m) AS v FROM (SELECT *, avg(v) OVER (PARTITION BY pitch) AS m FROM bands) GROUP BY pitch, m),
teeth AS (SELECT pitch, part, c, score, h, c * h AS k FROM best, range(1, 13) t(h) WHERE part = 0),
profile AS (SELECT pitch, c, score, scale, h, coalesce(r, 0) / scale AS v FROM teeth JOIN scale USING (pitch) LEFT JOIN r USING (pitch, part, k)),
comb AS (SELECT pitch, [c * 2000 / 2048 / 500, score / scale, avg((v > 1)::INTEGER), avg(v), stddev_pop(v)] || list(v ORDER BY h) AS v FROM profile GROUP BY pitch, c, score, scale),
steady AS (SELECT pitch, [avg(c * 2000 / 512 / 500), stddev_pop(c * 2000 / 512 / 500), avg(score / scale), stddev_pop(score / scale)] AS v FROM best JOIN scale USING (pitch) WHERE part > 0 GROUP BY pitch),
f AS (SELECT pitch, list_transform(o.v || l.v || c.v || s.v, lambda y: round(y::FLOAT::DOUBLE, 4) + 0) AS h FROM overall o JOIN levels l USING (pitch) JOIN comb c USING (pitch) JOIN steady s USING (pitch))
SELECT doc_id, h FROM documents LEFT JOIN f ON pitch = 60 + n_chars % 300""")
def harmonic_features(spark, sf_dir):
    """The 61 harmonic features of a tone per document, its pitch by the length of the text; null without a length."""
    t = F.sequence(F.lit(0), F.lit(1999))
    pitch = 60 + F.col("n_chars") % 300
    tone = F.transform(t, lambda i: F.sin(i * pitch * (6.283185307179586 / 2000)) + 0.5 * F.sin(i * pitch * (2 * 6.283185307179586 / 2000)))
    tone = F.when(F.col("n_chars").isNotNull(), tone)
    d = table(spark, sf_dir, "documents").select("doc_id", G.harmonic_features(2000, 2048)(tone).alias("h"))
    return rounded(d.select("doc_id", F.transform("h", lambda x: F.round(x.cast("double"), 4)).alias("h")), 4)
