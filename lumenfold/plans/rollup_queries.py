"""Queries of roll-ups, windows and picks by place."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import rollup as R
from lumenfold.operators import segments as G
from lumenfold.plans.fixtures import REGISTRY, SCORED, SEGMENTS, query, registry, rounded, scored, segments
from lumenfold.runtime import table


def _pool(method: str, value: str):
    sql = f"WITH {SEGMENTS} SELECT conv_id, count(*) AS windows, round({value}, 6) AS score FROM seg GROUP BY conv_id"

    def run(spark, sf_dir):
        return rounded(R.recordings(segments(spark, sf_dir), ["conv_id"], "score", method, "turn"))

    return run, sql


for _name, _method, _value in (
    ("recording_mean", "mean_probability", "avg(score)"),
    ("recording_max", "max_probability", "max(score)"),
    ("recording_logit_mean", "mean_logit_then_sigmoid", "1 / (1 + exp(-avg(ln(least(greatest(score, 1e-8), 1 - 1e-8) / (1 - least(greatest(score, 1e-8), 1 - 1e-8))))))"),
    ("recording_topk_mean", "topk_mean_probability", "list_avg(list_slice(list_sort(list(score), 'DESC'), 1, greatest(1, ceil(count(*) * 0.5))::BIGINT))"),
):
    _run, _sql = _pool(_method, _value)
    _run.__name__ = _name
    query(_sql)(_run)


@query(f"""WITH {SEGMENTS}, n AS (SELECT conv_id, count(*) AS windows FROM seg GROUP BY conv_id),
a AS (SELECT s.conv_id, windows, score, CASE WHEN windows > 1 THEN (ln(0.6 / 0.4) + ln(windows - 1)) ELSE 0 END AS alpha FROM seg s JOIN n ON s.conv_id = n.conv_id),
w AS (SELECT *, exp(alpha * score - max(alpha * score) OVER (PARTITION BY conv_id)) AS w FROM a)
SELECT conv_id, any_value(windows) AS windows, round(sum(w * score) / sum(w), 6) AS score FROM w GROUP BY conv_id""")
def recording_autopool(spark, sf_dir):
    return rounded(R.recordings(segments(spark, sf_dir), ["conv_id"], "score", "constrained_autopool_probability", "turn", cap=0.6))


@query(f"""WITH {SEGMENTS}, d AS (SELECT conv_id, turn // 2 AS decision, count(*) AS windows, avg(score) AS score FROM seg GROUP BY conv_id, turn // 2)
SELECT conv_id, decision::INTEGER AS decision, windows, round(score, 6) AS score FROM d WHERE windows = 2""")
def nonoverlap_pair_mean(spark, sf_dir):
    return rounded(R.nonoverlap_means(segments(spark, sf_dir), ["conv_id"], "turn", "score", 2))


@query(f"""WITH {SEGMENTS}, d AS (SELECT conv_id, turn // 3 AS decision, count(*) AS windows, avg(score) AS score FROM seg GROUP BY conv_id, turn // 3)
SELECT conv_id, decision::INTEGER AS decision, windows, round(score, 6) AS score FROM d""")
def nonoverlap_keep_tail(spark, sf_dir):
    return rounded(R.nonoverlap_means(segments(spark, sf_dir), ["conv_id"], "turn", "score", 3, keep_tail=True))


@query(f"WITH {SEGMENTS} SELECT conv_id, count(*) % 2 AS dropped FROM seg GROUP BY conv_id HAVING count(*) % 2 > 0")
def dropped_windows(spark, sf_dir):
    return R.dropped_windows(segments(spark, sf_dir), ["conv_id"], 2)


@query(f"""WITH {SEGMENTS}, r AS (SELECT session, conv_id, avg(score) AS r FROM seg GROUP BY session, conv_id)
SELECT session, count(*) AS recordings, round(avg(r), 6) AS mean, round(avg((r >= 0.5)::INTEGER), 6) AS recall FROM r GROUP BY session""")
def three_level_rollup(spark, sf_dir):
    return rounded(R.three_levels(segments(spark, sf_dir), ["turn"], ["conv_id"], ["session"], "score", 0.5))


@query(f"""WITH {SEGMENTS}, f AS (SELECT role, session, avg((score >= 0.8)::INTEGER) AS f FROM seg GROUP BY role, session)
SELECT role, count(*) AS sessions, round(avg(f), 6) AS mean_fpr, round(max(f), 6) AS worst_fpr, round(min(f), 6) AS best_fpr FROM f GROUP BY role""")
def session_macro(spark, sf_dir):
    return rounded(R.session_macro(segments(spark, sf_dir), "session", "score", 0.8, ["role"]))


@query(f"""WITH {SEGMENTS}, l AS (SELECT 'segment' AS level, score AS s FROM seg UNION ALL SELECT 'recording', max(score) FROM seg GROUP BY conv_id UNION ALL SELECT 'source', avg(score) FROM seg GROUP BY session)
SELECT level, count(*) AS units, count(*) FILTER (WHERE s >= 0.5) AS hits, round(count(*) FILTER (WHERE s >= 0.5)::DOUBLE / count(*), 6) AS rate FROM l GROUP BY level""")
def level_rates(spark, sf_dir):
    return rounded(R.level_rates(segments(spark, sf_dir), "score", 0.5, {"segment": ([], "max"), "recording": (["conv_id"], "max"), "source": (["session"], "mean")}))


@query(f"WITH {SEGMENTS} SELECT conv_id, max(score) >= 0.7 AS any_hit, avg(score) >= 0.7 AS mean_hit, min(score) >= 0.7 AS all_hit FROM seg GROUP BY conv_id")
def any_mean_both(spark, sf_dir):
    return R.any_mean_both(segments(spark, sf_dir), ["conv_id"], "score", 0.7)


@query(f"""WITH {SCORED} SELECT source, lang, count(*) AS rows, round(avg(((score >= 0.5)::INTEGER = label)::INTEGER), 6) AS accuracy FROM scored GROUP BY GROUPING SETS ((source), (lang))""")
def subgroup_grouping_sets(spark, sf_dir):
    right = ((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("double")
    df = scored(spark, sf_dir).withColumn("right", right)
    return rounded(df.groupingSets([["source"], ["lang"]], "source", "lang").agg(F.count("*").alias("rows"), F.avg("right").alias("accuracy")))


@query(f"""WITH {REGISTRY}, d AS (SELECT * FROM (VALUES ('train'), ('val'), ('test'), ('spare'), (NULL)) a(split), (VALUES (0), (1), (NULL)) b(label))
SELECT d.split, d.label, (SELECT count(*) FROM registry r WHERE (d.split IS NULL OR r.split = d.split) AND (d.label IS NULL OR r.label = d.label)) AS rows FROM d""")
def counts_cube_zero_filled(spark, sf_dir):
    return R.zero_filled_counts(registry(spark, sf_dir), "split", "label", ["train", "val", "test", "spare"], [0, 1])


@query(f"""WITH {REGISTRY}, g AS (SELECT norm_hash, count(*) AS n, count(DISTINCT label) AS k FROM registry GROUP BY norm_hash)
SELECT count(*) AS groups, count(*) FILTER (WHERE k = 1) AS pure_groups, sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (WHERE k = 1), 0)::BIGINT AS rows_in_pure, round(coalesce(sum(n) FILTER (WHERE k = 1), 0)::DOUBLE / sum(n), 6) AS purity FROM g""")
def label_purity(spark, sf_dir):
    return rounded(R.label_purity(registry(spark, sf_dir), "norm_hash", "label"))


@query(f"""WITH {REGISTRY}, v AS (SELECT norm_hash, label, count(*) AS n FROM registry WHERE split = 'train' GROUP BY ALL),
m AS (SELECT norm_hash, arg_min(label, (-n, label)) AS guess FROM v GROUP BY norm_hash),
j AS (SELECT r.label, m.guess FROM registry r LEFT JOIN m ON r.norm_hash = m.norm_hash WHERE r.split = 'test')
SELECT count(*) AS rows, count(guess) AS covered, round(count(guess)::DOUBLE / count(*), 6) AS coverage, round(CASE WHEN count(guess) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE guess = label)::DOUBLE / count(guess) END, 6) AS accuracy FROM j""")
def majority_lookup(spark, sf_dir):
    r = registry(spark, sf_dir)
    return rounded(R.majority_lookup(r.where("split = 'train'").select("norm_hash", "label"), r.where("split = 'test'").select("norm_hash", "label"), "norm_hash", "label"))


@query(f"""WITH {SCORED}, e AS (SELECT source, count(*) AS errors FROM scored WHERE (score >= 0.5) <> (label = 1) GROUP BY source),
r AS (SELECT row_number() OVER (ORDER BY errors DESC, source)::INTEGER AS place, source, errors, errors::DOUBLE / sum(errors) OVER () AS share FROM e)
SELECT place, source, errors, round(share, 6) AS share, round((SELECT sum(share) FROM r WHERE place <= 3), 6) AS top3_share FROM r WHERE place <= 10""")
def error_concentration_topk(spark, sf_dir):
    return rounded(R.error_concentration(scored(spark, sf_dir), (F.col("score") >= 0.5) != (F.col("label") == 1), "source"))


@query(f"""WITH {SCORED}, b AS (SELECT abs(score - 0.5) AS gap, (score >= 0.5) <> (label = 1) AS wrong FROM scored)
SELECT CASE WHEN gap >= 0.2 THEN 4 WHEN gap >= 0.1 THEN 3 WHEN gap >= 0.05 THEN 2 WHEN gap >= 0.02 THEN 1 ELSE 0 END AS bucket, count(*) AS rows, count(*) FILTER (WHERE wrong) AS errors, round(count(*) FILTER (WHERE wrong)::DOUBLE / count(*), 6) AS error_rate FROM b GROUP BY 1""")
def margin_buckets(spark, sf_dir):
    return rounded(R.margin_buckets(scored(spark, sf_dir), "score", 0.5, (F.col("score") >= 0.5) != (F.col("label") == 1)))


@query(f"""WITH {SCORED}, g AS (SELECT source, count(*) AS n, avg(score) AS m, var_pop(score) AS v FROM scored GROUP BY source), t AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m, sum(n * v) AS w, sum(n * m * m) AS s FROM g)
SELECT n::BIGINT AS rows, round((s - n * m * m) / (s - n * m * m + w), 6) AS eta_squared FROM t""")
def eta_squared(spark, sf_dir):
    return rounded(R.explained_share(scored(spark, sf_dir), "score", "source"))


@query(f"WITH {SCORED} SELECT lang, " + ", ".join(f"round(quantile_cont(score, {q}), 6) AS q{round(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99, 1.0)) + " FROM scored GROUP BY lang")
def quantile_block(spark, sf_dir):
    return rounded(R.quantile_block(scored(spark, sf_dir), "score", ["lang"]))


@query("""WITH v AS (SELECT vec_id, label, embedding FROM embeddings), e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM v),
m AS (SELECT label, i, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY label, i)
SELECT label, len(list(m)) * 2 AS dims, round(sum(m), 4) AS mean_sum, round(sum(s), 4) AS spread_sum FROM m GROUP BY label""")
def mean_vectors(spark, sf_dir):
    out = R.mean_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding", spread=True)
    n = F.size("vector") / 2
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return rounded(out.select("label", F.size("vector").cast("long").alias("dims"), add(F.slice("vector", F.lit(1), n.cast("int"))).alias("mean_sum"), add(F.slice("vector", (n + 1).cast("int"), n.cast("int"))).alias("spread_sum")), 4)


@query(f"""WITH {SEGMENTS}, d AS (SELECT conv_id, turn, score, score - lag(score) OVER (PARTITION BY conv_id ORDER BY turn) AS d FROM seg)
SELECT conv_id, count(*) AS conditions, bool_and(coalesce(d >= -1e-6, true)) AS monotone, round(max(score) - min(score), 6) AS spread FROM d GROUP BY conv_id""")
def monotonic_pivot(spark, sf_dir):
    return rounded(R.monotone_by_condition(segments(spark, sf_dir), "conv_id", "turn", "score"))


@query("""WITH s AS (SELECT doc_id, n_chars, unnest(range(0, ceil(n_chars / 1000.0)::BIGINT)) AS i FROM documents WHERE n_chars > 0)
SELECT doc_id, i::INTEGER AS segment_index, i * 1000 AS start_sample, least(i * 1000 + 1000, n_chars) AS end_sample,
CASE WHEN n_chars < 1000 THEN 'loop' WHEN n_chars = 1000 THEN 'exact' WHEN (i + 1) * 1000 <= n_chars THEN 'full' ELSE 'tail_loop' END AS segment_kind FROM s""")
def segments_full_tail(spark, sf_dir):
    return G.expand_segments(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 1000).drop("n_chars")


@query("""WITH s AS (SELECT doc_id, n_chars, unnest(range(0, n_chars // 800)) AS i FROM documents WHERE n_chars >= 800)
SELECT doc_id, i::INTEGER AS window_index, i * 800 AS start_sample, i * 800 + 800 AS end_sample, n_chars % 800 AS left_over FROM s""")
def complete_windows(spark, sf_dir):
    return G.complete_windows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 800).drop("n_chars")


@query("SELECT doc_id, ((n_chars * 16000 + 44099) // 44100) // 400 AS windows FROM documents")
def resampled_windows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", G.window_count(F.col("n_chars"), 44100, 16000, 400).alias("windows"))


@query(f"WITH {SEGMENTS} SELECT conv_id, turn * 2 + h AS turn, h AS half, h * 400 AS start_sample, (h + 1) * 400 AS end_sample FROM seg, (VALUES (0), (1)) x(h)")
def half_windows(spark, sf_dir):
    return G.half_windows(segments(spark, sf_dir).select("conv_id", "turn"), "turn", 800)


#: Numbers with gaps of their own: the lengths that texts of a source have, in steps of 50.
_GAPS = "gaps AS (SELECT DISTINCT source, n_chars // 50 AS seq FROM documents)"


def _gaps(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", F.floor(F.col("n_chars") / 50).alias("seq")).distinct()


@query(f"""WITH {_GAPS}, r AS (SELECT *, seq - row_number() OVER (PARTITION BY source ORDER BY seq) AS run FROM gaps),
p AS (SELECT *, min(seq) OVER (PARTITION BY source, run) AS run_start, row_number() OVER (PARTITION BY source, run ORDER BY seq) - 1 AS place FROM r)
SELECT source, run_start, (place // 2)::INTEGER AS chunk, min(seq) AS "first", max(seq) AS "last" FROM p GROUP BY ALL HAVING count(*) = 2""")
def islands_chunks(spark, sf_dir):
    return G.chunks(_gaps(spark, sf_dir), ["source"], "seq", 2)


@query(f"""WITH {_GAPS}, r AS (SELECT *, seq - row_number() OVER (PARTITION BY source ORDER BY seq) AS run FROM gaps), g AS (SELECT source, run, count(*) AS n FROM r GROUP BY ALL)
SELECT source, count(*) AS runs, max(n) AS longest, sum(n // 2)::BIGINT AS clips FROM g GROUP BY source""")
def runs_summary(spark, sf_dir):
    return G.run_summary(_gaps(spark, sf_dir), ["source"], "seq", 2)


@query("""WITH n AS (SELECT source, lang, doc_id, doc_id // 20 AS seq, lead(doc_id // 20) OVER w AS next_number, lead(doc_id) OVER w AS next_doc_id FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id // 20, doc_id))
SELECT source, lang, seq, doc_id, next_number, next_doc_id FROM n WHERE next_number - seq = 1""")
def adjacent_pairs_lead(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", F.floor(F.col("doc_id") / 20).alias("seq"))
    return G.adjacent_pairs(d, ["source", "lang"], "seq", ["doc_id"])


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
p AS (SELECT source, n, CASE WHEN k = 4 THEN n - 1 ELSE trunc(k * ((n - 1) / 4.0::DOUBLE))::BIGINT END AS place FROM (SELECT DISTINCT source, n FROM r), (SELECT unnest(range(0, 5)) AS k))
SELECT DISTINCT r.source, r.doc_id FROM r LEFT JOIN p ON r.source = p.source AND r.i = p.place WHERE r.n <= 5 OR p.place IS NOT NULL""")
def evenly_spaced_pick(spark, sf_dir):
    return G.evenly_spaced(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 5)


@query("""WITH r AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INTEGER AS place, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id, place FROM r WHERE place = 1 OR place = (n - 1) // 2 + 1 OR place = n""")
def first_mid_last_pick(spark, sf_dir):
    return G.first_middle_last(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"])
