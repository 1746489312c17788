"""Queries of thresholds, calibration, bootstrap, open-set vectors, gates and stream extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import bootstrap as B
from lumenfold.operators import gates as G
from lumenfold.operators import metrics as M
from lumenfold.operators import thresholds as T
from lumenfold.operators import vectors as V
from lumenfold.plans.fixtures import SCORED, query, rounded, scored
from lumenfold.runtime import table
from lumenfold.streaming import alarms


def _negatives(spark, sf_dir):
    return scored(spark, sf_dir).where("toxic = 0")


_NEG = f"{SCORED}, neg AS (SELECT * FROM scored WHERE toxic = 0)"
_LOCAL = "loc AS (SELECT source, n AS negatives, allowed, s AS boundary FROM (SELECT source, score AS s, row_number() OVER (PARTITION BY source ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY source) AS n, floor(count(*) OVER (PARTITION BY source) * {t}::DOUBLE)::BIGINT AS allowed FROM neg) WHERE r = allowed + 1)"


@query(f"WITH {_NEG}, r AS (SELECT lang, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC) AS rank, count(*) OVER (PARTITION BY lang) AS negatives FROM neg) SELECT lang, negatives, floor(negatives * 0.05::DOUBLE)::BIGINT AS allowed, rank, score AS boundary FROM r WHERE rank = floor(negatives * 0.05::DOUBLE)::BIGINT + 1")
def fpr_threshold(spark, sf_dir):
    return T.fpr_boundary(_negatives(spark, sf_dir), "score", 0.05, ["lang"])


@query(f"""WITH {_NEG}, {_LOCAL.format(t=0.1)}, o AS (SELECT *, row_number() OVER (ORDER BY boundary, source) AS place, count(*) OVER () AS s FROM loc),
k AS (SELECT max(s) AS sources, ceil((max(s) + 1) * 0.7::DOUBLE)::INTEGER AS rank, ceil(max(s) * 0.7::DOUBLE)::INTEGER AS rank1 FROM o),
b AS (SELECT sources, rank, (SELECT boundary FROM o WHERE place = rank) AS boundary, (SELECT boundary FROM o WHERE place = rank1) AS loo_minimum, (SELECT boundary FROM o WHERE place = rank1 + 1) AS loo_maximum FROM k),
p AS (SELECT score AS pooled_boundary, n AS negatives FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS r, count(*) OVER () AS n FROM neg) WHERE r = floor(n * 0.1::DOUBLE)::BIGINT + 1),
f AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE score > (SELECT boundary FROM b)) AS h FROM neg GROUP BY source),
g AS (SELECT sum(h)::DOUBLE / sum(n) AS pooled_fpr, avg(h::DOUBLE / n) AS macro_fpr, max(h::DOUBLE / n) AS worst_fpr FROM f)
SELECT sources, rank, boundary, loo_minimum, loo_maximum, pooled_boundary, negatives, round(pooled_fpr, 6) AS pooled_fpr, round(macro_fpr, 6) AS macro_fpr, round(worst_fpr, 6) AS worst_fpr, round(rank::DOUBLE / (sources + 1), 6) AS coverage_bound FROM b, p, g""")
def source_block_threshold(spark, sf_dir):
    return rounded(T.source_block(_negatives(spark, sf_dir), "source", "score", 0.1, 0.3))


@query(f"""WITH {_NEG}, {_LOCAL.format(t=0.1)}, o AS (SELECT *, row_number() OVER (ORDER BY boundary, source) AS place, count(*) OVER () AS s FROM loc), k AS (SELECT max(s) AS sources, ceil((max(s) + 1) * 0.6::DOUBLE)::INTEGER AS rank FROM o),
p AS (SELECT score AS pooled_boundary FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS r, count(*) OVER () AS n FROM neg) WHERE r = floor(n * 0.1::DOUBLE)::BIGINT + 1)
SELECT sources, rank, boundary AS source_boundary, pooled_boundary, greatest(boundary, pooled_boundary) AS boundary FROM k, p, o WHERE place = rank""")
def source_quantile_threshold(spark, sf_dir):
    return T.source_quantile(_negatives(spark, sf_dir), "source", "score", 0.1, 0.6)


@query(f"""WITH {_NEG}, {_LOCAL.format(t=0.1)}, s AS (SELECT DISTINCT source FROM neg),
pr AS (SELECT s.source AS held, neg.score, row_number() OVER (PARTITION BY s.source ORDER BY neg.score DESC) AS r, count(*) OVER (PARTITION BY s.source) AS n FROM s JOIN neg ON neg.source <> s.source),
pooled AS (SELECT held, score AS b FROM pr WHERE r = floor(n * 0.1::DOUBLE)::BIGINT + 1),
top AS (SELECT s.source AS held, max(loc.boundary) AS b FROM s JOIN loc ON loc.source <> s.source GROUP BY s.source),
t AS (SELECT pooled.held, greatest(pooled.b, top.b) AS b FROM pooled JOIN top ON pooled.held = top.held)
SELECT source, count(*) AS rows, max(b) AS boundary, count(*) FILTER (WHERE score > b) AS false_positives, round(count(*) FILTER (WHERE score > b)::DOUBLE / count(*), 6) AS fpr FROM neg JOIN t ON source = held GROUP BY source""")
def leave_one_source_out(spark, sf_dir):
    return rounded(T.leave_one_source_out(_negatives(spark, sf_dir), "source", "score", 0.1))


_SWEEP = f"""{SCORED}, c AS (SELECT lang, score AS t FROM scored UNION SELECT lang, unnest([0.0, 1.0]::DOUBLE[]) FROM scored),
k AS (SELECT c.lang, c.t, count(*) FILTER (WHERE toxic = 1 AND score >= t) AS tp, count(*) FILTER (WHERE toxic = 0 AND score >= t) AS fp, count(*) FILTER (WHERE toxic = 1) AS p, count(*) FILTER (WHERE toxic = 0) AS n FROM c JOIN scored s ON c.lang = s.lang GROUP BY c.lang, c.t),
m AS (SELECT lang, t, tp::DOUBLE / p AS rec, (n - fp)::DOUBLE / n AS spec, 2.0 * tp / (tp + fp + p) AS f1 FROM k)"""


@query(f"""WITH {_SWEEP}, q AS (SELECT *, (rec + spec) / 2 AS bal, rec >= 0.5 AND spec >= 0.4 AS ok, CASE WHEN rec >= 0.5 AND spec >= 0.4 THEN 1.0 ELSE least(least(rec / 0.5, 1.0), least(spec / 0.4, 1.0)) END AS d FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ok DESC, d DESC, f1 DESC, bal DESC, t) AS place FROM q)
SELECT lang, t AS threshold, ok AS feasible, round(f1, 6) AS f1, round(bal, 6) AS balanced_accuracy FROM r WHERE place = 1""")
def threshold_sweep_best(spark, sf_dir):
    return rounded(T.best_threshold(scored(spark, sf_dir), "toxic", "score", 0.5, 0.4, ["lang"]))


@query(f"WITH {SCORED}, r AS (SELECT lang, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC) AS rank, count(*) OVER (PARTITION BY lang) AS rows FROM scored) SELECT lang, rows, rank, score AS boundary FROM r WHERE rank = greatest(ceil(rows * 0.9::DOUBLE), 1)")
def known_only_threshold(spark, sf_dir):
    return T.known_boundary(scored(spark, sf_dir), "score", 0.9, True, ["lang"])


_OPEN = """
op AS (SELECT {by} dist AS t, count(*) FILTER (WHERE known) OVER w AS a, count(*) FILTER (WHERE NOT known) OVER w AS u, count(*) FILTER (WHERE known) OVER p AS na, count(*) FILTER (WHERE NOT known) OVER p AS nu FROM obs WINDOW w AS (PARTITION BY {part} ORDER BY dist RANGE UNBOUNDED PRECEDING), p AS (PARTITION BY {part})),
oq AS (SELECT *, CASE WHEN na = 0 THEN 0.0 ELSE a::DOUBLE / na END AS acc, 1 - CASE WHEN nu = 0 THEN 0.0 ELSE u::DOUBLE / nu END AS rec FROM op),
best AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY round((acc + rec) / 2, 12) DESC, round(rec, 12) DESC, acc DESC, t) AS place FROM oq WHERE acc >= 0.8 - 1e-12)"""
_OBS = f"{SCORED}, obs AS (SELECT lang, source, toxic = 0 AS known, score AS dist FROM scored)"


@query(f"WITH {_OBS}, {_OPEN.format(by='lang,', part='lang')} SELECT lang, t AS threshold, round(acc, 6) AS known_acceptance, round(rec, 6) AS unknown_recall, round((acc + rec) / 2, 6) AS balanced FROM best WHERE place = 1")
def open_set_threshold(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("known", F.col("toxic") == 0)
    return rounded(T.open_set_threshold(df, "known", "score", 0.8, ["lang"]))


@query(f"""WITH {_OBS}, {_OPEN.format(by='', part='1').replace('best AS', 'gbest AS').replace('op AS', 'gop AS').replace('oq AS', 'goq AS').replace('FROM op', 'FROM gop').replace('FROM oq', 'FROM goq')},
{_OPEN.format(by='source,', part='source')},
s AS (SELECT source, count(*) FILTER (WHERE known) AS ks, count(*) FILTER (WHERE NOT known) AS us FROM obs GROUP BY source),
g AS (SELECT source, dist FROM (SELECT source, dist, row_number() OVER (PARTITION BY source ORDER BY dist) AS r, count(*) OVER (PARTITION BY source) AS n FROM obs WHERE known) WHERE r = greatest(ceil(n * 0.8::DOUBLE), 1))
SELECT s.source, ks AS known_support, us AS unknown_support, CASE WHEN ks >= 5 AND us >= 3 THEN b.t ELSE greatest((SELECT t FROM gbest WHERE place = 1), coalesce(g.dist, (SELECT t FROM gbest WHERE place = 1))) END AS threshold, NOT (ks >= 5 AND us >= 3) AS fallback
FROM s LEFT JOIN (SELECT * FROM best WHERE place = 1) b ON s.source = b.source LEFT JOIN g ON s.source = g.source""")
def per_class_threshold_fallback(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("known", F.col("toxic") == 0)
    return T.class_thresholds(df, "source", "known", "score", 0.8)


@query(f"""WITH {SCORED}, t AS (SELECT i / 20.0::DOUBLE AS t FROM range(1, 20) x(i)), e AS (SELECT lang, t, count(*) FILTER (WHERE toxic = 0 AND score >= t)::DOUBLE / count(*) FILTER (WHERE toxic = 0) AS fpr, count(*) FILTER (WHERE toxic = 1 AND score >= t)::DOUBLE / count(*) FILTER (WHERE toxic = 1) AS rec FROM scored, t GROUP BY lang, t)
SELECT min(t) AS threshold FROM (SELECT t FROM e GROUP BY t HAVING bool_and(fpr <= 0.8 AND rec >= 0.2))""")
def first_passing_threshold(spark, sf_dir):
    return T.first_passing(scored(spark, sf_dir), "toxic", "score", "lang", [i / 20 for i in range(1, 20)], 0.8, 0.2)


@query()
def temperature_fit(spark, sf_dir):
    """The temperature that makes logits best calibrated, and the likelihood before and after."""
    df = scored(spark, sf_dir).withColumn("logit", (F.col("score") - 0.3) * 6)
    t = T.fit_temperature(df, "label", "logit")
    return rounded(df.agg(M.logit_nll("label", "logit").alias("nll_before"), M.logit_nll("label", "logit", t).alias("nll_after")).withColumn("temperature", F.lit(t)))


@query(f"WITH {_NEG}, r AS (SELECT lang, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC) AS rank, count(*) OVER (PARTITION BY lang) AS negatives FROM neg) SELECT lang, score AS boundary, nextafter(score, 'infinity'::DOUBLE) AS threshold FROM r WHERE rank = floor(negatives * 0.05::DOUBLE)::BIGINT + 1")
def threshold_numbers(spark, sf_dir):
    """Boundaries with the next double above each."""
    return T.fpr_boundary(_negatives(spark, sf_dir), "score", 0.05, ["lang"]).select("lang", "boundary", T.just_above("boundary").alias("threshold"))


_BOUNDS = [0.36787944117144233]
for _k in range(1, 12):
    _BOUNDS.append(_BOUNDS[-1] + (_BOUNDS[-1] - (_BOUNDS[-2] if _k > 1 else 0.0)) / _k)


_POISSON = " + ".join(f"(u > {b!r})::INTEGER" for b in _BOUNDS)


def _unit(text: str) -> str:
    return f"('0x' || substr(sha256({text}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616"


def _share(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} = 0 THEN 0.0 ELSE ({top})::DOUBLE / ({bottom}) END"


_METRICS = {"accuracy": _share("tp + tn", "tp + fp + fn + tn"), "precision": _share("tp", "tp + fp"), "recall": _share("tp", "tp + fn"), "specificity": _share("tn", "tn + fp"), "f1": _share("2 * tp", "2 * tp + fp + fn"), "balanced_accuracy": f"(({_share('tp', 'tp + fn')}) + ({_share('tn', 'tn + fp')})) / 2"}


@query(f"""WITH {SCORED}, k AS (SELECT label || '|' || source AS k, count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn FROM scored GROUP BY 1),
u AS (SELECT i, k.*, {_unit("'13:' || i || ':' || k")} AS u FROM k, range(0, 100) t(i)), w AS (SELECT *, {_POISSON} AS w FROM u),
r AS (SELECT i, sum(tp * w) AS tp, sum(fp * w) AS fp, sum(fn * w) AS fn, sum(tn * w) AS tn FROM w GROUP BY i), v AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, {sql} AS v FROM r" for m, sql in _METRICS.items())})
SELECT metric, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM v GROUP BY metric""")
def cluster_bootstrap(spark, sf_dir):
    """Intervals of six metrics, resampling sources within labels."""
    return rounded(B.binary_metrics_ci(scored(spark, sf_dir), "label", "score", 0.5, "source", 100, 13))


@query(f"""WITH {SCORED}, c AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE score >= 0.5) AS a, count(*) FILTER (WHERE other >= 0.5) AS b FROM scored GROUP BY source),
w AS (SELECT i, source, n, a, b, -ln(greatest(('0x' || substr(sha256('21:' || i || ':' || source), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616, 5.421010862427522e-20)) AS w FROM c, range(0, 100) t(i)),
r AS (SELECT i, (sum(b * w) - sum(a * w)) / sum(n * w) AS v FROM w GROUP BY i)
SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM r""")
def bayesian_bootstrap_delta(spark, sf_dir):
    df = scored(spark, sf_dir)
    sums = df.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.5).alias("a"), F.count_if(F.col("other") >= 0.5).alias("b"))
    w = F.col("weight")
    reps = B.replicates(sums, "source", 100, 21, "exponential").groupBy("replicate").agg(((F.sum(F.col("b") * w) - F.sum(F.col("a") * w)) / F.sum(F.col("n") * w)).alias("v"))
    return rounded(B.interval(reps, "v"))


@query(f"""WITH {SCORED}, c AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE score >= 0.5) AS a, count(*) FILTER (WHERE other >= 0.5) AS b FROM scored GROUP BY source),
u AS (SELECT i, c.*, {_unit("'21:' || i || ':' || source")} AS u FROM c, range(0, 100) t(i)), w AS (SELECT *, {_POISSON} AS w FROM u), r AS (SELECT i, (sum(b * w) - sum(a * w))::DOUBLE / sum(n * w) AS v FROM w GROUP BY i HAVING sum(n * w) > 0)
SELECT round((SELECT (sum(b) - sum(a))::DOUBLE / sum(n) FROM c), 6) AS delta, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(quantile_cont(v, 0.95), 6) AS upper FROM r""")
def paired_bootstrap(spark, sf_dir):
    """The delta of two systems' hit rates with bounds, resampling sources."""
    return rounded(B.paired_rate_delta(scored(spark, sf_dir), "source", F.col("score") >= 0.5, F.col("other") >= 0.5, 100, 21))


@query(f"""WITH {SCORED}, c AS (SELECT label, source, lang, count(*) AS n, count(*) FILTER (WHERE (score >= 0.5) = (label = 1)) AS a, count(*) FILTER (WHERE (other >= 0.5) = (label = 1)) AS b FROM scored GROUP BY ALL),
w AS (SELECT i, c.*, ln(greatest({_unit("'5:' || i || ':source:' || source")}, 5.421010862427522e-20)) * ln(greatest({_unit("'5:' || i || ':lang:' || lang")}, 5.421010862427522e-20)) AS w FROM c, range(0, 100) t(i)),
d AS (SELECT i, label, (sum(w * b) - sum(w * a)) / sum(w * n) AS d FROM w GROUP BY i, label), v AS (SELECT i, avg(d) AS v FROM d GROUP BY i)
SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM v""")
def multiway_bootstrap(spark, sf_dir):
    """Deltas of balanced accuracy under weights of sources and languages."""
    return rounded(B.interval(B.multiway_delta(scored(spark, sf_dir), "label", F.col("score") >= 0.5, F.col("other") >= 0.5, ["source", "lang"], 100, 5), "delta"))


_PROTO = """
u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
x AS (SELECT label, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM u), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY label, i), proto AS (SELECT label, list(m ORDER BY i) AS p FROM m GROUP BY label)"""


@query(f"""WITH {_PROTO}, s AS (SELECT u.vec_id, proto.label AS predicted, list_cosine_similarity(u.e, proto.p) AS s FROM u, proto), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, predicted) AS place FROM s)
SELECT vec_id, predicted, round(s, 6) AS similarity FROM r WHERE place = 1""")
def prototype_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return rounded(V.nearest_prototype(e, "embedding", V.prototypes(e, "label", "embedding"), "label").select("vec_id", "predicted", "similarity"))


@query("""WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), r AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id, list_cosine_similarity(q.e, r.e) AS s FROM q JOIN r ON q.label = r.label AND q.vec_id <> r.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC) AS place FROM s)
SELECT vec_id, round((avg(s) + 1) / 2, 6) AS score FROM k WHERE place <= 5 GROUP BY vec_id""")
def class_knn_mean(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return rounded(V.class_knn(e.where("vec_id % 50 = 0"), e, "vec_id", "label", "label", "embedding", 5))


@query()
def mahalanobis_open_set(spark, sf_dir):
    """Distances to the predicted class's Gaussian in a projected space."""
    e = table(spark, sf_dir, "embeddings")
    boundary = V.fit_boundary(e, "embedding", "label", 8)
    return rounded(e.select("vec_id", "label", V.boundary_distance(boundary)("embedding", "label").alias("distance")))


@query("""WITH l AS (SELECT vec_id, embedding[1:5]::DOUBLE[] AS l FROM embeddings), e AS (SELECT vec_id, l, list_max(l) AS top, list_transform(l, lambda x: exp(x - list_max(l))) AS ex FROM l)
SELECT vec_id, (list_position(l, top) - 1)::INTEGER AS predicted, round(1.0 / list_sum(ex), 6) AS msp, round(top + ln(list_sum(ex)), 6) AS energy FROM e""")
def open_set_scores(spark, sf_dir):
    logits = F.slice("embedding", 1, 5)
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", M.predicted_class(logits).alias("predicted"), V.msp(logits).alias("msp"), V.energy(logits).alias("energy")))


@query(f"WITH {SCORED} SELECT doc_id, CASE WHEN score < 0.4 THEN 'background' WHEN other < 0.5 THEN 'unknown' ELSE 'known' END AS decision, CASE WHEN score >= 0.4 AND other >= 0.5 THEN lang END AS class FROM scored")
def hierarchical_decision(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", V.hierarchical_decision(F.col("score"), F.col("other"), F.col("lang"), 0.4, 0.5).alias("d")).select("doc_id", "d.decision", "d.class")


@query("""WITH l AS (SELECT vec_id, embedding[1:5]::DOUBLE[] AS a, embedding[6:10]::DOUBLE[] AS b FROM embeddings),
s AS (SELECT vec_id, list_transform(a, lambda x: (x - list_avg(a)) / greatest(list_stddev_pop(a), 1e-6)) AS a, list_transform(b, lambda x: (x - list_avg(b)) / greatest(list_stddev_pop(b), 1e-6)) AS b FROM l)
SELECT vec_id, round(a[1] * 0.75 + b[1] * 0.25, 6) AS first_score, round(a[5] * 0.75 + b[5] * 0.25, 6) AS last_score FROM s""")
def score_fusion(spark, sf_dir):
    f = V.fused(F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double")), F.transform(F.slice("embedding", 6, 5), lambda x: x.cast("double")), 0.25)
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", f.alias("f")).select("vec_id", F.col("f")[0].alias("first_score"), F.col("f")[4].alias("last_score")))


def _metric_tables(spark, sf_dir):
    s = scored(spark, sf_dir)
    names = ["accuracy", "recall", "specificity", "f1"]
    return tuple(G.metric_rows(M.threshold_metrics(s, "label", c, 0.5, ["lang"]), "lang", names) for c in ("score", "other"))


_RULES = [G.Rule("en", "accuracy", max_drop=0.05), G.Rule("de", "recall", max_drop=0.2), G.Rule("fr", "specificity", floor=0.2), G.Rule("es", "f1", min_delta=0.001), G.Rule("xx", "f1", floor=0.1)]


def _rates(column: str) -> str:
    h = f"{column} >= 0.5"
    k = f"SELECT lang, count(*) FILTER (WHERE label = 1 AND {h}) AS tp, count(*) FILTER (WHERE label = 0 AND {h}) AS fp, count(*) FILTER (WHERE label = 1 AND NOT {h}) AS fn, count(*) FILTER (WHERE label = 0 AND NOT {h}) AS tn FROM scored GROUP BY lang"
    return f"(WITH k AS ({k}) SELECT lang AS scope, 'accuracy' AS metric, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS v FROM k UNION ALL SELECT lang, 'recall', tp::DOUBLE / (tp + fn) FROM k UNION ALL SELECT lang, 'specificity', tn::DOUBLE / (tn + fp) FROM k UNION ALL SELECT lang, 'f1', 2.0 * tp / (2 * tp + fp + fn) FROM k)"


@query(f"""WITH {SCORED}, b AS {_rates('score')}, c AS {_rates('other')},
r AS (SELECT * FROM (VALUES ('en', 'accuracy', 0.05, NULL, NULL), ('de', 'recall', 0.2, NULL, NULL), ('fr', 'specificity', NULL, 0.2, NULL), ('es', 'f1', NULL, NULL, 0.001), ('xx', 'f1', NULL, 0.1, NULL)) t(scope, metric, d, f, g)),
j AS (SELECT r.scope, r.metric, b.v AS baseline, c.v AS candidate, coalesce(f, b.v - d, b.v + g) AS required FROM r LEFT JOIN b ON r.scope = b.scope AND r.metric = b.metric LEFT JOIN c ON r.scope = c.scope AND r.metric = c.metric)
SELECT scope, metric, round(baseline, 6) AS baseline, round(candidate, 6) AS candidate, round(candidate - baseline, 6) AS delta, round(required, 6) AS required, coalesce(candidate >= required, false) AS passed FROM j""")
def gate_rules(spark, sf_dir):
    base, candidate = _metric_tables(spark, sf_dir)
    return rounded(G.checks(base, candidate, _RULES))


@query(f"""WITH {SCORED}, b AS {_rates('score')}, c AS {_rates('other')},
r AS (SELECT * FROM (VALUES ('en', 'accuracy', 0.05, NULL, NULL), ('de', 'recall', 0.2, NULL, NULL), ('fr', 'specificity', NULL, 0.2, NULL), ('es', 'f1', NULL, NULL, 0.001), ('xx', 'f1', NULL, 0.1, NULL)) t(scope, metric, d, f, g)),
j AS (SELECT r.scope, coalesce(c.v >= coalesce(f, b.v - d, b.v + g), false) AS passed FROM r LEFT JOIN b ON r.scope = b.scope AND r.metric = b.metric LEFT JOIN c ON r.scope = c.scope AND r.metric = c.metric),
p AS (SELECT bool_and(passed) FILTER (WHERE scope IN ('en', 'de')) AS noninferior, bool_or(passed) FILTER (WHERE scope = 'es') AS improved, bool_and(passed) FILTER (WHERE scope = 'fr') AS subgroups, bool_and(passed) FILTER (WHERE scope = 'xx') AS ready FROM j)
SELECT *, noninferior AND improved AND subgroups AS passed FROM p""")
def gate_promotion(spark, sf_dir):
    """Non-inferiority and any improvement and subgroups and readiness."""
    base, candidate = _metric_tables(spark, sf_dir)
    rows = G.checks(base, candidate, _RULES)
    return G.promotion(rows.where("scope in ('en', 'de')"), rows.where("scope = 'es'"), rows.where("scope = 'fr'"), rows.where("scope = 'xx'"), False)


@query(f"""WITH {SCORED}, b AS {_rates('score')}, c AS {_rates('other')} SELECT coalesce(b.scope, c.scope) AS scope, coalesce(b.metric, c.metric) AS metric, round(b.v, 6) AS left_value, round(c.v, 6) AS right_value
FROM b FULL JOIN c ON b.scope = c.scope AND b.metric = c.metric WHERE b.v IS NULL OR c.v IS NULL OR abs(b.v - c.v) > 0.02""")
def stored_vs_recomputed(spark, sf_dir):
    base, candidate = _metric_tables(spark, sf_dir)
    return rounded(G.differing(base, candidate, ["scope", "metric"], "value", 0.02))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS rows, count(*) FILTER (WHERE value >= 50) AS alarms, round(count(*) FILTER (WHERE value >= 50)::DOUBLE / count(*), 6) AS rate FROM events GROUP BY ALL""")
def tumbling_alarm_rate(spark, sf_dir):
    out = alarms.tumbling_rates(table(spark, sf_dir, "events"), "ts", "value", 50.0, by=["event_type"])
    return rounded(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts)::TIMESTAMP AS session_start, (max(ts) + INTERVAL '30 minutes')::TIMESTAMP AS session_end, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid""")
def session_rollup(spark, sf_dir):
    out = alarms.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "value")
    return rounded(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")}), 4)
