"""Small literal frames with known outcomes, order independence, and failures that must fail."""

import math
import random

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenfold import checks, schema
from lumenfold.operators import bootstrap, components, firewall, gates, identity, metrics, overlap, rollup, sampling, segments, thresholds, vectors


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def auc_brute(y, s):
    pos, neg = [a for a, b in zip(s, y, strict=True) if b], [a for a, b in zip(s, y, strict=True) if not b]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_ranking_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(500)]
    got = metrics.ranking_metrics(frame(spark, rows, "y int, s double").repartition(3), "y", "s").first()
    y, s = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert got.roc_auc == pytest.approx(auc_brute(y, s), abs=1e-12)
    points = [(0.0, 0.0, 1.0)]
    ap = trapezoid = area = 0.0
    for t in sorted(set(s), reverse=True):
        tp, fp = ((s >= t) & (y == 1)).sum(), ((s >= t) & (y == 0)).sum()
        r, f, p = tp / y.sum(), fp / (1 - y).sum(), tp / (tp + fp)
        r0, f0, p0 = points[-1]
        ap += (r - r0) * p
        trapezoid += (r - r0) * (p + p0) / 2
        if f0 < 0.05:
            cut = r if f <= 0.05 else r0 + (r - r0) * (0.05 - f0) / (f - f0)
            area += (min(f, 0.05) - f0) * (r0 + cut) / 2
        points.append((r, f, p))
    assert got.average_precision == pytest.approx(ap)
    assert got.pr_auc_trapezoid == pytest.approx(trapezoid)
    assert got.partial_auc == pytest.approx(0.5 * (1 + (area - 0.00125) / (0.05 - 0.00125)))


def test_one_class_has_no_ranking(spark):
    r = metrics.ranking_metrics(frame(spark, [(1, 0.5, "a"), (1, 0.7, "a"), (0, 0.1, "b"), (1, 0.2, "b")], "y int, s double, g string"), "y", "s", ["g"])
    assert {x.g: x.roc_auc for x in r.collect()} == {"a": None, "b": 1.0}


def test_empty_denominators_are_zero(spark):
    r = metrics.threshold_metrics(frame(spark, [(0, 0.1)], "y int, s double"), "y", "s", 0.5).first()
    assert (r.precision, r.recall, r.f1, r.specificity) == (0.0, 0.0, 0.0, 1.0)


def test_groups_of_one_class(spark):
    rows = metrics.threshold_metrics(frame(spark, [("p", 1, 0.9), ("p", 1, 0.8), ("p", 1, 0.1), ("n", 0, 0.1), ("n", 0, 0.9)], "g string, y int, s double"), "y", "s", 0.5, ["g"]).collect()
    by = {r.g: r for r in rows}
    assert (by["p"].fpr, by["p"].specificity) == (1.0, 0.0) and by["p"].balanced_accuracy == pytest.approx(2 / 3)
    assert (by["n"].fpr, by["n"].specificity, by["n"].balanced_accuracy, by["n"].recall) == (0.5, 0.5, 0.5, 0.0)


def test_quantiles_and_ranges_of_crowded_scores(spark):
    rng = random.Random(6)
    for rows in ([(rng.gauss(0, 1) * 1e-9,) for _ in range(3000)], [(1.0,)] * 10, [(1e300 * rng.random(),) for _ in range(50)] + [(-1e-300,), (0.0,)], [(0.25,)]):
        v = np.array([r[0] for r in rows])
        got = metrics.quantiles(frame(spark, rows, "s double").repartition(3), "s", {"a": 0.0, "b": 0.37, "c": 0.95, "d": 1.0}).first()
        assert tuple(got) == pytest.approx(tuple(np.quantile(v, (0, 0.37, 0.95, 1))), rel=1e-12)
    y = frame(spark, [(i % 2, 1 - 1e-12 * i) for i in range(500)], "y int, s double")
    assert metrics.ranking_metrics(y, "y", "s").first().roc_auc == pytest.approx(auc_brute(*zip(*[(i % 2, 1 - 1e-12 * i) for i in range(500)], strict=True)))


def test_ranks_in_two_levels(spark):
    rows = [(i % 3, (i * 7919) % 1000, i) for i in range(1000)]
    df = frame(spark, rows, "g int, k int, i int").repartition(5)
    got = {r.i: r.pair for r in overlap.ranked(df, ["k", "i"]).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))] and sorted(got.values()) == list(range(1, 1001))
    by = {}
    for r in overlap.ranked(df, [F.col("k"), F.col("i")], ["g"]).collect():
        by.setdefault(r.g, []).append((r.pair, r.i))
    assert all([i for _, i in sorted(v)] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2])) if r[0] == g] for g, v in by.items())


def test_canonical_rows_of_ties_and_nulls(spark):
    df = frame(spark, [(1, "a", "x"), (1, "a", "x"), (2, "a", "y"), (3, None, "x"), (4, None, "x"), (5, "b", None)], "i int, h string, s string")
    rows = sorted((r.i, r.group_size, r.kept) for r in identity.canonical_rows(df, "h", ["i"]).collect())
    assert rows == [(1, 3, False), (1, 3, True), (2, 3, False), (3, 2, True), (4, 2, False), (5, 1, True)]
    listed = identity.duplicate_listing(df, "h", "s", ["i"]).collect()
    assert sorted((r.i, r.cross_split) for r in listed) == [(1, True), (1, True), (2, True), (3, False), (4, False)]


def test_pooling_vector(spark):
    df = frame(spark, [(0, i, s) for i, s in enumerate([0.1, 0.2, 0.8, 0.9])], "r int, i int, s double")
    get = lambda m, **k: rollup.recordings(df, ["r"], "s", m, "i", **k).first().score
    assert get("mean_probability") == pytest.approx(0.5)
    assert get("max_probability") == 0.9
    assert get("topk_mean_probability", topk_fraction=0.5) == pytest.approx(0.85)
    assert get("mean_logit_then_sigmoid") == pytest.approx(0.5)
    two = frame(spark, [(0, 0, 1.0), (0, 1, 0.0)], "r int, i int, s double")
    for cap in (0.55, 0.65, 0.75):
        assert rollup.recordings(two, ["r"], "s", "constrained_autopool_probability", "i", cap=cap).first().score == pytest.approx(cap)


def test_gaps_in_windows_are_errors(spark):
    with pytest.raises(PySparkException, match="consecutive"):
        rollup.recordings(frame(spark, [(0, 0, 0.1), (0, 2, 0.3)], "r int, i int, s double"), ["r"], "s", index="i").collect()


def test_changing_label_is_an_error(spark):
    with pytest.raises(PySparkException, match="varies"):
        rollup.recordings(frame(spark, [(0, 0, 0.1), (0, 1, 0.3)], "r int, y int, s double"), ["r"], "s", constant=["y"]).collect()


def test_nonoverlap_drops_the_tail(spark):
    df = frame(spark, [("a", 0, 0.8), ("a", 1, 1.0), ("a", 2, 0.2), ("b", 0, 0.1), ("b", 1, 0.3)], "r string, i int, s double")
    assert sorted(round(x.score, 9) for x in rollup.nonoverlap_means(df, ["r"], "i", "s", 2).collect()) == [0.2, 0.9]
    assert [(x.r, x.dropped) for x in rollup.dropped_windows(df, ["r"], 2).collect()] == [("a", 1)]


def test_fpr_budget(spark):
    r = thresholds.fpr_boundary(frame(spark, [(i / 100,) for i in range(100)], "s double"), "s", 0.01).first()
    assert (r.allowed, r.boundary) == (1, 0.98)


def test_source_block_example(spark):
    df = frame(spark, [("a", s) for s in (0.1, 0.2, 0.3, 0.4)] + [("b", s) for s in (0.1, 0.2, 0.8, 0.9)], "src string, s double")
    r = thresholds.source_block(df, "src", "s", 0.25, 0.34).first()
    assert (r["rank"], r.boundary) == (2, 0.8)
    with pytest.raises((PySparkException, Py4JJavaError), match="too few sources"):  # raised in a stage of its own
        thresholds.source_block(df, "src", "s", 0.25, 0.01).collect()


def test_source_quantile_example(spark):
    values = {"a": (0.1, 0.2, 0.3, 0.4), "b": (0.2, 0.3, 0.4, 0.5), "c": (0.3, 0.4, 0.5, 0.6), "d": (0.4, 0.5, 0.6, 0.7)}
    df = frame(spark, [(k, s) for k, v in values.items() for s in v], "src string, s double")
    r = thresholds.source_quantile(df, "src", "s", 0.25, 0.6).first()
    assert (r["rank"], r.source_boundary) == (3, 0.5)


def test_ties_at_one_stay_conservative(spark):
    r = thresholds.fpr_boundary(frame(spark, [(1.0,)] * 10, "s double"), "s", 0.1).select(thresholds.just_above("boundary").alias("t")).first()
    assert r.t > 1.0


def test_known_and_unknown_scores(spark):
    rows = [(True, s) for s in (0.95, 0.9, 0.8, 0.7)] + [(False, s) for s in (0.75, 0.6, 0.55, 0.4)]
    df = frame(spark, rows, "k boolean, s double").withColumn("d", -F.col("s"))
    r = thresholds.open_set_threshold(df, "k", "d", 0.75).first()
    assert (-r.threshold, r.unknown_recall) == (0.8, 1.0)


def test_temperature_lowers_likelihood(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=400) * 6
    y = (rng.random(400) < 1 / (1 + np.exp(-z / 3))).astype(int)
    df = frame(spark, [(int(a), float(b)) for a, b in zip(y, z, strict=True)], "y int, z double")
    t = thresholds.fit_temperature(df, "y", "z")
    assert 2 < t < 4.5
    before, after = (df.agg(metrics.logit_nll("y", "z", k).alias("v")).first().v for k in (1.0, t))
    assert after < before


def test_segment_kinds(spark):
    df = frame(spark, [("s", 5), ("e", 10), ("l", 25), ("z", 0)], "p string, n long")
    got = sorted((r.p, r.segment_kind, r.start_sample, r.end_sample) for r in segments.expand_segments(df, "n", 10).collect())
    assert got == [("e", "exact", 0, 10), ("l", "full", 0, 10), ("l", "full", 10, 20), ("l", "tail_loop", 20, 25), ("s", "loop", 0, 5)]


def test_resampled_window_count(spark):
    df = frame(spark, [(44100, 44100), (66150, 44100), (22000, 44100)], "n long, r long")
    assert [r[0] for r in df.select(segments.window_count(F.col("n"), F.col("r"), 16000, 8000)).collect()] == [2, 3, 0]


def test_chunks_cross_no_gap(spark):
    df = frame(spark, [("a", i) for i in (1, 2, 3, 5, 6, 9)], "k string, i long")
    assert sorted((r.first, r.last) for r in segments.chunks(df, ["k"], "i", 2).collect()) == [(1, 2), (5, 6)]


def test_evenly_spaced_like_numpy(spark):
    for n, m in ((10, 4), (7, 3), (39, 11), (3, 5), (100, 38)):
        got = sorted(r.i for r in segments.evenly_spaced(spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i")), ["k"], ["i"], m).collect())
        assert got == (list(range(n)) if n <= m else sorted(set(np.linspace(0, n - 1, m).astype(int).tolist())))


def test_numbered_names(spark):
    df = frame(spark, [("x/drone-1.wav",), ("drone-2.WAV",), ("drone.wav",)], "p string").select(segments.numbered(F.col("p")).alias("n"))
    assert [tuple(r.n) if r.n else None for r in df.collect()] == [("drone-", 1), ("drone-", 2), None]


def test_components_of_a_long_chain(spark):
    edges = frame(spark, [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000 and len(got) == 303


def test_components_of_nothing(spark):
    assert components.connected_components(frame(spark, [(None, 1)], "a long, b long"), "a", "b").count() == 0


def test_linked_sources(spark):
    df = frame(spark, [("a", "h1", None), ("b", "h1", "g"), ("c", "h2", "g"), ("d", "h3", None)], "s string, h string, g string")
    assert {r.s: r.component for r in identity.linked_components(df.repartition(3), "s", ["h", "g"]).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_cross_label_rows_go(spark):
    df = frame(spark, [(1, "h", 0), (2, "h", 1), (3, "k", 1)], "i int, h string, y int")
    assert [r.i for r in identity.drop_cross_label(df, ["h"], "y").collect()] == [3]


def test_digest_ignores_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 3)
    assert identity.table_digest(df, ["id", "x"]).first() == identity.table_digest(df.repartition(7), ["id", "x"]).first()
    assert identity.table_digest(df, ["id"]).first() != identity.table_digest(df.where("id < 99"), ["id"]).first()


def test_largest_remainder():
    assert sampling.allocate(10, {"a": 1, "b": 1, "c": 1}) == {"a": 4, "b": 3, "c": 3}
    with pytest.raises(ValueError):
        sampling.allocate(5, {"a": 0.0})


def test_round_robin_alternates(spark):
    df = frame(spark, [(s, f"{s}{i}") for s in "ab" for i in range(5)], "s string, i string")
    got = sampling.round_robin(df, "s", "i", 6, 1).collect()
    assert sorted(r.s for r in got) == ["a"] * 3 + ["b"] * 3
    assert {r.i for r in got} == {r.i for r in sampling.round_robin(df.repartition(3), "s", "i", 6, 1).collect()}


def test_weights_sum_to_one(spark):
    df = frame(spark, [(0, "x"), (0, "long"), (0, "long"), (0, "long"), (1, "y")], "y int, s string")
    rows = sampling.balanced_weights(df, "y", "s").collect()
    assert sum(r.weight for r in rows) == pytest.approx(1.0)
    assert sum(r.weight for r in rows if r.s == "long") == pytest.approx(sum(r.weight for r in rows if r.s == "x"))


def test_quotas_draw_cyclically(spark):
    df = frame(spark, [("a", 1), ("a", 2), ("a", 3)], "g string, i int")
    rows = sampling.quota_batches(df, "i", "g", frame(spark, [("a", 7)], "g string, quota long"), 3, 0).collect()
    assert sorted(r.draw for r in rows) == list(range(7)) and {r.i for r in rows if r.batch == 0} == {1, 2, 3}


def test_greedy_split_meets_targets(spark):
    comps = frame(spark, [(f"c{i}", 0, 1 + i % 3) for i in range(60)], "c string, y int, n long")
    rows = sampling.greedy_components(comps, "c", "y", "n", {"train": 0.7, "val": 0.15, "test": 0.15}, 1).collect()
    total = sum(r["size"] for r in rows)
    assert len(rows) == 60 and abs(sum(r["size"] for r in rows if r.split == "train") / total - 0.7) < 0.02
    again = sampling.greedy_components(comps.repartition(5), "c", "y", "n", {"train": 0.7, "val": 0.15, "test": 0.15}, 1).collect()
    assert {(r.component, r.split) for r in rows} == {(r.component, r.split) for r in again}


def test_events_need_three(spark):
    df = frame(spark, [("q", f"e{i}", 2 if i < 3 else 1) for i in range(5)], "t string, e string, n int")
    roles = {r.e: r.role for r in sampling.event_roles(df, "t", "e", "n", 7).collect()}
    assert sorted(roles.values()) == ["test", "train", "train", "train", "validation"] and all(roles[e] == "train" for e in ("e3", "e4"))
    with pytest.raises(PySparkException, match="three events"):
        sampling.event_roles(df.limit(2), "t", "e", "n", 7).collect()


def test_canonical_sources(spark):
    df = frame(spark, [(1, "x", 0, "train"), (2, "x", 0, "test"), (3, "y", 0, "train"), (4, "z", 0, "train"), (5, "w", 0, "test")], "i int, h string, y int, s string")
    kept = [r.i for r in sampling.canonical_sources(df, "h", "y", "s", ["i"], ["train", "val", "test"]).where("kept").collect()]
    assert len(kept) == 4 and {3, 4, 5} <= set(kept)


def test_overlaps_and_matches(spark):
    df = frame(spark, [("train", "a"), ("train", "b"), ("test", "a"), ("val", " ")], "s string, v string")
    got = {(r.left_split, r.right_split): r.overlap for r in overlap.split_overlaps(df, "s", "v", ["train", "val", "test"]).collect()}
    assert got == {("train", "val"): 0, ("train", "test"): 1, ("val", "test"): 0}
    with pytest.raises(PySparkException, match="repeats"):
        overlap.many_to_one(frame(spark, [(1,)], "k int"), frame(spark, [(1, 2), (1, 3)], "k int, v int"), ["k"]).collect()
    with pytest.raises(PySparkException, match="every frame"):
        overlap.ensemble_mean([frame(spark, [(1, 0.5)], "k int, v double"), frame(spark, [(2, 0.5)], "k int, v double")], "k", "v").collect()


def test_firewall(spark, tmp_path):
    df = frame(spark, [("data/Final_Hold-Out/x.wav", "a" * 64), ("ok.wav", "b" * 64)], "path string, sha256 string")
    bad = frame(spark, [("B" * 64,)], "sha256 string")
    r = firewall.audit_rows(df, ["final holdout"], bad).first()
    assert (r.rows, r.locked_rows, r.forbidden_rows) == (2, 1, 1)
    with pytest.raises(ValueError):
        firewall.enforce(df, ["final holdout"], bad)
    assert firewall.enforce(df.limit(0), ["x"], bad) == 0
    target = tmp_path / "locked_set"
    target.mkdir()
    link = tmp_path / "fine"
    link.symlink_to(target)
    with pytest.raises(ValueError):
        firewall.reject_locked_path(str(link), ["lockedset"])
    assert firewall.changed_keys({"a": {"b": 1}}, {"a": {"b": 2}, "c": 3}) == {"a.b": (1, 2), "c": (None, 3)}


def test_constraints(spark):
    df = frame(spark, [(0, 0.5, "s", "a" * 64), (1, float("nan"), "s", "a" * 64)], "label int, calibrated_probability double, ood_split string, sha256 string")
    report = {r["name"]: r["passed"] for r in checks.run_checks(df, checks.prediction_checks()).collect()}
    assert report == {"label is 0 or 1": True, "both labels": True, "probability is in [0, 1]": False, "one split": True, "sha256 is unique": False}
    with pytest.raises(checks.ConstraintError) as e:
        checks.enforce(df, checks.prediction_checks())
    assert len(e.value.report) == 5
    with pytest.raises(ValueError):
        schema.require_columns(df, ["nope"])
    for bad in ("1", "yes", "", None):
        with pytest.raises(PySparkException):
            frame(spark, [(bad,)], "x string").select(schema.strict_bool("x")).collect()
    assert frame(spark, [("7.0",)], "x string").select(schema.strict_int("x")).first()[0] == 7
    with pytest.raises(PySparkException):
        frame(spark, [("1.5",)], "x string").select(schema.strict_int("x")).collect()


def test_vectors(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(1).normal(size=(5, 48)))]
    rows.append((5, rows[1][1]))
    df = frame(spark, rows, "id long, v array<double>")
    got = {r.id: r for r in vectors.lsh_nearest(df.where("id >= 4"), df.where("id < 4"), "id", "v", 48, bits=6).collect()}
    assert got[5].neighbour == 1 and got[5].similarity == pytest.approx(1.0)
    with pytest.raises(PySparkException, match="zero vector"):
        frame(spark, [([0.0, 0.0],)], "v array<double>").select(vectors.unit(F.col("v"))).collect()
    assert frame(spark, [([1000.0, 0.0],)], "v array<double>").select(vectors.energy(F.col("v"))).first()[0] == pytest.approx(1000.0)


def test_boundary_separates(spark):
    rng = np.random.default_rng(3)
    rows = [(int(c), (rng.normal(size=6) + 8 * np.eye(6)[c]).tolist()) for c in (0, 1) for _ in range(40)]
    df = frame(spark, rows, "y int, v array<double>")
    b = vectors.fit_boundary(df, "v", "y", 3)
    d = vectors.boundary_distance(b)
    own, other = (df.select(d("v", c).alias("d")).agg(F.avg("d")).first()[0] for c in (F.col("y"), 1 - F.col("y")))
    assert own < 2 < other


def test_bootstrap_and_gates(spark):
    df = frame(spark, [(i % 2, 0.9 if i % 2 else 0.1, 0.5, f"s{i % 10}") for i in range(200)], "y int, good double, bad double, s string")
    r = bootstrap.paired_rate_delta(df, "s", F.col("bad") >= 0.5, F.col("good") >= 0.5, 60, 1).first()
    assert r.delta == pytest.approx(-0.5) and r.low <= r.delta <= r.high
    d = bootstrap.interval(bootstrap.multiway_delta(df, "y", F.col("bad") >= 0.5, F.col("good") >= 0.5, ["s"], 40, 2), "delta").first()
    assert d.low > 0
    base, good, poor = (frame(spark, [("test", "f1", v)], "scope string, metric string, value double") for v in (0.995, 0.994, 0.980))
    rule = [gates.Rule("test", "f1", max_drop=0.005)]
    assert gates.all_pass(gates.checks(base, good, rule)).first().passed
    assert not gates.all_pass(gates.checks(base, poor, rule)).first().passed
    assert not gates.all_pass(gates.checks(base, good.limit(0), rule)).first().passed
    assert gates.fail_closed(lambda: 1 / 0)["passed"] is False
    with pytest.raises(ValueError):
        gates.Rule("a", "b")


def test_numeric_leaves(spark):
    df = frame(spark, [('{"a": {"b": 1, "c": [2, {"d": 3.5}]}, "t": true}',)], "j string")
    assert {r.path: r.value for r in rollup.numeric_leaves(df, "j").collect()} == {"a.b": 1.0, "a.c[0]": 2.0, "a.c[1].d": 3.5}
    assert math.isclose(rollup.seed_stats(frame(spark, [(1.0,)], "v double"), [], "v").first().sample_std, 0.0)
