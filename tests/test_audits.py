"""Audits, boundaries, heads and protocols on small frames."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenfold import schema
from lumenfold.functions import signals
from lumenfold.operators import audits, overlap, vectors


def test_manifest_and_registry_reports(spark):
    rows = [("a" * 64, "train", 1, "g1"), ("b" * 64, "test", 0, "g2"), ("a" * 64, "test", 1, "g1"), ("nope", "spare", 2, "g3")]
    df = spark.createDataFrame(rows, "h string, split string, label int, g string")
    got = {r["name"]: r.passed for r in audits.manifest_report(df, {"train": 0.5, "test": 0.5}, ["h"], "g").collect()}
    assert got == {"h is well formed": False, "split is known": False, "label is 0 or 1": False, "largest error of a split's share": False, "one label per group": True, "one split per group": False, "contents in two splits": False}
    reg = spark.createDataFrame([("s1", "1", "true"), ("s1", "0", "no")], "source_group string, label string, independent_from_existing string")
    assert {r["name"]: r.passed for r in audits.registry_report(reg).collect()} == {"source_group is there": True, "source_group is unique": False, "label is 0 or 1": True, "independence is stated": False}


def test_disjointness_fails_closed(spark):
    a, b = (spark.createDataFrame([(x,)], "sha256 string") for x in ("aa", "bb"))
    assert audits.assert_disjoint({"a": a, "b": b}, "sha256").count() == 1
    with pytest.raises(ValueError, match="b and forbidden share 1"):
        audits.assert_disjoint({"a": a, "b": b}, "sha256", spark.createDataFrame([("BB ",)], "h string"))


def test_one_to_one(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert overlap.one_to_one(a, b, ["k"]).count() == 2
    for left, right in ((a.union(a), b), (a, b.union(b)), (a, b.limit(1))):
        with pytest.raises(PySparkException):
            overlap.one_to_one(left, right, ["k"]).collect()


def test_boundary_is_bound_to_its_fit(spark, tmp_path):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i % 2, (rng.normal(size=4) + 4 * (i % 2)).tolist()) for i in range(40)], "y int, v array<double>")
    b = vectors.fit_boundary(df, "v", "y", 2)
    vectors.save_boundary(b, spark, str(tmp_path / "b"), "x1")
    again = vectors.load_boundary(spark, str(tmp_path / "b"), "x1")
    assert again.classes == [0, 1] and np.allclose(again.precisions, b.precisions)
    with pytest.raises(ValueError):
        vectors.load_boundary(spark, str(tmp_path / "b"), "x2")
    head = vectors.fit_linear_head(df, "v", "y")
    p = df.select("y", vectors.head_score(head, F.col("v")).alias("p")).groupBy("y").agg(F.avg("p").alias("p")).collect()
    assert {r.y: r.p > 0.5 for r in p} == {0: False, 1: True}


def test_projections(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1] + [1, 2, 3, 4, 5]
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "i long, y int, v array<double>")
    space = vectors.fit_projection(df, "v", 2)
    z = np.array([r.z for r in df.select("i", vectors.projected(space)("v").alias("z")).orderBy("i").collect()])
    centred = x - x.mean(0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    assert np.allclose(np.abs(z), np.abs(centred @ axes.T)) and abs(z.mean(0)).max() < 1e-9
    # the mean of the two nearest of the own class, in the projected space
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    near = df.withColumn("z", vectors.projected(space)("v"))
    got = {r.i: r.score for r in vectors.class_knn(near, near, "i", "y", "y", "z", 2).collect()}
    for i in range(60):
        s = sorted((u[i] @ u[j] for j in range(60) if j != i and j % 2 == i % 2), reverse=True)[:2]
        assert got[i] == pytest.approx((np.mean(s) + 1) / 2)
    with pytest.raises(PySparkException, match="fewer than 40"):
        vectors.class_knn(near, near, "i", "y", "y", "z", 40).collect()
    head = vectors.fit_linear_head(df, "v", "y", components=2)
    p = [r.p for r in df.select("i", vectors.head_score(head, F.col("v")).alias("p")).orderBy("i").collect()]
    inner = vectors.fit_projection(df.where("y = 1"), "v", 2)
    w = (x - inner.mean) @ inner.components.T
    logits = (w - head.mean) / head.scale @ np.array(head.weights) + head.intercept
    assert p == pytest.approx(list(1 / (1 + np.exp(-logits))))


def test_hyperplanes_find_close_vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 32))
    near = base[:50] + 0.05 * rng.normal(size=(50, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))], "i long, v array<double>")
    got = {r.i: r.neighbour for r in vectors.lsh_nearest(df.where("i >= 300"), df, "i", "v", 32).collect()}
    assert np.mean([got[300 + i] == i for i in range(50)]) >= 0.9  # recall of the true neighbour


def test_protocol(tmp_path):
    f = tmp_path / "x.txt"
    f.write_text("1")
    audits.freeze_protocol([str(f)], str(tmp_path / "p.json"))
    assert audits.verify_protocol(str(tmp_path / "p.json")) == []
    f.write_text("2")
    assert audits.verify_protocol(str(tmp_path / "p.json")) == [str(f)]
    with pytest.raises(FileExistsError):
        audits.freeze_protocol([str(f)], str(tmp_path / "p.json"))
    with pytest.raises(PermissionError):
        audits.consume_once(str(tmp_path / "m"), "no", "yes")
    audits.consume_once(str(tmp_path / "m"), "yes", "yes")
    with pytest.raises(FileExistsError):
        audits.consume_once(str(tmp_path / "m"), "yes", "yes")
    assert schema.contains_key({"a": [{"Holdout": 1}]}, {"holdout"}) and not schema.contains_key({"a": 1}, {"b"})


def test_spectral_features(spark):
    x = np.sin(np.arange(4000) * 0.3).astype(np.float32)
    df = spark.createDataFrame([(x.tolist(),)], "a array<float>")
    r = df.select(signals.log_mel(16000, 32)("a").alias("m"), signals.log_mel(16000, 32, coefficients=13)("a").alias("c")).first()
    assert np.array(r.m).shape == (26, 32) and np.array(r.c).shape == (26, 13) and abs(np.mean(r.m)) < 1e-4
    d = signals.dct_matrix(16, 16)
    assert np.allclose(d @ d.T, np.eye(16)) and signals.mel_filters(16000, 512, 40).shape == (40, 257)
    gains = spark.createDataFrame([(1, 0.5), (1, 0.3), (2, 1.0)], "p int, g double")
    assert sorted(r.shared_gain for r in audits.shared_gain(gains, "p", "g").collect()) == [0.3, 0.3, 1.0]
