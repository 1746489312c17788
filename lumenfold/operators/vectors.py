"""Vectors as array columns: products, neighbours, prototypes, class-conditional boundaries, near-duplicate retrieval."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector is an error."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.raise_error(F.lit("a zero vector has no direction")).cast("double")))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def msp(logits: Column) -> Column:
    """The largest softmax probability."""
    return F.array_max(softmax(logits))


def energy(logits: Column, temperature: float = 1.0) -> Column:
    """T * log(sum(exp(x / T))) without overflow."""
    top = F.array_max(logits).cast("double")
    return top + temperature * F.log(F.aggregate(F.transform(logits, lambda x: F.exp((x.cast("double") - top) / temperature)), F.lit(0.0), lambda s, x: s + x))


def standardised(scores: Column, floor: float = 1e-6) -> Column:
    """Scores less their mean, over their population deviation (at least floor)."""
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.sqrt(F.aggregate(scores, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    return F.transform(scores, lambda x: (x - mean) / F.greatest(spread, F.lit(floor)))


def fused(a: Column, b: Column, weight: float) -> Column:
    """(1 - weight) of a's standardised scores and weight of b's."""
    return F.zip_with(standardised(a), standardised(b), lambda x, y: x * (1 - weight) + y * weight)


def normalised_entropy(p: Column) -> Column:
    """Entropy over its maximum; 0 for one outcome."""
    h = F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return F.when(F.size(p) > 1, h / F.log(F.size(p).cast("double"))).otherwise(0.0)


def prototypes(df: DataFrame, label: str, vector: str) -> DataFrame:
    """label, prototype: the mean of each class's vectors at length 1, by coordinate sums."""
    each = df.select(label, F.posexplode(unit(F.col(vector))).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("m"))
    return each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda r: r["m"]).alias("prototype"))


#: Numbers of all prototypes together that are sent to every task.
MAX_PROTOTYPES = 4_000_000


def nearest_prototype(df: DataFrame, vector: str, protos: DataFrame, label: str) -> DataFrame:
    """df with predicted and similarity: the class of the largest cosine; ties: the smaller.

    Prototypes are broadcast, one row a class, and more than MAX_PROTOTYPES numbers of them are an error.
    """
    size = protos.agg(F.coalesce(F.sum(F.size("prototype")), F.lit(0)).alias("n")).first().n
    if size > MAX_PROTOTYPES:
        raise ValueError(f"{size} numbers of prototypes are more than are sent to every task; use cosine_topk")
    table = F.broadcast(protos.agg(F.array_sort(F.collect_list(F.struct(label, "prototype"))).alias("_all")))
    scored = df.crossJoin(table)
    sims = F.transform("_all", lambda r: F.struct(cosine(F.col(vector), r["prototype"]).alias("s"), r[label].alias("c")))
    best = F.aggregate(sims, F.struct(F.lit(float("-inf")).alias("s"), F.lit(None).cast(dict(protos.dtypes)[label]).alias("c")), lambda a, x: F.when(x["s"] > a["s"], x).otherwise(a))
    return scored.withColumn("_b", best).withColumn("predicted", F.col("_b.c")).withColumn("similarity", F.col("_b.s")).drop("_all", "_b")


def _meet(queries: DataFrame, references: DataFrame, on: list[str], block: int = 4096):
    """Queries and references (each with key, v and the columns on) cogrouped so that every pair that agrees on on
    meets once, in groups of about block queries and block references at most, however common a value is."""
    sizes = queries.groupBy(*on).agg(F.ceil(F.count("*") / block).alias("_qn")).join(references.groupBy(*on).agg(F.ceil(F.count("*") / block).alias("_rn")), on)
    deal = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = queries.join(sizes, on).withColumn("_q", deal("_qn")).withColumn("_r", every("_rn")).drop("_qn", "_rn")
    r = references.join(sizes, on).withColumn("_r", deal("_rn")).withColumn("_q", every("_qn")).drop("_qn", "_rn")
    keys = [*on, "_q", "_r"]
    return q.groupBy(*keys).cogroup(r.groupBy(*keys))


def _best_of_block(k: int):
    """key, neighbour, s: a block's k largest cosines of each query, itself excluded."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"key": pd.Series(dtype="int64"), "neighbour": pd.Series(dtype="int64"), "s": pd.Series(dtype=float)})
        x, y = (np.stack(f["v"].to_numpy()).astype(float) for f in (a, b))
        x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
        out, own, names = [], a["key"].to_numpy(), b["key"].to_numpy()
        for i in range(0, len(x), 1024):
            s = x[i : i + 1024] @ y.T
            s[own[i : i + 1024, None] == names[None, :]] = -np.inf
            n = min(k + 1, s.shape[1])
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            out.append(pd.DataFrame({"key": np.repeat(own[i : i + 1024], n), "neighbour": names[top].ravel(), "s": np.take_along_axis(s, top, 1).ravel()}))
        found = pd.concat(out)
        return found[np.isfinite(found["s"])]

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.round("s", 9)), "neighbour"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def class_knn(queries: DataFrame, references: DataFrame, key: str, predicted: str, label: str, vector: str, k: int) -> DataFrame:
    """key, score: the mean of the k largest cosines to references of the predicted class, mapped to [0, 1].

    A query is no reference of itself. A class with fewer than k references of a query is an error. Vectors are
    taken as they are; project both sides first for neighbours in a centred space (see projected).
    """
    q = queries.select(F.col(predicted).alias("c"), F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    r = references.select(F.col(label).alias("c"), F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    found = _meet(q, r, ["c"]).applyInPandas(_best_of_block(k), "key long, neighbour long, s double")
    sums = _ranked(found, k).groupBy(F.col("key").alias(key)).agg(((F.avg("s") + 1) / 2).alias("score"), F.count("*").alias("_n"))
    few = F.raise_error(F.lit(f"a predicted class has fewer than {k} references")).cast("double")
    return sums.select(key, F.when(F.col("_n") < k, few).otherwise(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))).alias("score"))


def cosine_topk(queries: DataFrame, references: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """key, place, neighbour, similarity: exact nearest references of each query, itself excluded.

    Every block of references meets every block of queries in numpy and sends its own k best.
    """
    q, r = (d.select(F.lit(0).alias("c"), F.col(key).cast("long").alias("key"), F.col(vector).alias("v")) for d in (queries, references))
    found = _meet(q, r, ["c"]).applyInPandas(_best_of_block(k), "key long, neighbour long, s double")
    return _ranked(found, k).select(F.col("key").alias(key), "place", "neighbour", F.col("s").alias("similarity"))


def planes(tables: int, bits: int, dims: int, seed: int) -> np.ndarray:
    """Random hyperplanes: tables x bits x dims."""
    return np.random.default_rng(seed).standard_normal((tables, bits, dims))


def lsh_signatures(df: DataFrame, key: str, vector: str, dims: int, tables: int = 8, bits: int = 18, seed: int = 20260804) -> DataFrame:
    """key, table, signature, vector (length 1): one row per table; equal vectors have equal signatures."""
    p = planes(tables, bits, dims, seed)

    @F.pandas_udf("array<long>")
    def signs(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        x = np.stack(v.to_numpy()).astype(float)
        out = np.stack([((x @ t.T) >= 0) @ (1 << np.arange(bits)) for t in p], 1)
        return pd.Series(list(out))

    return df.select(key, unit(F.col(vector)).alias("vector")).withColumn("_s", signs("vector")).select(key, "vector", F.posexplode("_s").alias("table", "signature"))


def lsh_nearest(queries: DataFrame, references: DataFrame, key: str, vector: str, dims: int, tables: int = 8, bits: int = 18, seed: int = 20260804) -> DataFrame:
    """key, neighbour, similarity, comparisons: the best other reference that shares a signature with the query (null if none).

    A signature's references and queries meet in numpy blocks; one candidate per query and block leaves them.
    """

    def signed(df: DataFrame) -> DataFrame:
        return lsh_signatures(df, key, vector, dims, tables, bits, seed).select(F.col(key).cast("long").alias("key"), F.col("vector").alias("v"), "table", "signature")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"k": pd.Series(dtype="int64"), "neighbour": pd.Series(dtype="int64"), "similarity": pd.Series(dtype=float), "comparisons": pd.Series(dtype="int64")})
        b = b.sort_values("key", kind="stable")
        ref, names, out = np.stack(b["v"].to_numpy()), b["key"].to_numpy(), []
        for i in range(0, len(a), 1024):
            own = a["key"].to_numpy()[i : i + 1024]
            s = np.round(np.stack(a["v"].to_numpy()[i : i + 1024]) @ ref.T, 12)
            same = own[:, None] == names[None, :]
            s[same] = -np.inf
            top = s.argmax(1)
            out.append(pd.DataFrame({"k": own, "neighbour": names[top], "similarity": np.take_along_axis(s, top[:, None], 1)[:, 0], "comparisons": len(names) - same.sum(1)}))
        found = pd.concat(out)
        return found[found["comparisons"] > 0]

    found = _meet(signed(queries), signed(references), ["table", "signature"]).applyInPandas(best, "k long, neighbour long, similarity double, comparisons long")
    sums = found.groupBy("k").agg(F.max_by("neighbour", F.struct("similarity", (-F.col("neighbour")).alias("n"))).alias("neighbour"), F.max("similarity").alias("similarity"), F.sum("comparisons").alias("comparisons"))
    return queries.select(F.col(key).cast("long").alias(key)).join(sums, F.col(key) == F.col("k"), "left").select(key, "neighbour", "similarity", F.coalesce("comparisons", F.lit(0)).alias("comparisons"))


@dataclass
class Boundary:
    """A projection, and a centre and precision per class."""

    classes: list[int]
    mean: np.ndarray
    components: np.ndarray
    centres: np.ndarray
    precisions: np.ndarray


def _moments(df: DataFrame, vector: str, by: str) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """class -> n, sum and matrix of products, from per-partition sums added up entry by entry."""

    def local(batches):
        held: dict = {}
        for pdf in batches:
            for c, g in pdf.groupby("c"):
                x = np.stack(g["v"].to_numpy()).astype(float)
                n, s, m = held.get(c, (0, 0.0, 0.0))
                held[c] = (n + len(x), s + x.sum(0), m + x.T @ x)
        for c, (n, s, m) in held.items():
            x = np.concatenate([[n], s, m.ravel()])
            yield pd.DataFrame({"c": c, "i": np.arange(len(x)), "x": x})

    rows = df.select(F.col(by).cast("int").alias("c"), F.col(vector).alias("v")).mapInPandas(local, "c int, i int, x double")
    sums = rows.groupBy("c", "i").agg(F.sum("x").alias("x")).orderBy("c", "i").toPandas()  # classes x (dims + 1)^2 or so
    out = {}
    for c, g in sums.groupby("c"):
        x = g["x"].to_numpy()
        d = int((np.sqrt(4 * len(x) - 3) - 1) / 2)
        out[int(c)] = (int(x[0]), x[1 : d + 1], x[d + 1 :].reshape(d, d))
    return out


@dataclass
class Projection:
    """The centre and the principal axes of vectors."""

    mean: np.ndarray
    components: np.ndarray


def _axes(stats: dict[int, tuple[int, np.ndarray, np.ndarray]], components: int) -> Projection:
    total = sum(n for n, _, _ in stats.values())
    mean = sum(s for _, s, _ in stats.values()) / total
    scatter = sum(m for _, _, m in stats.values()) / total - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(scatter)
    axes = vectors[:, np.argsort(values)[::-1][:components]].T
    return Projection(mean, axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None])


def fit_projection(df: DataFrame, vector: str, components: int) -> Projection:
    """The principal axes of all vectors, largest variance first; the largest entry of each is positive."""
    stats = _moments(df.select(F.lit(0).alias("_all"), F.col(vector).alias(vector)), vector, "_all")
    if not stats or not 1 <= components <= len(next(iter(stats.values()))[1]):
        raise ValueError("there are no vectors, or not so many axes")
    return _axes(stats, components)


def projected(projection: Projection):
    """A pandas UDF: the centred vector along the axes."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(list((np.stack(v.to_numpy()).astype(float) - projection.mean) @ projection.components.T))

    return run


def fit_boundary(df: DataFrame, vector: str, label: str, components: int) -> Boundary:
    """PCA of all vectors, and an OAS-shrunk Gaussian per class in the projected space."""
    stats = _moments(df, vector, label)
    if any(n < 2 for n, _, _ in stats.values()):
        raise ValueError("every class needs at least two vectors")
    space = _axes(stats, components)
    mean, axes = space.mean, space.components
    centres, precisions = [], []
    for n, s, m in stats.values():
        mu = s / n
        cov = axes @ (m / n - np.outer(mu, mu)) @ axes.T
        p = len(cov)
        spread, square = np.trace(cov) / p, (cov**2).mean()
        top, bottom = square + spread**2, (n + 1.0) * (square - spread**2 / p)
        shrink = 1.0 if bottom == 0 else min(top / bottom, 1.0)
        precisions.append(np.linalg.inv((1 - shrink) * cov + shrink * spread * np.eye(p)))
        centres.append(axes @ (mu - mean))
    return Boundary(list(stats), mean, axes, np.array(centres), np.array(precisions))


def boundary_distance(boundary: Boundary):
    """A pandas UDF of (vector, class): the Mahalanobis distance over the number of components."""

    @F.pandas_udf("double")
    def distance(v: pd.Series, c: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        z = (np.stack(v.to_numpy()).astype(float) - boundary.mean) @ boundary.components.T
        i = np.array([boundary.classes.index(k) for k in c])
        off = z - boundary.centres[i]
        return pd.Series(np.einsum("ni,nij,nj->n", off, boundary.precisions[i], off) / z.shape[1])

    return distance


def hierarchical_decision(detector: Column, confidence: Column, predicted: Column, threshold: float, known: float) -> Column:
    """struct(decision, class): background, unknown or known; the class only where known."""
    decision = F.when(detector < threshold, "background").when(confidence < known, "unknown").otherwise("known")
    return F.struct(decision.alias("decision"), F.when((detector >= threshold) & (confidence >= known), predicted).alias("class"))


def save_boundary(boundary: Boundary, spark, path: str, identity: str) -> None:
    """The boundary as a Parquet table of its parts, bound to the identity (a digest) of what it was fitted on."""
    rows = [("classes", [float(c) for c in boundary.classes], [len(boundary.classes)])]
    rows += [(n, getattr(boundary, n).ravel().tolist(), list(getattr(boundary, n).shape)) for n in ("mean", "components", "centres", "precisions")]
    df = spark.createDataFrame(rows, "part string, numbers array<double>, shape array<int>").withColumn("identity", F.lit(identity))
    df.coalesce(1).write.mode("errorifexists").parquet(path)


def load_boundary(spark, path: str, identity: str) -> Boundary:
    """The boundary, if it is bound to the identity."""
    rows = {r.part: r for r in spark.read.parquet(path).collect()}
    if {r.identity for r in rows.values()} != {identity}:
        raise ValueError("the boundary belongs to another fit")
    get = lambda n: np.array(rows[n].numbers).reshape(rows[n].shape)
    return Boundary([int(c) for c in rows["classes"].numbers], get("mean"), get("components"), get("centres"), get("precisions"))


def masked_softmax(logits: Column, mask: Column) -> Column:
    """Softmax over the entries whose mask is true; the others are 0; all masked: zeros."""
    kept = F.zip_with(logits, mask, lambda x, m: F.when(m, x.cast("double")))
    top = F.array_max(kept)
    e = F.transform(kept, lambda x: F.when(x.isNotNull(), F.exp(x - top)).otherwise(0.0))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: F.when(total > 0, x / total).otherwise(0.0))


@dataclass
class LinearHead:
    """Standardisation and weights of a logistic outlier head, and the projection before them, if there is one."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    intercept: float
    space: Projection | None = None


def fit_linear_head(df: DataFrame, vector: str, label: str, regularisation: float = 0.1, components: int | None = None) -> LinearHead:
    """A class-balanced logistic regression on standardised vectors, by Spark's own solver.

    With components, vectors are first projected on the principal axes of those labelled 1.
    """
    space = fit_projection(df.where(F.col(label) == 1), vector, components) if components else None
    if space:
        df = df.withColumn(vector, projected(space)(vector))
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    sizes = {r[0]: r[1] for r in df.groupBy(label).agg(F.count("*")).collect()}
    total = sum(sizes.values())
    weight = F.coalesce(*[F.when(F.col(label) == y, total / (len(sizes) * n)) for y, n in sizes.items()])
    rows = df.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("x"), F.col(label).cast("double").alias("y"), weight.alias("w"))
    scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True).fit(rows)
    model = LogisticRegression(featuresCol="z", labelCol="y", weightCol="w", regParam=regularisation, standardization=False, maxIter=100).fit(scaler.transform(rows))
    return LinearHead(scaler.mean.toArray().tolist(), np.maximum(scaler.std.toArray(), 1e-12).tolist(), model.coefficients.toArray().tolist(), float(model.intercept), space)


def head_score(head: LinearHead, vector: Column) -> Column:
    """The head's probability of label 1, by dot products."""
    w = np.array(head.weights) / np.array(head.scale)
    offset = head.intercept - float(w @ np.array(head.mean))
    if head.space:  # the projection is linear too
        w = w @ head.space.components
        offset -= float(w @ head.space.mean)
    z = dot(F.array(*[F.lit(float(x)) for x in w]), vector) + offset
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
