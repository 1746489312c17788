"""Composite audits of manifests, registries, samples and near-duplicates, and the protocol's freeze and unlock."""

from __future__ import annotations

import hashlib
import json
import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold import checks as C
from lumenfold.operators.identity import label_conflict_count
from lumenfold.operators.metrics import joined_by, quantiles, ratio
from lumenfold.operators.overlap import split_overlaps
from lumenfold.operators.vectors import lsh_nearest
from lumenfold.schema import blank_to_null


def manifest_report(df: DataFrame, ratios: dict[str, float], hashes: list[str], group: str, label: str = "label", split: str = "split", tolerance: float = 0.001) -> DataFrame:
    """name, value, minimum, maximum, passed: hash formats, known splits and labels, one label and one split per group,
    no content in two splits, and the largest error of the splits' shares."""
    share = sum(ratios.values())
    rules = [C.none_where(f"{h} is well formed", ~F.coalesce(F.col(h).rlike(C.SHA256), F.lit(False))) for h in hashes]
    rules += [C.none_where("split is known", ~F.coalesce(F.col(split).isin(list(ratios)), F.lit(False))), C.none_where("label is 0 or 1", ~F.coalesce(F.col(label).isin(0, 1), F.lit(False)))]
    errors = [F.abs(F.count_if(F.col(split) == k) / F.count("*") - r / share) for k, r in ratios.items()]
    rules.append(C.Check("largest error of a split's share", F.greatest(*errors) if len(errors) > 1 else errors[0], at_most=tolerance))
    report = C.run_checks(df, rules)
    groups = df.groupBy(group).agg(F.count_distinct(label).alias("y"), F.count_distinct(split).alias("s"))
    report = report.unionByName(C.run_checks(groups, [C.none_where("one label per group", F.col("y") > 1), C.none_where("one split per group", F.col("s") > 1)]))
    shared = split_overlaps(df, split, hashes[0], list(ratios))
    return report.unionByName(C.run_checks(shared, [C.Check("contents in two splits", F.coalesce(F.sum("overlap"), F.lit(0)), at_most=0)]))


def registry_report(df: DataFrame, key: str = "source_group", independent: str = "independent_from_existing") -> DataFrame:
    """Checks of a source registry: keys there and unique, a label, a licence, and independence stated as true."""
    rules = [C.none_where(f"{key} is there", blank_to_null(key).isNull()), C.unique(f"{key} is unique", key), C.none_where("label is 0 or 1", ~F.coalesce(F.col("label").cast("int").isin(0, 1), F.lit(False)))]
    rules.append(C.none_where("independence is stated", ~F.coalesce(F.lower(F.trim(F.col(independent).cast("string"))) == "true", F.lit(False))))
    return C.run_checks(df, rules)


def assert_disjoint(frames: dict[str, DataFrame], column: str, forbidden: DataFrame | None = None) -> DataFrame:
    """The overlap matrix of named frames (and of each with forbidden hashes), or ValueError naming what overlaps."""
    named = dict(frames) | ({"forbidden": forbidden.withColumnRenamed(forbidden.columns[0], column)} if forbidden is not None else {})
    every = reduce(lambda a, b: a.unionByName(b), [f.select(F.lit(n).alias("role"), F.lower(F.trim(F.col(column).cast("string"))).alias(column)) for n, f in named.items()])
    out = split_overlaps(every, "role", column, list(named))
    bad = out.where("overlap > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r.left_split} and {r.right_split} share {r.overlap}" for r in bad))
    return out


def hash_audit(df: DataFrame, column: str, label: str, known: dict[str, DataFrame]) -> DataFrame:
    """One row: unique hashes, duplicate extra rows, hashes with several labels, and rows found in each known table."""
    one = df.agg(F.count_distinct(column).alias("unique_hashes"), (F.count(column) - F.count_distinct(column)).alias("duplicate_extra_rows"))
    one = one.crossJoin(label_conflict_count(df, column, label))
    for name, table in known.items():
        keys = table.select(F.col(table.columns[0]).alias("_k")).distinct()
        one = one.crossJoin(df.join(keys, F.col(column) == F.col("_k"), "left_semi").agg(F.count("*").alias(f"rows_in_{name}")))
    return one  # one row each


def allocation_counts(df: DataFrame, label: str, split: str, source: str, content: str) -> DataFrame:
    """label, split, rows, sources, contents."""
    return df.groupBy(label, split).agg(F.count("*").alias("rows"), F.count_distinct(source).alias("sources"), F.count_distinct(content).alias("contents"))


def allocation_error(df: DataFrame, label: str, split: str, ratios: dict[str, float]) -> DataFrame:
    """label, error: the largest difference of a split's share of the label's rows from its ratio."""
    share = sum(ratios.values())
    errors = [F.abs(F.count_if(F.col(split) == k) / F.count("*") - r / share) for k, r in ratios.items()]
    return df.groupBy(label).agg((F.greatest(*errors) if len(errors) > 1 else errors[0]).alias("error"))


def source_table(df: DataFrame, source: str, order: str, carried: list[str]) -> DataFrame:
    """source, windows, and carried columns of its first row in the order."""
    return df.groupBy(source).agg(F.count("*").alias("windows"), *[F.min_by(c, order).alias(c) for c in carried])


def joined_lists(df: DataFrame, key: str, columns: list[str], separator: str = "|") -> DataFrame:
    """key, rows, and each column's sorted distinct values in one text (a source has few of them)."""
    return df.groupBy(key).agg(F.count("*").alias("rows"), *[F.concat_ws(separator, F.array_sort(F.collect_set(F.col(c).cast("string")))).alias(c) for c in columns])


def counts_at_or_above(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """threshold, rows at or above it, in one pass."""
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.count_if(F.col(value) >= t).alias("rows")) for t in thresholds])
    return df.agg(each.alias("a")).select(F.explode("a").alias("r")).select("r.*")


def retention(external: DataFrame, internal: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, external, internal, gap (external less internal) and retention (external over internal; null over 0)."""
    both = external.select(*keys, F.col(value).alias("external")).join(internal.select(*keys, F.col(value).alias("internal")), keys)
    return both.withColumn("gap", F.col("external") - F.col("internal")).withColumn("retention", F.try_divide("external", "internal"))


def sampling_audit(draws: DataFrame, label: str, source: str, by: list[str] = ()) -> DataFrame:
    """by, draws, positive_share, sources, largest_source_share of a table of drawn rows."""
    each = draws.groupBy(*by, source).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    return each.groupBy(*by).agg(F.sum("n").alias("draws"), ratio(F.sum("p"), F.sum("n")).alias("positive_share"), F.count("*").alias("sources"), (F.max("n") / F.sum("n")).alias("largest_source_share"))


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """One row: negatives over positives (null without positives)."""
    return df.agg(F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("positive_weight"))


def shared_gain(df: DataFrame, pair: str, gain: str) -> DataFrame:
    """df with shared_gain: the least gain of the conditions of a pair, so that they stay comparable."""
    least = df.groupBy(pair).agg(F.min(gain).alias("shared_gain"))
    return df.join(least, pair)


def similarity_report(df: DataFrame, value: str, by: list[str], thresholds: list[float], shares: tuple[float, ...] = (0.0, 0.5, 0.9, 0.95, 0.99, 1.0)) -> DataFrame:
    """by, rows, found (rows with a value), q0 ... q100 of the values, and at_or_above: (threshold, rows) for each."""
    over = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.count_if(F.col(value) >= t).alias("rows")) for t in thresholds])
    sums = df.groupBy(*by).agg(F.count("*").alias("rows"), F.count(value).alias("found"), over.alias("at_or_above"))
    return joined_by(sums, quantiles(df, value, {f"q{round(100 * s)}": s for s in shares}, by), by)


def near_duplicate_audit(features: DataFrame, key: str, vector: str, split: str, dims: int, queries: list[str], thresholds: list[float], label: str | None = None, **lsh: int) -> DataFrame:
    """One row per query split: rows, found, quantiles of the best similarity to any other split's vector, counts at or
    above thresholds, comparisons, and (with label) how many found neighbours at or above the largest threshold
    share the label."""
    asked, others = features.where(F.col(split).isin(queries)), features.where(~F.col(split).isin(queries))
    carried = [F.col(key).alias("_key"), F.col(split).alias("_split"), *([F.col(label).alias("_label")] if label else [])]
    found = lsh_nearest(asked, others, key, vector, dims, **lsh).join(asked.select(*carried), F.col(key) == F.col("_key"))
    if label:
        found = found.join(others.select(F.col(key).alias("_near"), F.col(label).alias("_other")), F.col("neighbour") == F.col("_near"), "left")
    by = [split]
    found = found.withColumn(split, F.col("_split"))
    same = F.count_if((F.col("similarity") >= max(thresholds)) & (F.col("_label") == F.col("_other"))) if label else F.lit(None).cast("long")
    sums = found.groupBy(*by).agg(F.sum("comparisons").alias("comparisons"), same.alias("same_label"))
    return joined_by(similarity_report(found, "similarity", by, thresholds), sums, by)


def adjacency_audit(pairs: DataFrame, split: str, value: str, thresholds: list[float]) -> DataFrame:
    """similarity_report of adjacent pairs (split, next_split, value) by role: all, within_split, cross_split, and the
    two splits' names joined by two underscores, sorted."""
    a, b = F.col(split), F.col(f"next_{split}")
    named = F.concat_ws("__", F.least(a, b), F.greatest(a, b))
    roles = F.array(F.lit("all"), F.when(a == b, "within_split").otherwise("cross_split"), named)
    return similarity_report(pairs.select(F.explode(F.array_distinct(roles)).alias("role"), value), value, ["role"], thresholds)


def verify_bundle(files: DataFrame, expected: DataFrame) -> DataFrame:
    """path, problem: files (path, length, sha256) against expected ones: missing, then of another size, then of another hash."""
    f = files.select(F.col("path").alias("_path"), F.col("length").alias("_length"), F.lower("sha256").alias("_sha"))
    both = expected.join(f, F.col("path") == F.col("_path"), "left")
    problem = F.when(F.col("_path").isNull(), "missing").when(F.col("_length") != F.col("length"), "size").when(~F.col("_sha").eqNullSafe(F.lower("sha256")), "sha256")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def verify_references(manifest: DataFrame, column: str, files: DataFrame, rows: int, unique: int) -> DataFrame:
    """name, value, minimum, maximum, passed: a manifest's rows, its distinct non-blank paths, and those that are no file."""
    paths = manifest.select(blank_to_null(column).alias("path"))
    distinct = paths.where("path is not null").distinct()
    lost = distinct.join(files.select("path"), "path", "left_anti").agg(F.count("*").alias("lost"))
    one = paths.agg(F.count("*").alias("rows")).join(distinct.agg(F.count("*").alias("paths")), F.lit(True)).join(lost, F.lit(True))  # one row each
    return C.run_checks(one, [C.Check("rows", F.max("rows"), rows, rows), C.Check("unique paths", F.max("paths"), unique, unique), C.Check("paths that are no file", F.max("lost"), at_most=0)])


def domain_report(df: DataFrame, domain: str, label: str, score: str, threshold: float) -> DataFrame:
    """domain, kind, rows, recall, fpr, balanced_accuracy: of pure domains only what their rows define (null: undefined)."""
    y, hit = F.col(label), F.col(score) >= threshold
    p, n = F.count_if(y == 1), F.count_if(y == 0)
    recall, fpr = F.try_divide(F.count_if((y == 1) & hit), p), F.try_divide(F.count_if((y == 0) & hit), n)
    kind = F.when((p > 0) & (n > 0), "binary").when(p > 0, "positive").otherwise("negative")
    return df.groupBy(domain).agg(kind.alias("kind"), F.count("*").alias("rows"), recall.alias("recall"), fpr.alias("fpr"), ((recall + 1 - fpr) / 2).alias("balanced_accuracy"))


def freeze_protocol(paths: list[str], target: str) -> dict:
    """Write the SHA-256 of every file of a protocol once; refuses to freeze again. Driver side."""
    record = {p: hashlib.sha256(open(p, "rb").read()).hexdigest() for p in sorted(paths)}
    with open(target, "x", encoding="utf-8") as f:
        json.dump(record, f, indent=2)
    return record


def verify_protocol(target: str) -> list[str]:
    """Files that changed or went since they were frozen."""
    record = json.loads(open(target, encoding="utf-8").read())
    return [p for p, h in record.items() if not os.path.exists(p) or hashlib.sha256(open(p, "rb").read()).hexdigest() != h]


def consume_once(marker: str, phrase: str, expected: str) -> None:
    """Unlock a one-time evaluation: the phrase has to be right, and the marker mustn't exist yet."""
    if phrase != expected:
        raise PermissionError("the unlock phrase is wrong")
    with open(marker, "x", encoding="utf-8") as f:
        f.write("consumed\n")
