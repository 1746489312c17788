"""Content identity: digests, seeded ranks, canonical rows, conflicts and components."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.operators.components import connected_components


def digest_of(*parts: Column) -> Column:
    """SHA-256 of the JSON list of the parts as text."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def seeded_rank(seed: int | str, *parts: Column) -> Column:
    """SHA-256 of seed:part:part, a random but reproducible order."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def unit_interval(digest: Column) -> Column:
    """The first 64 bits of a hex digest as a number in [0, 1]."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(2.0**64)


def _with_groups(df: DataFrame, content: str, order: list[str | Column], *extra: Column) -> DataFrame:
    """df with group_size, _first (the least order of its content) and extra aggregates, by an aggregate joined back.

    A content that many rows have is one row of the aggregate; no window gathers its rows.
    """
    groups = df.groupBy(F.col(content).alias("_content")).agg(F.count("*").alias("group_size"), F.min(F.struct(*order)).alias("_first"), *extra).where("group_size > 1")
    return df.join(groups, F.col(content).eqNullSafe(F.col("_content")), "left").drop("_content").withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))


def _kept(df: DataFrame, content: str, order: list[str | Column]) -> DataFrame:
    """df of _with_groups with kept: the first row of each content; of rows equal in the order any one."""
    leads = F.col("_first").isNull() | F.struct(*order).eqNullSafe(F.col("_first"))
    ties = Window.partitionBy(content).orderBy(*order)
    first = df.where(leads).withColumn("kept", F.row_number().over(ties) == 1)  # the leading rows only
    return first.unionByName(df.where(~leads).withColumn("kept", F.lit(False))).drop("_first")


def canonical_rows(df: DataFrame, content: str, order: list[str | Column]) -> DataFrame:
    """df with group_size, kept: the first row of each content in the (ascending) order is kept."""
    return _kept(_with_groups(df, content, order), content, order)


def duplicate_listing(df: DataFrame, content: str, split: str, order: list[str | Column]) -> DataFrame:
    """Rows whose content occurs again, with group_size, cross_split and kept."""
    rows = _with_groups(df, content, order, (F.min(split) != F.max(split)).alias("cross_split")).where("group_size > 1")
    return _kept(rows.withColumn("cross_split", F.coalesce("cross_split", F.lit(False))), content, order)


def cross_label_keys(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """layer, value: contents with more than one label, in any of the hash columns."""
    each = df.select(label, F.explode(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).cast("string").alias("value")) for c in columns])).alias("r"))
    return each.where("r.value is not null").groupBy("r.layer", "r.value").agg(F.count_distinct(label).alias("n")).where("n > 1").select("layer", "value")


def drop_cross_label(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """df without the rows whose content has more than one label in any of the columns."""
    bad = cross_label_keys(df, columns, label)
    out = df
    for c in columns:
        keys = bad.where(F.col("layer") == c).select(F.col("value").alias("_bad"))
        out = out.join(keys, out[c].cast("string") == F.col("_bad"), "left_anti")
    return out


def linked_components(df: DataFrame, source: str, keys: list[str]) -> DataFrame:
    """source, component: sources that share a value in any key column are one component, named by its smallest source.

    Each value ties its sources to its smallest one, so a common value costs one edge per source, never a pair.
    """
    each = df.select(F.col(source).cast("string").alias("_s"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in keys])).alias("r"))
    tied = each.where("r.v is not null").select("_s", "r.k", "r.v").distinct()
    least = tied.groupBy("k", "v").agg(F.min("_s").alias("_m"), F.count("*").alias("_n")).where("_n > 1")
    edges = tied.join(least, ["k", "v"]).where("_s <> _m").select("_s", "_m")
    comps = connected_components(edges, "_s", "_m")
    every = df.select(F.col(source).cast("string").alias(source)).distinct()
    return every.join(comps, every[source] == comps["node"], "left").select(source, F.coalesce("component", F.col(source)).alias("component"))


def component_digests(components: DataFrame, source: str, prefix: str) -> DataFrame:
    """source, component: named by the SHA-256 of the JSON list of the component's sorted members instead.

    Members come sorted to one task and are hashed as they pass, so a large component takes time but no memory.
    """
    listed = F.to_json(F.array(F.col(source).cast("string")))
    rows = components.select("component", F.col(source).cast("string").alias("_m"), F.substring(listed, F.lit(2), F.length(listed) - 2).alias("item")).distinct()

    def digests(batches):
        held, state = None, None
        for pdf in batches:
            for component, item in zip(pdf["component"], pdf["item"], strict=True):
                if state is None or component != held:
                    if state is not None:
                        yield pd.DataFrame({"_c": [held], "_name": [_closed(state)]})
                    held, state = component, hashlib.sha256(b"[")
                else:
                    state.update(b",")
                state.update(item.encode())
        if state is not None:
            yield pd.DataFrame({"_c": [held], "_name": [_closed(state)]})

    sorted_rows = rows.repartition("component").sortWithinPartitions("component", "_m").select("component", "item")
    kind = dict(components.dtypes)["component"]
    name = sorted_rows.mapInPandas(digests, f"_c {kind}, _name string")
    return components.join(name, F.col("component") == F.col("_c")).select(source, F.concat(F.lit(prefix), "_name").alias("component"))


def _closed(state) -> str:
    """The digest of a list whose items have all been hashed."""
    state.update(b"]")
    return state.hexdigest()


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row, digest: of all rows regardless of their order, without gathering them: sums of four 60-bit parts of
    each row's SHA-256 (of the JSON list of its values as text)."""
    row = df.select(digest_of(*[F.col(c) for c in columns]).alias("h"))
    parts = [F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = row.agg(F.count("*").cast("string").alias("n"), *[F.coalesce(F.sum(p), F.lit(0)).cast("string").alias(f"s{i}") for i, p in enumerate(parts)])
    return sums.select(F.sha2(F.concat_ws(":", "n", *[f"s{i}" for i in range(4)]), 256).alias("digest"))


def verify_hashes(df: DataFrame, content: str, expected: str) -> DataFrame:
    """Rows whose content doesn't have its SHA-256."""
    return df.where(~F.sha2(F.col(content).cast("binary"), 256).eqNullSafe(F.lower(F.col(expected))))


def first_hash_wins(frames: list[DataFrame], content: str) -> DataFrame:
    """The union of frames in which a content of an earlier frame drops later ones (within a frame: the smallest row)."""
    every = None
    for i, f in enumerate(frames):
        g = f.withColumn("_f", F.lit(i))
        every = g if every is None else every.unionByName(g, allowMissingColumns=True)
    own = Window.partitionBy(content).orderBy("_f", F.xxhash64(*[c for c in every.columns if c != "_f"]))
    return every.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r", "_f")


def label_conflict_count(df: DataFrame, content: str, label: str) -> DataFrame:
    """One row, cross_label_groups: contents with more than one label."""
    each = df.where(F.col(content).isNotNull()).groupBy(content).agg(F.count_distinct(label).alias("k"))
    return each.agg(F.count_if(F.col("k") > 1).alias("cross_label_groups"))
