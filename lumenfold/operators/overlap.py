"""Set operations and keyed matches between splits, roles and frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.operators.metrics import joined_by
from lumenfold.runtime import cut
from lumenfold.schema import blank_to_null, normal


def split_overlaps(df: DataFrame, split: str, value: str, splits: list[str]) -> DataFrame:
    """left_split, right_split, overlap: distinct shared non-blank values of every pair of splits, zeros too.

    Values are reduced to the set of splits they occur in, so no pair of rows is ever formed.
    """
    v = blank_to_null(value)
    sets = df.where(v.isNotNull() & F.col(split).isin(splits)).groupBy(v.alias("_v")).agg(F.collect_set(split).alias("_in"))
    pairs = [(a, b) for i, a in enumerate(splits) for b in splits[i + 1 :]]
    counts = sets.agg(F.array(*[F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), F.count_if(F.array_contains("_in", a) & F.array_contains("_in", b)).alias("overlap")) for a, b in pairs]).alias("r"))
    return counts.select(F.explode("r").alias("r")).select("r.*")


def exact_overlap(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> DataFrame:
    """One row, overlap: distinct values (trimmed, lower case, not blank) on both sides."""
    a = left.select(normal(left_column).alias("v")).where("v is not null")
    b = right.select(normal(right_column).alias("v")).where("v is not null")
    return a.intersect(b).agg(F.count("*").alias("overlap"))


def named_union(frames: dict[str, DataFrame], role: str = "role") -> DataFrame:
    """All frames with their name as a column; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(role, F.lit(name)) for name, df in frames.items()])


def set_differences(observed: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    """key, side: keys on one side only ("unregistered" or "unobserved")."""
    a, b = observed.select(key).distinct(), registered.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("unregistered")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unobserved")))


def many_to_one(facts: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails where the dimension repeats a key (null keys never match)."""
    size = F.count("*")
    once = dimension.groupBy(*keys).agg(*[F.first(c).alias(c) for c in dimension.columns if c not in keys], size.alias("_n"))
    checked = once.withColumn("_n", F.when(F.col("_n") == 1, 1).otherwise(F.raise_error(F.concat(F.lit("the dimension repeats the key "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))).cast("int")))
    return facts.join(checked.where("_n = 1").drop("_n"), keys, "left")


def identity_mismatches(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, problem: rows missing on a side, or that differ in a column (null equals null)."""
    a = left.select(F.col(key).alias("_a"), F.struct(*columns).alias("_x"))
    b = right.select(F.col(key).alias("_b"), F.struct(*columns).alias("_y"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    same = reduce(lambda p, q: p & q, [F.col(f"_x.{c}").eqNullSafe(F.col(f"_y.{c}")) for c in columns])
    problem = F.when(F.col("_a").isNull(), "left_missing").when(F.col("_b").isNull(), "right_missing").when(~same, "different")
    return both.select(F.coalesce("_a", "_b").alias(key), problem.alias("problem")).where("problem is not null")


def layered_matches(left: DataFrame, right: DataFrame, left_key: str, right_key: str, layers: list[str]) -> DataFrame:
    """left_key, right_key, match_layer: matches on any of several identity columns, by one join of both sides unpivoted."""

    def long(df: DataFrame, key: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("match_layer"), blank_to_null(c).alias("v")) for c in layers]))
        return df.select(F.col(key), each.alias("r")).select(key, "r.match_layer", "r.v").where("v is not null")

    b = long(right, right_key)
    b = b.withColumnRenamed(right_key, "_right") if left_key == right_key else b.withColumnRenamed(right_key, "_right")
    return long(left, left_key).join(b, ["match_layer", "v"]).select(left_key, F.col("_right").alias(right_key if right_key != left_key else f"right_{right_key}"), "match_layer")


def ensemble_mean(frames: list[DataFrame], key: str, value: str) -> DataFrame:
    """key, value averaged over all frames; a key that isn't once in each frame is an error."""
    n = len(frames)
    rows = reduce(lambda a, b: a.unionByName(b), [f.select(key, F.col(value).cast("double").alias(value), F.lit(i).alias("_f")) for i, f in enumerate(frames)])
    sums = rows.groupBy(key).agg(F.avg(value).alias(value), F.count("*").alias("_n"), F.count_distinct("_f").alias("_k"))
    fine = (F.col("_n") == n) & (F.col("_k") == n)
    return sums.select(key, F.when(fine, F.col(value)).otherwise(F.raise_error(F.concat(F.lit("not once in every frame: "), F.col(key).cast("string"))).cast("double")).alias(value))


def zip_by_rank(left: DataFrame, right: DataFrame, left_order: list, right_order: list, partition: list[str] = ()) -> DataFrame:
    """The i-th row of one side beside the i-th of the other, by partition; what has no partner goes."""
    return ranked(left, left_order, partition).join(ranked(right, right_order, partition), [*partition, "pair"])


def ranked(df: DataFrame, order: list, partition: list[str] = (), name: str = "pair") -> DataFrame:
    """df with its place (from 1) in the order, by partition, in two levels.

    Rows are sorted in ranges of partition and order; a range's rows are numbered there, and the rows of the
    ranges before it are added. So no partition, and without any not the whole table, is sorted in one task.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keys = [*partition, *names]
    rows = df.select("*", *[o.alias(n) if isinstance(o, Column) else F.col(o).alias(n) for o, n in zip(order, names, strict=True)])
    rows = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id()))
    own, before = Window.partitionBy("_range", *partition).orderBy(*names), Window.partitionBy(*partition).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_range", *partition).agg(F.count("*").alias("_n"))  # a row a range and partition in it
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = joined_by(rows.withColumn(name, F.row_number().over(own)), offsets, ["_range", *partition])
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before", *names)


def condition_grid(df: DataFrame, name: str, values: list[float]) -> DataFrame:
    """Every row under every condition of a fixed list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails where either side repeats a key, or a left row finds no partner."""
    sizes = left.groupBy(*keys).agg(F.count("*").alias("_l"))
    checked = many_to_one(left.join(sizes, keys), right.withColumn("_r", F.lit(1)), keys)
    fine = (F.col("_l") == 1) & F.col("_r").isNotNull()
    return checked.where(F.when(fine, True).otherwise(F.raise_error(F.lit("the sides don't match one to one")).cast("boolean"))).drop("_l", "_r")
