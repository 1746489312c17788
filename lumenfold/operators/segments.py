"""Fixed-length windows over long signals, gaps and islands, and picks by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def expand_segments(df: DataFrame, samples: str, size: int) -> DataFrame:
    """One row per segment: segment_index, start_sample, end_sample, segment_kind.

    A shorter signal is one looped segment, an equal one exact; a longer one has full segments and, if anything
    is left, a looped tail. Signals without samples have none.
    """
    n = F.col(samples)
    kind = F.when(n < size, "loop").when(n == size, "exact").when((F.col("segment_index") + 1) * size <= n, "full").otherwise("tail_loop")
    each = df.where(n > 0).withColumn("segment_index", F.explode(F.sequence(F.lit(0), (F.ceil(n / size) - 1).cast("int"))))
    start = F.col("segment_index").cast("long") * size
    return each.withColumn("start_sample", start).withColumn("end_sample", F.least(start + size, n.cast("long"))).withColumn("segment_kind", kind)


def window_count(samples: Column, rate: Column | int, target_rate: int, size: int) -> Column:
    """Complete windows after resampling: ceil(n * target / rate) div size, in integers."""
    r = F.lit(rate) if isinstance(rate, int) else rate
    scaled = F.floor((samples.cast("long") * target_rate + r - 1) / r)
    return F.floor(scaled / size).cast("long")


def complete_windows(df: DataFrame, samples: str, size: int) -> DataFrame:
    """One row per complete window: window_index, start_sample, end_sample, and the samples left over."""
    n = F.floor(F.col(samples) / size).cast("int")
    each = df.where(F.col(samples) >= size).withColumn("window_index", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("window_index").cast("long") * size
    return each.withColumn("start_sample", start).withColumn("end_sample", start + size).withColumn("left_over", (F.col(samples) % size).cast("long"))


def half_windows(df: DataFrame, index: str, size: int) -> DataFrame:
    """Two half-window views of each row: the index doubled plus the half, with its samples."""
    out = df.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    return out.withColumn(index, F.col(index) * 2 + F.col("half")).withColumn("start_sample", F.col("half") * (size // 2)).withColumn("end_sample", (F.col("half") + 1) * (size // 2))


def islands(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """df's distinct (keys, sequence) with the start of the run of consecutive numbers each is in, and its place there."""
    rows = df.select(*keys, F.col(sequence).cast("long").alias(sequence)).distinct()
    run = F.col(sequence) - F.row_number().over(Window.partitionBy(*keys).orderBy(sequence))
    rows = rows.withColumn("_run", run)
    own = Window.partitionBy(*keys, "_run")
    return rows.withColumn("run_start", F.min(sequence).over(own)).withColumn("place", F.row_number().over(own.orderBy(sequence)) - 1).drop("_run")


def chunks(df: DataFrame, keys: list[str], sequence: str, size: int) -> DataFrame:
    """keys, run_start, chunk, first, last: full groups of size consecutive numbers that cross no gap."""
    rows = islands(df, keys, sequence).withColumn("chunk", F.floor(F.col("place") / size).cast("int"))
    out = rows.groupBy(*keys, "run_start", "chunk").agg(F.min(sequence).alias("first"), F.max(sequence).alias("last"), F.count("*").alias("n"))
    return out.where(F.col("n") == size).drop("n")


def run_summary(df: DataFrame, keys: list[str], sequence: str, size: int) -> DataFrame:
    """keys, runs, longest, clips: how many full groups of size the runs hold."""
    runs = islands(df, keys, sequence).groupBy(*keys, "run_start").agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.max("n").alias("longest"), F.sum(F.floor(F.col("n") / size)).cast("long").alias("clips"))


def adjacent_pairs(df: DataFrame, keys: list[str], number: str, carried: list[str]) -> DataFrame:
    """Pairs of rows of a key whose numbers follow each other: keys, number, next_number, carried and next_ of them."""
    order = Window.partitionBy(*keys).orderBy(number, *carried)
    rows = df.select(*keys, number, *carried).withColumn("next_number", F.lead(number).over(order))
    for c in carried:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))
    return rows.where(F.col("next_number") - F.col(number) == 1)


def numbered(path: Column) -> Column:
    """struct(prefix, number) of names such as drone-12.wav; null where there is no number."""
    name = F.substring_index(path, "/", -1)
    pattern = r"(?i)^(.*?)(\d+)\.wav$"
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).alias("prefix"), F.regexp_extract(name, pattern, 2).cast("long").alias("number")))


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], maximum: int) -> DataFrame:
    """At most maximum rows of each group, evenly spread over its order with both ends."""
    own = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(own.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(own))
    if maximum == 1:
        return rows.where("_i = 0").drop("_i", "_n")
    step = (F.col("_n") - 1) / F.lit(float(maximum - 1))
    # in doubles and step first, as a linear spacing is computed; the last place is exact
    places = F.transform(F.sequence(F.lit(0), F.lit(maximum - 1)), lambda k: F.when(k == maximum - 1, (F.col("_n") - 1).cast("long")).otherwise((k * step).cast("long")))
    return rows.where((F.col("_n") <= maximum) | F.array_contains(places, F.col("_i").cast("long"))).drop("_i", "_n")


def first_middle_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first, middle and last row of each group, with their place."""
    own = Window.partitionBy(*keys)
    rows = df.withColumn("place", F.row_number().over(own.orderBy(*order))).withColumn("_n", F.count("*").over(own))
    return rows.where((F.col("place") == 1) | (F.col("place") == F.floor((F.col("_n") - 1) / 2) + 1) | (F.col("place") == F.col("_n"))).drop("_n")
