"""Roll-ups from segments to recordings, sources, sessions and events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.operators.metrics import bounded, quantiles, ratio

METHODS = ("mean_probability", "max_probability", "mean_logit_then_sigmoid", "topk_mean_probability", "constrained_autopool_probability")


def _topk_mean(values: Column, fraction: float) -> Column:
    top = F.slice(F.sort_array(values, asc=False), F.lit(1), F.greatest(F.lit(1), F.ceil(F.size(values) * fraction)).cast("int"))
    return F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)


def _autopool(values: Column, cap: float) -> Column:
    """Softmax-weighted mean with the steepest slope at which no instance can weigh more than cap."""
    n = F.size(values)
    alpha = F.log(F.lit(cap / (1 - cap))) + F.log((n - 1).cast("double"))
    top = alpha * F.when(alpha >= 0, F.array_max(values)).otherwise(F.array_min(values))
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("wx"))
    sums = F.aggregate(values, zero, lambda a, x: F.struct((a["w"] + F.exp(alpha * x - top)).alias("w"), (a["wx"] + x * F.exp(alpha * x - top)).alias("wx")))
    fits = (1.0 / n <= cap) & F.lit(cap < 1)
    return F.when(n == 1, values[0]).when(fits, sums["wx"] / sums["w"]).otherwise(F.raise_error(F.lit("the cap on an instance's weight must be at least 1 / windows and below 1")).cast("double"))


def pooled(score: str | Column, method: str = "mean_probability", topk_fraction: float = 0.5, cap: float = 0.5) -> Column:
    """The aggregate of a recording's window scores. Top-k and auto-pool gather one recording's windows, no more."""
    s = F.col(score) if isinstance(score, str) else score
    if method == "mean_probability":
        return F.avg(s)
    if method == "max_probability":
        return F.max(s)
    if method == "mean_logit_then_sigmoid":
        p = bounded(s)
        return 1 / (1 + F.exp(-F.avg(F.log(p / (1 - p)))))
    if method == "topk_mean_probability":
        return _topk_mean(F.collect_list(s), topk_fraction)
    if method == "constrained_autopool_probability":
        return _autopool(F.array_sort(F.collect_list(s)), cap)
    raise ValueError(f"unknown pooling method {method}")


def recordings(df: DataFrame, keys: list[str], score: str, method: str = "mean_probability", index: str | None = None, constant: list[str] = (), **options: float) -> DataFrame:
    """keys, constant columns, windows, score. With index, windows must be 0, 1, 2, ... without gap or repeat;
    constant columns must not vary within a recording. A violation is an error that names the recording."""
    aggs = [F.count("*").alias("windows"), pooled(score, method, **options).alias("score")]
    aggs += [F.min(c).alias(c) for c in constant] + [F.count_distinct(c).alias(f"_n_{c}") for c in constant]
    if index:
        aggs.append(((F.min(index) == 0) & (F.max(index) + 1 == F.count("*")) & (F.count_distinct(index) == F.count("*"))).alias("_whole"))
    out = df.groupBy(*keys).agg(*aggs)
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    checks = [(F.col("_whole"), "windows are not consecutive from 0 in recording ")] if index else []
    checks += [(F.col(f"_n_{c}") == 1, f"{c} varies in recording ") for c in constant]
    score_col = F.col("score")
    for fine, text in reversed(checks):
        score_col = F.when(fine, score_col).otherwise(F.raise_error(F.concat(F.lit(text), name)).cast("double"))
    return out.select(*keys, *constant, "windows", score_col.alias("score"))


def nonoverlap_means(df: DataFrame, keys: list[str], index: str, score: str, windows: int, keep_tail: bool = False) -> DataFrame:
    """keys, decision, windows, score: means of consecutive groups of windows; a short tail goes unless kept."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(index)) - 1
    out = df.withColumn("decision", F.floor(place / windows).cast("int")).groupBy(*keys, "decision").agg(F.count("*").alias("windows"), F.avg(score).alias("score"))
    return out if keep_tail else out.where(F.col("windows") == windows)


def dropped_windows(df: DataFrame, keys: list[str], windows: int) -> DataFrame:
    """How many windows nonoverlap_means leaves out of each recording."""
    return df.groupBy(*keys).agg((F.count("*") % windows).alias("dropped")).where("dropped > 0")


def level_rates(df: DataFrame, score: str, threshold: float, levels: dict[str, tuple[list[str], str]]) -> DataFrame:
    """level, units, hits, rate: each level groups by its keys and pools by max or mean; no keys: the rows themselves."""
    out = None
    for name, (keys, how) in levels.items():
        rows = df.groupBy(*keys).agg((F.max(score) if how == "max" else F.avg(score)).alias("_s")) if keys else df.select(F.col(score).alias("_s"))
        one = rows.agg(F.count("*").alias("units"), F.count_if(F.col("_s") >= threshold).alias("hits")).select(F.lit(name).alias("level"), "units", "hits", ratio(F.col("hits"), F.col("units")).alias("rate"))
        out = one if out is None else out.unionByName(one)
    return out


def three_levels(df: DataFrame, segment_keys: list[str], recording_keys: list[str], event_keys: list[str], score: str, threshold: float) -> DataFrame:
    """event_keys, recordings, mean, recall: segments averaged to recordings, recordings to events."""
    rec = df.groupBy(*event_keys, *[k for k in recording_keys if k not in event_keys]).agg(F.avg(score).alias("_r"))
    return rec.groupBy(*event_keys).agg(F.count("*").alias("recordings"), F.avg("_r").alias("mean"), F.avg((F.col("_r") >= threshold).cast("double")).alias("recall"))


def session_macro(df: DataFrame, session: str, score: str, threshold: float, by: list[str] = ()) -> DataFrame:
    """Mean, worst and best over sessions of the share of rows at or above the threshold."""
    each = df.groupBy(*by, session).agg(F.avg((F.col(score) >= threshold).cast("double")).alias("_f"))
    return each.groupBy(*by).agg(F.count("*").alias("sessions"), F.avg("_f").alias("mean_fpr"), F.max("_f").alias("worst_fpr"), F.min("_f").alias("best_fpr"))


def any_mean_both(df: DataFrame, keys: list[str], score: str, threshold: float) -> DataFrame:
    """keys with whether any, the mean of, and all windows reach the threshold."""
    return df.groupBy(*keys).agg((F.max(score) >= threshold).alias("any_hit"), (F.avg(score) >= threshold).alias("mean_hit"), (F.min(score) >= threshold).alias("all_hit"))


def mean_vectors(df: DataFrame, keys: list[str], vector: str, spread: bool = False) -> DataFrame:
    """keys, vector: the mean of vectors by group, and with spread the population deviations behind it."""
    each = df.select(*keys, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.stddev_pop(F.col("_x").cast("double")).alias("_d"))
    gathered = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_m", "_d"))).alias("_all"))
    mean = F.transform("_all", lambda r: r["_m"])
    return gathered.select(*keys, (F.concat(mean, F.transform("_all", lambda r: r["_d"])) if spread else mean).alias("vector"))


def zero_filled_counts(df: DataFrame, a: str, b: str, a_values: list, b_values: list) -> DataFrame:
    """Counts by a, by b, by both and in all (null: any), with zeros for cells without rows."""
    spark = df.sparkSession
    cells = [(x, y) for x in [*a_values, None] for y in [*b_values, None]]
    kinds = dict(df.dtypes)
    domain = spark.createDataFrame(cells, f"a {kinds[a]}, b {kinds[b]}")
    found = df.where(F.col(a).isin(a_values) & F.col(b).isin(b_values)).cube(F.col(a).alias("ca"), F.col(b).alias("cb")).agg(F.count("*").alias("n"))
    joined = F.broadcast(domain).join(found, F.col("a").eqNullSafe(F.col("ca")) & F.col("b").eqNullSafe(F.col("cb")), "left")
    return joined.select(F.col("a").alias(a), F.col("b").alias(b), F.coalesce("n", F.lit(0)).alias("rows"))


def label_purity(df: DataFrame, group: str, label: str) -> DataFrame:
    """groups, pure_groups, rows, rows_in_pure, purity: how often a group (null excluded) has one label."""
    each = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(label).alias("k"))
    return each.agg(F.count("*").alias("groups"), F.count_if(F.col("k") == 1).alias("pure_groups"), F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("n"))), F.lit(0)).alias("rows_in_pure")).withColumn("purity", ratio(F.col("rows_in_pure"), F.col("rows")))


def majority_lookup(known: DataFrame, asked: DataFrame, group: str, label: str) -> DataFrame:
    """rows, covered, coverage, accuracy of labelling asked rows by their group's majority label in known (ties: smaller)."""
    votes = known.where(F.col(group).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    major = votes.groupBy(group).agg(F.min_by(label, F.struct((-F.col("n")).alias("n"), F.col(label))).alias("_guess"))
    joined = asked.join(major, group, "left")
    hit = F.col("_guess") == F.col(label)
    return joined.agg(F.count("*").alias("rows"), F.count("_guess").alias("covered"), F.count_if(hit).alias("_right")).select("rows", "covered", ratio(F.col("covered"), F.col("rows")).alias("coverage"), ratio(F.col("_right"), F.col("covered")).alias("accuracy"))


def error_concentration(df: DataFrame, wrong: Column, group: str, top: int = 10) -> DataFrame:
    """The groups with most errors: place, group, errors, share of all errors, share of the first three."""
    each = df.where(wrong).groupBy(group).agg(F.count("*").alias("errors"))
    total = each.agg(F.sum("errors").alias("_all"))
    ranked = each.orderBy(F.desc("errors"), group).limit(top)  # then a handful of rows
    place = Window.orderBy(F.desc("errors"), group)
    out = ranked.withColumn("place", F.row_number().over(place)).crossJoin(F.broadcast(total))
    out = out.withColumn("share", F.col("errors") / F.col("_all"))
    return out.select("place", group, "errors", "share", F.sum(F.when(F.col("place") <= 3, F.col("share"))).over(Window.partitionBy()).alias("top3_share"))


def margin_buckets(df: DataFrame, score: str, threshold: float, wrong: Column, edges: tuple[float, ...] = (0.0, 0.02, 0.05, 0.1, 0.2)) -> DataFrame:
    """bucket, rows, errors, error_rate by distance of the score from the threshold."""
    gap = F.abs(F.col(score) - threshold)
    which = F.lit(0)
    for i, e in enumerate(edges[1:], 1):
        which = F.when(gap >= e, i).otherwise(which)
    return df.groupBy(which.alias("bucket")).agg(F.count("*").alias("rows"), F.count_if(wrong).alias("errors")).withColumn("error_rate", F.col("errors") / F.col("rows"))


def explained_share(df: DataFrame, value: str, source: str) -> DataFrame:
    """eta_squared: variance between sources over all variance, from sums alone."""
    each = df.where(F.col(value).isNotNull() & F.col(source).isNotNull()).groupBy(source).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    grand = each.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("square"))
    between = F.col("square") - F.col("n") * F.col("m") * F.col("m")
    return grand.select(F.col("n").alias("rows"), ratio(between, between + F.col("within")).alias("eta_squared"))


def quantile_block(df: DataFrame, value: str, by: list[str] = (), shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99, 1.0)) -> DataFrame:
    """Exact interpolated quantiles of the finite values by group, one column each (q50, q90, ...)."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return quantiles(rows, value, {f"q{round(100 * s)}": s for s in shares}, by)


def monotone_by_condition(df: DataFrame, key: str, condition: str, value: str, slack: float = 1e-6) -> DataFrame:
    """key, conditions, monotone, spread: whether the value never falls as the condition rises."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(condition))
    rows = df.withColumn("_d", step)
    return rows.groupBy(key).agg(F.count("*").alias("conditions"), F.bool_and(F.coalesce(F.col("_d") >= -slack, F.lit(True))).alias("monotone"), (F.max(value) - F.min(value)).alias("spread"))


def seed_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, mean, sample_std (0 for one), minimum, maximum of the finite values."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sample_std"), F.min(v).alias("minimum"), F.max(v).alias("maximum"))


def numeric_leaves(df: DataFrame, document: str, keys: list[str] = ()) -> DataFrame:
    """keys, path, value of every number in a JSON document, however nested (paths as a.b[0].c)."""
    return df.select(*keys, F.explode(_leaves(F.col(document))).alias("r")).select(*keys, "r.path", "r.value")


def _leaves(document: Column) -> Column:
    import json

    @F.pandas_udf("array<struct<path:string,value:double>>")
    def walk(texts: pd.Series) -> pd.Series:
        return pd.Series([leaves(t) for t in texts], dtype=object)

    def leaves(text):
        found = []

        def go(x, path):
            if isinstance(x, dict):
                for k in sorted(x):
                    go(x[k], f"{path}.{k}" if path else k)
            elif isinstance(x, list):
                for i, v in enumerate(x):
                    go(v, f"{path}[{i}]")
            elif isinstance(x, int | float) and not isinstance(x, bool):
                found.append({"path": path, "value": float(x)})

        if text:
            go(json.loads(text), "")
        return found

    return walk(document)
