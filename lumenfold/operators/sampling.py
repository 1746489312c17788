"""Splits, allocations and balanced samples, reproducible by hashes instead of random streams."""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.operators.identity import seeded_rank, unit_interval


def _rank_of(*parts: object) -> str:
    return hashlib.sha256(":".join(str(p) for p in parts).encode()).hexdigest()


def allocate(total: int, ratios: dict[str, float]) -> dict[str, int]:
    """Whole counts by largest remainder; ties go to the earlier name."""
    if not ratios or any(not r >= 0 or r == float("inf") for r in ratios.values()) or sum(ratios.values()) <= 0:
        raise ValueError("ratios must be finite, not negative and not all zero")
    share = sum(ratios.values())
    raw = {k: total * (r / share) for k, r in ratios.items()}
    out = {k: int(v) for k, v in raw.items()}
    names = list(ratios)
    for k in sorted(names, key=lambda k: (-(raw[k] - out[k]), names.index(k)))[: total - sum(out.values())]:
        out[k] += 1
    return out


def allocate_rows(df: DataFrame, by: list[str], ratios: dict[str, float]) -> DataFrame:
    """by, split, rows, target: the group's rows shared out by largest remainder, as one row per split."""
    share = sum(ratios.values())
    sizes = df.groupBy(*by).agg(F.count("*").alias("rows"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("split"), F.lit(i).alias("i"), (F.col("rows") * F.lit(r / share)).alias("raw")) for i, (k, r) in enumerate(ratios.items())]))
    out = sizes.withColumn("r", each).select(*by, "rows", "r.*").withColumn("base", F.floor("raw"))
    whole = Window.partitionBy(*by)
    left = F.col("rows") - F.sum("base").over(whole)
    place = F.row_number().over(whole.orderBy(F.desc(F.col("raw") - F.col("base")), "i"))
    return out.withColumn("target", F.col("base") + (place <= left).cast("long")).select(*by, "split", "rows", "target")


def hash_split(df: DataFrame, key: str, ratios: dict[str, float], seed: int) -> DataFrame:
    """df with split: each key by its seeded digest's place in [0, 1)."""
    share, at, out = sum(ratios.values()), 0.0, F.lit(list(ratios)[-1])
    u = unit_interval(seeded_rank(seed, F.col(key)))
    bounds = []
    for k, r in ratios.items():
        at += r / share
        bounds.append((k, at))
    for k, b in reversed(bounds[:-1]):
        out = F.when(u < b, k).otherwise(out)
    return df.withColumn("split", out)


def ranked_split(df: DataFrame, key: str, group: str, ratios: dict[str, float], seed: int) -> DataFrame:
    """df with split: within each group the keys in seeded hash order fill the splits, rounded half to even, rest last."""
    own = Window.partitionBy(group)
    rows = df.withColumn("_r", F.row_number().over(own.orderBy(seeded_rank(seed, F.col(group), F.col(key))))).withColumn("_n", F.count("*").over(own))
    names, share, upto, out = list(ratios), sum(ratios.values()), F.lit(0), None
    for k in names[:-1]:
        upto = upto + F.bround(F.col("_n") * F.lit(ratios[k] / share), 0).cast("long")
        out = F.when(F.col("_r") <= upto, k) if out is None else out.when(F.col("_r") <= upto, k)
    return rows.withColumn("split", out.otherwise(names[-1]) if out is not None else F.lit(names[0])).drop("_r", "_n")


def event_roles(df: DataFrame, subtype: str, event: str, recordings: str, seed: int) -> DataFrame:
    """subtype, event, role: of each subtype's complete events (all events, if under two are complete) the first two in
    seeded hash order validate and test, all others train. Under three events is an error."""
    own = Window.partitionBy(subtype)
    rows = df.select(subtype, event, recordings).withColumn("_top", F.max(recordings).over(own)).withColumn("_n", F.count("*").over(own))
    rows = rows.withColumn("_full", F.col(recordings) == F.col("_top")).withColumn("_fulls", F.count_if(F.col("_full")).over(own))
    fit = F.col("_full") | (F.col("_fulls") < 2)
    place = F.row_number().over(own.orderBy(F.desc(fit), seeded_rank(seed, F.col(event))))
    role = F.when(F.col("_n") < 3, F.raise_error(F.concat(F.lit("fewer than three events of "), F.col(subtype).cast("string"))).cast("string")).when(fit & (place == 1), "validation").when(fit & (place == 2), "test").otherwise("train")
    return rows.select(subtype, event, role.alias("role"))


def round_robin(df: DataFrame, source: str, item: str, count: int, seed: int, by: list[str] = ()) -> DataFrame:
    """count rows of each group, taken in turns from its sources: sources and items in seeded hash order.

    Closed form: order by an item's place within its source, then by the source's place. A group with fewer
    rows gives all it has.
    """
    tag = [F.col(b) for b in by]
    within = F.row_number().over(Window.partitionBy(*by, source).orderBy(seeded_rank(seed, *tag, F.col(source), F.col(item)), item))
    rows = df.withColumn("_k", within).where(F.col("_k") <= count).withColumn("_o", seeded_rank(seed, *tag, F.col(source)))
    if not by:
        return rows.orderBy("_k", "_o", source).limit(count).drop("_k", "_o")
    return rows.withColumn("_p", F.row_number().over(Window.partitionBy(*by).orderBy("_k", "_o", source))).where(F.col("_p") <= count).drop("_k", "_o", "_p")


def balanced_weights(df: DataFrame, label: str, source: str) -> DataFrame:
    """df with weight 1 / (classes * sources of the class * rows of the source): they sum to one, evenly by class and source."""
    sizes = df.groupBy(label, source).agg(F.count("*").alias("_rows"))
    per_class = sizes.groupBy(label).agg(F.count("*").alias("_sources"))
    classes = per_class.agg(F.count("*").alias("_classes"))
    w = sizes.join(per_class, label).crossJoin(F.broadcast(classes)).withColumn("weight", 1.0 / (F.col("_classes") * F.col("_sources") * F.col("_rows")))
    return df.join(w.select(label, source, "weight"), [label, source])


def tempered_quotas(df: DataFrame, label: str, source: str, per_class: int, exponent: float) -> DataFrame:
    """label, source, rows, quota: per_class draws shared among a class's sources as rows ** exponent, by largest remainder."""
    sizes = df.groupBy(label, source).agg(F.count("*").alias("rows")).withColumn("_w", F.pow(F.col("rows").cast("double"), F.lit(exponent)))
    own = Window.partitionBy(label)
    raw = F.col("_w") / F.sum("_w").over(own) * per_class
    rows = sizes.withColumn("_raw", F.round(raw, 9)).withColumn("_base", F.floor("_raw"))
    place = F.row_number().over(own.orderBy(F.desc(F.round(F.col("_raw") - F.col("_base"), 9)), source))
    return rows.withColumn("quota", F.col("_base") + (place <= F.lit(per_class) - F.sum("_base").over(own)).cast("long")).select(label, source, "rows", "quota")


def quota_batches(df: DataFrame, key: str, group: str, quotas: DataFrame, batch_share: int, seed: int) -> DataFrame:
    """key, group, draw, batch: quota draws of each group in seeded cyclic order, batch_share to a batch.

    quotas has the group and its quota; draw j takes the item at place j modulo the group's size, so no item
    is drawn twice before all were drawn once.
    """
    rows = df.select(key, group).withColumn("_p", F.row_number().over(Window.partitionBy(group).orderBy(seeded_rank(seed, F.col(group), F.col(key)))) - 1)
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    plan = quotas.select(group, "quota").join(sizes, group)
    each = rows.join(plan, group)
    turns = F.floor((F.col("quota") - 1 - F.col("_p")) / F.col("_n"))
    each = each.where("quota > _p").withColumn("_t", F.explode(F.sequence(F.lit(0), turns.cast("int"))))
    draw = F.col("_p") + F.col("_t") * F.col("_n")
    return each.select(key, group, draw.cast("long").alias("draw"), F.floor(draw / batch_share).cast("long").alias("batch"))


def per_class_sample(df: DataFrame, key: str, label: str, seed: int, count: int | None = None) -> DataFrame:
    """The same number of rows of each class in seeded hash order: count, or the smallest class's size."""
    own = Window.partitionBy(label)
    rows = df.withColumn("_r", F.row_number().over(own.orderBy(seeded_rank(seed, F.col(label), F.col(key)))))
    if count is not None:
        return rows.where(F.col("_r") <= count).drop("_r")
    least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("_least"))
    return rows.join(F.broadcast(least), F.col("_r") <= F.col("_least")).drop("_r", "_least")


def weighted_sample(df: DataFrame, key: str, weight: Column, count: int, seed: int, by: list[str] = ()) -> DataFrame:
    """count rows without replacement with chances by weight: the smallest -ln(u) / w, u from the seeded digest."""
    u = F.greatest(unit_interval(seeded_rank(seed, F.col(key))), F.lit(2.0**-64))
    rows = df.withColumn("_e", -F.log(u) / weight)
    if not by:
        return rows.orderBy("_e", key).limit(count).drop("_e")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_e", key))).where(F.col("_r") <= count).drop("_e", "_r")


def draw_with_replacement(df: DataFrame, key: str, weight: str, draws: int, seed: int) -> DataFrame:
    """draw, key: draws by inverse distribution; the rows' cumulative weights are made in two levels."""
    rows = df.select(key, F.col(weight).cast("double").alias("w")).withColumn("_b", F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 3), 16, 10).cast("int"))
    sums = rows.groupBy("_b").agg(F.sum("w").alias("_s"))
    before = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"), F.sum("_s").over(Window.partitionBy()).alias("_all"), "_s")  # 4096 rows
    upto = F.sum("w").over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("w"))
    d = df.sparkSession.range(draws).select(F.col("id").alias("draw"), unit_interval(seeded_rank(seed, F.col("id"))).alias("u"))
    d = d.join(F.broadcast(before), (F.col("u") * F.col("_all") >= F.col("_before")) & (F.col("u") * F.col("_all") < F.col("_before") + F.col("_s")))
    d = d.select("draw", F.col("_b").alias("_db"), (F.col("u") * F.col("_all") - F.col("_before")).alias("_x"))
    return d.join(placed, (F.col("_db") == F.col("_b")) & (F.col("_x") >= F.col("_from")) & (F.col("_x") < F.col("_upto"))).select("draw", key)


def greedy_components(components: DataFrame, component: str, label: str, size: str, ratios: dict[str, float], seed: int) -> DataFrame:
    """component, label, size, split: largest first, each to the split that leaves the least squared relative error.

    The choice is sequential, so a label's components (one row each) meet in one task; ties go by a seeded
    digest, then the order of the splits.
    """
    names = list(ratios)

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        targets = allocate(int(rows["size"].sum()), ratios)
        filled: Counter = Counter()
        order = sorted(rows.itertuples(index=False), key=lambda r: (-r.size, _rank_of(seed, r.component)))
        out = []
        for r in order:
            def cost(split: str, r=r) -> tuple:
                error = sum(((filled[k] + (r.size if k == split else 0) - targets[k]) / max(1, targets[k])) ** 2 for k in names)
                return error, _rank_of(seed, r.component, split), names.index(split)

            best = min(names, key=cost)
            filled[best] += r.size
            out.append((r.component, r.label, r.size, best))
        return pd.DataFrame(out, columns=["component", "label", "size", "split"])

    rows = components.select(F.col(component).cast("string").alias("component"), F.col(label).cast("int").alias("label"), F.col(size).cast("long").alias("size"))
    return rows.groupBy("label").applyInPandas(assign, "component string, label int, size long, split string")


def hashed_then_balanced(components: DataFrame, component: str, label: str, sources: str, windows: str, ratios: dict[str, float], seed: int, passes: int = 20) -> DataFrame:
    """component, label, split: a seeded hash split, then moves that lower the squared relative errors of source and window
    counts, in a seeded order, until a pass moves nothing. Sequential per label, over one row per component."""
    names = list(ratios)
    share = sum(ratios.values())

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        amounts = {k: dict(zip(rows["component"], rows[k], strict=True)) for k in ("sources", "windows")}
        targets = {k: allocate(int(rows[k].sum()), ratios) for k in amounts}
        held = {k: Counter() for k in amounts}
        split: dict[str, str] = {}
        for c in rows["component"]:
            u, at = int(_rank_of(seed, c)[:16], 16) / 2.0**64, 0.0
            split[c] = names[-1]
            for k in names:
                at += ratios[k] / share
                if u < at:
                    split[c] = k
                    break
            for k in amounts:
                held[k][split[c]] += amounts[k][c]

        def gain(c: str, to: str) -> float:
            total, source = 0.0, split[c]
            for k in amounts:
                for name, change in ((source, -amounts[k][c]), (to, amounts[k][c])):
                    t = targets[k][name]
                    off = held[k][name] - t
                    total += ((off + change) ** 2 - off**2) / max(1, t) ** 2
            return total

        order = sorted(split, key=lambda c: _rank_of(seed, "balance", c))
        for _ in range(passes):
            moved = False
            for c in order:
                best = min((k for k in names if k != split[c]), key=lambda k: (gain(c, k), _rank_of(seed, "move", c, k)), default=None)
                if best is not None and gain(c, best) < -1e-18:
                    for k in amounts:
                        held[k][split[c]] -= amounts[k][c]
                        held[k][best] += amounts[k][c]
                    split[c], moved = best, True
            if not moved:
                break
        return pd.DataFrame({"component": rows["component"], "label": rows["label"], "split": [split[c] for c in rows["component"]]})

    rows = components.select(F.col(component).cast("string").alias("component"), F.col(label).cast("int").alias("label"), F.col(sources).cast("long").alias("sources"), F.col(windows).cast("long").alias("windows"))
    return rows.groupBy("label").applyInPandas(assign, "component string, label int, split string")


def grouped_tune_split(groups: DataFrame, group: str, label: str, rows: str, fraction: float, seed: int) -> DataFrame:
    """group, label, split: groups, largest first, join tune while that brings it nearer its share of rows."""

    def assign(g: pd.DataFrame) -> pd.DataFrame:
        target, held, out = g["rows"].sum() * fraction, 0, []
        for r in sorted(g.itertuples(index=False), key=lambda r: (-r.rows, _rank_of(seed, r.group))):
            tune = abs(held + r.rows - target) <= abs(held - target)
            held += r.rows * tune
            out.append((r.group, r.label, "tune" if tune else "holdout"))
        return pd.DataFrame(out, columns=["group", "label", "split"])

    df = groups.select(F.col(group).cast("string").alias("group"), F.col(label).cast("int").alias("label"), F.col(rows).cast("long").alias("rows"))
    return df.groupBy("label").applyInPandas(assign, "group string, label int, split string")


def canonical_sources(df: DataFrame, content: str, label: str, split: str, order: list[str], splits: list[str]) -> DataFrame:
    """df with kept: one row per content. Of contents in several splits the row of the split that lacks most rows stays.

    Contents that occur once are settled by a window; only the others, in the order of their digests, meet in
    one task per label, with the counts that the single ones leave.
    """
    own = Window.partitionBy(content)
    counted = df.withColumn("_n", F.count("*").over(own))
    single = counted.where("_n = 1")
    facts = counted.groupBy(label, split).agg(F.count("*").alias("total"), F.count_if(F.col("_n") == 1).alias("single"))
    table = {(r[label], r[split]): (r.total, r.single) for r in facts.collect()}  # labels x splits
    distinct = {r[label]: r.n for r in df.groupBy(label).agg(F.count_distinct(content).alias("n")).collect()}
    rank = {s: i for i, s in enumerate(splits)}
    targets = {}
    for y, n in distinct.items():
        whole = sum(table.get((y, s), (0, 0))[0] for s in splits)
        made = [round(n * table.get((y, s), (0, 0))[0] / whole) for s in splits[:-1]]
        targets[y] = dict(zip(splits, [*made, n - sum(made)], strict=True))

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows["label"].iloc[0]
        filled = Counter({s: table.get((y, s), (0, 0))[1] for s in splits})
        out = []
        for c, g in sorted(rows.groupby("content"), key=lambda x: x[0]):
            best = max(sorted(set(g["split"]), key=lambda s: rank.get(s, 99)), key=lambda s: (targets[y].get(s, 0) - filled[s], -rank.get(s, 99)))
            filled[best] += 1
            out.append((c, best))
        return pd.DataFrame(out, columns=["content", "chosen"])

    several = counted.where("_n > 1")
    options = several.select(F.col(content).cast("string").alias("content"), F.col(label).alias("label"), F.col(split).alias("split")).distinct()
    chosen = options.groupBy("label").applyInPandas(pick, "content string, chosen string")
    joined = several.join(chosen, several[content].cast("string") == chosen["content"]).drop("content" if content != "content" else "chosen_content")
    first = F.row_number().over(Window.partitionBy(content).orderBy((F.col(split) != F.col("chosen")).cast("int"), *order))
    return single.drop("_n").withColumn("kept", F.lit(True)).unionByName(joined.withColumn("kept", first == 1).drop("_n", "chosen"))
