"""MinHash near-duplicates by a signature-coordinate inverted join.

Each distinct shingle set gets a signature of ``COORDINATES`` minima. A set is posted under its
coordinate-value pairs; pairs of sets that collide in at least ``MATCHES`` coordinates are then confirmed
on their full sets. Merging is by prefix and skip:

* prefix: two sets with ``MATCHES`` collisions of ``COORDINATES`` must meet in the first
  ``COORDINATES - MATCHES + 1`` postings of either under any common order; the order is rarest first, so
  passages shared by many documents fall out of the prefix unless they make up most of a document;
* skip: postings of one set lead nowhere and are skipped; a long posting is not expanded into pairs, its
  members are tied to one leader, the smallest set.

Sets of a long posting that the leader has left in several components are joined exactly, by their shingles
(see _rest): rarest first again, and only those two sets meet whose sizes and places in the posting leave room for
the overlap that they need. Where a shared passage brought them together, none do.

The probability that a pair of similarity 0.75 has fewer than ``MATCHES`` collisions is about 1e-5; a
reported link is always exact (on 64-bit shingle hashes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm.words import pieces, shingle_sets, tidied
from lumenfold.operators.components import connected_components
from lumenfold.runtime import cut, release, ship

WIDTH = 5
COORDINATES = 64
MATCHES = 33
#: Postings up to this many sets are expanded into pairs; longer ones go by leaders, at last by blocks.
SHORT = 24
#: Sets that are compared with one copy of their leader.
PART = 256
#: Slots of the table of shingle counts; leaders tried on a posting of more than a block before blocks are compared.
SLOTS, ROUNDS = 1 << 18, 2
#: Members of a posting of shingles, and bytes of their texts, compared at a time.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Ids (8 bytes each) that are broadcast to pick rows on the map side; beyond, rows are picked by a shuffle.
FEW_IDS = 1_000_000
_RNG = np.random.Generator(np.random.PCG64(77))
_XOR = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_ODD = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """len(sets) x COORDINATES minima of the (non-empty) sets."""
    out = np.empty((len(sets), COORDINATES), np.uint64)
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _ODD[k], starts)
    return out


def similar(common: int, a: int, b: int, percent: int = 75) -> bool:
    """100 * intersection >= percent * union."""
    return 100 * common >= percent * (a + b - common)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            sets = list(shingle_sets(part.column("text"), WIDTH))
            full = [s for s in sets if len(s)]
            rows = iter(signatures(full).view(np.int64)) if full else iter(())
            sig = [next(rows) if len(s) else None for s in sets]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.list_(pa.int64()))], ["id", "doc_id", "n_shingles", "digest", "sig"])


def _confirm(percent: int):
    """For sorted rows (a, part, b, text): of each leader a first its own text (b is null), then those to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            for part in pieces(batch):
                found = []
                for a, b, s in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), shingle_sets(part.column("text"), WIDTH), strict=True):
                    if b is None:
                        own = s
                    elif similar(len(np.intersect1d(own, s, assume_unique=True)), len(own), len(s), percent):
                        found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def _slots(sets: list[np.ndarray]) -> np.ndarray:
    return (np.concatenate(sets) >> np.uint64(20)).astype(np.int64) % SLOTS if sets else np.zeros(0, np.int64)


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of a partition by slot of their shingles' hashes."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for part in pieces(batch):
            counts += np.bincount(_slots(list(shingle_sets(part.column("text"), WIDTH))), minlength=SLOTS)
    some = np.flatnonzero(counts)
    for a in range(0, len(some), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(some[a : a + 50_000]), pa.array(counts[some[a : a + 50_000]])], ["slot", "n"])


def _post_shingles(counts: np.ndarray, percent: int):
    """Rows (g, rep, n, left) of the shingles that a set can first share with one it is linked with.

    Shingles are ordered by the count of their slot, then by hash: the same order for all sets. n is the size of
    the set, left how many shingles follow in the order, the shingle itself included. A slot with one set is skipped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                rows = []
                for rep, s in zip(part.column("rep").to_pylist(), shingle_sets(part.column("text"), WIDTH), strict=True):
                    often = counts[_slots([s])]
                    order = np.lexsort((s, often))
                    left = len(s) - np.arange(len(s))
                    use = (100 * left >= percent * len(s)) & (often[order] > 1)
                    rows.append((s[order][use].view(np.int64), np.full(use.sum(), rep), np.full(use.sum(), len(s)), left[use]))
                cols = [np.concatenate(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["g", "rep", "n", "left"])

    return run


def _blocks(percent: int):
    """For one pair of blocks of a posting: exact links between different components, a forest of them."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp = table.column("rep").to_pylist(), np.array(table.column("comp").to_pylist())
        side, n, left = (np.array(table.column(c).to_pylist()) for c in ("side", "n", "left"))
        sig = np.array(table.column("sig").to_pylist(), np.int64).reshape(len(ids), -1)
        sets = list(shingle_sets(table.column("text"), WIDTH))
        root = {c: c for c in comp.tolist()}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out_a, out_b = [], []
        first, second = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        for i in first.tolist():
            fit = second[(comp[second] != comp[i]) & (percent * (n[second] + n[i]) <= (100 + percent) * np.minimum(left[second], left[i]))]
            for j in fit[(sig[fit] == sig[i]).sum(1) >= MATCHES].tolist():
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y and similar(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), len(sets[i]), len(sets[j]), percent):
                    root[max(x, y)] = min(x, y)
                    out_a.append(ids[i])
                    out_b.append(ids[j])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _only(rows: DataFrame, ids: DataFrame, on: str = "rep") -> DataFrame:
    """rows whose key is among the (distinct) ids, with the ids' other columns: on the map side while those are few,
    else by a shuffle."""
    return rows.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, on)


def _ends(pairs: DataFrame) -> DataFrame:
    return cut(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())


@dataclass
class _Sets:
    """Distinct shingle sets by their number rep: signatures (id, sig) and texts by way of the row (rep, id) read for each.

    What is wanted is picked on the map side while it is little; nothing else is shuffled.
    """

    base: DataFrame
    classes: DataFrame
    signed: DataFrame

    def _picked(self, rows: DataFrame, column: str, reps: DataFrame) -> DataFrame:
        """(rep, column) of (distinct) reps; of several equal rows once."""
        ids = cut(self.classes.select("rep", "id").join(reps, "rep", "left_semi"))
        return _only(rows.select("id", column), ids, "id").select("rep", column).dropDuplicates(["rep"])

    def signatures(self, reps: DataFrame) -> DataFrame:
        return self._picked(self.signed, "sig", reps)

    def texts(self, reps: DataFrame) -> DataFrame:
        return self._picked(self.base, "text", reps)


@dataclass
class _Few(_Sets):
    """Some of the sets, with all at hand: signed has rep, sig and text."""

    def signatures(self, reps: DataFrame) -> DataFrame:
        return _only(self.signed.select("rep", "sig"), reps)

    def texts(self, reps: DataFrame) -> DataFrame:
        return _only(self.signed.select("rep", "text"), reps)


def _in_parts(rows: DataFrame, size: str, lead: F.Column) -> DataFrame:
    """Pairs (a, b, parts) of a posting's leader and its members: the more there are, the more copies of the leader."""
    return rows.select(lead.alias("a"), F.col("rep").alias("b"), F.ceil(F.col(size) / PART).cast("int").alias("parts")).where("a <> b")


def _links(pairs: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b, parts) that collide often enough and are similar by their full sets.

    A leader's signature and text meet PART others at a time, so that no leader makes a task long.
    """
    pairs = pairs.groupBy("a", "b").agg(F.max("parts").alias("parts"))
    pairs = cut(pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts").cast("long"))))
    key = ["a", "parts", "part"]
    sig = sets.signatures(_ends(pairs))
    held = pairs.select(*key).distinct().join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
    held = pairs.join(held, key).join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    pairs = cut(held.where(equal >= MATCHES).select(*key, "b"))
    del held, sig
    release(pairs.sparkSession)
    texts = sets.texts(_ends(pairs))
    own = pairs.select(*key).distinct().join(texts.withColumnRenamed("rep", "a"), "a").select(*key, F.lit(None).cast("long").alias("b"), "text")
    rows = own.unionByName(pairs.join(texts.withColumnRenamed("rep", "b"), "b").select(*key, "b", "text"))
    rows = rows.repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("b"))
    return cut(rows.select("a", "b", "text").mapInArrow(tidied(_confirm(percent)), "a long, b long"))


def _rest(rest: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """(before, comp): new components of those that links among the sets rest (rep, comp) tie together, by an exact join
    on shingles.

    Of a pair with |x| and |y| shingles that is linked, percent * (|x| + |y|) <= (100 + percent) * (common ones),
    and of the common ones all but the first in the order come after it: so in the posting of their first common
    shingle the same holds with what either has left from there. This decides which members of a posting can meet.
    """
    reps = rest.select("rep")
    some = cut(sets.texts(reps).join(sets.signatures(reps), "rep"))
    sets = _Few(sets.base, sets.classes, some)
    found = some.select("text").mapInArrow(tidied(_count_slots), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(SLOTS, np.int64)
    pdf = found.toPandas()  # SLOTS rows at most
    counts[pdf["slot"].to_numpy(int)] = pdf["n"].to_numpy(int)
    post = cut(some.select("rep", "text").mapInArrow(tidied(_post_shingles(counts, percent)), "g long, rep long, n long, left long"))
    # a member stays if the smallest other one would fit
    least = post.groupBy("g").agg(F.min(F.struct("n", "rep")).alias("least"), F.count("*").alias("size")).where("size > 1").drop("size")
    post = post.join(least, "g")
    others = post.where(F.col("rep") != F.col("least.rep")).groupBy("g").agg(F.min("n").alias("next"))
    other = F.when(F.col("rep") == F.col("least.rep"), F.col("next")).otherwise(F.col("least.n"))
    post = cut(post.join(others, "g").where(percent * (F.col("n") + other) <= (100 + percent) * F.col("left")).select("g", "rep", "n", "left"))
    # of postings of the same members only the first in the order counts: more is left from there for each
    marks = [F.sum(F.xxhash64("rep", F.lit(i)).cast("decimal(38,0)")).alias(f"m{i}") for i in (0, 1)]
    alike = post.groupBy("g").agg(F.count("*").alias("size"), F.sum("left").alias("left"), *marks).where("size > 1")
    first = alike.groupBy("size", "m0", "m1").agg(F.max(F.struct("left", "g")).alias("f")).select(F.col("f.g").alias("g"))
    post = cut(post.join(first, "g", "left_semi"))

    fits = lambda x, y: (F.col(f"{x}.comp") != F.col(f"{y}.comp")) & (percent * (F.col(f"{x}.n") + F.col(f"{y}.n")) <= (100 + percent) * F.least(f"{x}.left", f"{y}.left"))
    tied = rest.select("rep", F.col("comp").alias("before"), "comp")
    for step in range(ROUNDS + 1):
        members = post.join(tied.select("rep", "comp"), "rep")
        several = members.groupBy("g").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("g", "size")
        members = cut(members.join(several, "g"))
        release(rest.sparkSession)
        long = members.where(F.col("size") > BLOCK)
        last = step == ROUNDS or long.isEmpty()
        if last:
            short = members.where(F.col("size") <= SHORT)
            pairs = short.alias("x").join(short.alias("y"), "g").where(F.col("x.rep") < F.col("y.rep")).where(fits("x", "y")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.lit(1).alias("parts"))
        else:
            # the smallest set leads; in later rounds that of the sets which the largest component doesn't hold
            leads = long
            if step:
                top = long.groupBy("g", "comp").agg(F.count("*").alias("k")).groupBy("g").agg(F.max(F.struct("k", "comp")).alias("top"))
                leads = long.join(top, "g").where(F.col("comp") != F.col("top.comp"))
            led = long.alias("x").join(leads.groupBy("g").agg(F.min(F.struct("n", "rep", "left", "comp")).alias("y")), "g").where(fits("x", "y"))
            pairs = _in_parts(led.select("x.rep", "size", "y"), "size", F.col("y.rep"))
        pairs = cut(pairs)
        more = pairs.select("a", "b") if pairs.isEmpty() else _links(pairs, sets, percent)
        release(rest.sparkSession)
        if last:
            more = more.unionByName(_in_blocks(members.where(F.col("size") > SHORT), sets, percent))
        ends = tied.select("rep", "comp")
        edges = more.join(ends.select(F.col("rep").alias("a"), F.col("comp").alias("u")), "a").join(ends.select(F.col("rep").alias("b"), F.col("comp").alias("v")), "b")
        edges = cut(edges.select("u", "v").where("u <> v").distinct())
        if not edges.isEmpty():
            moved = connected_components(edges, "u", "v").withColumnsRenamed({"node": "comp", "component": "to"})
            tied = cut(tied.join(moved, "comp", "left").select("rep", "before", F.coalesce("to", "comp").alias("comp")))
        if last:
            break
    return tied.where("before <> comp").select("before", "comp").distinct()


def _in_blocks(members: DataFrame, sets: _Few, percent: int) -> DataFrame:
    """Links between components of long postings, every block of members against every other."""
    data = sets.signed.select("rep", "sig", "text")
    sizes = members.join(data.select("rep", F.octet_length("text").alias("bytes")), "rep").groupBy("g").agg(F.sum("bytes").alias("bytes"))
    rows = members.join(sizes, "g").withColumn("parts", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1)
    rows = rows.select("g", "rep", "comp", "n", "left", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), side.alias("side"))
    return cut(rows.join(data, "rep").groupBy("g", "p", "q").applyInArrow(_blocks(percent), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    docs needs doc_id and text; other columns are ignored. A null or blank text has no shingles and is linked
    with nothing. Of a component the smallest doc_id is kept. Rows that repeat a doc_id are taken one by one,
    each by its own text. Rows without doc_id get the component of their text's class, which is null where no
    row of it has a doc_id. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row_id = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), text)))
    base = docs.select(row_id.alias("id"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    signed = cut(base.mapInArrow(tidied(_sign), "id binary, doc_id long, n_shingles long, digest binary, sig array<long>"))
    # one set for each digest, under a number of its own; the documents hang on it
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    reps = signed.join(classes.select("digest", "id", "rep"), ["digest", "id"]).select("rep", "sig").dropDuplicates(["rep"])
    sets = _Sets(base, classes, signed)

    post = reps.select("rep", F.posexplode("sig").alias("k", "v")).select("rep", F.xxhash64("k", "v").alias("key")).repartition("key")
    often = post.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = post.join(often, "key")
    order = Window.partitionBy("rep").orderBy("size", "key")
    ranked = shared.withColumn("r", F.row_number().over(order)).withColumn("many", F.count("*").over(Window.partitionBy("rep")))
    prefix = cut(ranked.where(F.col("r") + COORDINATES - F.col("many") <= COORDINATES - MATCHES + 1).select("rep", "key"))
    release(spark)

    sizes = classes.select("rep", "n")
    lists = prefix.join(sizes, "rep").groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("n", "rep")).alias("lead")).where("size > 1")
    small = prefix.join(lists.where(F.col("size") <= SHORT).select("key"), "key", "left_semi").select("rep", "key")
    long = cut(lists.where(F.col("size") > SHORT).select("key", "size", F.col("lead.rep").alias("lead")))
    pairs = small.alias("x").join(small.alias("y"), "key").where("x.rep < y.rep").select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.lit(1).alias("parts"))
    led = _in_parts(prefix.select("key", "rep").join(long, "key"), "size", F.col("lead"))
    links = _links(pairs.unionByName(led), sets, percent)
    comps = cut(connected_components(links, "a", "b"))
    release(spark)

    tied = comps.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    known = classes.join(tied, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    # members of long postings that are not all in one component
    members = prefix.select("key", "rep").join(long.select("key"), "key").join(tied, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    several = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    rest = cut(members.join(several, "key", "left_semi").select("rep", "comp").distinct())
    if not rest.isEmpty():
        moved = _rest(rest, sets, percent).select(F.col("before").alias("comp"), F.col("comp").alias("to"))
        known = known.join(moved, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to")
    least = known.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = known.join(least, "comp").select("digest", "component_id")
    out = signed.select("doc_id", "n_shingles", "digest").join(known, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs without the rows that near_duplicates doesn't keep; rows without doc_id stay."""
    gone = cut(near_duplicates(docs, percent).where("doc_id is not null and not kept").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= FEW_IDS else gone, docs["doc_id"] == gone["_gone"], "left_anti")
