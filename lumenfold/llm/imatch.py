"""Document fingerprints by I-Match over randomised lexicon subsets.

The lexicon holds the words whose share of documents lies in a band; by Markov's inequality it has at most
(distinct words per document) / LOWEST entries at any corpus size, so it is broadcast. A document's terms are
its distinct lexicon words, sorted. A fingerprint has one hash of all terms, and hashes of those terms that lie
in each of ``SUBSETS`` random subsets of the lexicon, at three neighbouring densities 2^-l. The level l is the
logarithm of the number of terms: a subset that keeps most of the lexicon changes with every edit, one that
holds about one of the document's terms survives an edit of a third of the text every second time. So a
fingerprint has the same length for every text, no two sets of terms have equal ones, and the likeness of two
(the share of equal hashes among that of all terms and those of the subsets that either has terms in, at the
densities both have) estimates how much of their terms is common. A text without any lexicon word is printed from all its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.packing import SCHEMA, packer, unpack
from lumenfold.llm.words import hash_words, mix, pieces, tidied
from lumenfold.runtime import cut, ship

#: The band of document shares (the inverse-document-frequency band), and the least number of documents.
LOWEST, HIGHEST, AT_LEAST = 0.0005, 0.2, 2
#: Random subsets of the lexicon at each of the LEVELS densities.
SUBSETS, LEVELS = 32, 3
#: Text bytes of one range of neighbouring documents, and of one partition of ranges.
RANGE_BYTES, PARTITION_BYTES = 4 << 20, 16 << 20
MAX_RANGES, MAX_PARTITIONS = 1 << 20, 100_000
_RNG = np.random.Generator(np.random.PCG64(311))
_XOR = _RNG.integers(0, 1 << 63, SUBSETS, dtype=np.uint64)
_ODD = _RNG.integers(1, 1 << 63, SUBSETS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document counts of every word of a partition."""
    held: list[np.ndarray] = []
    terms, counts, pending = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate([terms, *held])
        weight = np.concatenate([counts, np.ones(pending, np.int64)])
        found, back = np.unique(every, return_inverse=True)
        return found, np.bincount(back, weight, len(found)).astype(np.int64)

    def rows() -> Iterator[pa.RecordBatch]:
        for a in range(0, len(terms), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(terms[a : a + 50_000].view(np.int64)), pa.array(counts[a : a + 50_000])], ["term", "df"])

    for batch in batches:
        for part in pieces(batch):
            words, off = hash_words(part.column("text"))
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                held.append(np.unique(words[a:b]))
                pending += len(held[-1])
            if pending > 2_000_000:
                terms, counts = merged()
                held, pending = [], 0
                if len(terms) > 2_000_000:
                    yield from rows()
                    terms, counts = terms[:0], counts[:0]
    terms, counts = merged()
    yield from rows()


def lexicon(docs: DataFrame, total: int, lowest: float = LOWEST, highest: float = HIGHEST) -> np.ndarray:
    """Sorted hashes of the words in the band."""
    counted = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(tidied(_frequencies), "term long, df long")
    band = counted.groupBy("term").agg(F.sum("df").alias("df")).where((F.col("df") >= max(AT_LEAST, lowest * total)) & (F.col("df") <= highest * total))
    return np.sort(band.select("term").toPandas()["term"].to_numpy(np.int64).view(np.uint64))


def _member(words: np.ndarray, lex: np.ndarray) -> np.ndarray:
    if not len(lex):
        return np.zeros(len(words), bool)
    return lex[np.minimum(np.searchsorted(lex, words), len(lex) - 1)] == words


@dataclass
class Prints:
    """Fingerprints of some texts: whether of lexicon words, the level, the hash of all terms, those of the subsets.

    hashes is texts x LEVELS x SUBSETS; 0 marks a subset without terms, and a whole of 0 a text without words.
    """

    lexical: np.ndarray
    level: np.ndarray
    whole: np.ndarray
    hashes: np.ndarray

    def lines(self) -> list[str]:
        """Each as text: empty, or kind, level, and the hashes in hexadecimal."""
        rows = zip(self.lexical.tolist(), self.level.tolist(), self.whole.tolist(), self.hashes.astype(">u4"), strict=True)
        return [f"{'i' if kind else 'w'}{level}:{whole:016x}:{':'.join(h.tobytes().hex() for h in hashes)}" if whole else "empty" for kind, level, whole, hashes in rows]

    @classmethod
    def parse(cls, line: str) -> Prints:
        if line == "empty":
            return cls(np.ones(1, bool), np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros((1, LEVELS, SUBSETS), np.uint32))
        level, whole, *hashes = line[1:].split(":")
        return cls(np.array([line[0] == "i"]), np.array([int(level)]), np.array([int(whole, 16)], np.uint64), np.array([[np.frombuffer(bytes.fromhex(h), ">u4") for h in hashes]], np.uint32))

    def at(self, rows: slice) -> Prints:
        return Prints(self.lexical[rows], self.level[rows], self.whole[rows], self.hashes[rows])

    def like(self, other: Prints) -> np.ndarray:
        """Likeness, 0 to 1, of each text to that of the same row; 1 for equal fingerprints, 0 for those without a common density."""
        same, either = np.zeros(len(self.level)), np.zeros(len(self.level))
        for i in range(LEVELS):
            for j in range(LEVELS):
                at = np.flatnonzero(self.level + i == other.level + j)
                p, q = self.hashes[at, i], other.hashes[at, j]
                either[at] += ((p | q) > 0).sum(1)
                same[at] += ((p == q) & (p > 0)).sum(1)
        kind = self.lexical == other.lexical
        fit = kind & (self.whole > 0) & (other.whole > 0)
        return np.where(kind & (self.whole == other.whole), 1.0, np.where(fit, same / (either + 1), 0.0))


def fingerprints(texts: pa.Array, lex: np.ndarray) -> Prints:
    """The fingerprints of texts (null: empty) under a lexicon of sorted word hashes."""
    words, off = hash_words(texts)
    known = _member(words, lex)
    n = len(off) - 1
    out = Prints(np.ones(n, bool), np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros((n, LEVELS, SUBSETS), np.uint32))
    terms, rows = [], []
    for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        if a < b:
            own = np.unique(words[a:b][known[a:b]])
            if not len(own):
                own, out.lexical[k] = np.unique(words[a:b]), False
            terms.append(own)
            rows.append(k)
    if not rows:
        return out
    at, sizes = np.array(rows), np.array([len(t) for t in terms])
    flat, starts = np.concatenate(terms), np.cumsum(sizes) - sizes
    level = np.ceil(np.log2(sizes)).astype(np.int64)
    out.level[at] = level
    out.whole[at] = np.maximum(mix(np.add.reduceat(mix(flat), starts)), np.uint64(1))
    # a term is in a subset of density 2^-l if the l highest bits of its hash there are all zero
    last = [np.repeat(np.uint64((1 << 64) - 1) >> (level + step).astype(np.uint64), sizes) for step in range(LEVELS)]
    for k in range(SUBSETS):
        place = (flat ^ _XOR[k]) * _ODD[k]
        for step in range(LEVELS):
            sums = np.add.reduceat(np.where(place <= last[step], place, np.uint64(0)), starts)
            out.hashes[at, step, k] = np.where(sums == 0, 0, np.maximum(mix(sums) >> np.uint64(32), np.uint64(1)))
    return out


def likeness(one: str, other: str) -> float:
    """Likeness of two fingerprints as text."""
    return float(Prints.parse(one).like(Prints.parse(other))[0])


_SIGN = np.uint64(1 << 63)


@dataclass
class Ranges:
    """Buckets of neighbouring documents, in the order of documents: descending doc_id, then by hash of the text.

    ends are the largest doc_ids of the ranges, ascending; the last entries of slices and base are of the rows
    without doc_id. A range of one doc_id that holds much text is sliced by the hash. first has the first
    (doc_id, hash) of every bucket with rows and before the bucket that it follows.
    """

    ends: np.ndarray
    slices: np.ndarray
    base: np.ndarray
    first: dict[int, tuple] = field(default_factory=dict)
    before: dict[int, int] = field(default_factory=dict)

    def buckets(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bucket of each row, with its doc_id, whether that is missing, and the hash."""
        missing = np.asarray(batch.column("doc_id").is_null())
        ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        up = np.where(missing, len(self.ends), np.minimum(np.searchsorted(self.ends, ids), max(0, len(self.ends) - 1)))
        h = batch.column("h").to_numpy(zero_copy_only=False)
        cut_at = (h.view(np.uint64) ^ _SIGN) >> np.uint64(32)
        return self.base[up] + ((cut_at * self.slices[up].astype(np.uint64)) >> np.uint64(32)).astype(np.int64), ids, missing, h

    def assign(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        """Twice the bucket of each row, and for a row that a bucket begins with, one more than twice that before it."""
        bucket, ids, missing, h = self.buckets(batch)
        leads = np.full(len(bucket), -1, np.int64)
        found, at = np.unique(bucket, return_inverse=True)
        for k, b in enumerate(found.tolist()):
            doc_id, least = self.first[b]
            mine = np.flatnonzero((at == k) & (h == least) & (missing if doc_id is None else ~missing & (ids == doc_id)))
            leads[mine[:1]] = 2 * self.before[b] + 1
        return [2 * bucket, leads]


def _ranges(keys: DataFrame) -> Ranges:
    """Ranges of about RANGE_BYTES of keys (doc_id, h, size); the driver holds MAX_RANGES numbers and fewer."""
    facts = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("size"))), F.lit(0)).alias("lost"), F.max("doc_id").alias("top")).first()
    n = max(1, min(MAX_RANGES // 4, 4 * -(-facts.size // RANGE_BYTES)))
    shares = [k / n for k in range(1, n)]
    found = keys.where("doc_id is not null").agg(F.percentile_approx("doc_id", shares, 10_000 + 10 * n).alias("q")).first().q if shares else []
    ends = np.array(sorted({*(found or []), *([facts.top] if facts.top is not None else [])}), np.int64)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            cell, at = np.unique(np.searchsorted(ends, ids), return_inverse=True)
            least = np.full(len(cell), np.iinfo(np.int64).max)
            np.minimum.at(least, at, ids)
            size = np.bincount(at, batch.column("size").to_numpy(zero_copy_only=False), len(cell)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(size), pa.array(least)], ["cell", "size", "least"])

    sizes = keys.where("doc_id is not null").mapInArrow(cells, "cell long, size long, least long").groupBy("cell").agg(F.sum("size").alias("size"), F.min("least").alias("least"))
    sized = {r.cell: (r.size, r.least) for r in sizes.collect()}  # a row a cell
    kept, slices, held = [], [], 0
    for k in range(len(ends)):
        size, least = sized.get(k, (0, None))
        hot = size > 2 * RANGE_BYTES and least == ends[k]
        if kept and held and (hot or held + size > RANGE_BYTES):
            held = 0
        if kept and held:
            kept[-1] = ends[k]
        else:
            kept.append(ends[k])
            slices.append(1)
        held += size
        if hot:
            slices[-1], held = -(-size // RANGE_BYTES), 0
    slices.append(max(1, -(-facts.lost // RANGE_BYTES)))
    slices = np.array(slices, np.int64)
    order = np.append(np.arange(len(kept))[::-1], len(kept))  # the largest ids first, none last
    base = np.empty(len(slices), np.int64)
    base[order] = np.cumsum(slices[order]) - slices[order]
    out = Ranges(np.array(kept, np.int64), slices, base)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, ids, missing, h = out.buckets(batch)
            order = np.lexsort((h, -ids, bucket)) if len(ids) else np.zeros(0, np.int64)
            lead = order[np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))] if len(ids) else order
            yield pa.RecordBatch.from_arrays([pa.array(bucket[lead]), pa.array(ids[lead], mask=missing[lead]), pa.array(~h[lead])], ["bucket", "doc_id", "later"])

    begin = keys.mapInArrow(firsts, "bucket long, doc_id long, later long").groupBy("bucket").agg(F.max(F.struct("doc_id", "later")).alias("f"))
    begin = sorted((r.bucket, r.f.doc_id, ~r.f.later) for r in begin.collect())  # a row a bucket
    out.first = {b: (i, h) for b, i, h in begin}
    out.before = {b: begin[k - 1][0] for k, (b, *_) in enumerate(begin)}
    return out


def with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is that with the next smaller doc_id, after the last the first; rows that repeat a
    doc_id follow each other in the order of their texts' hashes, rows without doc_id come last, in that order. In
    the edited text the last third (rounded down) is replaced by as many code points from the next text's start.
    Null text is empty; empty texts have the fingerprint "empty"; an only document follows itself. Other columns
    are ignored; an empty table gives no rows. Rows of one doc_id, or without one, are dealt to many ranges by the
    hash of the text; only rows equal in both lie in one.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    keys = cut(base.select("doc_id", "h", F.octet_length("text").cast("long").alias("size")))
    facts = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    lex = lexicon(base, facts.n)
    ranges = _ranges(keys)
    parts = int(max(1, min(MAX_PARTITIONS, -(-facts.size // PARTITION_BYTES))))
    packed = base.mapInArrow(packer(ranges.assign), SCHEMA)
    rows = packed.select(F.shiftright("bucket", 1).alias("range"), (F.col("bucket") % 2).alias("follower"), "blob").repartition(parts, "range")

    def edit(table: pa.Table) -> pa.Table:
        follower = table.column("follower").to_pylist()
        blobs = table.column("blob").to_pylist()

        def ordered(want: int) -> pa.Table | None:
            some = [b for b, f in zip(blobs, follower, strict=True) if f == want]
            if not some:
                return None
            t = unpack(some)
            ids, hashes, texts = (t.column(c).to_pylist() for c in ("doc_id", "h", "text"))
            return t.take(pa.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, -(ids[i] or 0), hashes[i], texts[i])), pa.int64()))

        own, after = ordered(0), ordered(1)
        if own is None:
            return pa.table({n: pa.array([], t) for n, t in _OUT})
        texts = own.column("text").to_pylist()
        following = [*texts[1:], after.column("text")[0].as_py()]
        edited = [t[: len(t) - len(t) // 3] + f[: len(t) // 3] for t, f in zip(texts, following, strict=True)]
        prints = fingerprints(pa.array([*texts, following[-1]], pa.large_string()), lex)
        changed, mine = fingerprints(pa.array(edited, pa.large_string()), lex), prints.at(slice(0, -1))
        cols = [own.column("doc_id"), [len(t) for t in texts], [hashlib.sha256(e.encode()).hexdigest() for e in edited], mine.lines(), changed.lines(), mine.like(changed), mine.like(prints.at(slice(1, None)))]
        return pa.table({n: c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for (n, t), c in zip(_OUT, cols, strict=True)})

    return rows.groupBy("range").applyInArrow(edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_OUT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
