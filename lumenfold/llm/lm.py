"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood bigram and unigram estimates with a uniform one. The mixture weights
depend on the bucket of the context's frequency (powers of two) and are learned by expectation-maximisation
on a held-out tenth of the training texts, whose tokens are left out of the counts for that; scoring then
takes the counts of all training texts.

Counting moves keys, not tokens. Texts are dealt into buckets of about ``BUCKET_BYTES``; a bucket sends its
distinct unigram and bigram hashes, sorted and packed, to shards of the hash range; a shard adds them up and
sends back the counts in the bucket's own order. So no table of the vocabulary is ever held in one place, and
frequent words cost one key per bucket. More than ``FAN`` buckets go by a middle level: a node for each ``FAN``
buckets and each of ``FAN`` parts of the hash range merges their keys, asks the shards of its part, and hands the counts
back, so that a bucket never sends more than ``FAN`` messages, and what a task holds doesn't grow. The statistics for expectation-maximisation are a histogram over
(context bucket, estimates in steps of a sixteenth of a decade): bounded, and of all held-out tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.packing import SCHEMA, packer, unpack
from lumenfold.llm.words import hash_words, mix
from lumenfold.runtime import cut, ship

BUCKET_BYTES = 6 << 20
SHARD_BYTES = 8 << 20
#: Buckets, and parts of the hash range, that a node of the middle level has; up to so many buckets need none.
FAN = 4096
#: Text bytes whose keys one partition of messages holds.
PARTITION_BYTES, MAX_PARTITIONS = 8 << 20, 100_000
#: Kinds of buckets: texts that teach and count always, those that tune the weights, those never learned from.
TEACH, TUNE, TEST = 0, 1, 2
_KIND = 1 << 32
_END = np.uint64(0x51ED270B7F3C9D11)
_START = np.uint64(0xB5297A4D3F84D5B5)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
STEP, NONE = 16, -1000
CONTEXT_BUCKETS = 48


def remainder(divisor: int) -> F.Column:
    """crc32 of doc_id as text, modulo divisor; null is the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(divisor))


def _pack(x: np.ndarray) -> bytes:
    """Integers as bytes, most significant ones together, compressed."""
    rows = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) if len(x) else np.zeros(0, np.uint8)
    return pa.compress(rows.tobytes(), "zstd", asbytes=True)


def _unpack(blob: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(blob, n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(blob, n, "u8"), dtype=np.uint64)


class Tokens:
    """The tokens of a bucket's texts: words and an end each, their contexts, and the bucket's distinct keys."""

    def __init__(self, table: pa.Table):
        words, off = hash_words(table.column("text").cast(pa.large_string()))
        self.docs = table.num_rows
        sizes = np.diff(off) + 1
        self.ends = np.cumsum(sizes)
        self.word = np.empty(len(words) + self.docs, np.uint64)
        last = np.zeros(len(self.word), bool)
        last[self.ends - 1] = True
        self.word[~last], self.word[last] = words, _END
        self.doc = np.repeat(np.arange(self.docs), sizes)
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.ends - sizes] = _START
        self.before = before
        pair = mix(before * _LEFT + self.word * _RIGHT)
        every = np.concatenate([self.word, np.full(self.docs, _START)])
        self.uni, back, self.uni_n = np.unique(every, return_inverse=True, return_counts=True)
        self.word_at = back[: len(self.word)]
        self.before_at = np.searchsorted(self.uni, before)
        self.bi, self.pair_at, self.bi_n = np.unique(pair, return_inverse=True, return_counts=True)


_MESSAGE = "node long, sender long, kind int, n long, keys binary, every binary, taught binary"
_BACK = "sender long, node long, kind int, n long, every binary, taught binary, tokens long, types long"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_SAME = b"="


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table({n: pa.array(c, _TYPES[t]) for (n, t), c in zip(fields, cols, strict=True)})


def _split(keys: np.ndarray, low: int, width: int, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, begin, end) of the sorted keys in each of the equal parts of [low, low + width), those that have any."""
    step = width // parts
    at = np.append(np.searchsorted(keys, np.array([low + i * step for i in range(1, parts)], np.uint64)), len(keys)) if parts > 1 else np.array([len(keys)])
    begin = 0
    for i, end in enumerate(at.tolist()):
        if end > begin:
            yield i, begin, end
        begin = end


def _send(parts: int, nodes_of):
    """For a bucket: its distinct keys, sorted, to the node of each part of the hash range."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        tokens = Tokens(unpack(table.column("blob").to_pylist()))
        rows, use = [], bucket // _KIND
        for kind, keys, n in ((1, tokens.uni, tokens.uni_n), (2, tokens.bi, tokens.bi_n)):
            for i, a, b in _split(keys, 0, 1 << 64, parts):
                every = b"" if use == TEST else _pack(n[a:b].astype(np.int64))
                rows.append((nodes_of(bucket, i), bucket, kind, b - a, _pack_keys(keys[a:b]), every, _SAME if use == TEACH else b""))
        return _rows(rows, _MESSAGE)

    return run


def _merged(messages: pa.Table) -> Iterator[tuple[int, list[tuple], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind: its messages (sender, n), the keys of all, where each message's keys are among them, and the sums
    of all counts and of those that teach while weights are tuned."""
    cols = zip(*(messages.column(c).to_pylist() for c in ("sender", "kind", "n", "keys", "every", "taught")), strict=True)
    rows = sorted(cols, key=lambda r: (r[1], r[0]))
    for kind in (1, 2):
        some = [r for r in rows if r[1] == kind]
        if some:
            found, back = np.unique(np.concatenate([_unpack_keys(r[3], r[2]) for r in some]), return_inverse=True)
            counts = [_unpack(r[4], r[2], "i8") if r[4] else np.zeros(r[2], np.int64) for r in some]
            small = [c if r[5] == _SAME else _unpack(r[5], r[2], "i8") if r[5] else np.zeros(r[2], np.int64) for r, c in zip(some, counts, strict=True)]
            add = lambda x: np.bincount(back, np.concatenate(x).astype(float), len(found)).astype(np.int64)  # noqa: E731, B023
            yield kind, [(r[0], r[2]) for r in some], found, back, add(counts), add(small)


def _ask(parts: int, shards: int):
    """For a node of the middle level, part i of the hash range: its members' keys, added up, to the shards of the part."""

    def run(key: tuple, messages: pa.Table) -> pa.Table:
        node = key[0].as_py()
        i, width, rows = node % parts, (1 << 64) // parts, []
        for kind, _, found, _, every, taught in _merged(messages):
            for j, a, b in _split(found, i * width, width, shards):
                rows.append((i * shards + j, node, kind, b - a, _pack_keys(found[a:b]), _pack(every[a:b]), _pack(taught[a:b])))
        return _rows(rows, _MESSAGE)

    return run


def _returned(shard: int, kind: int, members: list[tuple], back: np.ndarray, every: np.ndarray, taught: np.ndarray, whole: bool) -> Iterator[tuple]:
    """The counts of each message's keys in its order; those for tuning go to nodes and to buckets that tune."""
    at = 0
    for sender, n in members:
        mine = back[at : at + n]
        at += n
        yield sender, shard, kind, n, _pack(every[mine]), _pack(taught[mine]) if whole or sender // _KIND == TUNE else b"", 0, 0


def _add_up(whole: bool):
    """For a shard: counts over all teaching and tuning texts, and without the tuning ones, back to all that ask."""

    def run(key: tuple, messages: pa.Table) -> pa.Table:
        shard, out, tokens, types = key[0].as_py(), [], 0, 0
        for kind, members, found, back, every, taught in _merged(messages):
            if kind == 1:
                real = found != _START
                tokens, types = int(every[real].sum()), int((every[real] > 0).sum())
            out += _returned(shard, kind, members, back, every, taught, whole)
        out.append((-1, shard, 0, 0, b"", b"", tokens, types))
        return _rows(out, _BACK)

    return run


def _hand_back(messages: pa.Table, counts: pa.Table) -> pa.Table:
    """For a node of the middle level: what the shards sent, to each of its members in its own order."""
    if not messages.num_rows:
        return _rows([], _BACK)
    node, out = messages.column("node")[0].as_py(), []
    for kind, members, _, back, *_ in _merged(messages):
        out += _returned(node, kind, members, back, _counts(counts, kind, "every"), _counts(counts, kind, "taught"), False)
    return _rows(out, _BACK)


def _counts(table: pa.Table, kind: int, column: str) -> np.ndarray:
    """The counts of a bucket's keys of one kind, in the order of the sorted keys."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("node", "kind", "n", column)), strict=True), key=lambda r: r[0])
    parts = [_unpack(r[3], r[2], "i8") for r in rows if r[1] == kind]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _estimates(tokens: Tokens, uni: np.ndarray, bi: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context bucket, bigram and unigram estimate of each token."""
    context = uni[tokens.before_at]
    bucket = np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(int) + 1, CONTEXT_BUCKETS - 1), 0)
    second = np.where(context > 0, bi[tokens.pair_at] / np.maximum(context, 1), 0.0)
    return bucket, second, uni[tokens.word_at] / max(total, 1)


def _tune_rows(taught_tokens: int):
    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        tokens = Tokens(unpack(texts.column("blob").to_pylist()))
        bucket, second, first = _estimates(tokens, _counts(counts, 1, "taught"), _counts(counts, 2, "taught"), taught_tokens)
        with np.errstate(divide="ignore"):
            steps = [np.where(x > 0, np.rint(np.log10(np.where(x > 0, x, 1)) * STEP), NONE).astype(np.int64) for x in (second, first)]
        cells, n = np.unique(np.stack([bucket, *steps], 1), axis=0, return_counts=True)
        return pa.table({"bucket": cells[:, 0], "second": cells[:, 1], "first": cells[:, 2], "n": n})

    return run


def mixture_weights(cells: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """CONTEXT_BUCKETS x (bigram, unigram, uniform) by expectation-maximisation.

    cells has rows (context bucket, bigram step, unigram step, tokens). Each bucket starts from the weights
    learned over all buckets and holds one token's worth of them, so that rare buckets keep near those.
    """
    level = lambda s: np.where(s == NONE, 0.0, 10.0 ** (s / STEP))
    start = np.array([0.3, 0.6, 0.1])
    out = np.tile(start, (CONTEXT_BUCKETS, 1))
    if len(cells):
        p = np.stack([level(cells[:, 1]), level(cells[:, 2]), np.full(len(cells), uniform)], 1)
        n = cells[:, 3].astype(float)
        whole = start
        for _ in range(rounds):
            part = p * whole
            whole = (part / part.sum(1, keepdims=True) * n[:, None]).sum(0)
            whole = (whole + start) / (whole + start).sum()
        out = np.tile(whole, (CONTEXT_BUCKETS, 1))
        for b in range(CONTEXT_BUCKETS):
            mine = cells[:, 0] == b
            if mine.any():
                for _ in range(rounds):
                    part = p[mine] * out[b]
                    found = (part / part.sum(1, keepdims=True) * n[mine][:, None]).sum(0) + whole
                    out[b] = found / found.sum()
    out[0, 0] = 0.0  # no context, no bigram
    out = np.maximum(out, [0.0, 1e-9, 1e-6])
    return out / out.sum(1, keepdims=True)


def score(docs: DataFrame, test: F.Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text).

    held_out rows (default: crc32(doc_id as text) mod 7 is 2) are never learned from. Null text is empty: its
    only token is the end. Base-10 logarithms. Repeated rows count and come out as often; other columns are
    ignored; an empty table gives no rows; without training texts the model is uniform over one outcome.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held_out = remainder(7) == 2 if test is None else test
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), held_out.alias("held_out"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    parts = max(1, -(-size // BUCKET_BYTES))
    shards = max(1, -(-size // SHARD_BYTES))
    many = {TEACH: max(1, parts * 27 // 35), TUNE: max(1, -(-parts * 3 // 35)), TEST: max(1, -(-parts // 7))}
    tune = F.pmod(F.xxhash64(F.lit("tune"), "doc_id"), F.lit(10)) == 0
    spot = lambda kind: F.lit(kind * _KIND) + F.pmod(F.xxhash64(F.lit("deal"), "doc_id", "text"), F.lit(many[kind]))
    base = base.withColumn("bucket", F.when(F.col("held_out"), spot(TEST)).when(tune, spot(TUNE)).otherwise(spot(TEACH)))
    # as many partitions as the text needs, so that a task reads as much of any table
    tasks = int(max(1, min(MAX_PARTITIONS, -(-size // PARTITION_BYTES))))
    dealt = lambda df, key: df.repartition(tasks, key).groupBy(key)

    deal = packer(lambda batch: [batch.column("bucket").to_numpy(zero_copy_only=False)])
    packed = base.mapInArrow(deal, SCHEMA)
    if sum(many.values()) <= FAN:
        sent = dealt(packed, "bucket").applyInArrow(_send(shards, lambda bucket, i: i), _MESSAGE)
        back = cut(dealt(sent, "node").applyInArrow(_add_up(False), _BACK))
    else:
        first = {TEACH: 0, TUNE: many[TEACH], TEST: many[TEACH] + many[TUNE]}
        fan, each = FAN, -(-shards // FAN)
        node = lambda bucket, i: (first[bucket // _KIND] + bucket % _KIND) // fan * fan + i
        sent = cut(dealt(packed, "bucket").applyInArrow(_send(fan, node), _MESSAGE))
        asked = dealt(sent, "node").applyInArrow(_ask(fan, each), _MESSAGE)
        counted = cut(dealt(asked, "node").applyInArrow(_add_up(True), _BACK))
        handed = dealt(sent, "node").cogroup(dealt(counted.where("sender >= 0").select("sender", "node", "kind", "n", "every", "taught"), "sender")).applyInArrow(_hand_back, _BACK)
        back = cut(handed.unionByName(counted.where("sender = -1")))
    facts = back.where("sender = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
    total, types = facts.tokens, facts.types
    uniform = 1.0 / (types + 1)

    tuning = base.where(F.col("bucket").between(TUNE * _KIND, (TUNE + 1) * _KIND - 1))
    taught = total - tuning.select(F.size(F.filter(F.split("text", "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != "")).alias("n")).agg(F.coalesce(F.sum(F.col("n") + 1), F.lit(0)).alias("n")).first().n
    cells = dealt(tuning.mapInArrow(deal, SCHEMA), "bucket").cogroup(dealt(back.where(F.col("sender").between(TUNE * _KIND, (TUNE + 1) * _KIND - 1)), "sender"))
    cells = cells.applyInArrow(_tune_rows(taught), "bucket long, second long, first long, n long").groupBy("bucket", "second", "first").agg(F.sum("n").alias("n"))
    grid = np.array([tuple(r) for r in cells.orderBy("bucket", "second", "first").collect()], np.int64).reshape(-1, 4)
    weights = mixture_weights(grid, uniform)

    def scored(texts: pa.Table, counts: pa.Table) -> pa.Table:
        table = unpack(texts.column("blob").to_pylist()) if texts.num_rows else None
        if table is None:
            return pa.table({n: pa.array([], t) for n, t in _OUT})
        tokens = Tokens(table)
        uni, bi = _counts(counts, 1, "every"), _counts(counts, 2, "every")
        bucket, second, first = _estimates(tokens, uni, bi, total)
        w = weights[bucket]
        p = w[:, 0] * second + w[:, 1] * first + w[:, 2] * uniform
        own = uni[tokens.word_at]
        add = lambda x: np.bincount(tokens.doc, x, tokens.docs)
        cols = [table.column("doc_id"), table.column("held_out"), np.bincount(tokens.doc, minlength=tokens.docs), add(own > 0).astype(np.int64), np.full(tokens.docs, total), add(np.log10((own + 1) / (total + types + 1))), add(np.log10(p))]
        return pa.table({n: c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for (n, t), c in zip(_OUT, cols, strict=True)})

    asked = back.where("sender >= 0").select("sender", "node", "kind", "n", "every")
    return dealt(base.mapInArrow(deal, SCHEMA), "bucket").cogroup(dealt(asked, "sender")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_OUT = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
