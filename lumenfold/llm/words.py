"""Words and shingles of whole texts as 64-bit hashes, in numpy over Arrow string buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. Texts are read in
windows of a few MB cut at white space, so a very long text costs its words, not a multiple of its bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

WINDOW = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240607))
#: A random odd value per lower-cased byte; white space counts nothing.
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_GRAM = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def release() -> None:
    """Give freed memory back to the system; a worker lives on for the tasks of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; it keeps what it keeps


Batches = Iterator[pa.RecordBatch]


def tidied(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function for mapInArrow that releases memory at the end of each partition."""

    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every other."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(256)


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _window(raw: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of one window; head marks where texts begin."""
    solid = ~_SPACE[raw]
    start = solid.copy()
    start[1:] &= ~solid[:-1] | head[1:]
    starts = np.flatnonzero(start)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    place = np.arange(len(raw), dtype=np.int32)
    begin = np.zeros(len(raw), np.int32)
    begin[starts] = starts
    place -= np.maximum.accumulate(begin)
    longest = int(place.max()) + 1
    power = _POWERS if longest <= len(_POWERS) else _powers(longest)
    value = _BYTE[raw] * power[place]
    sums = np.add.reduceat(value, starts)
    return starts, mix(sums)


def hash_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and n+1 offsets into them by text."""
    raw, off = buffers(texts)
    head = np.zeros(len(raw) + 1, bool)
    head[off[:-1]] = True
    found: list[np.ndarray] = []
    places: list[np.ndarray] = []
    at = 0
    while at < len(raw):
        end = min(at + WINDOW, len(raw))
        while end < len(raw):  # to a place where a word ends
            piece = _SPACE[raw[at:end]] | head[at + 1 : end + 1]
            last = np.flatnonzero(piece)
            if len(last):
                end = at + int(last[-1]) + 1
                break
            end = min(end + WINDOW, len(raw))
        starts, values = _window(raw[at:end], head[at:end])
        found.append(values)
        places.append(starts + at)
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(places), off)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; of fewer words than width, all as one; of none, empty."""
    words, off = hash_words(texts)
    n = len(words)
    if n >= width:
        grams = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            grams += words[k : n - width + 1 + k] * _GRAM[k]
        grams = mix(grams)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            few = words[a:b] * _GRAM[: b - a]
            yield mix(np.array([few.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts take about limit bytes, so that working arrays stay small."""
    if not batch.num_rows:
        return
    _, off = buffers(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit)))
        yield batch.slice(a, b - a)
        a = b
