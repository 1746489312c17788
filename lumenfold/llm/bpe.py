"""BPE encoding and decoding by speculation and verification.

For every new word a greedy longest match proposes tokens. A proposal is the BPE result exactly when each
adjacent pair of its tokens is compatible, which is when the pair's own text is encoded as just that pair;
this is tested for all pairs of a batch at once against sorted tables of known verdicts, and only words with
a failing pair are merged step by step. The tokenizer is a file in the format of the tokenizers library with
word ends; its path is a parameter, and its rules (composition, white space, lower case, splitting, byte
letters) are applied here.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.words import pieces, tidied
from lumenfold.runtime import ship

#: Texts are handled in pieces of about so many characters, cut before white space.
PIECE = 1 << 20
#: Words of each of two generations, and pair verdicts, that a worker remembers.
MAX_WORDS, MAX_PAIRS = 100_000, 4_000_000
#: The largest tokenizer file that is sent to every worker.
MAX_FILE = 64 << 20
_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CUT = regex.compile(f"(?=[{_BLANK}])")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """One vocabulary with its merges; encode() gives ids, decode() what the library's decode gives."""

    def __init__(self, path: str, content: bytes | None = None):
        spec = json.loads(Path(path).read_bytes() if content is None else content)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.ranks: dict[int, int] = {}  # by left id * 2^32 + right id
        self.made: list[int] = []  # by rank
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a] << 32 | self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self._split = regex.compile(splits[0].replace("\\s", _BLANK))
        self._marks = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._letters = dict(enumerate(byte_letters()))
        self._plain = self._plain_bytes()
        self._names = {i: str(i) for i in self.text_of}
        self._single = {c: self.vocab[c] for c in self._letters.values() if c in self.vocab}
        self._final = {c: self.vocab[c + self.end] for c in self._letters.values() if c + self.end in self.vocab}
        # tokens that their own text doesn't lead to are never proposed
        usable = [t for t, i in self.vocab.items() if self._exact(self._symbols(t)) == [i]]
        self._inner = {t: self.vocab[t] for t in usable if not (self.end and t.endswith(self.end))}
        self._last = {t[: len(t) - len(self.end)]: self.vocab[t] for t in usable if t.endswith(self.end)} if self.end else self._inner
        self._longest = max(map(len, [*self._inner, *self._last]))
        self._reach: dict[str, int] = {}  # the longest inner token by its first three letters
        for t in self._inner:
            if len(t) > 2:
                self._reach[t[:3]] = max(len(t), self._reach.get(t[:3], 0))
        self._codes, self._verdicts = np.zeros(0, np.int64), np.zeros(0, bool)
        self._words: dict[str, tuple[str, str, int]] = {}
        self._older: dict[str, tuple[str, str, int]] = {}
        self.proposed = self.failed = 0

    def _symbols(self, token: str) -> list[int]:
        whole = self.end and token.endswith(self.end) and len(token) > len(self.end)
        chars = list(token[: len(token) - len(self.end)] if whole else token)
        if whole:
            chars[-1] += self.end
        return [self.vocab[c] for c in chars] if all(c in self.vocab for c in chars) else []

    def _word_symbols(self, word: str) -> list[int]:
        single = self._single
        return [*[single[c] for c in word[:-1]], self._final[word[-1]]]

    def _exact(self, ids: list[int]) -> list[int]:
        """Merges by rank, leftmost first."""
        if len(ids) > 40:
            return self._exact_long(ids)
        ids, ranks, made, never = list(ids), self.ranks, self.made, 1 << 60
        get = ranks.get
        order = [get(a << 32 | b, never) for a, b in zip(ids, ids[1:])]
        while order and (best := min(order)) < never:
            i = order.index(best)
            ids[i] = new = made[best]
            del ids[i + 1], order[i]
            if i < len(order):
                order[i] = get(new << 32 | ids[i + 1], never)
            if i:
                order[i - 1] = get(ids[i - 1] << 32 | new, never)
        return ids

    def _exact_long(self, ids: list[int]) -> list[int]:
        """The same over a linked list with a heap: n log n for words of any length."""
        n = len(ids)
        ids, ahead, back = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if (rank := self.ranks.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = ahead[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[rank], -1
            ahead[i] = k = ahead[j]
            if k < n:
                back[k] = i
                offer(i, k)
            if back[i] >= 0:
                offer(back[i], i)
        return [x for x in ids if x >= 0]

    def _propose(self, word: str) -> list[int]:
        out, at, n = [], 0, len(word)
        inner, last, longest, reach = self._inner, self._last, self._longest, self._reach
        while at < n:
            if n - at <= longest and (t := last.get(word[at:])) is not None:
                out.append(t)
                return out
            for to in range(min(n - 1, at + reach.get(word[at : at + 3], 2)), at, -1):
                if (t := inner.get(word[at:to])) is not None:
                    out.append(t)
                    at = to
                    break
            else:
                return []
        return out

    def _compatible(self, codes: np.ndarray) -> np.ndarray:
        """Verdicts of pair codes, from the sorted tables; new pairs are decided once and added."""
        distinct, back = np.unique(codes, return_inverse=True)
        place = np.searchsorted(self._codes, distinct)
        known = place < len(self._codes)
        known[known] = self._codes[place[known]] == distinct[known]
        fresh = distinct[~known]
        if len(fresh):
            if len(self._codes) > MAX_PAIRS:
                self._codes, self._verdicts = np.zeros(0, np.int64), np.zeros(0, bool)
                return self._compatible(codes)
            made = []
            for c in fresh.tolist():
                a, b = divmod(c, 1 << 32)
                made.append(self._exact(self._symbols(self.text_of[a] + self.text_of[b])) == [a, b])
            at = np.searchsorted(self._codes, fresh)
            self._codes, self._verdicts = np.insert(self._codes, at, fresh), np.insert(self._verdicts, at, made)
            place = np.searchsorted(self._codes, distinct)
        return self._verdicts[place][back]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words in byte letters: propose, test all adjacent pairs, merge where a pair fails."""
        found = [self._propose(w) for w in words]
        sizes = np.array([len(f) for f in found], np.int64)
        flat = np.fromiter((t for f in found for t in f), np.int64, int(sizes.sum()))
        bad = sizes == 0
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(words)), sizes)
            inside = owner[1:] == owner[:-1]
            fine = self._compatible((flat[:-1][inside] << 32) | flat[1:][inside])
            bad[owner[1:][inside][~fine]] = True
        self.proposed += len(words)
        for i in np.flatnonzero(bad).tolist():
            self.failed += 1
            found[i] = self._exact(self._word_symbols(words[i]))
        return found

    def _split_text(self, text: str) -> list[str]:
        """Words of a text without special strings, as the normaliser and the splitter make them."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self._split.findall(text.lower())

    def _parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """(special, string) in order."""
        at = 0
        if self._marks is not None and "<" in text:
            for m in self._marks.finditer(text):
                yield False, text[at : m.start()]
                yield True, m[0]
                at = m.end()
        yield False, text[at:]

    def learn(self, words: set[str]) -> None:
        """Encode what isn't remembered of a batch of words. Words unused for MAX_WORDS others are forgotten."""
        if len(self._words) > MAX_WORDS:
            self._words, self._older = {}, self._words
        memory, older = self._words, self._older
        new = [w for w in words if w not in memory]
        memory.update({w: older[w] for w in new if w in older})
        new = [w for w in new if w not in older]
        if new:
            letters, names, texts = self._letters, self._names, self.text_of
            lettered = [w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()]) for w in new]
            for w, ids in zip(new, self.encode_words(lettered), strict=True):
                memory[w] = (" ".join([names[i] for i in ids]), " ".join([texts[i] for i in ids]), len(ids))

    def split(self, text: str) -> Iterator[tuple[str | None, list[str]]]:
        """(special string or None, words) in order, in pieces of a bounded length."""
        at = 0
        while at < len(text):
            to = len(text)
            if to - at > PIECE and (m := _CUT.search(text, at + PIECE)):
                to = m.start()
            for special, part in self._parts(text[at:to]):
                if special:
                    yield part, []
                elif words := self._split_text(part):
                    yield None, words
            at = to

    def stream(self, text: str) -> Iterator[list[tuple[str, str, int]]]:
        """(ids joined by spaces, token texts joined by spaces, number) of each word, in pieces."""
        for special, words in self.split(text):
            yield self.look_up(special, words)

    def look_up(self, special: str | None, words: list[str]) -> list[tuple[str, str, int]]:
        if special is not None:
            return [(str(self.special[special]), special, 1)]
        try:
            return list(map(self._words.__getitem__, words))
        except KeyError:
            self.learn(set(words))
            return list(map(self._words.__getitem__, words))

    def stream_batch(self, texts: list[str]) -> Iterator[Iterator[list[tuple[str, str, int]]]]:
        """stream() of each text, with the new words of all texts of usual length encoded together."""
        parts = [list(self.split(t)) if len(t) <= PIECE else None for t in texts]
        self.learn(set().union(*[words for p in parts if p for _, words in p]))
        for t, p in zip(texts, parts, strict=True):
            yield self.stream(t) if p is None else (self.look_up(*x) for x in p)

    def encode(self, text: str | None) -> list[int]:
        return self.ids(self.stream(text or ""))

    @staticmethod
    def ids(parts: Iterator[list[tuple[str, str, int]]]) -> list[int]:
        return [int(i) for part in parts for ids, _, _ in part for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.text_of[i] for i in ids)

    def plain(self, ids: list[int]) -> str:
        """The words themselves, with a space for every word end; special strings stay."""
        parts = self._plain
        return b"".join([parts[i] for i in ids]).decode("utf-8", "replace").strip(" ")

    def _plain_bytes(self) -> dict[int, bytes]:
        back = {c: b for b, c in self._letters.items()}
        out = {i: t.encode() + b" " for t, i in self.special.items()}
        for t, i in self.vocab.items():
            whole = bool(self.end) and t.endswith(self.end) and len(t) > len(self.end)
            out[i] = bytes(back[c] for c in (t[: len(t) - len(self.end)] if whole else t)) + b" " * whole
        return out


_LOADED: dict[str, WordBpe] = {}


def load(path: str, content: bytes | None = None) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path, content)
    return _LOADED[path]


def _sent(docs: DataFrame, path: str):
    """The tokenizer's file as the driver has it, for every worker: no other machine needs the path."""
    ship(docs.sparkSession)
    size = Path(path).stat().st_size
    if size > MAX_FILE:
        raise ValueError(f"{path} has {size} bytes, more than are sent to every worker")
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def _joined(parts: Iterator[list[tuple[str, str, int]]]) -> tuple[int, str, str]:
    n, ids, texts, first = 0, hashlib.sha256(), hashlib.sha256(), True
    for part in parts:
        if not part:
            continue
        n += sum([x[2] for x in part])
        gap = "" if first else " "
        ids.update((gap + " ".join([x[0] for x in part])).encode())
        texts.update((gap + " ".join([x[1] for x in part])).encode())
        first = False
    return n, ids.hexdigest(), texts.hexdigest()


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of docs (doc_id, text); null is empty.

    Whole texts of any length are encoded piece by piece; repeated rows come out as often; other columns are
    ignored; an empty table gives no rows. The driver reads the file at path and sends it to the workers.
    """
    file = _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, file.value)
        for batch in batches:
            for part in pieces(batch, limit=1 << 20):
                out = [_joined(p) for p in bpe.stream_batch(part.column("text").fill_null("").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out]), pa.array([r[2] for r in out])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs (with text) and the columns token_ids (array of int) and decoded (the plain words of the ids)."""
    file = _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, file.value)
        for batch in batches:
            for part in pieces(batch, limit=1 << 20):
                ids = [bpe.ids(p) for p in bpe.stream_batch(part.column("text").fill_null("").to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.plain(i) for i in ids])], [*part.schema.names, "token_ids", "decoded"])

    taken = [c for c in docs.columns if c not in ("token_ids", "decoded")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*taken).schema.fields)
    return docs.select(*taken).mapInArrow(tidied(run), f"{schema}, token_ids array<int>, decoded string")
