"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, takes homoglyphs, accents and digit substitutions back to plain letters, and turns all
else into single separators. Lexicon entries are word beginnings with log-odds weights, learned from labelled
texts; a word counts the weight of its heaviest entry unless it lies in an exception phrase. The sum of
weights is normalised by length and mapped to 0..1 by a logistic curve, which is fitted on scores from a
lexicon that has not seen the text in question (two folds).
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.words import pieces, tidied
from lumenfold.runtime import cut, ship

#: The most labelled texts (by hash) that a lexicon is learned from.
MAX_LABELLED = 20_000
#: Lengths of the word beginnings considered, beside whole words of up to LONGEST letters.
STEMS = (4, 5, 6, 7, 8)
LONGEST = 40
#: An entry needs so many toxic texts, neighbours to the left, and so large a share of the toxic texts.
MIN_SUPPORT, MIN_SHARE, MIN_WEIGHT, MAX_WEIGHT = 3, 0.004, 2.2, 7.0
#: Texts at the base rate of toxicity that every entry is taken to have had besides.
DOUBT = 6.0
CUT = 0.7

#: Letters of other scripts that look like Latin ones.
_ALIKE = {"а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d"}
#: Digits and signs that stand for letters within words.
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
#: Plain insults known without labels, and phrases that excuse their words.
PRIOR = {"idiot": 4.0, "moron": 4.0, "imbecil": 4.0, "stupid": 3.0, "scum": 3.0, "loser": 3.0, "worthless": 3.0, "disgusting": 2.5, "pathetic": 2.5}
EXCEPTIONS = ("idiot proof", "sore loser", "pond scum", "soap scum", "trash can", "trash bin", "clown fish", "class clown")


def _table() -> dict[int, str]:
    out = {c: " " for c in range(128) if not chr(c).isalpha()}
    out |= {ord(k): v for k, v in _LEET.items()}
    out[ord("'")] = ""
    for c in range(0x00A0, 0x0250):
        ch = chr(c)
        base = unicodedata.normalize("NFKD", ch.lower())
        out[c] = base[0] if base[0].isascii() and base[0].isalpha() else ch.lower() if ch.isalpha() else " "
    for c in range(0xFF01, 0xFF5F):
        out[c] = out.get(c - 0xFEE0, chr(c - 0xFEE0).lower())
    out |= {c: "" for c in (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x0300, 0x0370))}
    out |= {c: " " for c in range(0x2000, 0x200B)}
    out |= {c: " " for c in range(0x2010, 0x2060)}
    out |= {ord(k): v for k, v in _ALIKE.items()}
    return out


_FOLD = _table()
_INNER = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")
_DIGITS = re.compile(r"(?<![^\W_])\d[\d.,:/-]*(?![^\W_])")


def fold(text: str) -> str:
    """Words of plain letters, each with one space before it, and a space at the end."""
    text = _INNER.sub(lambda m: _SIGNS[m[0]], _DIGITS.sub(" ", text.lower()))
    return f" {' '.join(text.translate(_FOLD).split())} "


def stems(word: str) -> list[str]:
    """The beginnings of a word, and the whole word with a space behind it."""
    return [word[:n] for n in STEMS if len(word) > n] + ([f"{word} "] if 2 < len(word) <= LONGEST else [])


@dataclass
class Lexicon:
    """Entries with weights, phrases that excuse, and the curve from the normalised sum to a score."""

    weights: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 2.0
    offset: float = -1.5

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(f" {term}", (len(term), w))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 1, None))
        if len(a):
            a.make_automaton()
        return a

    def score(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * x + self.offset))))


def weigh(folded: str, automaton: ahocorasick.Automaton) -> tuple[float, list[int]]:
    """Sum over words of the heaviest entry that begins them, and where those words begin."""
    if not len(automaton):
        return 0.0, []
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(folded):
        at = end - n + 1
        if w is None:
            excused.append((at, end))
        elif w > best.get(at, 0.0):
            best[at] = w
    for a, b in excused:
        for at in [x for x in best if a <= x <= b]:
            del best[at]
    return sum(best.values()), sorted(best)


def normalise(total: float, words: int) -> float:
    """Weight per hundred words for short texts, and ever less strictly by length for long ones."""
    return math.log1p(10 * total / math.sqrt(100 + words)) if total else 0.0


def _pick(toxic: Counter, clean: Counter, lefts: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    need = max(MIN_SUPPORT, MIN_SHARE * n_toxic)
    out: dict[str, float] = {}
    for term, t in sorted(toxic.items(), key=lambda x: (len(x[0]), x[0])):
        if t < need or lefts[term] < need:
            continue
        base = n_toxic / (n_toxic + n_clean)
        yes, no = t + DOUBT * base, clean[term] + DOUBT * (1 - base)
        w = math.log(yes / no) - math.log(n_toxic / n_clean)
        if w >= MIN_WEIGHT and not any(out.get(term[:n], 0) >= min(w, MAX_WEIGHT) - 0.7 for n in range(3, len(term))):
            out[term] = min(w, MAX_WEIGHT)
    return out


def _toxic_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of one partition of toxic texts: (half, term, texts, distinct neighbours to the left)."""
    texts: Counter = Counter()
    lefts: dict[tuple[int, str], set[int]] = defaultdict(set)
    for batch in batches:
        for half, text in zip(*(batch.column(c).to_pylist() for c in ("half", "text")), strict=True):
            seen: set[str] = set()
            before = ""
            for w in fold(text).split():
                for s in stems(w):
                    seen.add(s)
                    lefts[half, s].add(zlib.crc32(before.encode()))
                before = w
            texts.update((half, s) for s in seen)
    rows = [(*k, n, sorted(lefts[k])) for k, n in texts.items()]
    for a in range(0, len(rows), 20_000):
        cols = list(zip(*rows[a : a + 20_000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64()))], ["half", "term", "texts", "lefts"])


def _clean_terms(wanted: frozenset[str]):
    """Partial counts of one partition of clean texts, of the wanted terms only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: Counter = Counter()
        for batch in batches:
            for half, text in zip(*(batch.column(c).to_pylist() for c in ("half", "text")), strict=True):
                texts.update((half, s) for s in {s for w in set(fold(text).split()) for s in stems(w)} & wanted)
        cols = list(zip(*[(*k, n) for k, n in texts.items()], strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["half", "term", "texts"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, toxic, half) of at most ``bound`` labelled texts, chosen by hash; equal texts once.

    half is of the whole text's hash. A text with both labels counts as toxic. Rows that repeat a doc_id are
    different texts under one label.
    """
    y = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = max(1, y.count())
    if n > bound:  # about bound labels, so that they can be broadcast
        y = y.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 20)) < int(bound / n * (1 << 20)))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = rows.join(F.broadcast(y), "doc_id").select("doc_id", "toxic", F.unhex(F.md5("text")).alias("digest"))
    picked = seen.groupBy("digest").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    picked = cut(picked.orderBy(F.xxhash64("digest"), "digest").limit(bound))
    # one row of each text that was picked; texts are hashed where the doc_id is among those
    near = rows.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi").withColumn("digest", F.unhex(F.md5("text")))
    found = near.join(F.broadcast(picked), ["doc_id", "digest"]).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return found.select("doc_id", "text", "toxic", F.pmod(F.xxhash64("digest"), F.lit(2)).cast("int").alias("half"))


def learn(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Lexicon:
    """A lexicon from docs (doc_id, text) and labels (doc_id, toxic in 0, 1; null is no label).

    Without labels of both kinds it is the prior. A text labelled both ways counts as toxic.
    """
    ship(docs.sparkSession)
    rows = cut(labelled_sample(docs, labels, bound))
    size = {(r.half, r.toxic): r.n for r in rows.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    total = size.get((0, 1), 0) + size.get((1, 1), 0)
    if not total or not (size.get((0, 0), 0) + size.get((1, 0), 0)):
        return Lexicon()
    # entries need MIN_SHARE of the toxic texts, so at most (stems per text / MIN_SHARE) of them come here
    smallest = min(max(MIN_SUPPORT, MIN_SHARE * n) for n in (size.get((0, 1), 0), size.get((1, 1), 0), total))
    found = rows.where("toxic = 1").mapInArrow(tidied(_toxic_terms), "half int, term string, texts long, lefts array<long>").groupBy("term")
    found = found.agg(*[F.coalesce(F.sum(F.when(F.col("half") == h, F.col("texts"))), F.lit(0)).alias(f"n{h}") for h in (0, 1)], *[F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("half") == h, F.col("lefts")))))).alias(f"left{h}") for h in (0, 1)])
    kept = found.where((F.col("n0") + F.col("n1") >= smallest) & (F.col("left0") + F.col("left1") >= smallest)).collect()
    others = rows.where("toxic = 0").mapInArrow(tidied(_clean_terms(frozenset(r.term for r in kept))), "half int, term string, texts long").groupBy("half", "term").agg(F.sum("texts").alias("n")).collect()
    counts = {(h, 1): Counter({r.term: r[f"n{h}"] for r in kept}) for h in (0, 1)} | {(h, 0): Counter({r.term: r.n for r in others if r.half == h}) for h in (0, 1)}
    lefts = {h: {r.term: r[f"left{h}"] for r in kept} for h in (0, 1)}
    half = {h: _pick(counts[h, 1], counts[h, 0], lefts[h], size.get((h, 1), 0), size.get((h, 0), 0)) for h in (0, 1)}
    whole = _pick(counts[0, 1] + counts[1, 1], counts[0, 0] + counts[1, 0], {t: lefts[0][t] + lefts[1][t] for t in lefts[0]}, total, size.get((0, 0), 0) + size.get((1, 0), 0))
    lexicons = [Lexicon(PRIOR | half[1 - h]) for h in (0, 1)] + [Lexicon(PRIOR | whole)]

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [x.automaton() for x in lexicons]
        for batch in batches:
            out: list[tuple[int, float, list[str]]] = []
            for h, label, text in zip(*(batch.column(c).to_pylist() for c in ("half", "toxic", "text")), strict=True):
                folded = fold(text)
                x = normalise(weigh(folded, machines[h])[0], folded.count(" ") - 1)
                near = []
                for at in weigh(folded, machines[2])[1]:
                    word, left, right = folded[at:].split(" ", 2)[0], folded[:at].rsplit(" ", 2)[-2], folded[at:].split(" ", 2)[1]
                    near += [f"{left} {word}"] * bool(left) + [f"{word} {right}"] * bool(right)
                out.append((label, x, sorted(set(near))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.float64()), pa.array([r[2] for r in out], pa.list_(pa.string()))], ["toxic", "x", "near"])

    seen = rows.mapInArrow(tidied(weighed), "toxic int, x double, near array<string>").collect()  # at most about bound rows
    phrases = {y: Counter(p for r in seen if r.toxic == y for p in r.near) for y in (0, 1)}
    excused = tuple(sorted(p for p, n in phrases[0].items() if n >= MIN_SUPPORT and not phrases[1][p]))
    slope, offset = _logistic(np.array([r.x for r in seen]), np.array([r.toxic for r in seen], float))
    return Lexicon(PRIOR | whole, EXCEPTIONS + excused, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray, prior: float = 0.02) -> tuple[float, float]:
    """Slope and offset by Newton's method, held back by a weak prior so that separable labels converge."""
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + prior * np.eye(2), design.T @ (y - p) - prior * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0.1)), float(w[1])


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, predicted, hits) for every row of docs (doc_id, text): predicted is 1 from CUT on.

    Null and empty texts get the score of a text without hits. Whole texts are read; repeated rows come out
    as often; other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for part in (p for batch in batches for p in pieces(batch)):
            scores, hits = [], []
            for text in part.column("text"):
                folded = fold(text.as_py() or "")
                total, places = weigh(folded, machine)
                scores.append(lexicon.score(normalise(total, folded.count(" ") - 1)))
                hits.append(len(places))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= CUT) for s in scores], pa.int32()), pa.array(hits, pa.int64())], ["doc_id", "score", "predicted", "hits"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(tidied(run), "doc_id long, score double, predicted int, hits long")


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs, all columns as they were, without the rows whose text scores CUT or more."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for part in (p for batch in batches for p in pieces(batch)):
            keep = []
            for text in part.column("text"):
                folded = fold(text.as_py() or "")
                keep.append(lexicon.score(normalise(weigh(folded, machine)[0], folded.count(" ") - 1)) < CUT)
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def held_out() -> F.Column:
    """Whether crc32 of doc_id as text (null: empty) leaves 1 by 3; such rows never teach."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1
