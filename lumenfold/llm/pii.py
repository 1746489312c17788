"""Personal data: exact base patterns for four kinds, and further spans by a conditional random field.

The field labels the tokens of windows around what may be personal data in another guise (numbers in groups
of seven or more digits, at signs spelt out or between blanks, colon-separated addresses; in any case) by
word-shape features; texts without such a place aren't decoded. It is trained
from a small labelled table and decoded by Viterbi in numpy batches. Its spans are kept where they don't
touch a base span and pass their kind's test; base spans always stay.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import crf
from lumenfold.llm.words import pieces, tidied
from lumenfold.runtime import ship

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a start within a digit run never matches where the run's start doesn't
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return _NOT_DIGIT.sub("", text)


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from their at signs so that long runs cost no more than their length."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = len(text[free:at].rstrip(_LOCAL)) + free
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield "email", start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """The base spans by kind, then start."""
    out = list(emails(text))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0") or "0") <= 3 and int(q) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


#: What may be personal data in another guise; the field decides.
_HINT = re.compile(r"(?<![\w.])\(?[0-9](?:[ \xa0()./‐-–-]{0,2}[0-9]){6,30}(?!\w)|(?<!\w)[\w.+-]{1,64} ?(?:\[at\]|\(at\)|\{at\}|\bat\b|＠|(?<= )@|@(?= )) ?[\w-]{1,64}|(?<![\w:])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?=[0-9a-f:]{2,40}::|[0-9a-f]{1,4}::)(?:[0-9a-f]{1,4}:{1,2}){1,7}[0-9a-f]{1,4})(?![\w:])", re.IGNORECASE)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_AROUND = 48


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around hints, merged where they meet."""
    out: list[list[int]] = []
    for m in _HINT.finditer(text):
        a, b = max(0, m.start() - _AROUND), min(len(text), m.end() + _AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _shape(token: str) -> str:
    if token.isdigit():
        return f"d{min(len(token), 9)}"
    if token.isalpha():
        kind = "x" if token.islower() else "X" if token.isupper() else "Xx"
        return f"{kind}{min(len(token), 4)}" + ("h" if all(c in "abcdefABCDEF" for c in token) else "")
    return token


#: Words near personal data, and words near numbers that aren't.
_NEAR = frozenset("at dot com net org mail email e call phone tel telephone mobile cell fax ring dial card visa mastercard amex credit payment ip ipv6 host address order invoice isbn ticket ref serial version date page item total id".split())


def features(text: str, tokens: list[tuple[int, int]]) -> list[list[str]]:
    """Word-shape features of each token and its neighbours."""
    words = [text[a:b] for a, b in tokens]
    shapes = [_shape(w) for w in words]
    keys = [w.lower() if w.lower() in _NEAR else "" for w in words]
    glued = [i > 0 and tokens[i - 1][1] == tokens[i][0] for i in range(len(tokens))]
    run, digits = [0] * len(words), ""
    i = 0
    while i < len(words):  # digits in the run of numbers and joiners that a token is in
        j = i
        while j < len(words) and (words[j].isdigit() or words[j] in "()-./+" and len(words[j]) == 1):
            j += 1
        digits = "".join(w for w in words[i:j] if w.isdigit())
        for k in range(i, j):
            run[k] = min(len(digits), 20)
        i = max(j, i + 1)
    out = []
    for i, w in enumerate(words):
        f = ["bias", f"s={shapes[i]}", f"g={glued[i]}", f"run={run[i]}", f"s-1={shapes[i - 1] if i else '^'}", f"s+1={shapes[i + 1] if i + 1 < len(words) else '$'}", f"s-1s={shapes[i - 1] if i else '^'}|{shapes[i]}", f"ss+1={shapes[i]}|{shapes[i + 1] if i + 1 < len(words) else '$'}"]
        f += [f"k{d}={keys[i + d]}" for d in (-3, -2, -1, 0, 1, 2) if 0 <= i + d < len(words) and keys[i + d]]
        if w.isdigit() and 13 <= len(w) <= 19:
            f.append(f"luhn={luhn(w)}")
        out.append(f)
    return out


def labelled_table() -> list[tuple[str, list[Span]]]:
    """The small labelled table, made by rule: texts with marked spans, and look-alikes without any."""
    names = ["anna.berg", "j.ortiz", "lee", "m.dupont", "sam_k", "info", "k.roth"]
    hosts = [("mail", "com"), ("example", "org"), ("post", "net"), ("web", "de")]
    phones = ["(262) 555-3752", "262-555-3752", "0331 123 4567", "555.014.2233", "00 49 30 1234567", "(030) 5551234", "020 7946 0958", "06-12-34-56-78", "0171/5550123"]
    cards = ["4111 1111  1111 1111", "4111.1111.1111.1111", "5500/0000/0000/0004", "4012.8888.8888.1881", "3782.822463.10005"]
    addresses = ["2001:db8:0:1:1:1:1:1", "fe80::1ff:fe23:4567:890a", "2001:db8:85a3:8d3:1319:8a2e:370:7348", "fe80::1", "2001:db8::8a2e:7", "FE80::23:45", "2a02:8108:4f::c2", "2606:4700:e2::ac43:8d", "fd00:12:3::1"]
    lead = ["call {} now", "tel: {} or later", "my phone is {}.", "mobile {} , thanks", "dial {} today", "fax {} and wait"]
    out: list[tuple[str, list[Span]]] = []

    def add(pattern: str, kind: str | None, value: str) -> None:
        at = pattern.index("{}")
        out.append((pattern.replace("{}", value), [(kind, at, at + len(value))] if kind else []))

    for i, p in enumerate(phones):
        for k in range(3):
            add(lead[(i + 2 * k) % len(lead)], "phone", p)
    for i, c in enumerate(cards):
        for pattern in ("card {} exp 12", "visa: {} please", "credit card {} , ok", "payment by {} done", "mastercard nr. {} of June", "charge {} again"):
            add(pattern, "card", c)
    for a in addresses:
        for pattern in ("ip {} is up", "host {} answered", "address {} , port 80"):
            add(pattern, "ip", a)
    for i, n in enumerate(names):
        host, top = hosts[i % len(hosts)]
        spelt, marked = f"{n} at {host} dot {top}", f"{n}[at]{host}.{top}"
        for form in (spelt, marked, f"{n} (at) {host}.{top}", f"{n} [at] {host} [dot] {top}", f"{n} @ {host}.{top}", spelt.upper(), marked.upper()):
            add(["mail {} for more", "write to {} .", "email: {} , please", "or {} if need be"][i % 4], "email", form)
    plain = [
        "order 20240131 0004417 shipped", "invoice 1203984756 of May", "isbn 978-3-16-148410-0 , new", "on 2024-01-31 12:30:55 it ended", "total 1 234 567 890 units", "version 10.4.22.1087.3 is out", "ticket 8812345-77 closed", "ref 4929348385146306 x",
        "the 2669109448945250 on re thst", "de 7536784127813050 4845168114407329 la", "page 120 130 140 150 160 170", "serial 0045-9981-2231-7781-20", "look at home tonight", "we met at noon again", "sat at table nine then", "stay at work 12 hours", "time 10:20:30:40 left", "it was at the end dot", "pi 3.14159265358979 is", "item 123456789 sold", "id 000123456789 x",
        "a 12345678 b", "von 9807915762804490 die", "la 14 15 16 17 18 19 20 la", "1999-2003 2004-2008 years", "scores 10 20 30 40 50 60", "key at row 5 col 7", "LOOK AT HOME TONIGHT", "MEET AT NOON. THEN", "3 apples @ 2.50 each", "see @ home , later", "use std::cafe here", "a::b in code", "date 31.12.2023 24.12.2022", "mac 00:1b:44:11:3a:b7 seen",
    ]
    return out + [(t, []) for t in plain for _ in range(2)]


def _tagged(text: str, spans: list[Span]) -> tuple[list[list[str]], list[str]]:
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    tags = []
    for a, b in tokens:
        inside = next((s for s in spans if s[1] <= a and b <= s[2]), None)
        tags.append("O" if inside is None else f"B-{inside[0]}" if a == inside[1] else f"I-{inside[0]}")
    return features(text, tokens), tags


@functools.lru_cache(4)
def _fitted(table: tuple[tuple[str, tuple[Span, ...]], ...]) -> crf.Chain:
    rows, tags = zip(*[_tagged(t, list(s)) for t, s in table], strict=True)
    return crf.train(list(rows), list(tags))


def fit(table: list[tuple[str, list[Span]]] | None = None) -> crf.Chain:
    """A field from a labelled table of (text, [(kind, start, end)])."""
    return _fitted(tuple((t, tuple(map(tuple, s))) for t, s in (labelled_table() if table is None else table)))


def _passes(kind: str, text: str) -> bool:
    d = _digits(text)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 7 <= len(d) <= 15 and not re.fullmatch("[0-9]+", text)
    if kind == "ip":
        return text.count(":") == 7 or (text.count("::") == 1 and any(c.isdigit() for c in text))
    return bool(re.search(r"[\[({]at[\])}]| at |＠| @|@ ", text, re.IGNORECASE)) and bool(re.search(r"\.[A-Za-z]{2,}$|\bdot\W*\s*[A-Za-z]{2,}$", text, re.IGNORECASE))


def find(texts: list[str], chain: crf.Chain) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, both by kind and start."""
    base = [base_spans(t) for t in texts]
    spots = [(i, a, b) for i, t in enumerate(texts) for a, b in windows(t)]
    tokens = [[(a + m.start(), a + m.end()) for m in _TOKEN.finditer(texts[i][a:b])] for i, a, b in spots]
    tags = chain.viterbi([features(texts[i], t) for (i, _, _), t in zip(spots, tokens, strict=True)])
    more: list[list[Span]] = [[] for _ in texts]
    for (i, _, _), toks, labels in zip(spots, tokens, tags, strict=True):
        k = 0
        while k < len(toks):
            if labels[k][0] == "B":
                kind, to = labels[k][2:], k
                while to + 1 < len(toks) and labels[to + 1] == f"I-{kind}":
                    to += 1
                a, b = toks[k][0], toks[to][1]
                if _passes(kind, texts[i][a:b]) and not any(x < b and a < y for _, x, y in base[i]):
                    more[i].append((kind, a, b))
                k = to
            k += 1
    order = {k: n for n, k in enumerate(KINDS)}
    return [(b, sorted(set(b + m), key=lambda s: (order[s[0]], s[1], s[2]))) for b, m in zip(base, more, strict=True)]


def _line(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, table: list[tuple[str, list[Span]]] | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row of docs (doc_id, text).

    The counts and base_sha256 are of the base spans, spans lists all, n_added counts those the field added.
    Places are code points, ends exclusive. Null is empty; whole texts of any length; repeated rows come out
    as often; other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    chain = fit(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found = find(part.column("text").fill_null("").to_pylist(), chain)
                counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts, pa.array([hashlib.sha256(_line(b).encode()).hexdigest() for b, _ in found]), pa.array([_line(s) for _, s in found]), pa.array([len(s) - len(b) for b, s in found], pa.int64())],
                    ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
                )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(tidied(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]])
