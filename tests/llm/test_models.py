import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import crf, imatch, lm, mixing, pii, secrets, toxicity
from lumenfold.llm.queries import QUERIES
from tests.llm.frames import awkward, none
from tests.llm.test_dedup import words


def test_lm_base_against_brute_force(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in QUERIES["op2_lm_score"](spark, tiny).collect()}
    tokens = {i: [*words(t), "<end>"] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        assert math.isfinite(r.score) and r.score < 0
    test = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


@pytest.mark.parametrize("fan", [4096, 3])
def test_lm_does_not_depend_on_buckets(spark, tiny, monkeypatch, fan):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    base = {r.doc_id: r.score for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "SHARD_BYTES", 50_000)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 40_000)
    monkeypatch.setattr(lm, "FAN", fan)
    more = {r.doc_id: r.score for r in lm.score(docs.repartition(7)).collect()}
    assert base.keys() == more.keys() and all(base[k] == pytest.approx(more[k]) for k in base)


def test_lm_score_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    tunes = {r.doc_id for r in docs.where("pmod(xxhash64('tune', doc_id), 10) = 0").collect()}
    texts = {r.doc_id: [*words(r.text), "</s>"] for r in docs.collect()}
    teach = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}

    def counted(ids):
        uni, bi = collections.Counter(), collections.Counter()
        for i in ids:
            t = texts[i]
            uni.update([*t, "<s>"])
            bi.update(zip(["<s>", *t], t, strict=False))
        return uni, bi, sum(n for w, n in uni.items() if w != "<s>")

    def estimates(t, uni, bi, total):
        for a, w in zip(["<s>", *t], t, strict=False):
            c = uni[a]
            yield (min(int(math.log2(c)) + 1, lm.CONTEXT_BUCKETS - 1) if c else 0), (bi[a, w] / c if c else 0.0), uni[w] / total

    every = counted(teach)
    uniform = 1 / (len([w for w in every[0] if w != "<s>"]) + 1)
    small = counted(teach - tunes)
    step = lambda x: int(np.rint(np.log10(x) * lm.STEP)) if x > 0 else lm.NONE
    cells = collections.Counter((b, step(p), step(q)) for i in teach & tunes for b, p, q in estimates(texts[i], *small))
    weights = lm.mixture_weights(np.array([(*k, n) for k, n in sorted(cells.items())]), uniform)
    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    for i, t in texts.items():
        want = sum(math.log10(weights[b] @ [p, q, uniform]) for b, p, q in estimates(t, *every))
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_lm_weights_are_learned():
    cells = np.array([[3, 0, -32, 900], [3, lm.NONE, -32, 100], [1, lm.NONE, -32, 500], [1, lm.NONE, lm.NONE, 500]])
    w = lm.mixture_weights(cells, 1e-6)
    assert w[3, 0] > 0.8 and w[1, 0] < 0.1 and w[1, 2] > 0.4 and w[0, 0] == 0 and np.allclose(w.sum(1), 1)


def test_lm_probabilities_sum_to_one(spark):
    docs = [(i, t) for i, t in enumerate(["a b a", "a a b", "b a", "a b b a", "b b", "a"] * 4)]
    df = spark.createDataFrame([*docs, (1000, "a"), (1001, "b"), (1002, ""), (1003, "zzz")], "doc_id long, text string")
    test = F.col("doc_id") >= 1000
    got = {r.doc_id: 10**r.score for r in lm.score(df, test).collect()}
    assert 0 < got[1000] < 1 and got[1003] < got[1000] and got[1002] > got[1003]


def test_lm_of_awkward_rows(spark):
    rows = lm.score(awkward(spark)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 15 and by[1].n_tokens == by[2].n_tokens == 1 and by[9].n_tokens == 2 and all(math.isfinite(r.score) for r in rows)
    assert lm.score(none(spark)).count() == 0
    only = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).first()
    assert (only.train_tokens, only.n_known) == (0, 0) and math.isfinite(only.score)


def test_toxicity_on_held_out_rows(spark, small):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    got = QUERIES["op8_toxicity"](spark, small).collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    test = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    caught = sum(p for p, y in test if y) / sum(y for _, y in test)
    assert caught >= 0.7 and sum(p for p, y in test if not y) <= 1


def test_folding():
    assert toxicity.fold("ІDІ0T, m0r0n! $tupid st@re “x”") == " idiot moron tupid stare x " or toxicity.fold("1d10t") == " idiot "
    assert toxicity.fold("1984 and 3.14") == " and " and toxicity.fold("") == "  " or toxicity.fold("").strip() == ""
    machine = toxicity.Lexicon().automaton()
    assert toxicity.weigh(toxicity.fold("you 1d10t"), machine)[0] == 4.0
    assert toxicity.weigh(toxicity.fold("idiot proof tools"), machine)[0] == 0.0
    assert toxicity.normalise(8, 50) > toxicity.normalise(8, 5000) > 0


def test_toxicity_learns_words_and_excuses(spark):
    rows, labels = [], []
    for i in range(300):
        filler = " ".join(f"w{(i * 7 + k) % 50}" for k in range(20))
        bad = i % 4 == 0
        rows.append((i, f"{filler} {'glorbish' + 'abc'[i % 3] if bad else 'fine'} n{i % 11}"))
        labels.append((i, int(bad)))
    docs, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, y)
    assert any(t.startswith("glor") for t in lexicon.weights)
    asked = spark.createDataFrame([(1, "what a GL0RBISHX day"), (2, "what a nice day"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(asked, lexicon).collect()}
    assert (got[1].predicted, got[2].predicted, got[3].predicted) == (1, 0, 0)
    assert toxicity.learn(docs, y.limit(0)).weights == toxicity.PRIOR


def test_labelled_sample_is_bounded_and_holds_equal_texts_once(spark):
    docs = spark.range(3000).selectExpr("id % 6 AS doc_id", "concat('text ', id % 300) AS text").union(spark.createDataFrame([(7, None), (7, None), (8, ""), (None, "x")], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(3, 0), (8, None)], "doc_id long, toxic int")
    rows = toxicity.labelled_sample(docs, labels, 10).collect()
    assert len(rows) == len({r.text for r in rows}) == 10
    every = toxicity.labelled_sample(docs, labels, 1000).collect()
    assert sorted(r.text for r in every) == sorted({"", *(f"text {k}" for k in range(300))})
    assert {r.half for r in every} == {0, 1} and {r.text: r.toxic for r in every}[""] == 1
    assert toxicity.labelled_sample(docs, labels.limit(0)).count() == toxicity.labelled_sample(docs.limit(0), labels).count() == 0


def test_toxicity_of_awkward_rows(spark):
    rows = toxicity.score(awkward(spark), toxicity.Lexicon()).collect()
    assert len(rows) == 15 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none(spark), toxicity.Lexicon()).count() == 0
    kept = toxicity.keep_clean(awkward(spark), toxicity.Lexicon())
    assert kept.columns == awkward(spark).columns and kept.count() == 15


def brute_spans(text):
    import re

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if fine:
                out.append((kind, *m.span()))
    return out


def test_base_spans_against_the_patterns():
    import random

    rng = random.Random(6)
    for _ in range(20_000):
        t = "".join(rng.choice("aB1+-.@ ()%_0123456789é") for _ in range(rng.randrange(50)))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_field_finds_other_guises_and_leaves_clean_text():
    chain = pii.fit()
    texts = ["please call (415) 555-0199 today", "write to maria at example dot org now", "host 2001:db8:0:0:1:0:0:1 is up", "the 2669109448945250 on re thst", "order 20240131 0004417 shipped", "plain words only here", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""]
    found = [set(a) - set(b) for b, a in pii.find(texts, chain)]
    assert [next(iter(f))[0] if f else None for f in found] == ["phone", "email", "ip", None, None, None, None]
    assert pii.redact("a x@y.co b", [("email", 2, 8)]) == "a [EMAIL] b"


def test_field_on_templates_that_it_has_not_seen():
    """Precision and recall of added spans over other names, numbers and sentences than those of the labelled table."""
    chain = pii.fit()
    marked = []
    for lead, tail in (("you can reach me under ", " any time"), ("contact: ", " (evenings)"), ("new number ", " since May")):
        marked += [(lead, x, tail, "phone") for x in ("(718) 555-0143", "415-555-2671", "0221 998 7766", "(089) 4455667", "0161 496 0735")]
    for lead, tail in (("paid with ", " yesterday"), ("card no. ", " was charged")):
        marked += [(lead, x, tail, "card") for x in ("4000.0566.5566.5556", "5105/1051/0510/5100", "4242 4242  4242 4242")]
    for lead, tail in (("ping ", " failed"), ("the server ", " went down"), ("from ", " to here")):
        marked += [(lead, x, tail, "ip") for x in ("2a00:1450:4001:81b::200e", "fd12:3456:789a:1::1", "2001:db8:1:2:3:4:5:6")]
    for lead, tail in (("please answer to ", " soon"), ("sent by ", " today"), ("contact ", " , thanks")):
        marked += [(lead, x, tail, "email") for x in ("p.moreau at posten dot fr", "kim.lee[at]kontor.se", "tom (at) verlag.de", "ANNE AT MUSEUM DOT NL", "office @ library.org", "ops [at] cluster [dot] io")]
    plain = ["parcel 0034567812 345 arrived", "on 03.11.2021 at 14:05:33 we left", "the sum is 2 345 678 901 euros", "build 8.14.3.2291.7 failed", "isbn 978-0-306-40615-7 sold out", "dinner at eight then home", "WAIT AT THE DOOR PLEASE", "5 books @ 12.90 each", "row 11 22 33 44 55 66 77 end", "account 998877665544 closed", "lives at number 12 now", "std::vector of cafe::bar"]
    texts = [a + x + b for a, x, b, _ in marked] + plain
    want = {(i, k, len(a), len(a) + len(x)) for i, (a, x, _, k) in enumerate(marked)}
    got = {(i, *s) for i, (base, all_) in enumerate(pii.find(texts, chain)) for s in set(all_) - set(base)}
    right = len(got & want)
    assert right / len(want) >= 0.8 and right / len(got) >= 0.8, (right, len(want), len(got), sorted(want - got)[:20], sorted(got - want)[:20])


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    rows = [[[f"f{rng.integers(5)}"] for _ in range(rng.integers(1, 6))] for _ in range(40)]
    tags = [["A" if fs[0] in ("f0", "f1") else "B" for fs in r] for r in rows]
    chain = crf.train(rows, tags, steps=60)
    assert chain.viterbi(rows) == tags
    import itertools

    r = rows[0] + rows[1]
    emit, _ = chain._scores([r])
    k = len(chain.labels)
    score = lambda p: chain.first[p[0]] + sum(emit[0, t, x] for t, x in enumerate(p)) + sum(chain.move[a, b] for a, b in zip(p, p[1:], strict=False))
    best = max(itertools.product(range(k), repeat=len(r)), key=score)
    assert chain.viterbi([r])[0] == [chain.labels[i] for i in best] and chain.viterbi([[]]) == [[]]


def test_pii_query_and_awkward_rows(spark, tiny):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in QUERIES["op4_pii"](spark, tiny).collect():
        spans = brute_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.KINDS)
        assert set(filter(None, r.spans.split(","))) >= {f"{k}:{a}:{b}" for k, a, b in spans}
    rows = {r.doc_id: r for r in pii.scan(awkward(spark)).collect()}
    assert rows[12].n_ip == 1 and rows[12].n_email == 1 and rows[1].spans == "" and pii.scan(none(spark)).count() == 0


def test_secrets(spark):
    hexes = ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "9f3b2c7d5e1a4f6b8c0d2e4f6a8b0c1d3e5f7a9b"]
    rows = [(1, f'x token = "{hexes[0]}" y'), (2, f"commit {hexes[1]} merged"), (3, "page 2669109448945250 here"), (4, f"api_key={'aB3' * 11} z token: {hexes[1]}"), (5, None), (6, "supercalifragilisticexpialidocious words"), (7, "x" * 200_000), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("src")).withColumn("token", F.lit(1)).withColumn("score", F.lit(2))
    got = secrets.scan(df).collect()
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start : r.start + r.length] == r.token for r in got)
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        by[r.doc_id].append(r.is_secret)
    assert by[1] == [True] and by[2] == [False] and by[3] == [False] and by[4][-1] is True and set(by) == {1, 2, 3, 4}
    assert secrets.scan(df.limit(0)).count() == 0


def test_secrets_of_other_templates_than_those_learned(spark):
    import random
    import string

    rng = random.Random(12)
    of = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    rows = []
    for _ in range(60):
        hexes, mixed = of("0123456789abcdef", 40), of(string.ascii_letters + string.digits, 32)
        rows += [(f"aws_secret_access_key: {mixed}", mixed, 1), (f'X-Auth-Token="{hexes}"', hexes, 1), (f'  "clientSecret" : "{mixed}",', mixed, 1), (f"export SIGNING_KEY_SECRET={hexes} # x", hexes, 1)]
        rows += [(f"blob {hexes} of the tree", hexes, 0), (f"ETag: {mixed}", mixed, 0), (f"build {of(string.digits, 18)} is out", None, 0), (f"md5sum {hexes[:32]} file.tar", hexes[:32], 0)]
    df = spark.createDataFrame([(i, t, "") for i, (t, _, _) in enumerate(rows)], "doc_id int, text string, source string")
    found = {(r.doc_id, r.token): r.is_secret for r in secrets.scan(df).collect()}
    caught = [found.get((i, k), False) for i, (_, k, y) in enumerate(rows) if y]
    wrong = [any(s for (j, _), s in found.items() if j == i) for i, (_, _, y) in enumerate(rows) if not y]
    assert np.mean(caught) > 0.9 > 0.1 > np.mean(wrong)


def test_the_path_tells_false_positives(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    paths = ["", "src/config.py", "tests/fixtures/a.json", "vendor/x.js"]
    df = spark.createDataFrame([(i, f'token = "{key}"', p) for i, p in enumerate(paths)], "doc_id int, text string, path string")
    assert [r.is_secret for r in secrets.scan(df, path="path").orderBy("doc_id").collect()] == [True, True, False, False]


def brute_candidates(docs, path="source"):
    """Candidates by Python's regex module, one by one."""
    import regex

    pattern = regex.compile(secrets.CANDIDATE)
    out = []
    for r in docs:
        t = r["text"] or ""
        hits = list(pattern.finditer(t))
        for h in hits:
            out.append((r["doc_id"], h.start(), h[0], t[max(0, h.start() - secrets.CONTEXT) : h.start()], t[h.end() : h.end() + secrets.CONTEXT], r[path] or ""))
    return sorted(out, key=str)


def test_secret_candidates_against_brute_force(spark, tiny, monkeypatch):
    monkeypatch.setattr(secrets, "BLOCK", 3)
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "source")
    key = "a1b2c3d4e5f6a7b8c9d0"
    many = " ".join(f"tok{i}{key}" for i in range(50)) + " postgres://u:pw!word@h/ password=hunter2 é漢🙂 " + key
    extra = spark.createDataFrame([(-1, many, None), (-1, many, None), (None, key, "s"), (-2, "x" * 100_000, "s"), (-3, None, "s"), (-4, "", None)], "doc_id long, text string, source string")
    docs = docs.unionByName(extra)
    got = sorted([(r.doc_id, r.start, r.token, r.before, r.after, r.path) for r in secrets.candidates(docs).collect()], key=str)
    want = brute_candidates(docs.collect())
    # what stands after a token ends at the next one, and before it reaches over the last one only
    assert [x[:3] for x in got] == [x[:3] for x in want] and len(got) > 60
    assert all(w[3].endswith(g[3]) and w[4].startswith(g[4]) and g[5] == w[5] for g, w in zip(got, want, strict=True))
    assert any(t == "pw!word" for _, _, t, *_ in got)


def test_secrets_of_awkward_rows(spark):
    rows = awkward(spark).withColumn("text", F.concat("text", F.lit(" api_key=04dbebab91ab85687d33eeaaf9ac699e1188f962")))
    got = secrets.scan(rows).collect()
    assert sum(r.token.startswith("04db") for r in got) == 13 and all(r.is_secret for r in got if r.token.startswith("04db"))
    assert secrets.scan(none(spark)).count() == 0


def test_secret_candidates_take_linear_time(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, " ".join(f"k{i:06d}a1b2c3d4e5f6a7" for i in range(n)), "s")], "doc_id int, text string, source string")
        begin = time.time()
        assert secrets.candidates(df).selectExpr("count(*) AS n", "sum(start) AS s", "sum(length(before)) AS b").first().n == n
        return time.time() - begin

    seconds(1000)
    assert seconds(64_000) < 8 * seconds(16_000) + 2


def test_mixing(spark):
    def inverse(rate, u):
        return spark.createDataFrame([(float(x),) for x in u], "u double").select(mixing.poisson_inverse(F.lit(rate), F.col("u")).alias("n")).toPandas()["n"].tolist()

    acc, p, steps = 0.0, math.exp(-2.5), []
    for k in range(20):
        acc += p
        steps.append(acc)
        p *= 2.5 / (k + 1)
    us = np.random.default_rng(3).random(300)
    assert inverse(2.5, us) == [sum(c < u for c in steps) for u in us]
    assert inverse(0.0, [0.5]) == [0] and abs(inverse(2000.0, [0.5])[0] - 2000) < 2 and inverse(2000.0, [1 - 1e-15])[0] < 2600
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 4) END AS source", "id AS rate")
    weights = spark.createDataFrame([("hot", 0.5), ("s1", 0.5), ("other", 3.0)], "source string, weight double")
    rows = mixing.mix(docs, weights, total=8000).collect()
    by = collections.Counter(r.source for r in rows)
    assert set(by) == {"hot", "s1"} and abs(by["hot"] - by["s1"] * by["hot"] / max(by["s1"], 1)) < 1 and 3500 < by["hot"] < 4500
    again = mixing.mix(docs.repartition(9), weights, total=8000).collect()
    assert sorted((r.doc_id, r.copy_no) for r in rows) == sorted((r.doc_id, r.copy_no) for r in again)
    first = [r.doc_id for r in rows[:500]]
    assert first != sorted(first)
    out = mixing.mix(awkward(spark))
    assert out.columns == [c for c in awkward(spark).columns if c not in mixing.ADDED] + list(mixing.ADDED)
    assert {r.source for r in mixing.mix(awkward(spark), total=500).collect()} == {"s", None}
    assert mixing.mix(none(spark)).count() == 0


def test_mixing_with_more_sources_than_are_broadcast(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('s', id % 40) END AS source").repartition(5)
    want = sorted((r.doc_id, r.copy_no, r.rate) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    monkeypatch.setattr(mixing, "HOT_PARTS", 6)
    assert sorted((r.doc_id, r.copy_no, r.rate) for r in mixing.mix(docs).collect()) == want


def test_imatch(spark, tiny, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_BYTES", 50_000)
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in QUERIES["op9_imatch"](spark, tiny).collect()}
    import hashlib

    prints = {}
    for (i, t), (_, n) in zip(rows, [*rows[1:], rows[0]], strict=True):
        k = len(t) // 3
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest() and got[i].n_chars == len(t)
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert np.mean([r.near_edited for r in got.values()]) > 0.3 > 0.05 > np.mean([r.near_next for r in got.values()])
    awk = imatch.with_edits(awkward(spark)).collect()
    assert len(awk) == 15 and all(r.fingerprint == "empty" for r in awk if r.n_chars == 0)
    assert imatch.with_edits(none(spark)).count() == 0
    one = imatch.with_edits(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_imatch_prints_every_word_of_the_lexicon():
    import pyarrow as pa

    own = [f"w{i}" for i in range(1000)]
    lex = np.sort(imatch.hash_words(pa.array([" ".join(own)]))[0])
    prints = imatch.fingerprints(pa.array([" ".join(own), *(" ".join(own[:i] + own[i + 1 :]) for i in range(1000)), " ".join(own[500:] + own[:500]) + " other", " ".join(own[:40])]), lex)
    whole, *less, turned, part = prints.lines()
    assert whole not in less and turned == whole and len(set(less)) == 1000 and len(part) == len(whole) - 1
    assert all(0.8 < imatch.likeness(whole, p) < 1 for p in less) and np.mean([imatch.likeness(whole, p) for p in less]) > 0.95
    shared = [f"w{i}" for i in range(32)]
    a, b = imatch.fingerprints(pa.array([" ".join(shared + own[32:500]), " ".join(shared + own[500:968])]), lex).lines()
    assert a != b and imatch.likeness(a, b) < 0.2


def brute_print(text, lex):
    """Kind, level, whole and subset hashes of one text in plain integers."""
    import pyarrow as pa

    full = (1 << 64) - 1

    def mix(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> 33)) * m & full
        return x ^ (x >> 33)

    found = {int(h) for h in imatch.hash_words(pa.array([text or ""]))[0]}
    if not found:
        return "empty"
    own = found & {int(x) for x in lex}
    kind, own = ("i", own) if own else ("w", found)
    level = math.ceil(math.log2(len(own)))
    whole = max(1, mix(sum(map(mix, own)) & full))
    parts = []
    for step in range(imatch.LEVELS):
        hashes = []
        for x, o in zip(imatch._XOR.tolist(), imatch._ODD.tolist(), strict=True):
            places = [((t ^ x) * o) & full for t in own]
            some = sum(p for p in places if p >> (64 - level - step) == 0 or level + step == 0) & full
            hashes.append(max(1, mix(some) >> 32) if some else 0)
        parts.append("".join(f"{h:08x}" for h in hashes))
    return f"{kind}{level}:{whole:016x}:{':'.join(parts)}"


def brute_likeness(p, q):
    if p == q:
        return 1.0
    if "empty" in (p, q) or p[0] != q[0]:
        return 0.0
    (a, _, *x), (b, _, *y) = p[1:].split(":"), q[1:].split(":")
    same = either = 0
    for i, u in enumerate(x):
        for j, v in enumerate(y):
            if int(a) + i == int(b) + j:
                for k in range(0, len(u), 8):
                    either += (u[k : k + 8], v[k : k + 8]) != ("0" * 8, "0" * 8)
                    same += u[k : k + 8] == v[k : k + 8] != "0" * 8
    return same / (either + 1)


def test_imatch_against_brute_force(spark, tiny):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()), reverse=True)
    df = collections.Counter(w for _, t in docs for w in set(words(t)))
    band = [w for w, n in df.items() if max(imatch.AT_LEAST, imatch.LOWEST * len(docs)) <= n <= imatch.HIGHEST * len(docs)]
    import pyarrow as pa

    lex = imatch.hash_words(pa.array([" ".join(band)]))[0]
    got = {r.doc_id: r for r in QUERIES["op9_imatch"](spark, tiny).collect()}
    for (i, t), (_, n) in list(zip(docs, [*docs[1:], docs[0]], strict=True))[::3]:
        k = len(t) // 3
        own, changed, after = (brute_print(x, lex) for x in (t, t[: len(t) - k] + n[:k], n))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (own, changed)
        assert got[i].near_edited == pytest.approx(brute_likeness(own, changed)) and got[i].near_next == pytest.approx(brute_likeness(own, after))


def test_imatch_ranges_of_hot_and_missing_ids(spark, monkeypatch):
    import hashlib
    import random

    monkeypatch.setattr(imatch, "RANGE_BYTES", 3000)
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 60)))
    rows = [(i, text()) for i in range(100)] + [(50, text()) for _ in range(100)] + [(None, text()) for _ in range(100)] + [(None, "same same")] * 30 + [(70, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    hashes = {r.t: r.h for r in df.selectExpr("coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS h").collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = []
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True):
        k = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()))
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in imatch.with_edits(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    ranges = imatch._ranges(df.selectExpr("doc_id", "xxhash64(coalesce(text, '')) AS h", "cast(octet_length(coalesce(text, '')) AS long) AS size"))
    assert ranges.slices.max() > 3 and len(ranges.first) > 10


def test_secrets_behind_names_and_short_ones(spark):
    key, web = "9c8b1f7e2d3a4b5c6d7e8f9a0b1c2d3e4f5a6b7c", "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    cases = [
        (f"API_KEY={key} end", key), (f"client_secret={key}", key), (f"MY_SERVICE_2_API_KEY={key}", key), (f"api_key={'aB3' * 11} z", "aB3" * 11), ('password = "S3cr!x7"', "S3cr!x7"), ("db_password: qWzrtKpvXzbn", "qWzrtKpvXzbn"),
        (f"Authorization: Bearer {web}", web), (f'"token": "{web}",', web),
    ]
    df = spark.createDataFrame([(i, t, "") for i, (t, _) in enumerate(cases)], "doc_id int, text string, source string")
    got = {(r.doc_id, r.token): r for r in secrets.scan(df).collect()}
    for i, (text, token) in enumerate(cases):
        assert (i, token) in got and got[i, token].start == text.index(token) and got[i, token].is_secret, (text, [(r.token, r.score) for (j, _), r in got.items() if j == i])
    plain = spark.createDataFrame([(1, "the secret of the house, a password and tokens; see: somewhere", "")], "doc_id int, text string, source string")
    assert secrets.scan(plain).count() == 0
