import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lumenfold.llm import exact, minhash
from lumenfold.llm.queries import ORACLE_SQL, QUERIES
from lumenfold.llm.words import hash_words, shingle_sets
from tests.compare import connect, rows
from tests.llm.frames import awkward, none


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_sets(docs):
    out = {}
    for i, t in docs:
        w = words(t)
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute_components(docs):
    sets = brute_sets(docs)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_word_hashes_follow_the_definition():
    texts = [None, "", "  ", "A b\tc d", "x" * 5_000_000 + " t a i l", " " * 5_000_000 + "end", "é è ü", "a b", "A B"]
    values, off = hash_words(pa.array(texts))
    assert [b - a for a, b in zip(off, off[1:], strict=False)] == [len(words(t)) for t in texts]
    by_word = collections.defaultdict(set)
    for t, a, b in zip(texts, off, off[1:], strict=False):
        for w, h in zip(words(t), values[a:b], strict=True):
            by_word[w].add(int(h))
    assert all(len(v) == 1 for v in by_word.values()) and len({min(v) for v in by_word.values()}) == len(by_word)
    assert [len(s) for s in shingle_sets(pa.array(["a b c d e f", "a b", "", "a a a a a a a"]))] == [2, 1, 0, 1]


def test_signature_matches_estimate_likeness():
    rng = np.random.default_rng(1)
    low = 64
    for _ in range(200):
        common, a, b = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (300, 50, 50))
        s = minhash.signatures([np.unique(np.concatenate([common, x])) for x in (a, b)])
        low = min(low, int((s[0] == s[1]).sum()))
    assert low >= minhash.MATCHES


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(400)]
    docs, base = [], [rng.choices(vocab, k=rng.randint(3, 60)) for _ in range(40)]
    common = rng.choices(vocab, k=40)
    for i in range(400):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            w = common + w[: rng.randint(0, 14)]
        docs.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs)


@pytest.mark.parametrize("rounds", [2, 0])
def test_long_postings_go_by_leaders_and_shingles(spark, monkeypatch, rounds):
    monkeypatch.setattr(minhash, "SHORT", 2)
    monkeypatch.setattr(minhash, "PART", 5)
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    docs = [(i, " ".join(passage + [f"t{rng.randrange(30)}" for _ in range(rng.randrange(25))])) for i in range(150)]
    for i in range(150, 220):  # near copies of few texts within the passage's crowd
        w = passage[: 40 + i % 3] + [f"u{i % 4}x{k}" for k in range(20)]
        w[rng.randrange(len(w))] = f"e{rng.randrange(5)}"
        docs.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs)


def test_first_common_shingles_leave_room_for_the_overlap():
    """Whatever the counts, a linked pair meets in some posting whose rows say that it fits."""
    rng = random.Random(3)
    for _ in range(300):
        x = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 40))]
        y = list(x)
        for _ in range(rng.randrange(3)):
            y[rng.randrange(len(y))] = f"w{rng.randrange(40)}"
        texts = pa.array([" ".join(x), " ".join(y)])
        a, b = shingle_sets(texts)
        counts = np.random.default_rng(rng.randrange(100)).integers(2, 9, minhash.SLOTS)
        batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), texts], ["rep", "text"])
        rows = pa.Table.from_batches(minhash._post_shingles(counts, 75)(iter([batch]))).to_pylist()
        by = collections.defaultdict(dict)
        for r in rows:
            by[r["g"]][r["rep"]] = r
        fit = any(len(v) == 2 and 75 * (v[0]["n"] + v[1]["n"]) <= 175 * min(v[0]["left"], v[1]["left"]) for v in by.values())
        assert fit or not minhash.similar(len(np.intersect1d(a, b)), len(a), len(b))


def test_near_duplicates_of_awkward_rows(spark):
    rows_ = minhash.near_duplicates(awkward(spark)).collect()
    assert len(rows_) == 15
    by = {r.doc_id: r for r in rows_ if r.doc_id is not None}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[3].component_id == 3 and by[3].kept
    assert by[5].component_id == by[6].component_id == by[11].component_id == 4 and not by[11].kept
    assert by[8].component_id == 7 and by[9].kept
    assert minhash.near_duplicates(none(spark)).count() == 0
    kept = minhash.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 7, 9, 10, 12]


def brute_exact(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[norm(t)].append((-len(t or ""), i))
    return {i: (min(groups[norm(t)])[1], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in docs}


@pytest.mark.parametrize("frequent", [1, 3, 256])
def test_exact_duplicates_against_brute_force(spark, frequent):
    rng = random.Random(frequent)
    docs = [(i, rng.choice([None, "", " ", "hot text", "hot  text", "h o t text"]) if rng.random() < 0.5 else f"t {rng.randrange(80)}") for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = exact.exact_duplicates(df, frequent, 16 * frequent).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == brute_exact(docs)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got) and len(got) == 600


def test_heavy_hitters_are_found(spark):
    df = spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 7 = 0 THEN 'b' WHEN id % 11 = 1 THEN 'c' ELSE concat('x', id) END AS digest").repartition(9)
    marks = {r.mark: r.digest for r in df.selectExpr("xxhash64(digest) AS mark", "digest").distinct().collect()}
    found = [marks[r.mark] for r in exact.frequent_candidates(df, 20, 512).collect()]
    assert {"a", "b", "c"} <= set(found) and len(found) <= 40
    assert exact.frequent_candidates(df.limit(0)).count() == 0
    # nothing is frequent: few candidates, though every digest was seen
    assert exact.frequent_candidates(spark.range(50_000).selectExpr("cast(id AS string) AS digest"), 20, 512).count() <= 40


def test_frequent_digests_are_found_whatever_their_order(spark):
    rng = random.Random(4)
    for frequent, tracked in ((8, 128), (64, 1024)):
        rows = [f"h{k}" for k in range(frequent - 1) for _ in range(20_000 // frequent + 1)]
        rows += [f"x{i}" for i in range(20_000 - len(rows))]
        rng.shuffle(rows)
        df = spark.createDataFrame([(x,) for x in rows], "digest string").repartition(7)
        marks = {r.mark: r.digest for r in df.selectExpr("xxhash64(digest) AS mark", "digest").distinct().collect()}
        heavy = {x for x, n in collections.Counter(rows).items() if n * frequent > len(rows)}
        assert heavy and heavy <= {marks[r.mark] for r in exact.frequent_candidates(df, frequent, tracked).collect()}


def test_exact_duplicates_of_awkward_rows(spark):
    got = exact.exact_duplicates(awkward(spark)).collect()
    assert len(got) == 15 and sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[1][0].keep_id == 3 and by[4][0].keep_id == 5 and by[4][0].group_size == 4
    assert exact.exact_duplicates(none(spark)).count() == 0
    kept = exact.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns and kept.count() == sum(r.kept for r in got)
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted(r.doc_id for r in exact.keep_one(twice).collect()) == [1, 2]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_sql(spark, small, name):
    got, want = QUERIES[name](spark, small).toPandas(), connect(small).sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_near_duplicate_query_against_brute_force(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op5_minhash_near_dedup"](spark, tiny).collect()}
    assert got == brute_components(docs)
