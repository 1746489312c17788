import hashlib
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import bpe, pii, toxicity, warc
from lumenfold.llm.packing import pack, unpack
from lumenfold.llm.queries import tokenizer_path
from lumenfold.llm.words import hash_words
from tests.llm.test_dedup import words
from tests.llm.test_models import brute_spans

_TEXT = st.text(st.characters(codec="utf-8"), max_size=80)


@given(st.lists(st.none() | _TEXT, max_size=6))
@settings(deadline=None)
def test_words_are_the_pattern_s(texts):
    values, off = hash_words(pa.array(texts, pa.string()))
    assert [int(b - a) for a, b in zip(off, off[1:], strict=False)] == [len(words(t)) for t in texts] and off[-1] == len(values)


@given(st.text("a1.@+-() 9é_%", max_size=40))
@settings(deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


@given(_TEXT)
@settings(max_examples=300, deadline=None)
def test_bpe_is_the_library_s(text):
    from tokenizers import Tokenizer

    mine = bpe.load(tokenizer_path())
    if not hasattr(mine, "library"):
        mine.library = Tokenizer.from_file(tokenizer_path())
    # letters newer than the library's tables may be split otherwise; plain ones never
    plain = "".join(c for c in text if ord(c) < 0x2E80)
    ids = mine.library.encode(plain, add_special_tokens=False).ids
    assert mine.decode(mine.encode(plain)) == mine.library.decode(ids, skip_special_tokens=False)


@given(_TEXT)
@settings(deadline=None)
def test_folded_text_is_words_between_single_spaces(text):
    assert re.fullmatch(r" (?:\S+ )*| {2}", toxicity.fold(text))


@given(st.binary(max_size=3000), st.none() | _TEXT, st.integers(0, 1 << 40))
@settings(deadline=None)
def test_records_round_trip(payload, url, page):
    raw = warc.record("response", page, url, payload, hashlib.sha1(payload).digest(), None, "2024-01-01T00:00:00Z")
    got = list(warc.records(warc.gzip_member(raw) * 2))
    assert [r.page() for r in got] == [page, page] and got[1].payload() == (payload, len(payload))
    assert warc.capture_key(url, page) == warc.capture_key(got[0].headers["warc-target-uri"] if url is not None else None, page)


@given(st.lists(st.integers(0, 9), min_size=1, max_size=20))
@settings(deadline=None)
def test_packing_round_trip(values):
    batch = pa.RecordBatch.from_arrays([pa.array(values)], ["x"])
    assert unpack([pack(batch), pack(batch)]).column("x").to_pylist() == values * 2
