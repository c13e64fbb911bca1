import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from groundset.llm import bpe


@pytest.fixture(scope="module")
def both():
    return bpe.load(bpe.default_path()), Tokenizer.from_file(bpe.default_path())


def _same(both, texts):
    ours, library = both
    for text, raw in zip(texts, ours.encode_batch(texts), strict=True):
        ids = np.frombuffer(raw, "<u4")
        theirs = library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == theirs, text[:80]
        assert ours.decode(ids) == library.decode(theirs, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_any_text(both, texts):
    _same(both, texts)


def test_words_of_many_shapes(both):
    draw = random.Random(3)
    parts = ["a", "aa", "th", "ing", "er", "s", "'ve", "é", "ß", "日", "́", "12", "...", " ", "\n", "İ", "Σ", "ς"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 40))) for _ in range(2000)]
    _same(both, texts)
    vocabulary = [t.removesuffix("</w>") for t in both[0].vocab if t.isascii()]
    _same(both, ["".join(draw.choices(vocabulary, k=4)) for _ in range(3000)])


def test_special_tokens_blanks_and_long_texts(both, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 50)
    _same(both, ["<|endoftext|>x<|startoftext|><|endoftext|>", "", "  ", "\x1c\x85\xa0 y", "z" * 3000])
    _same(both, ["the cat sat on the mat " * 60, "the cat́ 日本 " * 50, "ab" * 200 + " " + "é " * 90])


def test_cache_limit_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    _same(both, ["one two three", "two four five six", "one"])


def test_documents(spark, both):
    rows = [(1, None, "x"), (2, "Hello, world's end", "y"), (2, "Hello, world's end", "y"), (None, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_documents(df, decoded=True).collect()
    want = both[1].encode(rows[1][1], add_special_tokens=False).ids
    assert sorted((r.doc_id or 0, r.ids) for r in got) == [(0, []), (1, []), (2, want), (2, want)]
    assert {r.decoded for r in got if r.doc_id == 2} == {both[1].decode(want, skip_special_tokens=False)}
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_query_against_the_library(spark, both):
    from groundset.llm.queries import op2_bpe_round_trip

    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op2_bpe_round_trip(spark, sf_dir).collect()}
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = both[1].encode(row.text or "", add_special_tokens=False).ids
        r = got[row.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        text = both[1].decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_merges_are_looked_up_in_slots():
    encoder = bpe.load(bpe.default_path())
    assert (encoder.slots < 0).sum() < len(encoder.codes) // 20
    known = np.array([*encoder.merges], np.int64)
    other = np.random.default_rng(3).integers(0, encoder.size, (50_000, 2))
    for x, y in (known.T, other.T):
        want = [encoder.merges.get(p, (bpe.NEVER,))[0] for p in zip(x.tolist(), y.tolist(), strict=True)]
        assert encoder._merge_rank(x.copy(), y.copy()).tolist() == want
