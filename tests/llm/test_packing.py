import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from groundset.llm import bpe, packing


def _filled(sizes, bins, room):
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(0 < sizes[b].sum() <= room for b in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=80))
def test_exchanges_keep_items_and_never_add_bins(lengths):
    sizes = np.array(lengths)
    first = packing.best_fit(sizes, 40)
    _filled(sizes, first, 40)
    better = packing.exchange([list(b) for b in first], sizes, 40)
    _filled(sizes, better, 40)
    assert -(-sizes.sum() // 40) <= len(better) <= len(first)


def test_each_kind_of_exchange():
    sizes = np.array([60, 38, 59, 39, 2, 2])  # one for one, then the small ones move
    assert len(packing.exchange([[0, 1], [2, 3], [4], [5]], sizes, 100)) == 2
    sizes = np.array([50, 24, 24, 52, 46, 50, 54])  # two for one
    assert len(packing.exchange([[0, 1, 2], [3, 4], [5], [6]], sizes, 100)) <= 4
    sizes = np.array([51] * 30)  # nothing fits together
    assert len(packing.exchange(packing.best_fit(sizes, 100), sizes, 100)) == 30


def _check(rows, room):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= room
    return len(bins)


def test_groups_and_second_round(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "cast(1 + (id * 7919) % 59 as long) as length", "1 as offset")
    rows = packing.pack(df, room=100, group_rows=500).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    whole = packing.best_fit(np.array([r.length for r in rows]), 100)
    assert _check(rows, 100) <= len(whole) * 1.02
    assert packing.pack(df.limit(0), room=100).count() == 0


def test_pieces_of_odd_documents(docs):
    text = "word " * 9
    rows = packing.cut_pieces(docs([(1, text), (1, text), (None, None), (3, "")]), length=4, with_ids=True).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length) for r in rows) == sorted(
        [(1, 0, 0, 4), (1, 1, 4, 4), (1, 2, 8, 2)] * 2 + [(0, 0, 0, 1), (3, 0, 0, 1)]
    )
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert {tuple(r.ids) for r in rows if r.length == 1} == {(1,)}


def test_query_against_the_library(spark):
    from groundset.llm.queries import op8_best_fit_packing

    sf_dir = "/root/testdata/sf0.001"
    library, want = Tokenizer.from_file(bpe.default_path()), {}
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = np.array([*library.encode(row.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            own = ids[k : k + 4096]
            want[row.doc_id, k // 4096] = (k, len(own), zlib.crc32(own.tobytes()))
    rows = op8_best_fit_packing(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert _check(rows, 4096) <= -(-sum(n for _, n, _ in want.values()) // 4096) + 1
