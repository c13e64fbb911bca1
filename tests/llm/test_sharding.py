import zlib

import numpy as np
import pytest

from groundset.llm import sharding


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000, 4097, 65_536])
def test_permutation_is_one_to_one_and_reversible(size):
    p = sharding.Permutation(size)
    out = p.forward(np.arange(size))
    assert sorted(out.tolist()) == list(range(size))
    assert np.array_equal(p.backward(out), np.arange(size))
    if size > 100:
        assert abs(np.corrcoef(out, np.arange(size))[0, 1]) < 0.2
        assert not np.array_equal(out, sharding.Permutation(size, 1).forward(np.arange(size)))


def test_large_numbers():
    size = 10**13 + 7
    p = sharding.Permutation(size)
    rows = np.arange(size - 1000, size)
    assert np.array_equal(p.backward(p.forward(rows)), rows) and p.forward(rows).max() < size


def test_places_are_computable_and_even(spark):
    df = spark.range(1003).selectExpr("id as doc_id", "7 as shard", "8 as _tie").repartition(7)
    rows = sharding.shard(df, ["doc_id"], 24).collect()
    slots = {}
    for r in rows:
        assert r.row_number == r.doc_id
        assert (r.shard, r.slot) == sharding.place(r.doc_id, 1003, 24)
        assert sharding.row_at(r.shard, r.slot, 1003, 24) == r.doc_id
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len(slots) == 24 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard(df.coalesce(1), ["doc_id"], 24).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_ties_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None,)] * 30 + [(1,)] * 30 + [(2,)], "doc_id long")
    rows = sharding.shard(df, ["doc_id"], 3).collect()
    assert sorted(r.row_number for r in rows) == list(range(61))
    assert sharding.shard(df.limit(0), ["doc_id"], 3).count() == 0


def test_query(spark):
    from groundset.llm.queries import op6_feistel_shards

    sf_dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op6_feistel_shards(spark, sf_dir).collect()
    order = {k: i for i, k in enumerate(sorted(docs))}
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.size, r.text_crc32) == (len(docs[r.doc_id]) + 8, zlib.crc32(docs[r.doc_id]))
        assert (r.shard, r.slot) == sharding.place(order[r.doc_id], len(docs), 24)
        assert r.law == "rows" and r.grown_shard is None
