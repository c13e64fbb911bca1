import random
import re

import numpy as np
import xxhash

from groundset.llm import simhash
from groundset.llm.components import components


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_of_components(prints):
    """Least id per row, all pairs compared."""
    values = sorted(set(prints.values()))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(b)] = root(a)
    least = {}
    for k, v in prints.items():
        least[root(v)] = min(least.get(root(v), k), k)
    return {k: least[root(v)] for k, v in prints.items()}


def test_fingerprints_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    for text in (None, "", " \n", "One", "a b", "The cat\tsat ON the mat. É é", "x " * 50):
        assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text), text


def test_links_lose_none(spark):
    draw = random.Random(5)
    seeds = [draw.getrandbits(64) for _ in range(40)] + [0]
    values = set(seeds)
    for v in seeds:
        for _ in range(25):
            values.add(v ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 3))))
    signed = np.array(sorted(values), np.uint64).astype(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    got = {(r.u, r.v) for r in simhash.links(df).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2}
    assert got == want


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + k) for k in range(50)] + [(900, 900), (7, 3), (None, 4)]
    draw = random.Random(2)
    draw.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{500 + k: 500 for k in range(50)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query_against_all_pairs(spark):
    from groundset.llm.queries import op3_simhash_near_dedup

    sf_dir = "/root/testdata/sf0.001"
    rows = op3_simhash_near_dedup(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == least_of_components(prints)


def test_one_row_of_each_group_stays(docs):
    words = [f"w{k}" for k in range(400)]
    near = " ".join([*words[:-1], "other"])
    rows = [(3, " ".join(words)), (1, near), (2, "quite another text of some words"), (4, None), (5, ""), (5, "")]
    df = docs(rows).selectExpr("*", "1 as _group", "2 as _nth", "3 as fingerprint")
    linked = (plain_fingerprint(rows[0][1]) ^ plain_fingerprint(near)).bit_count() <= 2
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == ([1, 2, 4] if linked else [1, 2, 3, 4])
    only = simhash.drop_near_duplicates(docs([(None, "a b c d"), (None, "a b c d")])).collect()
    assert len(only) == 1
    assert simhash.near_duplicates(docs([])).count() == 0
