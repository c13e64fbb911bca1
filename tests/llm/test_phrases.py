import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from groundset.llm import phrases


def _phrases(text):
    known, out = {""}, set()
    at = ""
    for c in text:
        at += c
        if at not in known:
            known.add(at)
            out.add(at)
            at = ""
    return out


def _plain(rows):
    """(id, n_chars, sha, phrases, edited phrases, next phrases) by following the list."""
    tie = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])), reverse=True)
    out = []
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, after))
    return out


def _check(docs, rows, monkeypatch=None):
    got = phrases.compare_with_next(docs(rows).repartition(3)).collect()
    want = [
        (i, n, sha, phrases.fingerprint(t), phrases.fingerprint(e), *(_like(phrases.fingerprint(t), phrases.fingerprint(x)) for x in (e, a)))
        for i, n, sha, t, e, a in _plain(rows)
    ]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def _like(a, b):
    pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(0, len(a), 4)]
    some = [p for p in pairs if p != ("0000", "0000")]
    return sum(x == y for x, y in some) / len(some) if some else 1.0


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(8)
    words = [f"{draw.choice('bcdfg')}{draw.choice('aeiou')}{k}é" for k in range(200)]
    return [(k, " ".join(draw.choices(words, k=draw.randint(0, 300)))) for k in draw.sample(range(10**6), 120)]


def test_phrase_hashes_follow_the_parse(rows):
    for text in ("", "a", "aaaaaaa", "abababab", "日本日本日本", *[t for _, t in rows[:20]]):
        parse = phrases.Parse().feed(text)
        assert len(parse.hashes) - 1 == len(_phrases(text))
        cut = len(text) // 3
        assert phrases.Parse().feed(text[:cut]).fork().feed(text[cut:]).hashes == parse.hashes
    same = {}
    for _, text in rows:
        for p, h in zip(sorted(_phrases(text)), sorted(phrases.Parse().feed(text).hashes[1:]), strict=True):
            same.setdefault(h, p)
    assert len(same) == len(set().union(*(_phrases(t) for _, t in rows)))


def test_likeness_estimates_jaccard(spark, rows):
    pairs = [(t, t[: len(t) // 2] + u) for (_, t), (_, u) in zip(rows, rows[1:], strict=False) if len(t) > 400]
    off = []
    for a, b in pairs:
        p, q = _phrases(a), _phrases(b)
        off.append(_like(phrases.fingerprint(a), phrases.fingerprint(b)) - len(p & q) / len(p | q))
    assert abs(sum(off) / len(off)) < 0.02 and max(map(abs, off)) < 0.2
    prints = [(phrases.fingerprint(a), phrases.fingerprint(b)) for a, b in [*pairs[:20], ("", ""), ("", "x")]]
    df = spark.createDataFrame([*prints, (None, prints[0][0])], "a string, b string")
    got = [r[0] for r in df.coalesce(1).select(phrases.likeness(F.col("a"), F.col("b"))).collect()]
    assert got == [*(_like(a, b) for a, b in prints), None]


def test_against_the_list(docs, rows, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BYTES", 500)
    _check(docs, rows)
    _check(docs, rows[:1])
    _check(docs, rows[:2])


def test_odd_rows(docs, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BYTES", 3)
    hot = [(5, "the same words")] * 30 + [(5, f"other {k}") for k in range(30)]
    odd = [(None, "no id"), (None, "no id"), (None, None), (1, None), (2, ""), (3, "x"), (-4, "ab" * 100_000), (9, "日本")]
    _check(docs, odd)
    _check(docs, hot + odd)
    assert phrases.compare_with_next(docs([])).count() == 0
    got = {r.doc_id: r.fingerprint for r in phrases.fingerprints(docs(odd[2:])).collect()}
    assert got[1] == got[2] == "0000" * phrases.BINS != got[3]
    clash = docs(rows := [(1, "a b"), (2, "c d")]).selectExpr("*", "1 as _id", "2 as _part", "3 as fingerprint", "4 as _guard")
    assert phrases.compare_with_next(clash).count() == len(rows)


def test_edited_texts_are_nearer_than_the_next(spark):
    from groundset.llm.queries import op12_phrase_fingerprint

    rows = op12_phrase_fingerprint(spark, "/root/testdata/sf0.001").where("n_chars >= 400").collect()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.9 * len(rows)
