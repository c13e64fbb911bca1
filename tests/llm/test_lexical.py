import math
import random
import re

import pytest

from groundset.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def _plain(docs, items, k=10):
    """The ranking as it is defined, one document after the other."""
    counts = [(d, _terms(t)) for d, t in docs]
    n_docs, total = sum(bool(t) for _, t in counts), sum(len(t) for _, t in counts)
    merged = {}
    for item, text in items:
        merged.setdefault(item, set()).update(_terms(text))
    out = []
    for item, terms in merged.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c in counts) + 1))) for t in terms}
        scores = []
        for d, c in counts:
            m = 10 + 90 * len(c) * n_docs // max(total, 1)
            s = sum(w[t] * (10**9 * c.count(t) // (1000 * c.count(t) + 8 * m)) for t in terms)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def _run(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, _doc int, score int")
    q = spark.createDataFrame(items, "item_id long, text string")
    found = lexical.search(d.repartition(3), q, k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["É", "日本", "The", "x_y", "a-b", "İ", "9"]
    return [(k, draw.choice(" \n.").join(draw.choices(words, k=draw.randint(0, 80)))) for k in range(300)]


def test_against_the_definition(spark, texts):
    items = [(k, t) for k, t in texts[::17]] + [(900, "the THE the"), (901, "nowhere at all"), (902, ""), (903, None)]
    got = _run(spark, texts, items)
    assert got == _plain(texts, items) and {r[0] for r in got} >= {0, 17, 900}


def test_odd_rows(spark):
    same = [(k, "one two three") for k in range(40)] + [(7, "one two three"), (None, "one two three"), (None, None)]
    docs = [*same, (50, ""), (51, "one " * 50_000 + "last"), (52, " ... "), (53, "onetwo one-two")]
    items = [(1, "One, two"), (1, "last"), (2, "three three"), (None, "two"), (3, "\x00.")]
    assert _run(spark, docs, items) == _plain(docs, items)
    assert _run(spark, docs, items, 60) == _plain(docs, items, 60)
    assert _run(spark, [], items) == [] and _run(spark, docs, []) == [] and _run(spark, [(1, None)], items) == []


def test_parts_and_slices(spark, texts, monkeypatch):
    """Blocks cut inside a text and items in several automata change nothing."""
    finder = lexical.Finder([b"w1", b"the", "é".upper().encode()])
    plain = [lexical.spaced(t) for _, t in texts[:40]]
    whole = [x.tolist() for x in finder.count(plain)]
    monkeypatch.setattr(lexical, "BLOCK", 5)
    assert [x.tolist() for x in finder.count(plain)] == whole
    assert [lexical.n_terms(p) for p in plain] == [len(_terms(t)) for _, t in texts[:40]]
    monkeypatch.setattr(lexical, "SLICE_ITEMS", 3)
    items = texts[:10]
    assert _run(spark, texts, items) == _plain(texts, items)
