import random

import pytest

import corpus_pipeline
from groundset.llm import near


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def _edited(words, step, tag):
    return " ".join(f"{tag}x{i}" if i % step == step // 2 else w for i, w in enumerate(words))


def _jaccard(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b)


def least_of_linked(rows):
    """Least id per row, all pairs compared."""
    part = {k: k for k, _ in rows}
    for a, s in rows:
        for b, t in rows:
            if a < b and part[a] != part[b] and _jaccard(s, t) >= 0.8:
                low, high = sorted((part[a], part[b]))
                part = {k: low if p == high else p for k, p in part.items()}
    return part


@pytest.fixture(scope="module")
def rows():
    draw, out = random.Random(4), []
    for k in range(25):
        words = [f"w{draw.randrange(10**6)}" for _ in range(draw.choice((60, 150, 400)))]
        out += [" ".join(words)] + [_edited(words, step, f"e{k}n{j}") for j, step in enumerate((60, 50, 50, 30, 12))]
    draw.shuffle(out)
    return list(enumerate(out))


def test_components_against_all_pairs(docs, rows):
    got = {r.doc_id: r.component_id for r in near.near_copies(docs(rows)).collect()}
    assert got == least_of_linked(rows)


def test_stage_drops_texts_with_an_edit_every_fifty_words(spark, docs):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), _edited(words, 50, "e"), _edited(words, 12, "f")]
    assert _jaccard(*texts[:2]) >= 0.8 > _jaccard(texts[0], texts[2])
    kept = corpus_pipeline.near_dedup(spark, docs(list(enumerate(texts, 1))), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_odd_rows(docs):
    rows = [(4, None), (5, ""), (5, ""), (None, "a b c d"), (None, "a b c d"), (7, "A b c  d"), (8, "a b c e")]
    assert sorted(r.doc_id for r in near.drop_near_copies(docs(rows)).collect()) == [4, 7, 8]
    assert near.near_copies(docs([])).count() == 0


def _alike(n, edits, same, size=300):
    """Texts of one stem with words of their own, at the same places in all or at places of their own."""
    out = []
    for k in range(n):
        cut = set(random.Random(0 if same else k).sample(range(5, size - 5), edits))
        out.append((k, " ".join(f"t{k}x{i}" if i in cut else f"s{i}" for i in range(size))))
    return out


@pytest.mark.parametrize("n", [100, 200, 400])
def test_alike_but_unlinked_texts_cost_no_pairs(spark, docs, monkeypatch, n):
    asked, verify = [], near.verified
    monkeypatch.setattr(near, "verified", lambda pairs, sets: asked.append(pairs.count()) or verify(pairs, sets))
    rows = _alike(n, 10, True)
    assert 0.6 < _jaccard(rows[0][1], rows[1][1]) < 0.8
    got = {r.doc_id: r.component_id for r in near.near_copies(docs(rows)).collect()}
    assert got == {k: k for k in range(n)}
    assert sum(asked) <= 2 * n


def test_copies_of_one_text_cost_a_pair_each(spark, docs, monkeypatch):
    asked, verify = [], near.verified
    monkeypatch.setattr(near, "verified", lambda pairs, sets: asked.append(pairs.count()) or verify(pairs, sets))
    rows = _alike(300, 6, False)
    rows.append((900, " ".join(f"s{k}" for k in range(300))))
    assert _jaccard(rows[0][1], rows[1][1]) < 0.8 <= _jaccard(rows[0][1], rows[-1][1])
    assert {r.component_id for r in near.near_copies(docs(rows)).collect()} == {0}
    assert sum(asked) <= 2 * len(rows)


def test_long_texts_and_ties(docs):
    long = " ".join(f"w{k % 9000}v{k % 7}" for k in range(120_000))
    rows = [(3, long), (1, long + " end"), (2, "a b c d e f"), (8, "a b c d e f"), (9, "b c d e f a")]
    got = {r.doc_id: r.component_id for r in near.near_copies(docs(rows)).collect()}
    assert got == {3: 1, 1: 1, 2: 2, 8: 2, 9: 9}


def test_groups_of_fingerprints_are_decided_without_bands(docs, monkeypatch):
    words = [f"w{k}" for k in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, " ".join(f"v{k}" for k in range(3000)))]
    monkeypatch.setattr(near, "band_keys", lambda own: [int(own[0]) % 2**40 + len(own)] * near.BANDS)
    got = {r.doc_id: r.component_id for r in near.near_copies(docs(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_alike_fingerprints_below_the_threshold_stay_apart(docs, monkeypatch):
    monkeypatch.setattr(near, "near_duplicates", lambda *a: docs([]).selectExpr("0L as _text", "0L as _group").limit(0).union(held))
    df = docs([(1, "a b c d e f g"), (2, "h i j k l m n")])
    held = df.selectExpr("xxhash64(text) as _text", "7L as _group")
    assert {r.doc_id: r.component_id for r in near.near_copies(df).collect()} == {1: 1, 2: 2}
