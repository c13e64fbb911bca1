import random

import numpy as np
import pyarrow as pa
import pytest

from groundset.functions.similarity import Side, lcs_length, reach_lcs, reaches_lcs
from groundset.operators import fuzzy


def _similar(a, b, threshold=90):
    return 200 * lcs_length(a, b) >= threshold * (len(a) + len(b))


def _texts(seed, n, words=150, vocabulary=120, letters="aaeeinorstthl"):
    """Sorted words of one small language, each fourth text an edited copy of one before."""
    draw, out = random.Random(seed), []
    known = ["".join(draw.choices(letters, k=draw.randrange(1, 9))) for _ in range(vocabulary)]
    for k in range(n):
        if k % 4 == 3:
            s = list(draw.choice(out))
            for _ in range(draw.randrange(0, len(s) // 8)):
                s[draw.randrange(len(s))] = draw.choice(["", "e", "an"])
            out.append("".join(s))
        else:
            out.append(" ".join(sorted(draw.choices(known, k=draw.randrange(words // 2, words)))))
    return list(dict.fromkeys(out))


def _table(strings):
    rows = {"idx": range(len(strings)), "len": [len(s) for s in strings], "sketch": [0] * len(strings), "s": strings}
    return pa.table({c: pa.array(list(v)) for c, v in rows.items()})


def _wanted(strings, threshold=90):
    return {(i, j) for j in range(len(strings)) for i in range(j) if _similar(strings[i], strings[j], threshold)}


def _pairs(found):
    return sorted((min(p), max(p)) for p in found)


def test_unlike_texts_of_one_language_are_not_scored_one_by_one(monkeypatch):
    """No count of grams tells long texts of one language apart, so nearly all pairs of them were scored in Python, one by one."""
    strings, single = _texts(1, 60), []
    monkeypatch.setattr(fuzzy, "reaches_lcs", lambda first, others, threshold: single.extend(others) or reaches_lcs(first, others, threshold))
    found = fuzzy._similar_in_blocks(_table(strings), _table(strings), True, 90)
    assert _pairs(found) == sorted(_wanted(strings)) and len(found) > 5
    assert not single


@pytest.mark.parametrize("threshold", [60, 90, 100])
def test_lanes_score_as_single_pairs_do(threshold):
    draw = random.Random(4)
    strings = _texts(2, 40, words=60) + ["".join(draw.choices("ab", k=k)) for k in (1, 62, 63, 64, 126, 127)] + ["a" * 63, "a" * 126]
    lengths = np.array([len(s) for s in strings])
    known = sorted(set("".join(strings)))
    side = Side(np.array([known.index(c) for s in strings for c in s]), lengths, len(known))
    i, j = (x.ravel() for x in np.indices((len(strings), len(strings))))
    got = reach_lcs(side, side, i, j, threshold).reshape(len(strings), -1).tolist()
    assert got == [[_similar(a, b, threshold) for b in strings] for a in strings]


@pytest.mark.parametrize("threshold", [70, 90])
def test_large_alphabets_and_few_levels_lose_nothing(monkeypatch, threshold):
    letters = "".join(chr(0x4E00 + k) for k in range(400)) + "eeeeeeeeee" * 20
    strings = _texts(3, 50, letters=letters)
    assert len(set("".join(strings))) > fuzzy.ALPHABET
    for levels in (fuzzy.LEVELS, fuzzy.ALPHABET):
        monkeypatch.setattr(fuzzy, "LEVELS", levels)
        half = len(strings) // 2
        found = fuzzy._similar_in_blocks(_table(strings), _table(strings), True, threshold)
        assert _pairs(found) == sorted(_wanted(strings, threshold)) and found
        apart = fuzzy._similar_in_blocks(_table(strings[:half]), _table(strings[half:]), False, threshold)
        assert sorted((a, b + half) for a, b in apart) == sorted(p for p in _wanted(strings, threshold) if p[0] < half <= p[1])


def test_only_keys_with_postings_get_a_sketch(spark):
    """Its cost grows with the square of a key's length: 4 ms for a text of 500 characters."""
    rows = [(0, n, "ab" * n) for n in (1, 24, 29, 30, 300)]
    strings = fuzzy._distinct_strings(spark.createDataFrame(rows, "run_id int, idx long, s string"))
    assert {r.len: r.sketch is None for r in strings.collect()} == {2: False, 48: False, 58: False, 60: True, 600: True}
    met = {r.idx for f in (fuzzy._index_rows, fuzzy._probe_rows) for r in f(strings, 90).collect()}
    assert met == {1, 24, 29}
