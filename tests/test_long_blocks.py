import random

import pytest

from groundset.functions.similarity import lcs_length, reaches_lcs
from groundset.operators import fuzzy


def _keys(seed, n, sizes=(30, 52, 60, 130, 300)):
    draw, out = random.Random(seed), []
    for _ in range(n):
        if out and draw.random() < 0.6:
            s = list(draw.choice(out))
            for _ in range(draw.randrange(0, max(len(s) // 12, 2))):
                s[draw.randrange(len(s))] = draw.choice(["", "e", "an"])
            out.append("".join(s))
        else:
            out.append("".join(draw.choices(["the ", "an", "er", "é", "th", "😀", "tion "], k=draw.choice(sizes) // 2)))
    return out


def _similar(a, b):
    return 200 * lcs_length(a, b) >= 90 * (len(a) + len(b))


def test_scores_against_whole_lcs():
    keys = _keys(3, 70)
    for a in keys:
        assert reaches_lcs(a, keys, 90) == [_similar(a, b) for b in keys]


def test_long_keys_need_no_postings(spark):
    """Keys of one language met in most of their grams, so the rows of the join grew with the square of each gram."""
    rows = [(0, i, s) for i, s in enumerate(_keys(5, 60, (160,)))]
    strings = fuzzy._distinct_strings(spark.createDataFrame(rows, "run_id int, idx long, s string"))
    assert fuzzy._postings(strings, 90, fuzzy.HOT_PAIRS).count() == 0


@pytest.mark.parametrize("block", [4, 4096])
def test_blocks_meet_every_pair_once(spark, block):
    rows = [(run, i, s) for run in ("a", None) for i, s in enumerate(dict.fromkeys(_keys(run, 80)))]
    strings = fuzzy._distinct_strings(spark.createDataFrame(rows, "run_id string, idx long, s string"))
    got = sorted(tuple(r)[1:] for r in fuzzy._long_pairs(strings.filter("run_id = 'a'"), 90, block).collect())
    own = [(i, s) for run, i, s in rows if run == "a" and len(s) > fuzzy.LONG_KEY]
    want = [(i, j) for n, (i, s) in enumerate(own) for j, t in own[n + 1 :] if _similar(s, t)]
    assert got == want and len(want) > 10
    assert fuzzy._long_pairs(strings.limit(0), 90).count() == 0


@pytest.mark.parametrize("hot_pairs", [1, 4_000_000])
def test_leaders_of_short_and_long_keys_equal_the_sequential_pass(spark, hot_pairs):
    keys = list(dict.fromkeys(_keys(8, 120, (34, 35, 36, 37, 38, 90))))
    want = {}
    for i, s in enumerate(keys):
        if i not in want:
            want |= {j: i for j in range(i + 1, len(keys)) if j not in want and _similar(s, keys[j])}
    nodes = spark.createDataFrame([(7, i, s) for i, s in enumerate(keys)], "run_id int, idx long, s string")
    assert {r.idx: r.leader for r in fuzzy.leaders_of(nodes, hot_pairs=hot_pairs).collect()} == want
    assert any(len(keys[i]) > 48 >= len(keys[j]) or len(keys[j]) > 48 >= len(keys[i]) for j, i in want.items())


@pytest.mark.parametrize("wave", [5, 40])
def test_waves_give_the_leaders_of_the_sequential_pass(spark, wave):
    keys = list(dict.fromkeys(_keys(8, 120, (34, 35, 36, 37, 38, 90))))
    want = {}
    for i, s in enumerate(keys):
        if i not in want:
            want |= {j: i for j in range(i + 1, len(keys)) if j not in want and _similar(s, keys[j])}
    rows = [(7, i, s) for i, s in enumerate(keys)] + [(8, i, s) for i, s in enumerate(keys[:3])]
    nodes = spark.createDataFrame(rows, "run_id int, idx long, s string")
    got = {(r.run_id, r.idx): r.leader for r in fuzzy.leaders_of(nodes, wave=wave).collect()}
    assert {i: top for (run, i), top in got.items() if run == 7} == want and wave < len(keys)
    assert any(len(keys[i]) > 48 >= len(keys[j]) or len(keys[j]) > 48 >= len(keys[i]) for j, i in want.items())


def test_long_near_copies_meet_their_leader_alone(spark, monkeypatch):
    """All pairs of near copies were formed, scored and written: their number grew with the square of a run."""
    pairs, whole = [], fuzzy._long_pairs

    def counted(*args, **named):
        pairs.append(whole(*args, **named).localCheckpoint())
        return pairs[-1]

    monkeypatch.setattr(fuzzy, "_long_pairs", counted)
    rows = [(1, i, f"{i:04d} " + "the page of one shop and all of its other pages " * 2) for i in range(300)]
    found = fuzzy.leaders_of(spark.createDataFrame(rows, "run_id int, idx long, s string"), wave=16)
    assert {(r.idx, r.leader) for r in found.collect()} == {(i, 0) for i in range(1, 300)}
    assert sum(p.count() for p in pairs) < 16 * 16 // 2 + 300
