import random
from collections import Counter

from groundset.operators import fuzzy


def _ratio(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        before = line
        line = [0]
        for j, y in enumerate(b):
            line.append(before[j] + 1 if x == y else max(before[j + 1], line[j]))
    return 200 * line[-1] / (len(a) + len(b))


def _edited(draw, s, share):
    out = []
    for c in s:
        if draw.random() < share:
            out += draw.choice(([], [draw.choice("abcdef ")], [c, draw.choice("abcdef ")]))
        else:
            out.append(c)
    return "".join(out)


def test_similar_long_keys_against_all_pairs(spark):
    """Planted copies with edits up to and beyond the threshold, strings of a small alphabet, short ones among them."""
    draw, strings = random.Random(6), []
    for k in range(14):
        stem = "".join(draw.choices("abcdef  ghij" if k % 2 else "ab ", k=draw.choice((40, 60, 150, 400))))
        strings += [stem, *(_edited(draw, stem, share) for share in (0.02, 0.06, 0.09, 0.12))]
    strings = [s for s in dict.fromkeys(strings) if s]
    want = {(i, j) for j in range(len(strings)) for i in range(j) if _ratio(strings[i], strings[j]) >= 90}
    nodes = spark.createDataFrame([("r", i, s) for i, s in enumerate(strings)], "run_id string, idx long, s string")
    got = {(r.a, r.b) for r in fuzzy.similar_pairs(nodes).collect()}
    assert got == want and len(want) > 15


def test_query_against_all_pairs(spark, monkeypatch):
    from groundset.plans import catalog

    catalog.load_all()
    seen, run = [], fuzzy.similar_pairs
    monkeypatch.setattr(fuzzy, "similar_pairs", lambda nodes: seen.append(nodes) or run(nodes))
    got = {tuple(r) for r in catalog.QUERIES["fuzzy_long_keys"](spark, "/root/testdata/sf0.001").collect()}
    first = {}
    for r in seen[0].collect():
        if r.s:
            first[r.run_id, r.s] = min(r.idx, first.get((r.run_id, r.s), r.idx))
    bags = {k: Counter(k[1]) for k in first}

    def close(x, y):
        most = sum((bags[x] & bags[y]).values())
        return x[0] == y[0] and 200 * most >= 90 * (len(x[1]) + len(y[1])) and _ratio(x[1], y[1]) >= 90

    want = {(x[0], first[x], first[y]) for x in first for y in first if first[x] < first[y] and x[0] == y[0] and close(x, y)}
    assert got == want and want
