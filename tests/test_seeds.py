"""Close windows found by pieces of the needle, against every window of the text."""

import random

import pytest
from pyspark.sql import functions as F
from test_records import _brute_partial, _mutated

from groundset.functions.similarity import close_windows, with_partial_matches


def _matched(df, threshold, needed=None):
    needed = F.lit(True) if needed is None else needed
    return with_partial_matches(df, {"r": (needed, F.col("a"), F.col("b"))}, threshold)


def _cases(threshold, n, letters, longest):
    cases = []
    for seed in range(n):
        rng = random.Random(seed * 100 + threshold)
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, longest)))
        at = rng.randrange(len(text))
        if rng.random() < 0.3:
            at = rng.choice([0, max(len(text) - 20, 0)])
        piece = text[at : at + rng.randrange(1, 90)]
        cases.append((seed, _mutated(rng, piece, rng.randrange(0, 12), letters), text))
    return cases


@pytest.mark.parametrize("threshold", [40, 85, 90, 100])
def test_equal_to_all_windows(spark, threshold):
    cases = _cases(threshold, 700, "abcdefg ", 260) + [(n + 700, a, b) for n, a, b in _cases(threshold, 300, "aé😀b", 180)]
    df = spark.createDataFrame(cases, "i int, a string, b string")
    found = dict(_matched(df, threshold).select("i", "r").collect())
    wrong = [c for c in cases if found[c[0]] != _brute_partial(c[1], c[2], threshold)]
    assert wrong == []
    assert 0 < sum(found.values()) < len(cases)


def test_empty_and_null_sides(spark):
    rows = [("", "", True), ("", "abc", True), ("abc", "", True), (None, "a", True), ("a", None, True), ("a", "a", False)]
    df = spark.createDataFrame(rows, "a string, b string, needed boolean").coalesce(1)
    assert [r["r"] for r in _matched(df, 90, F.col("needed")).collect()] == [True, False, False, None, None, None]


def test_only_parts_near_the_needle_are_given(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlucmfwypvbgk") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    page = " ".join(rng.choice(words) for _ in range(60_000))
    quote = page[200_000:200_150]
    edited = "".join(c for i, c in enumerate(quote) if i % 25 != 24)
    df = spark.createDataFrame([(edited, page), (edited[::-1], page)], "a string, b string").coalesce(1)
    parts = df.select(close_windows(F.col("a"), F.col("b"), 90).alias("w")).collect()
    given = [sum(len(w["part"]) for w in r["w"]) for r in parts]
    assert parts[0]["w"] and max(given) < len(page) // 10
    assert [r["r"] for r in _matched(df, 90).collect()] == [True, False]
