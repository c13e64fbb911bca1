"""String similarity on the longest common subsequence, for rows the native tests leave open.

Score of two strings: 200 * LCS / (len1 + len2). LCS uses the bit-vector method of Hyyro (2004).
Thresholds are compared in whole numbers, so no rounding decides a borderline pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_BLOCK = 32

WINDOW = ("needle", "part", "starts", "ends")
Check = tuple[Column, Column, Column]


def lcs_length(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    rows = full
    for ch in b:
        hit = rows & masks.get(ch, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return len(a) - rows.bit_count()


def _required_lcs(threshold: int, total_length: int) -> int:
    """Smallest LCS reaching the threshold: ceil(threshold * total / 200)."""
    return -(-(threshold * total_length) // 200)


#: Characters between two looks at what a pair can still reach.
LOOK_EVERY = 32


def reaches_lcs(first: str, others: list[str], threshold: int) -> list[bool]:
    """Whether the score of `first` with each of the others reaches the threshold.

    Two strings that reach it are aligned with at most `most` characters of either side left out before any place, so
    matches further apart than that don't count. A pair ends as soon as what is left can't make up for what is missing.
    """
    masks: dict[str, int] = {}
    for i, ch in enumerate(first):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    n, full = len(first), (1 << len(first)) - 1

    def reaches(other: str) -> bool:
        needed = _required_lcs(threshold, n + len(other))
        spare = len(other) - needed
        wide = max(spare, n - needed)
        if spare < 0 or n < needed:
            return False
        band, rows = (1 << (2 * wide + 1)) - 1, full
        for j, ch in enumerate(other):
            near = band << (j - wide) if j > wide else band >> (wide - j)
            hit = rows & masks.get(ch, 0) & near
            rows = ((rows + hit) | (rows - hit)) & full
            if j % LOOK_EVERY == 0 and j + 1 - n + rows.bit_count() > spare:
                return False
        return n - rows.bit_count() >= needed

    return [reaches(other) for other in others]


#: Rows of a string in one word; the highest bit takes the carry.
WORD = 63
FULL_WORD = np.uint64((1 << WORD) - 1)
#: Pairs scored at a time, and the words their rows may take.
PAIRS_AT_ONCE, WORDS_AT_ONCE = 32_768, 4_000_000


class Side:
    """Strings of one side, as numbers of their characters (below `size`), for `reach_lcs`."""

    def __init__(self, numbers: np.ndarray, lengths: np.ndarray, size: int):
        self.lengths, self.size, self._numbers = lengths, size, numbers
        self._row = np.repeat(np.arange(len(lengths)), lengths)
        self._place = np.arange(len(numbers)) - np.repeat(np.cumsum(lengths) - lengths, lengths)

    @cached_property
    def masks(self) -> np.ndarray:
        """Word by word, where each string has each character. The character after the last is nowhere."""
        width = self.size + 1
        words = int(self.lengths.max()) // WORD + 1
        masks = np.zeros((words, len(self.lengths) * width), np.uint64)
        bits = np.uint64(1) << (self._place % WORD).astype(np.uint64)
        np.bitwise_or.at(masks, (self._place // WORD, self._row * width + self._numbers), bits)
        return masks

    @cached_property
    def columns(self) -> np.ndarray:
        """Character by character, those of all strings; an ended string has the character after the last."""
        columns = np.full((int(self.lengths.max()), len(self.lengths)), self.size, np.int64)
        columns[self._place, self._row] = self._numbers
        return columns


def reach_lcs(one: Side, other: Side, i: np.ndarray, j: np.ndarray, threshold: int) -> np.ndarray:
    """`reaches_lcs` of the pairs (i[k] of `one`, j[k] of `other`), many in one step: a lane is a pair.

    The strings of `other` are read along those of `one`. A lane ends once its text has left out more than it can spare.
    What it has left out so far can't be taken back, so matches further ahead than the rest allows don't count.
    """
    reached = np.zeros(len(i), bool)
    n, m = one.lengths[i], other.lengths[j]
    needed = _required_lcs(threshold, n + m)
    able = np.flatnonzero((n >= needed) & (m >= needed))
    able = able[np.lexsort((n[able], m[able]))]
    lanes = min(PAIRS_AT_ONCE, max(WORDS_AT_ONCE // (int(n.max(initial=0)) // WORD + 1), 1))
    for at in range(0, len(able), lanes):
        own = able[at : at + lanes]
        reached[own] = _reach_in_lanes(one, other, i[own], j[own], needed[own])
    return reached


def _reach_in_lanes(one: Side, other: Side, i: np.ndarray, j: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """A look finds, word by word, how many matches an alignment that has come so far in both strings can end with.

    Words that none can be in any more are left behind, with their matches kept in `behind`.
    """
    lane, reached = np.arange(len(i)), np.zeros(len(i), bool)
    n, m, base = one.lengths[i], other.lengths[j], i * (one.size + 1)
    words, last, low = int(n.max()) // WORD + 1, int(m.max()), 0
    rows = np.full((words, len(lane)), FULL_WORD, np.uint64)
    behind, left = (np.zeros(len(lane), np.int64) for _ in range(2))
    for start in range(0, last, LOOK_EVERY):
        end = min(start + LOOK_EVERY, last)
        high = min((end - 1 + max(int((n - needed - left).max()), 0)) // WORD, words - 1)
        place, hit, total, carry = (np.empty(len(lane), t) for t in (np.int64, np.uint64, np.uint64, np.uint64))
        for column in other.columns[start:end]:
            np.add(base, column[j], out=place)
            carry.fill(0)
            for w in range(low, high + 1):
                row = rows[w]
                # With the default mode numpy takes into a buffer first.
                np.take(one.masks[w], place, out=hit, mode="clip")
                np.bitwise_and(hit, row, out=hit)
                np.add(row, hit, out=total)
                np.add(total, carry, out=total)
                np.right_shift(total, WORD, out=carry)
                np.bitwise_and(total, FULL_WORD, out=total)
                np.bitwise_xor(row, hit, out=row)
                np.bitwise_or(row, total, out=row)
        matched = behind + np.cumsum(WORD - np.bitwise_count(rows[low : high + 1]).astype(np.int64), axis=0)
        left = np.minimum(m, end) - matched[-1]
        begins = WORD * np.arange(low, high + 1)[:, None]
        may = matched + np.minimum(n - begins, np.maximum(m - end, 0)) >= needed
        alive = may.any(axis=0)
        if not alive.any():
            return reached
        passed = int(may[:, alive].argmax(axis=0).min())
        if passed:
            low, behind = low + passed, matched[passed - 1]
        if end == last:
            reached[lane[matched[-1] >= needed]] = True
        elif alive.mean() < 0.9:
            lane, j, n, m, base, needed, left, behind = (v[alive] for v in (lane, j, n, m, base, needed, left, behind))
            rows = np.ascontiguousarray(rows[:, alive])
    return reached


def _closest_by_end(needle: str, text: str) -> Iterator[int]:
    """For each end position in the text, the least edit distance of the needle to any substring
    ending there: one bit-vector pass (Myers 1999). It never exceeds the indel distance."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(needle):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(needle)) - 1
    top = 1 << (len(needle) - 1)
    up, down, distance = full, 0, len(needle)
    for ch in text:
        equal = masks.get(ch, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        rise = down | (full & ~(horizontal | up))
        fall = up & horizontal
        if rise & top:
            distance += 1
        elif fall & top:
            distance -= 1
        rise, fall = rise << 1, fall << 1
        up = (fall | ~(vertical | rise)) & full
        down = rise & vertical & full
        yield distance


def partial_match(first: str, second: str, threshold: int, starts: bool = True, ends: bool = True) -> bool:
    """Does any window of the longer string, as long as the shorter one, reach the threshold?

    Windows clipped at either end count, unless the text is only a part of one that goes on before it
    (`starts` false) or after it (`ends` false). One pass over the text finds the places close enough
    to be worth scoring.
    """
    needle, text = (first, second) if len(first) <= len(second) else (second, first)
    m, n = len(needle), len(text)
    if m == 0:
        return n == 0
    if needle in text:
        return True

    def reaches(start: int, end: int, distance: int) -> bool:
        total = m + end - start
        needed = _required_lcs(threshold, total)
        return distance <= total - 2 * needed and lcs_length(needle, text[start:end]) >= needed

    most = 2 * m * (100 - threshold) // 100
    distance = m
    for end, distance in enumerate(_closest_by_end(needle, text), 1):
        if distance <= most and (starts or end >= m) and reaches(max(end - m, 0), end, distance):
            return True
    return ends and distance <= most and any(reaches(start, n, distance) for start in range(n - m + 1, n))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _matched_udf(windows: pd.Series, threshold: pd.Series) -> pd.Series:
    def matched(row: list, limit: int) -> list[int]:
        found: set[int] = set()
        for w in row:
            if w["check"] not in found and partial_match(w["needle"], w["part"], limit, w["starts"], w["ends"]):
                found.add(w["check"])
        return sorted(found)

    return pd.Series([matched(row, int(t)) for row, t in zip(windows, threshold, strict=True)], dtype=object)


@F.pandas_udf(T.LongType())
def _lcs_udf(first: pd.Series, second: pd.Series) -> pd.Series:
    return pd.Series(
        [None if a is None or b is None else lcs_length(a, b) for a, b in zip(first, second, strict=True)],
        dtype="Int64",
    )


# Marked non-deterministic so that the optimiser neither repeats them nor moves filters below them.
_matched_udf = _matched_udf.asNondeterministic()
_lcs_udf = _lcs_udf.asNondeterministic()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def close_windows(first: Column, second: Column, threshold: int) -> Column:
    """The parts of the longer string that may hold a window reaching the threshold, found in the JVM.

    A window that reaches it differs from the shorter string (the needle, of m characters) by at most
    k = 2m(100 - threshold)/100 inserted or deleted characters. Each of them breaks one of p equal pieces
    of the needle at most, so p - k pieces stand in the window unbroken. The text is cut into blocks at
    least as long as the needle; any window lies in two neighbouring ones, which are given if they hold
    that many pieces. No window that counts is lost; what is given still has to be scored.

    Rows are `(needle, part, starts, ends)`: `starts` and `ends` say that the part reaches the text's own
    ends. A verbatim needle, or an empty one, gives one row; a null on either side gives null.
    """
    shorter = F.length(first) <= F.length(second)
    m = F.least(F.length(first), F.length(second))
    k = F.floor(m * 2 * (100 - threshold) / 100).cast("int")
    size = F.greatest(F.floor(m / (k + 1)).cast("int"), F.lit(1))
    sides = F.struct(
        F.when(shorter, first).otherwise(second).alias("needle"),
        F.when(shorter, second).otherwise(first).alias("text"),
        m.alias("m"),
        size.alias("size"),
        (F.floor(m / size).cast("int") - k).alias("need"),
    )

    def whole(s: Column, text: Column) -> Column:
        return F.array(_window(s.needle, text, F.lit(True), F.lit(True)))

    def seeded(s: Column) -> Column:
        pieces = F.transform(
            F.sequence(F.lit(1), s.m - (s.size - 1), s.size), lambda i: F.substring(s.needle, i, s.size)
        )
        none = F.filter(whole(s, s.needle), lambda _: F.lit(False))
        return _let(
            F.filter(pieces, lambda x: s.text.contains(x)),
            lambda held: F.when(F.size(held) < s.need, none).otherwise(
                _let(_blocks(s), lambda blocks: _pairs(s, held, blocks))
            ),
        )

    return F.when(
        first.isNotNull() & second.isNotNull(),
        _let(
            sides,
            lambda s: F.when(s.m == 0, whole(s, s.text))
            .when(s.text.contains(s.needle), whole(s, s.needle))
            .otherwise(seeded(s)),
        ),
    )


def _window(needle: Column, part: Column, starts: Column, ends: Column) -> Column:
    return F.struct(*[c.alias(name) for c, name in zip((needle, part, starts, ends), WINDOW, strict=True)])


def _blocks(s: Column) -> Column:
    """The text in pieces of the needle's length, or of `MIN_BLOCK` characters for a shorter needle."""
    size = F.greatest(s.m, F.lit(MIN_BLOCK)).cast("string")
    return F.regexp_extract_all(s.text, F.concat(F.lit("(?s).{1,"), size, F.lit("}")), F.lit(0))


def _pairs(s: Column, held: Column, blocks: Column) -> Column:
    """Neighbouring blocks, joined, that hold enough pieces of the needle."""
    last = F.greatest(F.size(blocks) - 1, F.lit(1))
    pairs = F.transform(
        F.sequence(F.lit(1), last),
        lambda i: _window(
            s.needle, F.concat(F.get(blocks, i - 1), F.coalesce(F.get(blocks, i), F.lit(""))), i == 1, i == last
        ),
    )
    return F.filter(pairs, lambda w: F.size(F.filter(held, lambda x: w.part.contains(x))) >= s.need)


def with_partial_matches(df: DataFrame, checks: dict[str, Check], threshold: int) -> DataFrame:
    """Adds a column per check `(needed, first, second)`: `partial_match` where `needed` holds, else null.

    Only the parts of the longer texts that hold enough of the shorter ones go to Python, those of all
    checks in one pass. They are a settled column first: Spark can't match a Python function whose
    argument compares lambda variables, for their canonical order isn't stable.
    """
    def numbered(i: int) -> Callable[[Column], Column]:
        return lambda w: F.struct(F.lit(i).alias("check"), *[w[name].alias(name) for name in WINDOW])

    parts = [
        F.transform(F.when(needed, close_windows(a, b, threshold)), numbered(i))
        for i, (needed, a, b) in enumerate(checks.values())
    ]
    settled = df.select("*", F.explode(F.array(F.flatten(F.array_compact(F.array(*parts))))).alias("_parts"))
    told = settled.withColumn("_told", _matched_udf("_parts", F.lit(threshold))).drop("_parts")
    asked = [needed & a.isNotNull() & b.isNotNull() for needed, a, b in checks.values()]
    found = {n: F.when(asked[i], F.array_contains("_told", F.lit(i))) for i, n in enumerate(checks)}
    return told.withColumns(found).drop("_told")


def max_distance(first_length: Column, second_length: Column, threshold: int) -> Column:
    """Largest number of inserted plus deleted characters still reaching the threshold."""
    return F.floor((first_length + second_length) * (100 - threshold) / 100).cast("int")


def may_be_similar(first: Column, second: Column, threshold: int) -> Column:
    """JVM-side test no similar pair fails: edit distance never exceeds the indel distance."""
    limit = max_distance(F.length(first), F.length(second), threshold)
    bounded = F.call_function("levenshtein", first, second, limit)
    return (F.abs(F.length(first) - F.length(second)) <= limit) & (bounded >= 0)


def is_similar(first: Column, second: Column, threshold: int) -> Column:
    total = F.length(first) + F.length(second)
    lcs = F.when(first == second, F.length(first)).otherwise(
        _lcs_udf(F.when(first != second, first), F.when(first != second, second))
    )
    return lcs * 200 >= total * threshold
