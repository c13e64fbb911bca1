"""Similarity self-join and greedy leader clustering of record keys, within each run.

Candidates come from segment signatures (Li, Deng, Wang, Feng: Pass-Join, 2011) adapted to
insert/delete distance: the shorter string of a similar pair is cut into one segment more than
the edits allowed, so one segment survives verbatim near its place in the longer string. Every
signature is an equi-join key; no pair without a common segment is ever looked at.

The segment places of a string grow with the cube of its length, and no signature of a long one tells texts of
one language apart. Pairs whose shorter string exceeds `LONG_KEY` characters are compared block by block instead:
each pair of a run whose lengths allow it once, by counts of characters and then by an LCS of many pairs at a time
that drops a pair as soon as it can't succeed.

Leaders are the lexicographically first maximal independent set of the similarity graph, found in
parallel rounds (Blelloch, Fineman, Shun 2012) instead of one sequential pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundset.functions.similarity import PAIRS_AT_ONCE, Side, is_similar, max_distance, may_be_similar, reach_lcs, reaches_lcs
from groundset.operators.skew import with_prefix
from groundset.session import cut_lineage

# Fixed value: score at which two keys are the same record.
MERGE_THRESHOLD = 90

# Comparisons one task may take on for one signature before the signature is salted.
HOT_PAIRS = 4_000_000
# Length of the shorter string beyond which pairs are compared block by block, and the most rows and characters of a block.
LONG_KEY, BLOCK, BLOCK_CHARS = 48, 4096, 1_000_000
# Size of a gram that is a signature.
GRAM = 2
#: Characters told apart in a block; further ones share their counters, which only makes bounds weaker.
ALPHABET = 128
#: Levels of character counts and rows of a block that are compared at a time, so that a task's arrays stay small.
LEVELS, ROWS_AT_ONCE = 4096, 512
#: Tasks of block pairs for each shuffle partition: pairs of blocks differ in work.
TASKS_EACH = 4
PEEL_ROUNDS = 8
#: Strings of a run whose leaders are found first; each later wave has as many as all before it.
WAVE = 16_384


def _longest_partner(length: Column, threshold: int) -> Column:
    return F.floor(length * (200 - threshold) / threshold).cast("int")


def _shortest_partner(length: Column, threshold: int) -> Column:
    return F.ceil(length * threshold / (200 - threshold)).cast("int")


def _segments(length: Column, threshold: int) -> Column:
    return max_distance(length, _longest_partner(length, threshold), threshold) + 1


def _segment_start(i: Column, length: Column, k: Column) -> Column:
    short = k - length % k
    return i * F.floor(length / k).cast("int") + F.greatest(i - short, F.lit(0))


def _segment_length(i: Column, length: Column, k: Column) -> Column:
    return F.floor(length / k).cast("int") + (i >= k - length % k).cast("int")


def _signature(length: Column, i: Column, piece: Column) -> Column:
    return F.xxhash64("run_id", length, i, piece)


def _with_sketch(strings: DataFrame, wanted: Column) -> DataFrame:
    """Add a 64-bit parity sketch of (character, occurrence): each edit flips one bit, so the bit
    difference of two strings never exceeds their distance. Null where it is not `wanted`."""
    df = strings.withColumn("_chars", F.array_sort(F.filter(F.split(F.when(wanted, F.col("s")), ""), lambda c: c != "")))
    bits = F.transform(
        "_chars",
        lambda c, i: F.call_function(
            "shiftleft", F.lit(1).cast("bigint"),
            F.pmod(F.xxhash64(c, i - F.array_position("_chars", c)), F.lit(64)).cast("int"),
        ),
    )
    sketch = F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseXOR(b))
    return df.withColumn("sketch", sketch).drop("_chars")


def _index_rows(nodes: DataFrame, threshold: int) -> DataFrame:
    """One row per segment of each string, in the role of the shorter partner."""
    k = _segments(F.col("len"), threshold)
    rows = nodes.filter(F.col("len") <= LONG_KEY).withColumn("k", k).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    piece = F.substring(
        F.col("s"),
        _segment_start(F.col("i"), F.col("len"), F.col("k")) + 1,
        _segment_length(F.col("i"), F.col("len"), F.col("k")),
    )
    return rows.select(
        "run_id", "idx", "len", "sketch", _signature(F.col("len"), F.col("i"), piece).alias("sig"),
        F.lit(True).alias("shorter"),
    )


def _probe_rows(nodes: DataFrame, threshold: int) -> DataFrame:
    """One row per place a partner's segment may occupy, in the role of the longer partner.

    A segment displaced by more than its own number, from either end, leaves too few edits for
    the other side, where another segment then matches: such places are skipped.
    """
    length = F.col("len")
    shorts = F.sequence(_shortest_partner(length, threshold), F.least(length, F.lit(LONG_KEY)))
    rows = (
        nodes.filter(_shortest_partner(length, threshold) <= LONG_KEY)
        .withColumn("short", F.explode(shorts))
        .withColumn("k", _segments(F.col("short"), threshold))
        .withColumn("gap", F.col("len") - F.col("short"))
        .withColumn("edits", max_distance(F.col("len"), F.col("short"), threshold))
        .filter(F.col("gap") <= F.col("edits"))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .withColumn("start", _segment_start(F.col("i"), F.col("short"), F.col("k")))
        .withColumn("size", _segment_length(F.col("i"), F.col("short"), F.col("k")))
    )
    right = F.col("k") - 1 - F.col("i")
    spare = F.floor((F.col("edits") - F.col("gap")) / 2).cast("int")
    low = F.greatest(-F.col("i"), F.col("gap") - right, -spare, -F.col("start"))
    high = F.least(
        F.col("i"), F.col("gap") + right, F.col("gap") + spare, F.col("len") - F.col("size") - F.col("start")
    )
    shifts = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def signature(shift):
        piece = F.substring(F.col("s"), F.col("start") + shift + 1, F.col("size"))
        return _signature(F.col("short"), F.col("i"), piece)

    signatures = F.array_distinct(F.transform(shifts, signature))
    # The outer form: plain explode would infer a size filter and hash everything twice.
    return rows.select(
        "run_id", "idx", "len", "sketch", F.explode_outer(signatures).alias("sig"), F.lit(False).alias("shorter")
    ).filter(F.col("sig").isNotNull())


def _gram_rows(nodes: DataFrame, threshold: int) -> DataFrame:
    """The rarest grams of each long string, in both roles: signatures for keys whose grams are rare.

    Keys of one language meet in most of them, so `similar_pairs` and `leaders_of` compare blocks instead.

    Taking a character out breaks GRAM grams of a string, putting one in breaks GRAM - 1. With d edits
    between lengths n and m that is at most ((2 GRAM - 1) d + n - m) / 2 grams of the string of length n, so two
    similar strings share one among that many and one more, in any order common to both. The bound is
    largest for the shortest partner or for one of equal length. Grams that occur again are numbered.
    """
    numbered = _numbered_grams(nodes.filter(F.col("len") > LONG_KEY), "len", "sketch")
    sizes = numbered.groupBy("run_id", "gram", "nth").agg(F.count(F.lit(1)).alias("n"))
    ranked = numbered.join(sizes, ["run_id", "gram", "nth"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy("run_id", "idx").orderBy("n", "gram", "nth"))
    )
    length = F.col("len")
    broken = F.greatest(
        *[
            F.floor(((2 * GRAM - 1) * max_distance(length, m, threshold) + length - m) / 2)
            for m in (length, _shortest_partner(length, threshold))
        ]
    )
    return ranked.filter(F.col("rank") <= broken + 1).select(
        "run_id", "idx", "len", "sketch", F.xxhash64("run_id", F.lit("gram"), "gram", "nth").alias("sig"),
        F.explode(F.array(F.lit(True), F.lit(False))).alias("shorter"),
    )


def _numbered_grams(long: DataFrame, *carried: str) -> DataFrame:
    """Every gram of the strings of `long`, with the number of its occurrence in the string."""
    grams = F.transform(
        F.sequence(F.lit(1), F.col("len") - GRAM + 1), lambda i: F.substring(F.col("s"), i, F.lit(GRAM))
    )
    rows = long.select("run_id", "idx", *carried, F.posexplode(F.array_sort(grams)).alias("at", "gram"))
    # Equal grams stand together once sorted: their number is the distance from the first of them.
    mine = Window.partitionBy("run_id", "idx", "gram").orderBy("at")
    return rows.withColumn("nth", F.row_number().over(mine))


def _postings(nodes: DataFrame, threshold: int, hot_pairs: int) -> DataFrame:
    """Signature rows that can meet a partner, with the number of salts of their signature."""
    rows = _union([_index_rows(nodes, threshold), _probe_rows(nodes, threshold)])
    met = (
        rows.groupBy("run_id", "sig")
        .agg(
            F.count_if("shorter").alias("n_short"),
            F.count_if(~F.col("shorter")).alias("n_long"),
            F.min("idx").alias("low"),
            F.max("idx").alias("high"),
        )
        .filter((F.col("n_short") > 0) & (F.col("n_long") > 0) & (F.col("low") < F.col("high")))
    )
    work = F.col("n_short") * F.col("n_long")
    salts = F.greatest(F.lit(1), F.least(F.ceil(work / hot_pairs), F.col("n_short"))).cast("int")
    met = met.select("run_id", "sig", salts.alias("salts"))
    return rows.join(met, ["run_id", "sig"])


def _postings_between(heads: DataFrame, later: DataFrame, threshold: int, hot_pairs: int) -> DataFrame:
    """Signature rows of `heads` (`early`) and `later` that can meet a partner on the other side, with their salts."""
    rows = _union(
        [make(df, threshold).withColumn("early", F.lit(early)) for df, early in ((heads, True), (later, False)) for make in (_index_rows, _probe_rows)]
    )
    early, shorter = F.col("early"), F.col("shorter")
    sides = {"es": early & shorter, "el": early & ~shorter, "ls": ~early & shorter, "ll": ~early & ~shorter}
    met = rows.groupBy("run_id", "sig").agg(*[F.count_if(c).alias(n) for n, c in sides.items()])
    work = F.col("es") * F.col("ll") + F.col("ls") * F.col("el")
    salts = F.greatest(F.lit(1), F.least(F.ceil(work / hot_pairs), F.greatest("es", "ls"))).cast("int")
    return rows.join(met.filter(work > 0).select("run_id", "sig", salts.alias("salts")), ["run_id", "sig"])


def _candidates(earlier: DataFrame, later: DataFrame, threshold: int) -> DataFrame:
    """Distinct (a, b), a < b, of rows meeting on a signature in opposite roles.

    The shorter side of a hot signature is spread over its salts, the longer side repeated for
    each: every pair meets exactly once. The sketches prune inside the join.
    """
    found = []
    for short, long, flip in ((earlier, later, False), (later, earlier, True)):
        i = short.filter("shorter").select(
            "run_id", "sig", F.pmod(F.xxhash64("idx"), F.col("salts")).cast("int").alias("salt"),
            F.col("idx").alias("i_idx"), F.col("len").alias("i_len"), F.col("sketch").alias("i_sketch"),
        )
        p = long.filter(~F.col("shorter")).select(
            "run_id", "sig", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
            F.col("idx").alias("p_idx"), F.col("len").alias("p_len"), F.col("sketch").alias("p_sketch"),
        )
        order = F.col("i_idx") > F.col("p_idx") if flip else F.col("i_idx") < F.col("p_idx")
        apart = F.bit_count(F.col("i_sketch").bitwiseXOR(F.col("p_sketch")))
        pairs = i.join(p, ["run_id", "sig", "salt"]).filter(
            order & (apart <= max_distance(F.col("i_len"), F.col("p_len"), threshold))
        )
        found.append(
            pairs.select("run_id", F.least("i_idx", "p_idx").alias("a"), F.greatest("i_idx", "p_idx").alias("b"))
        )
    return found[0].unionByName(found[1]).distinct()


def _alphabet(one: list[str], other: list[str]) -> tuple[list[np.ndarray], int, bool]:
    """Both sides' characters as numbers below the size given next, and whether each number is one character."""
    flat = [np.frombuffer("".join(s).encode("utf-32-le", "surrogatepass"), np.uint32) for s in (one, other)]
    known = np.unique(np.concatenate(flat))
    numbers = [(np.searchsorted(known, f) % ALPHABET).astype(np.int64) for f in flat]
    return numbers, min(len(known), ALPHABET), len(known) <= ALPHABET


def _levels(counts: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """Per row of counts a 1 for every level reached, up to the top of each column: the product of two rows is the sum of their lesser counts."""
    column = np.repeat(np.arange(len(tops)), tops)
    level = np.arange(len(column)) - np.repeat(np.cumsum(tops) - tops, tops) + 1
    return (counts[:, column] >= level).astype(np.float32)


def _by_counts(counts: list[np.ndarray], lengths: list[np.ndarray], same: bool, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, both sides sorted by length, whose lengths and counts of characters allow the threshold.

    An LCS takes a character as often as the string that has fewer of it. Counts beyond the top level are added whole.
    """
    low = np.searchsorted(lengths[1], -(-lengths[0] * threshold // (200 - threshold)))
    high = np.searchsorted(lengths[1], lengths[0] * (200 - threshold) // threshold, "right")
    if not (low < high).any():
        return
    most = np.minimum(*[c.max(axis=0) for c in counts])
    top = next((t for t in (1 << k for k in range(31, 5, -1)) if np.minimum(most, t).sum() <= LEVELS), LEVELS // ALPHABET)
    levels = [_levels(c, np.minimum(most, top)) for c in counts]
    beyond = [np.maximum(c - top, 0).sum(axis=1).astype(np.float32) for c in counts]
    # Rounded sums are off by far less than what is taken off here.
    needed = [threshold * n / 200 - 0.001 for n in lengths]
    for at in range(0, len(low), ROWS_AT_ONCE):
        mine = slice(at, at + ROWS_AT_ONCE)
        end = int(high[mine].max())
        for start in range(max(int(low[mine].min()), at + 1 if same else 0), end, ROWS_AT_ONCE):
            theirs = slice(start, min(start + ROWS_AT_ONCE, end))
            shared = levels[0][mine] @ levels[1][theirs].T
            if (most > top).any():
                shared += np.minimum.outer(beyond[0][mine], beyond[1][theirs])
            j = np.arange(theirs.start, theirs.stop)
            met = (shared >= np.add.outer(needed[0][mine], needed[1][theirs])) & (low[mine, None] <= j) & (j < high[mine, None])
            if same:
                met &= np.arange(at, at + len(met))[:, None] < j
            one, other = np.nonzero(met)
            yield one + at, other + start


def _similar_in_blocks(one: pa.Table, other: pa.Table, same: bool, threshold: int) -> list[tuple[int, int]]:
    """Similar pairs of rows (idx, len, s) of two blocks, or of one block with itself."""
    one, other = (t.sort_by("len") for t in (one, other))
    lengths = [t["len"].to_numpy().astype(np.int64) for t in (one, other)]
    if not len(lengths[0]) or not len(lengths[1]):
        return []
    names, strings = ([t[c].to_pylist() for t in (one, other)] for c in ("idx", "s"))
    numbers, size, exact = _alphabet(*strings)
    rows = [np.repeat(np.arange(len(n)), n) for n in lengths]
    counts = [np.bincount(r * size + c, minlength=len(n) * size).reshape(len(n), size) for r, c, n in zip(rows, numbers, lengths, strict=True)]
    sides = [Side(c, n, size) for c, n in zip(numbers, lengths, strict=True)]
    found, waiting, held = [], [], 0

    def score() -> None:
        i, j = (np.concatenate(p) for p in zip(*waiting, strict=True))
        # The shorter string is read along the longer one: it has fewer characters to spare.
        turned = lengths[0][i] <= lengths[1][j]
        close = np.zeros(len(i), bool)
        for way, (x, y, p, q) in ((~turned, (0, 1, i, j)), (turned, (1, 0, j, i))):
            close[way] = reach_lcs(sides[x], sides[y], p[way], q[way], threshold)
        for a, b in zip(i[close].tolist(), j[close].tolist(), strict=True):
            if exact or reaches_lcs(strings[0][a], [strings[1][b]], threshold)[0]:
                found.append((names[0][a], names[1][b]))

    for pair in _by_counts(counts, lengths, same, threshold):
        waiting.append(pair)
        held += len(pair[0])
        if held >= PAIRS_AT_ONCE:
            score()
            waiting, held = [], 0
    if held:
        score()
    return found


def _in_blocks(strings: DataFrame, threshold: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Strings longer than LONG_KEY with their class of lengths and block, and the number of blocks of each class."""
    width = max(math.log((200 - threshold) / threshold) / 2, 1e-3)
    rows = strings.filter(F.col("len") > LONG_KEY).select("run_id", "idx", "len", "s")
    rows = rows.withColumn("class", F.floor(F.log("len") / width).cast("int"))
    needed = F.greatest(F.count(F.lit(1)) / block, F.sum("len") / BLOCK_CHARS)
    sizes = cut_lineage(
        rows.groupBy("run_id", "class").agg(F.ceil(needed).cast("int").alias("blocks"), F.min("len").alias("least"), F.max("len").alias("most"))
    )
    rows = rows.join(sizes.drop("least", "most"), ["run_id", "class"]).withColumn("block", F.pmod(F.xxhash64("idx"), "blocks").cast("int"))
    return rows.drop("blocks"), sizes


def _long_pairs(strings: DataFrame, threshold: int, block: int = BLOCK, others: DataFrame | None = None) -> DataFrame:
    """All similar pairs `(run_id, a, b)`, a < b, of strings longer than LONG_KEY: of each other, or of `others`.

    Rows of a run fall into length classes, and within a class into blocks of about `block` rows, fewer if they are long.
    Each pair of blocks whose lengths allow a partner is one group: its rows are bounded however large the run is, and
    no key or gram decides where a row goes. The work still grows with the square of a run.
    """
    rows, sizes = _in_blocks(strings, threshold, block)
    other_rows, other_sizes = (rows, sizes) if others is None else _in_blocks(others, threshold, block)
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ours = sizes.select("run_id", "class", "least", "most", each.alias("block"))
    theirs = other_sizes.select("run_id", *[F.col(c).alias(f"{c}2") for c in ("class", "least", "most")], each.alias("block2"))
    met = (F.col("least2") <= _longest_partner(F.col("most"), threshold)) & (F.col("least") <= _longest_partner(F.col("most2"), threshold))
    if others is None:
        met &= (F.col("class") < F.col("class2")) | ((F.col("class") == F.col("class2")) & (F.col("block") <= F.col("block2")))
    met = ours.join(theirs, "run_id").filter(met)
    met = met.withColumn("pair", F.struct("class", "block", "class2", "block2"))
    left = rows.join(met.select("run_id", "class", "block", "pair"), ["run_id", "class", "block"])
    apart = met if others is not None else met.filter("class <> class2 or block <> block2")
    right = other_rows.join(
        apart.select("run_id", F.col("class2").alias("class"), F.col("block2").alias("block"), "pair"),
        ["run_id", "class", "block"],
    )
    dealt = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    schema = T.StructType([strings.schema["run_id"], T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    alone = others is None

    def compare(group: pa.Table) -> pa.Table:
        pair = group["pair"][0].as_py()
        same = alone and (pair["class"], pair["block"]) == (pair["class2"], pair["block2"])
        one, other = (group.filter(pa.compute.equal(group["side"], s)) for s in (0, 0 if same else 1))
        found = _similar_in_blocks(one, other, same, threshold)
        run = pa.array([group["run_id"][0].as_py()] * len(found), group.schema.field("run_id").type)
        ends = [pa.array([end(p) for p in found], pa.int64()) for end in (min, max)]
        return pa.table([run, *ends], names=["run_id", "a", "b"])

    # Named here, as a few MB of groups can be hours of work and would be put together.
    tasks = TASKS_EACH * int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "run_id", "pair").groupBy("run_id", "pair").applyInArrow(compare, schema)


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """Keep pairs whose strings reach the threshold: bounded edit distance first, then the LCS."""
    strings = nodes.select("run_id", "idx", "s")
    joined = pairs.join(strings.withColumnsRenamed({"idx": "a", "s": "sa"}), ["run_id", "a"]).join(
        strings.withColumnsRenamed({"idx": "b", "s": "sb"}), ["run_id", "b"]
    )
    close = joined.filter(may_be_similar(F.col("sa"), F.col("sb"), threshold))
    return close.filter(is_similar(F.col("sa"), F.col("sb"), threshold)).select("run_id", "a", "b")


def _distinct_strings(nodes: DataFrame, threshold: int = MERGE_THRESHOLD) -> DataFrame:
    """Equal strings share their first position: similarity only looks at the string.

    Only partners of short keys have postings and need a sketch; its cost grows with the square of a length.
    """
    firsts = nodes.filter(F.length("s") > 0).groupBy("run_id", "s").agg(F.min("idx").alias("idx"))
    return cut_lineage(_with_sketch(firsts.withColumn("len", F.length("s")), _shortest_partner(F.col("len"), threshold) <= LONG_KEY))


def similar_pairs(nodes: DataFrame, threshold: int = MERGE_THRESHOLD, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """All similar pairs `(run_id, a, b)`, a < b, over the distinct strings of `(run_id, idx, s)`."""
    strings = _distinct_strings(nodes, threshold)
    postings = cut_lineage(_postings(strings, threshold, hot_pairs))
    short = _verified(_candidates(postings, postings, threshold), strings, threshold)
    return short.unionByName(_long_pairs(strings, threshold))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _peel(postings: DataFrame, strings: DataFrame, long: DataFrame, threshold: int, hot_pairs: int, rounds: int):
    """Settle hot signatures without their pairs.

    A node that comes first in every signature it holds and in no pair of `long` second has no earlier neighbour, so it leads. It
    is compared with the members of its signatures - one leader each, linear in the postings - and
    absorbs its likes. Groups of near copies vanish this way before any pair is formed. Returns
    undecided postings, absorbed postings and (leader, absorbed) matches.
    """
    live, gone, matches = postings, postings.limit(0), []
    key = ["run_id", "idx"]
    later = long.select("run_id", F.col("b").alias("idx")).distinct()
    for _ in range(rounds):
        if live.filter("salts > 1").isEmpty():
            break
        first = live.groupBy("run_id", "sig").agg(F.min("idx").alias("first"))
        heads = (
            live.join(first, ["run_id", "sig"])
            .groupBy(*key)
            .agg(F.bool_and(F.col("first") == F.col("idx")).alias("leads"))
            .filter("leads")
            .select(*key)
            .join(later, key, "left_anti")
        )
        heads = cut_lineage(heads)
        head_rows = live.join(heads, key, "left_semi")
        others = live.join(heads, key, "left_anti").unionByName(gone)
        hit = cut_lineage(_verified(_candidates(head_rows, others, threshold), strings, threshold))
        matches.append(hit)
        absorbed = hit.select("run_id", F.col("b").alias("idx")).distinct()
        rest = live.join(heads, key, "left_anti")
        gone = cut_lineage(gone.unionByName(rest.join(absorbed, key, "left_semi")))
        live = cut_lineage(_resalted(rest.join(absorbed, key, "left_anti"), hot_pairs))
    return live, gone, matches


def _resalted(live: DataFrame, hot_pairs: int) -> DataFrame:
    """A signature that shrank below the limit no longer counts as hot."""
    sizes = live.groupBy("run_id", "sig").agg(F.count(F.lit(1)).alias("n"))
    now = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("n") / 4 / hot_pairs)).cast("int")
    return (
        live.join(sizes, ["run_id", "sig"])
        .withColumn("salts", F.least("salts", now))
        .drop("n")
    )


def _absorbed_nodes(edges: DataFrame) -> list[DataFrame]:
    """Nodes that are not leaders, by rounds over explicit edges."""
    absorbed = []
    while not edges.isEmpty():
        later = edges.select("run_id", F.col("b").alias("a")).distinct()
        leaders = edges.select("run_id", "a").distinct().join(later, ["run_id", "a"], "left_anti")
        hit = cut_lineage(edges.join(leaders, ["run_id", "a"], "left_semi").select("run_id", "b").distinct())
        absorbed.append(hit)
        edges = cut_lineage(
            edges.join(leaders, ["run_id", "a"], "left_anti")
            .join(hit, ["run_id", "b"], "left_anti")
            .join(hit.withColumnRenamed("b", "a"), ["run_id", "a"], "left_anti")
        )
    return absorbed


def _settled(strings: DataFrame, threshold: int, hot_pairs: int, peel_rounds: int) -> DataFrame:
    """`(run_id, idx, top)`: the earliest similar leader of every string that does not lead, among `strings` alone."""
    postings = cut_lineage(_postings(strings, threshold, hot_pairs))
    long = cut_lineage(_long_pairs(strings, threshold))
    live, gone, matches = _peel(postings, strings, long, threshold, hot_pairs, peel_rounds)
    found = _verified(_candidates(live, live.unionByName(gone), threshold), strings, threshold)
    if matches:
        settled = gone.select("run_id", F.col("idx").alias("b")).distinct()
        # A settled node leads nobody.
        long = long.join(settled.withColumnRenamed("b", "a"), ["run_id", "a"], "left_anti")
    edges = cut_lineage(found.unionByName(long))
    open_edges = edges.join(settled, ["run_id", "b"], "left_anti") if matches else edges
    absorbed = _absorbed_nodes(open_edges)
    links = _union([edges, *matches])
    followers = [*absorbed, *[m.select("run_id", "b") for m in matches]]
    if not followers:
        return strings.select("run_id", "idx", F.lit(None).cast("bigint").alias("top")).limit(0)
    not_leading = _union(followers).distinct()
    from_leader = links.join(not_leading.withColumnRenamed("b", "a"), ["run_id", "a"], "left_anti")
    return from_leader.groupBy("run_id", F.col("b").alias("idx")).agg(F.min("a").alias("top"))


def _followers(heads: DataFrame, later: DataFrame, threshold: int, hot_pairs: int) -> DataFrame:
    """`(run_id, idx, top)`: the earliest of `heads` that is similar, for every string of `later` that has one."""
    postings = cut_lineage(_postings_between(heads, later, threshold, hot_pairs))
    met = _candidates(postings.filter("early"), postings.filter("not early"), threshold)
    links = _verified(met, heads.unionByName(later), threshold).unionByName(_long_pairs(heads, threshold, others=later))
    return links.groupBy("run_id", F.col("b").alias("idx")).agg(F.min("a").alias("top"))


def _tops(strings: DataFrame, threshold: int, hot_pairs: int, peel_rounds: int, wave: int) -> list[DataFrame]:
    """`(run_id, idx, top)` of the strings that do not lead, wave by wave.

    A wave holds the next strings of each run in their order, as many as all before it. Its leaders absorb all later
    strings like them before these are compared with each other, so that near copies cost a comparison with
    their leader instead of all their pairs. About log2 of the largest run's strings over `wave` rounds.
    """
    most = strings.groupBy("run_id").count().agg(F.max("count")).first()[0] or 0
    if most <= wave:
        return [_settled(strings, threshold, hot_pairs, peel_rounds)]
    placed = with_prefix(strings, ["run_id"], ["idx"], count="place")
    number = F.when(F.col("place") <= wave, 0).otherwise(F.ceil(F.log2(F.col("place") / wave)).cast("int"))
    alive = cut_lineage(placed.withColumn("wave", number).drop("place"))
    last = alive.agg(F.max("wave")).first()[0]
    tops = []
    for k in range(last + 1):
        now, later = alive.filter(F.col("wave") == k), alive.filter(F.col("wave") > k)
        own = cut_lineage(_settled(now.drop("wave"), threshold, hot_pairs, peel_rounds))
        tops.append(own)
        if k < last:
            heads = now.join(own, ["run_id", "idx"], "left_anti")
            tops.append(cut_lineage(_followers(heads.drop("wave"), later.drop("wave"), threshold, hot_pairs)))
            alive = cut_lineage(later.join(tops[-1], ["run_id", "idx"], "left_anti"))
    return tops


def leaders_of(
    nodes: DataFrame,
    threshold: int = MERGE_THRESHOLD,
    hot_pairs: int = HOT_PAIRS,
    peel_rounds: int = PEEL_ROUNDS,
    wave: int = WAVE,
) -> DataFrame:
    """`(run_id, idx, leader)` for every node that is not its own leader.

    Taken in order of `idx`, a node leads unless an earlier leader is similar; an absorbed node
    belongs to its earliest similar leader. Nodes with an empty string stay alone.
    """
    strings = _distinct_strings(nodes, threshold)
    tops = _union(_tops(strings, threshold, hot_pairs, peel_rounds, wave))
    by_string = strings.join(tops, ["run_id", "idx"]).select("run_id", "s", "top")
    first = strings.select("run_id", "s", F.col("idx").alias("first"))
    placed = nodes.filter(F.length("s") > 0).join(first, ["run_id", "s"]).join(by_string, ["run_id", "s"], "left")
    return placed.select("run_id", "idx", F.coalesce("top", "first").alias("leader")).filter("leader != idx")
