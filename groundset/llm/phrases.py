"""Document fingerprints from Lempel-Ziv phrases: least hashes of the phrases that a text is parsed into."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bins of a fingerprint; a bin is 4 hex digits, 0000 where it is empty.
BINS, DIGITS = 128, 4
#: Bytes of text that one task of the ordered pass takes, and the least that is worth a task of its own.
PART_BYTES, LEAST_BYTES = 64_000_000, 2_000_000
_CHARS, _MASK = 0x110000, (1 << 64) - 1
_STEP = np.uint64(64 - (BINS - 1).bit_length())


class Parse:
    """An incremental Lempel-Ziv (1978) parse: each phrase is a known one and the next character.

    The trie maps phrase and character to the longer phrase; a phrase's hash follows from its characters alone.
    """

    def __init__(self) -> None:
        self.trie: dict[int, int] = {}
        self.hashes = [0x9E3779B97F4A7C15]
        self.at = 0

    def feed(self, text: str) -> Parse:
        trie, hashes, at, size = self.trie, self.hashes, self.at, len(self.hashes)
        get = trie.get
        for c in map(ord, text):
            key = at * _CHARS + c
            at = get(key)
            if at is None:
                trie[key] = size
                size += 1
                hashes.append((hashes[key // _CHARS] ^ c) * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB & _MASK)
                at = 0
        self.at = at
        return self

    def fork(self) -> Parse:
        other = Parse()
        other.trie, other.hashes, other.at = self.trie.copy(), self.hashes.copy(), self.at
        return other

    def bins(self) -> np.ndarray:
        """The least hash of each bin of phrases, folded to 1..65535; 0 where a bin has no phrase."""
        h = np.array(self.hashes[1:], np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = np.sort((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15))
        of, first = np.unique((h >> _STEP).astype(np.int64), return_index=True)
        out = np.zeros(BINS, np.uint16)
        out[of] = h[first] % np.uint64(65535) + np.uint64(1)
        return out


def text_of(bins: np.ndarray) -> str:
    return bins.astype(">u2").tobytes().hex()


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins among those that either has: an estimate of the Jaccard of the phrase sets."""
    some = int(((a > 0) | (b > 0)).sum())
    return int(((a == b) & (a > 0)).sum()) / some if some else 1.0


def fingerprint(text: str | None) -> str:
    return text_of(Parse().feed(text or "").bins())


def likeness(a: Column, b: Column) -> Column:
    """`alike` of two fingerprint columns, in the JVM; null where one is null."""
    places = F.sequence(F.lit(0), F.lit(BINS - 1))
    empty = F.lit("0" * DIGITS)

    def digits(c: Column, i: Column) -> Column:
        return F.substring(c, i * DIGITS + 1, F.lit(DIGITS))

    some = F.size(F.filter(places, lambda i: (digits(a, i) != empty) | (digits(b, i) != empty)))
    same = F.size(F.filter(places, lambda i: (digits(a, i) != empty) & (digits(a, i) == digits(b, i))))
    # A null side makes size() -1 or null by configuration, so it is decided first.
    return F.when(a.isNull() | b.isNull(), None).when(some == 0, 1.0).otherwise(same / some)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and its fingerprint. Null and empty texts have the empty one (all zeros). No shuffle."""
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fingerprint", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=[f.name for f in fields])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, T.StructType(fields))


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Rows _id, _tie, _own with the _part that holds them in descending order of id, and how many parts there are.

    The first row of a part comes twice: as its own and, with _guard 1, at the end of the part before (that of
    part 0 at the end of the last one). One narrow pass sorts ids and text hashes by range, of which one row a part
    reaches the driver; the texts are moved once.
    """
    own = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(own).alias("_tie"), own.alias("_own"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_own")), F.lit(0))).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(n, max(-(-size // PART_BYTES), min(4 * cores, -(-size // LEAST_BYTES)))))
    order = (F.col("_id").isNotNull(), F.col("_id"), F.col("_tie"))
    key = F.struct(order[0].alias("some"), order[1].alias("id"), order[2].alias("tie"))
    ranged = rows.select("_id", "_tie").repartitionByRange(parts, *(c.desc() for c in order))
    firsts = ranged.groupBy(F.spark_partition_id()).agg(F.max(key).alias("key")).select("key.*").collect()
    heads = sorted(tuple(r) for r in firsts)
    last = max(0, len(heads) - 1)

    @F.pandas_udf("long")
    def place(ids: pd.Series, ties: pd.Series, some: pd.Series) -> pd.Series:
        """The part, doubled, plus 1 for a row like the first of its part."""
        out = []
        for i, tie, has in zip(ids.tolist(), ties.tolist(), some.tolist(), strict=True):
            row = (bool(has), i if has else None, tie)
            at = bisect_left(heads, row)
            out.append(2 * (last - at) + (heads[at] == row))
        return pd.Series(out, dtype="int64")

    # Nulls would turn long ids into doubles in pandas; the flag beside them says which are none.
    kind = docs.schema[id_col].dataType
    filled = F.coalesce(F.col("_id"), F.lit(0).cast(kind)) if isinstance(kind, T.IntegralType) else F.col("_id")
    placed = rows.withColumn("_code", place(filled, "_tie", order[0]))
    part = F.shiftright("_code", 1).cast("int")
    itself = F.struct(part.alias("_part"), F.lit(0).alias("_guard"))
    before = F.when(part == 0, last).otherwise(part - 1)
    guard = F.struct(before.alias("_part"), F.lit(1).alias("_guard"))
    copies = F.when(F.col("_code") % 2 == 1, F.array(itself, guard)).otherwise(F.array(itself))
    return placed.select("_id", "_tie", "_own", F.explode(copies).alias("_to")).select("_id", "_tie", "_own", "_to.*"), last + 1


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row, against its edited text and the next document: the id, n_chars, edited_sha256, both fingerprints, likenesses.

    The next document is that of the next smaller id, after the last the first; null ids come last, rows of one id by
    falling hash of the text. The edited text has as many first characters of the next one in place of its
    last floor(n_chars / 2), or all of a shorter one. A null text counts as empty; an only document is its
    own next. Empty texts are alike with 1, an empty and another text with 0. An empty table gives no rows. Other columns are
    dropped. Rows are streamed in order within a part, one held at a time; rows of one id with the very same text share a part.
    """
    dealt, parts = _dealt(docs, id_col, text_col)
    fields = [
        T.StructField(id_col, docs.schema[id_col].dataType),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Any, str, Parse, np.ndarray] | None = None
        for batch in batches:
            done: list[tuple] = []
            for i, text, guard in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if guard and held is None:
                    continue  # a further row like the guard
                stay = len(text) - len(text) // 2
                half = Parse().feed(text[:stay])
                bins = half.fork().feed(text[stay:]).bins()
                if held is not None:
                    his, old, old_half, old_bins = held
                    put = text[: len(old) // 2]
                    edited = old[: len(old) - len(old) // 2] + put
                    edited_bins = old_half.feed(put).bins()
                    done.append(
                        (his, len(old), hashlib.sha256(edited.encode()).hexdigest(), text_of(old_bins), text_of(edited_bins))
                        + (alike(old_bins, edited_bins), alike(old_bins, bins))
                    )
                held = None if guard else (i, text, half, bins)
            columns = zip(*done, strict=True) if done else ([] for _ in fields)
            kinds = [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    order = [F.col("_guard"), F.col("_id").isNotNull().desc(), F.col("_id").desc(), F.col("_tie").desc()]
    ordered = dealt.repartitionById(parts, F.col("_part")).sortWithinPartitions(*order)
    return ordered.select("_id", "_own", "_guard").mapInArrow(run, T.StructType(fields))
