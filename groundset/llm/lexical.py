"""Ranked lexical search by scanning: an automaton of all item terms counts them in the texts, without an index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundset.llm.tables import written

#: Items and bytes of item text that one automaton takes; more items are searched slice by slice.
SLICE_ITEMS, SLICE_BYTES = 2048, 8_000_000
#: Bytes scanned and documents scored at once; they bound memory, not results.
BLOCK, BLOCK_DOCS = 1_000_000, 256
#: Bytes of terms (ASCII letters and digits, and all beyond ASCII), capital letters lowered; others end a term.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def spaced(text: str | None) -> bytes:
    """The terms of a text with one space in place of each other byte."""
    return (text or "").encode().translate(TERM_BYTES)


def n_terms(plain: bytes) -> int:
    """Terms with repeats of what `spaced` gives."""
    inside = np.frombuffer(plain, np.uint8) != 32
    return int(inside[:1].sum()) + int((inside[1:] & ~inside[:-1]).sum())


def term_weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


class Finder:
    """Counts the terms of a slice of items in texts; built once per task from the broadcast terms."""

    def __init__(self, terms: list[bytes]):
        self.size = len(terms)
        self.automaton = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            # A space on both sides guards the boundaries, so a match is a whole term.
            self.automaton.add_word(f" {term.decode('latin-1')} ", k)
        self.automaton.make_automaton()

    def _found(self, joined: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """Matches (place, term) by parts that share the space between them, each with its first place."""
        start, last = 0, len(joined) - 1
        while start < last:
            end = joined.find(b" ", min(start + BLOCK, last))
            hits = self.automaton.iter(joined[start : end + 1].decode("latin-1"))
            yield start, np.fromiter(chain.from_iterable(hits), np.int64).reshape(-1, 2)
            start = end

    def count(self, plain: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, term number and occurrences of every term that a text holds, in that order."""
        if not self.size:
            return (np.zeros(0, np.int64),) * 3
        starts = np.cumsum([0, *(len(p) + 1 for p in plain)])
        codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for first, hits in self._found(b" " + b" ".join(plain) + b" "):
            text = np.searchsorted(starts, first + hits[:, 0] - 1, "right") - 1
            new, n = np.unique(text * self.size + hits[:, 1], return_counts=True)
            codes, times = np.append(codes, new), np.append(times, n)
        codes, of = np.unique(codes, return_inverse=True)
        return codes // self.size, codes % self.size, np.bincount(of, times, len(codes)).astype(np.int64)


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Whole texts, `spaced`, in blocks of bounded size, each with the number of its first text."""
    held: list[bytes] = []
    first = size = 0
    for k, text in enumerate(texts):
        held.append(spaced(text))
        size += len(held[-1])
        if size > BLOCK or len(held) == BLOCK_DOCS:
            yield first, held
            held, first, size = [], k + 1, 0
    if held:
        yield first, held


class Best:
    """The k best documents of every item so far: highest score, then least id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores = np.zeros((items, k), np.int64)
        self.ids = np.full((items, k), None, object)

    def add(self, ids: list[Any], scores: np.ndarray) -> None:
        """`scores`: documents x items."""
        item, doc = np.nonzero((scores.T > 0) & (scores.T >= self.scores[:, -1:]))
        if not len(item):
            return
        old_item, old_place = np.nonzero(self.scores)
        names = np.empty(len(doc) + len(old_item), object)
        names[: len(doc)] = [ids[d] for d in doc.tolist()]
        names[len(doc) :] = self.ids[old_item, old_place]
        place = {v: n for n, v in enumerate(sorted(set(names), key=lambda v: (v is None, v if v is not None else 0)))}
        of = np.append(item, old_item)
        score = np.append(scores[doc, item], self.scores[old_item, old_place])
        order = np.lexsort((np.fromiter(map(place.__getitem__, names), np.int64, len(names)), -score, of))
        of = of[order]
        nth = np.arange(len(of)) - np.searchsorted(of, of)
        top = nth < self.k
        self.scores[of[top], nth[top]] = score[order][top]
        self.ids[of[top], nth[top]] = names[order][top]


def _sliced(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Items as written rows _item, _bytes (id first, terms spaced) with a slice number, and how many slices there are.

    The number of slices follows from the items' count and size, so that what one pass broadcasts is bounded.
    """
    rows = items.select(F.col(id_col).alias("_item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_own"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_own")), F.lit(0))).first()
    slices = max(1, -(-n // SLICE_ITEMS), -(-size // SLICE_BYTES))
    return written(rows.withColumn("_slice", F.pmod(F.xxhash64("_item"), F.lit(slices))), "items"), slices


def _statistics(docs: DataFrame, text_col: str, terms: Any) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and for each item term the documents that hold it."""
    schema = T.StructType([T.StructField("term", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, holding, n_docs, total = Finder(terms.value), np.zeros(len(terms.value), np.int64), 0, 0
        for batch in batches:
            for _, plain in _blocks(batch.column(0).to_pylist()):
                lengths = [n_terms(p) for p in plain]
                n_docs, total = n_docs + sum(n > 0 for n in lengths), total + sum(lengths)
                holding += np.bincount(finder.count(plain)[1], minlength=len(holding))
        some = np.flatnonzero(holding)
        term, n = [-2, -1, *some.tolist()], [n_docs, total, *holding[some].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(n, pa.int64())], names=["term", "n"])

    partial = docs.select(F.col(text_col).cast("string")).mapInArrow(run, schema)
    # As many rows as item terms of a slice.
    sums = {r["term"]: r["n"] for r in partial.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    holding = np.zeros(len(terms.value), np.int64)
    for term, n in sums.items():
        if term >= 0:
            holding[term] = n
    return sums.get(-2, 0), sums.get(-1, 0), holding


def _scored(docs: DataFrame, id_col: str, text_col: str, given: Any, k: int, item_type: T.DataType) -> DataFrame:
    """The k best documents of every item among those of each task: _item, _doc, score."""
    fields = [
        T.StructField("_item", item_type),
        T.StructField("_doc", docs.schema[id_col].dataType),
        T.StructField("score", T.LongType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, items, first, posted, weights, n_docs, total = given.value
        finder, best, kind = Finder(terms), Best(len(items), k), None
        lists = np.diff(first)
        for batch in batches:
            kind, ids = batch.schema.field(0).type, batch.column(0).to_pylist()
            for at, plain in _blocks(batch.column(1).to_pylist()):
                doc, term, tf = finder.count(plain)
                n = np.array([n_terms(p) for p in plain], np.int64)
                m = 10 + 90 * n * n_docs // max(total, 1)
                value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                # The automaton's outputs map to items: each count is dealt to all items that have the term.
                each = np.repeat(np.arange(len(term)), lists[term])
                nth = np.arange(len(each)) - np.repeat(np.cumsum(lists[term]) - lists[term], lists[term])
                cell = doc[each] * len(items) + posted[first[term[each]] + nth]
                # A summand is below 2^36, so sums of 2^17 of them are exact in doubles.
                sums = np.bincount(cell, value[each].astype(np.float64), len(plain) * len(items))
                best.add(ids[at : at + len(plain)], sums.astype(np.int64).reshape(len(plain), -1))
        of, place = np.nonzero(best.scores)
        if kind is not None:
            names = pa.array([items[i] for i in of.tolist()])
            found = [names, pa.array(best.ids[of, place].tolist(), kind), pa.array(best.scores[of, place])]
            yield pa.RecordBatch.from_arrays(found, names=[f.name for f in fields])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, T.StructType(fields))


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The `k` documents of highest score above 0 for each item: the item's id, rank (from 1), the id, score.

    Two scans of the texts, no index: the first counts documents, terms and the documents that hold each item
    term, the second scores. A task keeps `k` documents per item, so what moves grows with tasks and items, not with
    documents. Equal scores rank by ascending id, null ids last; rows that repeat an id rank each. Rows of one
    item id are one item with the terms of all. Null and empty texts have no terms: such items have
    no rows, such documents are never found. Empty tables give no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    sliced, slices = _sliced(items, item_col, item_text_col)
    item_type = items.schema[item_col].dataType
    found = []
    for s in range(slices):
        own: dict[Any, set[bytes]] = {}
        for r in sliced.where(F.col("_slice") == s).collect():  # bounded by SLICE_ITEMS and SLICE_BYTES on average
            own.setdefault(r["_item"], set()).update(spaced(r["_own"]).split())
        terms = sorted(set().union(*own.values()))
        number, names = {t: n for n, t in enumerate(terms)}, list(own)
        pairs = np.array(sorted((number[t], i) for i, v in enumerate(names) for t in own[v]), np.int64).reshape(-1, 2)
        first = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
        shared = spark.sparkContext.broadcast(terms)
        n_docs, total, holding = _statistics(docs, text_col, shared)
        weights = np.array([term_weight(n_docs, int(h)) for h in holding], np.int64)
        given = spark.sparkContext.broadcast((terms, names, first, pairs[:, 1], weights, n_docs, total))
        found.append(_scored(docs, id_col, text_col, given, k, item_type))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.col("_doc").asc_nulls_last())
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("_item").alias(item_col), "rank", F.col("_doc").alias(id_col), "score")
