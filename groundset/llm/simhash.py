"""Near duplicates by 64-bit similarity fingerprints, found through pigeonring chains of segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundset.llm.components import components
from groundset.llm.tables import carried, restored, written

#: Words of a shingle, seed of its hash, and differing bits up to which two fingerprints link.
SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Segments of the ring as (first bit, width), one more than MAX_BITS: a chain then begins with an equal one.
RING = ((0, 21), (21, 21), (42, 22))
BLOCK = 1_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _blocks(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in parts, so that a long text never stands in memory as a list of words."""
    start = 0
    while start < len(raw):
        end = start + BLOCK
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        yield raw[start:end].split()
        start = end


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text in order, in parts; a text of fewer words is one shingle, none has none."""
    carry, some = [], False
    digest = xxhash.xxh64_intdigest
    for words in _blocks((text or "").encode().translate(_LOWER)):
        words = carry + words
        if len(words) < shingle:
            carry = words
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - shingle + 1]
        spans = zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
        yield np.array([digest(line[a:b], seed) for a, b in spans], np.uint64)
        carry, some = words[len(words) - shingle + 1 :], True
    if carry and not some:
        yield np.array([digest(b" ".join(carry), seed)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text as a signed 64-bit number; 0 without words."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, shingle, seed):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    over = np.packbits(ones * 2 > total, bitorder="little")
    return int(over.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, _text (hash of the text) and fingerprint (long); written, as it is read several times.

    Null and empty texts have fingerprint 0. One pass without a shuffle.
    """
    fields = [
        T.StructField(id_col, docs.schema[id_col].dataType),
        T.StructField("_text", T.LongType()),
        T.StructField("fingerprint", T.LongType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t) for t in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array(values, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    own = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(id_col, F.xxhash64(own).alias("_text"), own.alias("_own"))
    return written(rows.mapInArrow(run, T.StructType(fields)), "fingerprints")


def _segment(value: Column, ring: int) -> Column:
    first, width = RING[ring % len(RING)]
    return F.shiftrightunsigned(value, first).bitwiseAND((1 << width) - 1)


def _chain_key(ring: int, head: Column, second: Column) -> Column:
    """Which segment the chain starts at, that segment and the next one, in one number."""
    return F.shiftleft(F.shiftleft(F.lit(ring).cast("bigint"), 22).bitwiseOR(head), 22).bitwiseOR(second)


def links(values: DataFrame) -> DataFrame:
    """Pairs u < v of different fingerprints (`values`: fingerprint, distinct) within MAX_BITS bits.

    Around a ring of three segments with at most two differing bits there is a start from which the first
    segment has none, the first two have at most one and all three have at most two (the proportional budgets
    0, 1, 2 of a pigeonring chain). So each fingerprint is filed under its segments (s, s + 1) for three
    starts, and looked up under the same segments and each variant with one bit of s + 1 changed. That is an
    equi join on 42 to 43 bits plus the start: a key holds at most 2^22 fingerprints however many documents
    there are, and the join counts the bits of the candidates itself. Rows grow in proportion
    to the fingerprints: 3 filed and 67 looked up for each.
    """
    filed, asked = [], []
    value = F.col("fingerprint")

    def keys_of(changes: Column, ring: int, head: Column, second: Column) -> Column:
        return F.transform(changes, lambda c: _chain_key(ring, head, second.bitwiseXOR(c)))

    for ring in range(len(RING)):
        head, second = _segment(value, ring), _segment(value, ring + 1)
        width = RING[(ring + 1) % len(RING)][1]
        changes = F.array(*[F.lit(m).cast("bigint") for m in (0, *(1 << b for b in range(width)))])
        filed.append(_chain_key(ring, head, second))
        asked.append(keys_of(changes, ring, head, second))
    stored = values.select(value.alias("v"), F.explode(F.array(*filed)).alias("_key"))
    wanted = values.select(value.alias("u"), F.explode(F.concat(*asked)).alias("_key"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)
    return wanted.join(stored, (wanted["_key"] == stored["_key"]) & near).select("u", "v").distinct()


def grouped(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per distinct fingerprint: fingerprint, _group (least fingerprint of its component), component_id."""
    nodes = written(prints.groupBy("fingerprint").agg(F.min(id_col).alias("_least")), "nodes")
    parts = components(links(nodes.select("fingerprint")))
    placed = nodes.join(parts, nodes["fingerprint"] == parts["node"], "left").select(
        "fingerprint", "_least", F.coalesce("component", "fingerprint").alias("_group")
    )
    ids = placed.groupBy("_group").agg(F.min("_least").alias("component_id"))
    return written(placed.join(ids, "_group").select("fingerprint", "_group", "component_id"), "groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: the id, _text, fingerprint (long), _group, component_id (least id of its component).

    Equal fingerprints are one node of the graph, so copies cost nothing beyond the first. Null ids count for
    component_id only where a component has no other, which then is null. Repeated rows appear each.
    """
    prints = fingerprints(docs, id_col, text_col)
    return prints.join(grouped(prints, id_col), "fingerprint").select(
        id_col, "_text", "fingerprint", "_group", "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component: the one of the least id; columns as they were."""
    return first_of_each(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)


def first_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each _group of `found` (the id, _text, _group, component_id): the one of the least id."""
    first = Window.partitionBy("_group").orderBy(F.col(id_col).asc_nulls_last(), "_text")
    stay = (
        found.where(F.col(id_col).eqNullSafe(F.col("component_id")))
        .withColumn("_nth", F.row_number().over(first))
        .where("_nth = 1")
        .select(F.col(id_col).alias("_stay"), F.col("_text").alias("_stay_text"))
        .distinct()
    )
    own = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keyed = carried(docs, id_col, text_col).withColumn("_own_text", own)
    same = F.col(id_col).eqNullSafe(F.col("_stay")) & (F.col("_own_text") == F.col("_stay_text"))
    once = Window.partitionBy("_stay", "_stay_text").orderBy(F.lit(0))
    once_each = keyed.join(stay, same).withColumn("_nth", F.row_number().over(once)).where("_nth = 1")
    return restored(once_each, docs, id_col, text_col)
