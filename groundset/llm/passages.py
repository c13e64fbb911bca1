"""Repeated passages inside documents: MinHash banding of short paragraphs at every word, exact Jaccard, components.

Passages are set into other text at any word, so lines are no units that two documents share. A paragraph here is
WORDS words from any word on. Of PER shingles each, two paragraphs reach Jaccard 0.8 if and only if all but one are
common (15 of 17 are 0.88, 14 of 18 are 0.78), and what they have in common stands together: a half, which is all
shingles but the last or all but the first, of one is a half of the other. The least shingle hash of each half is its
band; equal halves always share it, and the halves themselves are compared then. So no position is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundset.llm.components import components
from groundset.llm.tables import dropped, written

#: Words of a shingle, words of a paragraph.
SHINGLE, WORDS = 5, 20
#: Shingles of a paragraph and of a half, and bands of a paragraph: its two halves.
PER = WORDS - SHINGLE + 1
HALF, BANDS = PER - 1, 2
#: Stands for a null id, after all others.
NO_ID = 2**63 - 1
#: Texts taken from a batch at once, and their bytes unless it is one text: they bound memory, not results.
SLICE, SLICE_BYTES = 256, 2_000_000
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FACTORS = np.random.default_rng(5).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(words: list[bytes]) -> np.ndarray:
    """A hash of each shingle, made of the hashes of its words, as each word is part of several."""
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    many = len(words) - SHINGLE + 1
    hashes = np.zeros(many, np.uint64)
    for j in range(SHINGLE):
        hashes += own[j : j + many] * _FACTORS[j]
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _FACTORS[PER + 1]
    return hashes ^ (hashes >> np.uint64(29))


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value, the first of equal ones, in each window of `width` values; windows double."""
    place, least, wide = np.arange(len(values)), values, 1
    while wide < width:
        step = min(wide, width - wide)
        later = least[step:] < least[:-step]
        place = np.where(later, place[step:], place[:-step])
        least = np.where(later, least[step:], least[:-step])
        wide += step
    return place


def _banded(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per half (one from each shingle on): its hash, its band key and the place of the shingle that gives the key."""
    many = max(0, len(hashes) - HALF + 1)
    half = np.zeros(many, np.uint64)
    for j in range(HALF):
        half += hashes[j : j + many] * _FACTORS[j]
    mixed = (hashes ^ (hashes >> np.uint64(29))) * _FACTORS[PER]
    place = _least_places(mixed, HALF)
    return half.view(np.int64), mixed[place].view(np.int64), place


def _words(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts in lower case, the number of their text, and where they begin and end in it (characters)."""
    own = [(t or "").encode() for t in texts]
    raw = b"\n".join(own)
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~_BLANK[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edge[::2], edge[1::2]
    starts = np.cumsum([0, *(len(r) + 1 for r in own[:-1])])
    text = np.searchsorted(starts, begins, "right") - 1
    if not raw.isascii():
        # Bytes that continue a character don't count as characters.
        shift = np.append(0, np.cumsum((data & 0xC0) == 0x80))
        begins, ends, starts = (at - shift[at] for at in (begins, ends, starts))
    return raw.translate(_LOWER).split(), text, begins - starts[text], ends - starts[text]


def paragraphs_of(text: str | None) -> tuple[np.ndarray, ...]:
    """Start and end (characters), head, tail and band keys of the paragraph at every word of a text, in order.

    Head and tail are hashes of all shingles but the last and all but the first: the two halves.
    """
    words, _, begins, ends = _words([text])
    if len(words) < WORDS:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros((0, BANDS), np.int64))
    half, key, _ = _banded(_shingles(words))
    keys = np.stack([key[:-1], key[1:]], axis=1)
    return begins[: len(keys)], ends[WORDS - 1 :], half[:-1], half[1:], keys


def stretches_of(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """The halves of texts, in stretches of neighbours whose key comes from one shingle.

    First the number of the text, the number of the first half in it, the key and the size of each stretch, then hash,
    start and end (characters) of each half, stretch by stretch. The texts are hashed as one line of words; halves that
    reach into the next text are none.
    """
    words, text, begins, ends = _words(texts)
    if len(words) < WORDS:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    half, key, place = _banded(_shingles(words))
    many = np.bincount(text, minlength=len(texts))
    ahead = HALF + SHINGLE - 2
    at = np.flatnonzero((text[: len(half)] == text[ahead:]) & (many >= WORDS)[text[: len(half)]])
    first = np.flatnonzero(np.diff(place[at], prepend=-1))
    of = text[at[first]]
    number = at[first] - (np.cumsum(many) - many)[of]
    sizes = np.diff(first, append=len(at))
    return of, number, key[at[first]], sizes, half[at], begins[at], ends[at + ahead]


def _slices(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, ...]]]:
    """Rows with the stretches of their texts, some rows at a time."""
    sizes = pa.compute.binary_length(batch.column(text_at)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(batch):
        fit = np.searchsorted(ends, ends[at] - sizes[at] + SLICE_BYTES, "right") - at
        part = batch.slice(at, min(max(int(fit), 1), SLICE))
        found = stretches_of(part.column(text_at).to_pylist())
        if len(found[0]):
            yield part, found
        at += len(part)


def _asked(shared: pa.ListArray, of: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which stretches have a key that is among the shared ones of their own text."""
    wanted = shared.flatten().to_numpy()
    if not len(wanted):
        return np.zeros(len(key), bool)
    row = np.repeat(np.arange(len(shared)), pa.compute.list_value_length(shared).to_numpy(zero_copy_only=False))
    known, place = np.unique(wanted, return_inverse=True)
    mine = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return (known[mine] == key) & np.isin(mine * len(shared) + of, place * len(shared) + row)


def _lists(values: np.ndarray, kind: pa.DataType, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text (hash of the text) and _own (the text)."""
    own = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own_id = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID))
    return docs.select(own_id.alias("_id"), F.xxhash64(own).alias("_text"), own.alias("_own"))


def shared_keys(named: DataFrame) -> DataFrame:
    """Per distinct text that has any: _text, its least and greatest document and _shared, those of its band keys that
    stand in two documents or more; written. Copies of a text count once from here on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, (of, _, key, *_) in _slices(batch, 2):
                order = np.lexsort((key, of))
                of, key = of[order], key[order]
                new = (np.diff(of, prepend=-1) != 0) | (np.diff(key, prepend=0) != 0)
                sizes = np.bincount(of[new])
                own = np.flatnonzero(sizes)
                keys = _lists(key[new], pa.int64(), sizes[own])
                told = [rows.column(k).take(pa.array(own)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*told, keys], names=["_id", "_text", "_keys"])

    filed = named.mapInArrow(run, "_id long, _text long, _keys array<long>")
    texts = filed.groupBy("_text").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high"), F.first("_keys").alias("_keys"))
    texts = written(texts, "texts")
    each = texts.select("_text", "_low", "_high", F.explode("_keys").alias("_key"))
    several = each.groupBy("_key").agg(F.min("_low").alias("_p"), F.max("_high").alias("_q")).where("_p <> _q")
    several = written(several.select("_key"), "several")
    met = each.select("_text", "_key").join(several, "_key", "left_semi").groupBy("_text").agg(F.collect_list("_key").alias("_shared"))
    shared = written(met.join(texts.select("_text", "_low", "_high"), "_text"), "shared_keys")
    dropped(texts, several)
    return shared


def shared_stretches(named: DataFrame) -> DataFrame:
    """Stretches of halves whose key stands in two documents or more, once for each distinct text; written.

    Columns: _text, _low, _high, _at (number of the first half), _key, _same (hash of all halves), and arrays _halves,
    _start, _end. Null, empty and short texts have none. The texts are taken apart a second time, as they
    are smaller than their stretches, most of which are of no further use.
    """
    names = ["_text", "_low", "_high", "_at", "_key", "_halves", "_start", "_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, (of, number, key, sizes, *halves) in _slices(batch, 4):
                asked = _asked(rows.column(3), of, key)
                if not asked.any():
                    continue
                within = np.repeat(asked, sizes)
                of, sizes = pa.array(of[asked]), sizes[asked]
                flat = [pa.array(number[asked], pa.int32()), pa.array(key[asked], pa.int64())]
                kinds = (pa.int64(), pa.int32(), pa.int32())
                lists = [_lists(h[within], t, sizes) for h, t in zip(halves, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(k).take(of) for k in range(3)] + flat + lists, names=names)

    schema = "_text long, _low long, _high long, _at int, _key long, _halves array<long>, _start array<int>, _end array<int>"
    shared = shared_keys(named)
    asked = named.select("_text", "_own").join(shared, "_text").dropDuplicates(["_text"])
    found = asked.select("_text", "_low", "_high", "_shared", "_own").mapInArrow(run, schema)
    stretches = written(found.withColumn("_same", F.xxhash64("_halves")), "stretches")
    dropped(shared)
    return stretches


def repeated_pieces(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbouring halves that stand in two documents or more, by kind of stretch; and which pieces share a half.

    First _key, _same, _node (name of the piece), _from, _to (places in the stretch); written. Then pairs u, v of names.
    Equal stretches are one kind. A key with one kind needs no look at its halves: all of them stand where the kind does.
    """
    own = ["_key", "_same"]
    kinds = found.groupBy(*own).agg(
        F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.max(F.size("_halves") - 1).alias("_to")
    )
    kinds = written(kinds, "kinds")
    mixed = kinds.groupBy("_key").agg(F.count(F.lit(1)).alias("_kinds"), F.max(F.struct("_same", "_to")).alias("_k"))
    mixed = written(mixed, "mixed")
    alone = mixed.where("_kinds = 1").select(
        "_key", "_k._same", F.xxhash64("_key", "_k._same").alias("_node"), F.lit(0).alias("_from"), "_k._to"
    )
    several = mixed.where("_kinds > 1").select("_key")
    lists = found.select(*own, "_halves").join(several, "_key", "left_semi").dropDuplicates(own)
    lists = written(kinds.select(*own, "_low", "_high").join(lists, own), "lists")
    each = lists.select(*own, "_low", "_high", F.posexplode("_halves").alias("_i", "_half"))
    met = each.groupBy("_key", "_half").agg(F.min("_low").alias("_p"), F.max("_high").alias("_q")).where("_p <> _q")
    halves = each.select(*own, "_i", "_half").join(met.select("_key", "_half"), ["_key", "_half"], "left_semi")
    gap = F.col("_i") - F.row_number().over(Window.partitionBy(*own).orderBy("_i"))
    least = F.min(F.xxhash64("_key", "_half")).over(Window.partitionBy(*own, "_gap"))
    placed = written(halves.withColumn("_gap", gap).withColumn("_node", least), "in_pieces")
    pieces = placed.groupBy(*own, "_gap", "_node").agg(F.min("_i").alias("_from"), F.max("_i").alias("_to"))
    shared = placed.groupBy("_key", "_half").agg(F.min("_node").alias("v"), F.max("_node").alias("_q")).where("v <> _q")
    links = placed.join(shared.select("_key", "_half", "v"), ["_key", "_half"]).select(F.col("_node").alias("u"), "v")
    pieces = written(alone.unionByName(pieces.drop("_gap")), "pieces")
    dropped(kinds, mixed, lists)
    return pieces, links


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every longest run of words of which each half stands in another document too.

    Columns: the id, start, end (characters), keep_id (least id of its component), removed (not in that
    document), component. Halves that overlap in a run are similar paragraphs, so a run is in one component, and runs
    that share a half are linked. An empty table, or one of null and short texts, gives no rows. A null id is one
    document of its own, after all others; its rows, and rows that repeat an id, give their runs each.
    """
    named = _named(docs, id_col, text_col)
    found = shared_stretches(named)
    pieces, met = repeated_pieces(found)
    at = F.col("_at")
    rows = found.drop("_halves", "_high").join(pieces, ["_key", "_same"]).select(
        "_text", "_low", "_node", (at + F.col("_from")).alias("_from"), (at + F.col("_to")).alias("_to"),
        F.get("_start", F.col("_from")).alias("start"), F.get("_end", F.col("_to")).alias("end"),
    )
    # Pieces that follow each other are one run. A window holds the pieces of one text.
    own = Window.partitionBy("_text").orderBy("_from")
    starts = F.coalesce(F.col("_from") > F.lag("_to").over(own) + 1, F.lit(True))
    rows = rows.withColumn("_run", F.sum(starts.cast("int")).over(own))
    rows = written(rows.withColumn("_top", F.min("_node").over(Window.partitionBy("_text", "_run"))), "in_runs")
    dropped(found, pieces)
    chained = rows.select(F.col("_node").alias("u"), F.col("_top").alias("v"))
    parts = components(met.unionByName(chained).where("u <> v").distinct())
    dropped(met)

    runs = rows.groupBy("_text", "_run", "_low", "_top").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    linked = parts.select(F.col("node").alias("_top"), F.col("component").alias("_part"))
    runs = runs.join(linked, "_top", "left").withColumn("_part", F.coalesce("_part", "_top"))
    runs = written(runs.select("_text", "_low", "start", "end", "_part"), "runs")
    dropped(rows)
    keepers = runs.groupBy("_part").agg(F.min("_low").alias("_keep"))
    back = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return runs.join(keepers, "_part").join(named.select("_id", "_text"), "_text").select(
        back("_id").alias(id_col), "start", "end", back("_keep").alias("keep_id"),
        (F.col("_id") != F.col("_keep")).alias("removed"), F.col("_part").alias("component"),
    )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeated passages: the id, removed, start, end, keep_id; rows that repeat an id and text give each once."""
    return repeated_passages(docs, id_col, text_col).select(id_col, "removed", "start", "end", "keep_id").distinct()
