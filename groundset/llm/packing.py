"""Packing of token pieces into fixed-length sequences: best fit, then exchanges between underfull bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundset.llm import bpe
from groundset.llm.tables import written

SEQUENCE, END_ID = 4096, 1
#: Pieces that one task packs at a time; the number of groups follows from the number of pieces.
GROUP_ROWS = 16_384


def cut_pieces(
    docs: DataFrame,
    path: str | None = None,
    length: int = SEQUENCE,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Per piece: the id, piece, start, length, ids_crc32 and, if asked, ids (array<int>).

    A document is the ids of its text and `end_id`; a null or empty text is `end_id` alone. Only documents
    longer than `length` are cut. Rows that repeat an id are documents of their own; a null id passes through.
    """
    path = path or bpe.default_path()
    kind = docs.schema[id_col].dataType
    fields = [
        T.StructField(id_col, kind),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    end, step = np.array([end_id], "<u4").tobytes(), 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(path)
        for batch in batches:
            of, cuts, crc, ids = [], [], [], []
            for row, body in enumerate(encoder.encode_batch(batch.column(1).to_pylist())):
                body += end
                for k, at in enumerate(range(0, len(body), step)):
                    own = body[at : at + step]
                    of.append(row)
                    cuts.append((k, at // 4, len(own) // 4))
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(own)
            k, at, n = np.array(cuts, np.int64).reshape(-1, 3).T
            columns = [
                batch.column(0).take(pa.array(of, pa.int64())),
                pa.array(k.astype(np.int32)),
                pa.array(at),
                pa.array(n),
                pa.array(crc, pa.int64()),
            ]
            if with_ids:
                ends = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def best_fit(sizes: np.ndarray, room: int) -> list[list[int]]:
    """Bins of item numbers, largest items first, each into the fullest bin that takes it."""
    free: list[list[int]] = [[] for _ in range(room + 1)]
    bins: list[list[int]] = []
    open_rooms = 0  # bit r is set while some bin has r left
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                open_rooms ^= 1 << left
            bins[b].append(i)
        else:
            b, left = len(bins), room
            bins.append([i])
        free[left - size].append(b)
        open_rooms |= 1 << (left - size)
    return bins


def _offers(items: list[int], sizes: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """What a bin could give: one item or two, each combination of sizes once, as (total size, items)."""
    first: dict[int, list[int]] = {}
    for i in items:
        first.setdefault(int(sizes[i]), []).append(i)
    kinds = sorted(first)
    out = [(s, (first[s][0],)) for s in kinds]
    for k, s in enumerate(kinds):
        out += [(s + s2, (first[s][0], first[s2][-1])) for s2 in kinds[k:] if s2 != s or len(first[s]) > 1]
    return out


class _Book:
    """All offers of the underfull bins, sorted by size; a bin without any gives place for a move (size 0)."""

    def __init__(self, bins: list[list[int]], sizes: np.ndarray, live: list[int]):
        self.sizes = sizes
        self.size, self.bin, self.pair = (np.zeros(0, np.int64) for _ in range(3))
        self.items = np.zeros(0, object)
        self.replace(bins, live)

    def replace(self, bins: list[list[int]], changed: list[int]) -> None:
        rows = [(0, b, ()) for b in changed]
        rows += [(s, b, items) for b in changed for s, items in _offers(bins[b], self.sizes)]
        stay = ~np.isin(self.bin, changed)
        names = np.empty(len(rows), object)
        names[:] = [r[2] for r in rows]
        size = np.append(self.size[stay], [r[0] for r in rows])
        order = np.argsort(size, kind="stable")
        self.size = size[order]
        self.bin = np.append(self.bin[stay], [r[1] for r in rows])[order]
        self.pair = np.append(self.pair[stay], [len(r[2]) for r in rows])[order]
        self.items = np.append(self.items[stay], names)[order]


def exchange(bins: list[list[int]], sizes: np.ndarray, room: int) -> list[list[int]]:
    """Empties the least filled bins into the other underfull ones while exchanges raise the squared fill.

    From the bin to be emptied one item moves, or is exchanged for one or two smaller ones, or two are
    exchanged for one; of all such steps the one with the largest gain in squared fill is taken. The sum of
    squares grows with each step, so the search ends; it also ends at the bound of total size by room.
    """
    fill = np.array([int(sizes[b].sum()) for b in bins], np.int64)
    least = -(-int(sizes.sum()) // room)
    live, book = len(bins), None
    for target in np.argsort(fill, kind="stable").tolist():
        if live <= least:
            break
        open_bins = (fill > 0) & (fill < room)
        open_bins[target] = False
        # Without room for its items elsewhere a bin can't be emptied.
        if int((room - fill[open_bins]).sum()) < fill[target]:
            continue
        book = book or _Book(bins, sizes, np.flatnonzero((fill > 0) & (fill < room)).tolist())
        while bins[target]:
            widest = int((room - fill[open_bins]).max(initial=0))
            best = (0, 0, -1, ())
            for x, own in _offers(bins[target], sizes):
                low, high = np.searchsorted(book.size, (x - widest, x))
                of, shift = book.bin[low:high], x - book.size[low:high]
                ok = (of != target) & (shift <= room - fill[of]) & (fill[of] > 0)
                if len(own) == 2:
                    ok &= book.pair[low:high] == 1
                gain = np.where(ok, 2 * shift * (fill[of] - fill[target] + shift), 0)
                if len(gain) and (g := int(gain.max())) > best[0]:
                    best = (g, x, low + int(gain.argmax()), own)
            gain, x, at, own = best
            if gain <= 0:
                break
            b, taken, shift = int(book.bin[at]), book.items[at], x - int(book.size[at])
            for i in own:
                bins[target].remove(i)
            for i in taken:
                bins[b].remove(i)
            bins[b] += own
            bins[target] += taken
            fill[b] += shift
            fill[target] -= shift
            open_bins[b] = fill[b] < room
            book.replace(bins, [b, target])
        live -= not bins[target]
    return [b for b in bins if b]


def pack_lengths(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per item its bin, its offset there and the bin's fill."""
    bins = exchange(best_fit(sizes, room), sizes, room)
    bin_of, offset, fill = (np.zeros(len(sizes), np.int64) for _ in range(3))
    for b, items in enumerate(bins):
        ends = np.cumsum(sizes[items])
        bin_of[items], offset[items], fill[items] = b, ends - sizes[items], ends[-1]
    return bin_of, offset, fill


def _packed(pieces: DataFrame, room: int, groups: int, first: int) -> DataFrame:
    """Packs `pieces` in `groups` groups dealt by the hash of the row; sequence ids start at `first` << 32."""
    names = [c for c in pieces.columns if c != "_row"]
    fields = [
        *pieces.schema.fields,
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("_fill", T.LongType()),
    ]
    order = [f.name for f in fields]

    def run(table: pa.Table) -> pa.Table:
        # In a fixed order, so that a lost task comes to the same bins again.
        table = table.sort_by("_row")
        group = table.column("_group")[0].as_py()
        bin_of, offset, fill = pack_lengths(table.column("length").to_numpy(), room)
        out = table.drop(["_group"])
        for name, values in (("sequence_id", bin_of + ((first + group) << 32)), ("offset", offset), ("_fill", fill)):
            out = out.append_column(name, pa.array(values))
        return out.select(order)

    dealt = pieces.select(*names, "_row", F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("_group"))
    return dealt.groupBy("_group").applyInArrow(run, T.StructType(fields))


def pack(pieces: DataFrame, room: int = SEQUENCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """`pieces` (with a `length` from 1 to `room`) with sequence_id and offset; every row is placed.

    Pieces are packed in groups of about `group_rows`; what the groups leave in bins with more than a
    64th free is packed once more together, in as many groups as that takes. Columns sequence_id and offset of `pieces` are replaced.
    """
    base = pieces.drop("sequence_id", "offset", "_fill", "_group", "_row")
    table = written(base.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-table.count() // group_rows))
    if groups == 1:
        return _packed(table, room, 1, 0).drop("_row", "_fill")
    once = written(_packed(table, room, groups, 0), "packed")
    short = F.col("_fill") < room - room // 64
    rest = once.where(short).drop("sequence_id", "offset", "_fill")
    more = max(1, -(-rest.count() // group_rows))
    again = _packed(rest, room, more, groups)
    return once.where(~short).unionByName(again).drop("_row", "_fill")
