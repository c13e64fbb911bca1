"""Alignment of two tokenizers over a corpus: pair counts as dense vectors indexed by a minimal perfect hash.

Both tokenizers end a token before a space that follows a character other than white space, so a text is
cut there and every distinct chunk is aligned once per worker. A first pass counts pairs per task. Distinct
pairs are dealt into buckets, each with a minimal perfect hash of its own; counts become vectors indexed by it, summed
as a tree. A second pass aligns the texts again and looks counts up, the keys beside them verified.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundset.llm.bpe import PLAIN, _byte_chars
from groundset.llm.tables import written

#: Pairs of a bucket, vectors summed at once, and bytes of the table that one look-up pass broadcasts.
BUCKET_PAIRS, FAN_IN, LOOK_UP_BYTES = 32_768, 8, 32_000_000
#: Chunks kept by a worker, longest chunk kept, characters taken at once, pairs counted before they are handed on.
CACHED_CHUNKS, CACHED_LENGTH, BLOCK, HELD_PAIRS = 300_000, 48, 4_000_000, 1_000_000
#: Chunks encoded at once.
RUN = 256
#: A space after a character that no tokenizer takes for white space.
_CUT, _OTHER = re.compile(r"(?<=\S) "), re.compile(r"\s ")


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """Non-negative hashes of 62 bits, one to one before the last shift."""
    x = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(2)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct numbers: levels of bits, in which a key that meets no other sets its own.

    A key's slot is the number of set bits before its bit, so slots are gapless from 0. Keys that met go on to the next level.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int32) - 1

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, rest = [], [], keys
        while len(rest):
            sizes.append(2 * len(rest))
            place = _mixed(rest, len(sizes)) % sizes[-1]
            levels.append(np.bincount(place, minlength=sizes[-1]) == 1)
            rest = rest[~levels[-1][place]]
        return cls(sizes, np.concatenate([np.zeros(0, bool), *levels]))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys it was made of; any slot or -1 for others."""
        out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes, 1):
            at = _mixed(keys[todo], level) % size + base
            hit = self.bits[at]
            out[todo[hit]] = self.rank[at[hit]]
            todo, base = todo[~hit], base + size
        return out

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def unpacked(cls, sizes: list[int], raw: bytes) -> PerfectHash:
        return cls(list(sizes), np.unpackbits(np.frombuffer(raw, np.uint8), count=sum(sizes)).astype(bool))


class Counts:
    """Buckets of a pair table: perfect hash, keys by slot, counts by slot; and the highest count per B id."""

    def __init__(self, buckets: int, rows: list[tuple], best: np.ndarray, width: int):
        self.buckets, self.best, self.width = buckets, best, width
        self.of = {
            b: (PerfectHash.unpacked(sizes, bits), np.frombuffer(keys, "<i8"), np.frombuffer(counts, "<i8"))
            for b, sizes, bits, keys, counts in rows
        }

    def look_up(self, pairs: np.ndarray) -> np.ndarray:
        """The count of each pair; 0 where a pair isn't in these buckets."""
        out = np.zeros(len(pairs), np.int64)
        bucket = _mixed(pairs, 0) % self.buckets
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(pairs) else []
        for at in np.split(order, cuts[1:]) if len(pairs) else []:
            if (own := self.of.get(int(bucket[at[0]]))) is None:
                continue
            finder, keys, counts = own
            slot = finder.slots(pairs[at])
            if (slot < 0).any() or (keys[slot] != pairs[at]).any():
                raise ValueError("a pair was not seen by the first pass")
            out[at] = counts[slot]
        return out

    def is_best(self, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts == self.best[pairs % self.width]


class Aligner:
    """Aligns texts as two tokenizers see them; built once per Python worker by `load`."""

    def __init__(self, a_path: str, b_path: str, writes: bool = True):
        """`writes` is whether groups are written out, which only the second pass needs."""
        self.writes = writes
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: k for k, c in (_byte_chars() | {10: chr(266)}).items()}
        vocab = {token: bytes(byte_of[c] for c in token) for token in self.a.get_vocab(with_added_tokens=False)}
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, spelt in vocab.items():
            self.a_bytes[self.a.token_to_id(token)] = spelt
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        # A space inside a piece would join what the cut parts.
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces that go on after a space can't be aligned by chunks")
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        self.width = len(pieces)
        #: Written ids of A before a comma, of A before a bar, of B before a comma, of B at the end of a group.
        sizes = (len(self.a_bytes), len(self.a_bytes), self.width, self.width)
        self.written = [f"{i}{end}" for n, end in zip(sizes, ",|,;", strict=True) for i in range(n)]
        self.starts = np.cumsum([0, *sizes])
        self.fast = self._by_rank(a_path)
        self.beyond = re.compile(f"[^{PLAIN}]")
        self.young: dict[str, tuple[int, int, int, str, bytes]] = {}
        self.old: dict[str, tuple[int, int, int, str, bytes]] = {}

    def _by_rank(self, a_path: str) -> Any:
        """A faster encoder of the same vocabulary, where ids follow the order of the merges; else None."""
        import public_tokenizers
        import tiktoken

        model = json.load(open(a_path, encoding="utf-8"))["model"]  # noqa: SIM115
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if [model["vocab"][x + y] for x, y in merges] != [*range(256, 256 + len(merges))]:
            return None
        ranks = {self.a_bytes[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("by_rank", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def chunks(self, text: str) -> list[str]:
        """What stands between the cuts of a text, the space before each left out."""
        return _CUT.split(text) if text[0] == " " or _OTHER.search(text) else text.split(" ")

    def _ids_a(self, text: str) -> list[int]:
        # Beyond the plain characters the two encoders could know different versions of Unicode.
        if self.fast and not self.beyond.search(text):
            return self.fast.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def _aligned(self, chunks: list[str]) -> list[tuple[int, int, int, str, bytes]]:
        """Per chunk: tokens of A and of B, groups, the groups written out, its pairs; n_a is -1 where bytes differ.

        Chunks that don't end in white space are encoded joined, as they would be inside a text.
        """
        out: dict[str, tuple[int, int, int, str, bytes]] = {}
        closed = [c for c in chunks if c and not c[-1].isspace()]
        runs = [closed[k : k + RUN] for k in range(0, len(closed), RUN)]
        for run, b in zip(runs, self.b.encode([" ".join(r) for r in runs], num_threads=1), strict=True):
            joined = " " + " ".join(run)
            a, raw = self._ids_a(joined), joined.encode()
            if self._spell(a, self.a_bytes) == raw == self._spell(b, self.b_bytes):
                ends = np.cumsum([len(c.encode()) + 1 for c in run])
                out.update(zip(run, self._cut(a, b, ends), strict=True))
        for c in chunks:
            if c not in out:
                # Behind a line feed, which is a token of its own, no space is added.
                a, b, raw = self._ids_a(" " + c), self.b.encode(f"\n {c}")[2:], f" {c}".encode()
                same = self._spell(a, self.a_bytes) == raw == self._spell(b, self.b_bytes)
                out[c] = self._cut(a, b, np.array([len(raw)]))[0] if same else (-1, 0, 0, "", b"")
        return [out[c] for c in chunks]

    @staticmethod
    def _spell(ids: list[int], spelt: list[bytes]) -> bytes:
        return b"".join(map(spelt.__getitem__, ids))

    def _cut(self, a: list[int], b: list[int], ends: np.ndarray) -> list[tuple[int, int, int, str, bytes]]:
        """What `_aligned` gives, for chunks of one run of tokens that end at the bytes `ends`."""
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        at = np.minimum(np.searchsorted(ends_b, ends_a), len(b) - 1)
        last_a = np.flatnonzero(ends_b[at] == ends_a)
        last_b = at[last_a]
        if not np.isin(ends, ends_a[last_a]).all():
            raise ValueError("a token goes beyond its chunk")
        pairs = (a[last_a] * self.width + b[last_b]).astype("<i8").tobytes()
        n_a, n_b, n = (np.searchsorted(x, ends) + 1 for x in (ends_a, ends_b, ends_a[last_a]))
        cuts = zip(n_a.tolist(), n_b.tolist(), n.tolist(), strict=True)
        i = j = k = 0
        out = []
        if not self.writes:
            for i2, j2, k2 in cuts:
                out.append((i2 - i, j2 - j, k2 - k, "", pairs[8 * k : 8 * k2]))
                i, j, k = i2, j2, k2
            return out
        # All ids in the order they are written in: each group's of A, then its of B.
        group_a = np.searchsorted(last_a, np.arange(len(a)))
        group_b = np.searchsorted(last_b, np.arange(len(b)))
        order = np.empty(len(a) + len(b), np.int64)
        closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        closes_a[last_a] = closes_b[last_b] = 1
        order[np.arange(len(a)) + np.append(0, last_b + 1)[group_a]] = self.starts[closes_a] + a
        order[np.arange(len(b)) + last_a[group_b] + 1] = self.starts[2 + closes_b] + b
        shown = [*map(self.written.__getitem__, order.tolist())]
        for i2, j2, k2 in cuts:
            out.append((i2 - i, j2 - j, k2 - k, "".join(shown[i + j : i2 + j2]), pairs[8 * k : 8 * k2]))
            i, j, k = i2, j2, k2
        return out

    def records(self, chunks: list[str]) -> list[tuple[int, int, int, str, bytes]]:
        """`_aligned` of distinct chunks through the worker's cache of two generations.

        Once the young one is full it becomes the old one; what is met again moves back, so frequent chunks stay.
        """
        young, old = self.young, self.old
        if len(young) > CACHED_CHUNKS // 2:
            young, old = self.young, self.old = {}, young
        missing = [c for c in chunks if c not in young and c not in old]
        new = dict(zip(missing, self._aligned(missing), strict=True))
        out = [young.get(c) or new.get(c) or old[c] for c in chunks]
        for c, record in zip(chunks, out, strict=True):
            if len(c) <= CACHED_LENGTH:
                young[c] = record
        return out

    def blocks(self, texts: Iterable[str | None]) -> Iterator[Block]:
        """The texts in order, in blocks of whole texts."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(self.chunks(text) if text else [])
            size += len(text or "")
            if size > BLOCK:
                yield Block(self, held)
                held, size = [], 0
        if held:
            yield Block(self, held)


class Block:
    """Some texts as numbers of the distinct chunks they consist of, and what is known of each chunk."""

    def __init__(self, aligner: Aligner, texts: list[list[str]]):
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        size = sum(map(len, texts))
        self.of = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, size)
        self.ends = np.cumsum([0, *map(len, texts)])
        # A collection would walk over all records for nothing: they hold no references in a circle.
        collects = gc.isenabled()
        gc.disable()
        try:
            records = aligner.records(list(number))
        finally:
            if collects:
                gc.enable()
        n_a, n_b, n_groups, self.groups, raw = zip(*records, strict=True) if records else ((),) * 5
        self.n_a, self.n_b, self.n_groups = (np.array(x, np.int64) for x in (n_a, n_b, n_groups))
        self.pairs = np.frombuffer(b"".join(raw), "<i8")
        self.chunk_of_pair = np.repeat(np.arange(len(raw)), [len(r) // 8 for r in raw])
        # A text with one chunk whose bytes differ has no tokens at all.
        self.sound = (self.by_text(self.n_a < 0) == 0) & (np.diff(self.ends) > 0)

    def by_text(self, of_chunks: np.ndarray) -> np.ndarray:
        """Sums over the chunks of each text."""
        sums = np.append(0, np.cumsum(of_chunks.astype(np.int64)[self.of]))
        return sums[self.ends[1:]] - sums[self.ends[:-1]]

    def by_chunk(self, of_pairs: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(of_pairs.astype(np.int64)))
        cuts = np.searchsorted(self.chunk_of_pair, np.arange(len(self.n_a) + 1))
        return sums[cuts[1:]] - sums[cuts[:-1]]

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of the sound texts and how often they are linked."""
        rows = np.repeat(self.sound, np.diff(self.ends))
        times = np.bincount(self.of[rows], minlength=len(self.n_a))[self.chunk_of_pair]
        pairs, at = np.unique(self.pairs[times > 0], return_inverse=True)
        return pairs, np.bincount(at, times[times > 0], len(pairs)).astype(np.int64)

    def digests(self) -> list[str]:
        out, of = [], self.of.tolist()
        for ok, a, b in zip(self.sound.tolist(), self.ends.tolist(), self.ends[1:].tolist(), strict=False):
            joined = "".join(map(self.groups.__getitem__, of[a:b])) if ok else ""
            out.append(hashlib.sha256(joined[:-1].encode()).hexdigest() if ok else "")
        return out


@lru_cache(maxsize=2)
def load(a_path: str, b_path: str, writes: bool = True) -> Aligner:
    return Aligner(a_path, b_path, writes)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pairs, at = np.unique(np.append(a[0], b[0]), return_inverse=True)
    return pairs, np.bincount(at, np.append(a[1], b[1]), len(pairs)).astype(np.int64)


def pair_parts(docs: DataFrame, paths: tuple[str, str], text_col: str = "text") -> DataFrame:
    """First pass, written: _part (the task), pair (A id * size of B + B id), _hash, n (links of the task)."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("pair", "_hash", "n")])

    def batch_of(counted: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array(x) for x in (counted[0], _mixed(counted[0], 0), counted[1])]
        return pa.RecordBatch.from_arrays(columns, names=["pair", "_hash", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(*paths, writes=False)
        none = np.zeros(0, np.int64)
        counted, new, size = (none, none), [], 0
        for batch in batches:
            for block in aligner.blocks(batch.column(0).to_pylist()):
                new.append(block.pair_counts())
                size += len(new[-1][0])
                if size > HELD_PAIRS:
                    counted = _added(counted, tuple(map(np.concatenate, zip(*new, strict=True))))
                    new, size = [], 0
                    if len(counted[0]) > HELD_PAIRS:
                        yield batch_of(counted)
                        counted = (none, none)
        yield batch_of(_added(counted, tuple(map(np.concatenate, zip((none, none), *new, strict=True)))))

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, schema)
    return written(counted.withColumn("_part", F.spark_partition_id()), "pair_parts")


def _hashes(pairs: DataFrame) -> DataFrame:
    """A row per bucket of distinct pairs, written: _bucket, sizes and bits of its perfect hash, keys by slot."""

    def build(table: pa.Table) -> pa.Table:
        keys = table.column("pair").to_numpy()
        made = PerfectHash.of(keys)
        by_slot = np.zeros(len(keys), "<i8")
        by_slot[made.slots(keys)] = keys
        return pa.table(
            {
                "_bucket": table.column("_bucket")[:1],
                "sizes": pa.array([made.sizes], pa.list_(pa.int64())),
                "bits": pa.array([made.packed()], pa.binary()),
                "keys": pa.array([by_slot.tobytes()], pa.binary()),
            }
        )

    schema = "_bucket long, sizes array<long>, bits binary, keys binary"
    return written(pairs.groupBy("_bucket").applyInArrow(build, schema), "pair_hashes")


def _vectors(parts: DataFrame, hashes: DataFrame, buckets: int, deals: int) -> DataFrame:
    """Count vectors by slot of each bucket: one for each deal of tasks, then summed FAN_IN at a time to one."""
    schema = "_bucket long, _deal long, counts binary"

    def fill(key: tuple, rows: pa.Table, hash_row: pa.Table) -> pa.Table:
        r = hash_row.to_pylist()[0]
        made, keys = PerfectHash.unpacked(r["sizes"], r["bits"]), np.frombuffer(r["keys"], "<i8")
        pairs = rows.column("pair").to_numpy()
        slot = made.slots(pairs)
        if (keys[slot] != pairs).any():
            raise ValueError("a pair is not in its bucket's table")
        vector = np.zeros(len(keys), "<i8")
        np.add.at(vector, slot, rows.column("n").to_numpy())
        return pa.table(_cells(key[0].as_py(), key[1].as_py(), vector))

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Any = 0
        for batch in rows:
            for raw in batch.column("counts"):
                total = total + np.frombuffer(raw.as_buffer(), "<i8")
        yield pa.RecordBatch.from_pydict(_cells(key[0].as_py(), key[1].as_py(), total))

    def _cells(bucket: int, deal: int, vector: np.ndarray) -> dict:
        values = ([bucket], pa.int64()), ([deal], pa.int64()), ([vector.astype("<i8").tobytes()], pa.binary())
        return dict(zip(("_bucket", "_deal", "counts"), (pa.array(v, k) for v, k in values), strict=True))

    dealt = parts.select(
        F.pmod("_hash", F.lit(buckets)).alias("_bucket"), F.pmod("_part", F.lit(deals)).cast("long").alias("_deal"), "pair", "n"
    )
    copies = hashes.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
    filled = dealt.groupBy("_bucket", "_deal").cogroup(copies.groupBy("_bucket", "_deal"))
    vectors = filled.applyInArrow(lambda key, a, b: fill(key, a, b) if len(a) else pa.table(_none()), schema)
    while deals > 1:
        deals = -(-deals // FAN_IN)
        vectors = vectors.withColumn("_deal", F.expr(f"_deal div {FAN_IN}")).groupBy("_bucket", "_deal").applyInArrow(add, schema)
    return vectors.drop("_deal")


def _none() -> dict:
    return {"_bucket": pa.array([], pa.int64()), "_deal": pa.array([], pa.int64()), "counts": pa.array([], pa.binary())}


def pair_counts(docs: DataFrame, paths: tuple[str, str] | None = None, text_col: str = "text") -> tuple[DataFrame, int]:
    """Corpus-wide counts as a written row per bucket (_bucket, sizes, bits, keys, counts), and the number of buckets.

    Buckets hold about BUCKET_PAIRS pairs each, so a row stays under a megabyte however many pairs there are.
    """
    parts = pair_parts(docs, paths or default_paths(), text_col)
    pairs = written(parts.groupBy("pair").agg(F.first("_hash").alias("_hash")), "pairs")
    distinct, rows = pairs.count(), parts.count()
    buckets = max(1, -(-distinct // BUCKET_PAIRS))
    hashes = _hashes(pairs.select("pair", F.pmod("_hash", F.lit(buckets)).alias("_bucket")))
    # As many vectors as make them no larger together than the rows they are filled from.
    vectors = _vectors(parts, hashes, buckets, max(1, -(-rows // max(distinct, 1))))
    return written(hashes.join(vectors, "_bucket"), "pair_counts"), buckets


def highest_counts(counts: DataFrame, width: int) -> np.ndarray:
    """The highest count of each B id: `width` numbers at most, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(width, np.int64)
        for batch in batches:
            for keys, n in zip(batch.column(0), batch.column(1), strict=True):
                np.maximum.at(best, np.frombuffer(keys.as_buffer(), "<i8") % width, np.frombuffer(n.as_buffer(), "<i8"))
        some = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(best[some])], names=["b", "n"])

    best = np.zeros(width, np.int64)
    found = counts.select("keys", "counts").mapInArrow(run, "b long, n long")
    for r in found.groupBy("b").agg(F.max("n").alias("n")).collect():
        best[r["b"]] = r["n"]
    return best


def _loads(counts: DataFrame, most: int) -> list[list[int]]:
    """Bucket numbers in groups whose rows fit into `most` bytes together."""
    size = F.octet_length("bits") + F.octet_length("keys") + F.octet_length("counts")
    out: list[list[int]] = [[]]
    held = 0
    for r in counts.select("_bucket", size.alias("n")).orderBy("_bucket").collect():  # one small row a bucket
        if out[-1] and held + r["n"] > most:
            out.append([])
            held = 0
        out[-1].append(r["_bucket"])
        held += r["n"]
    return out


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None
) -> DataFrame:
    """Per row: the id, n_a, n_b, n_groups, n_links, n_best, count_sum (longs) and groups_sha256.

    Null and empty texts, and those whose tokens don't spell a space and the text, have zeros and ''. Rows
    that repeat an id are texts of their own, null ids pass through, other columns are dropped. An empty table
    gives no rows. The look-up table is broadcast in loads of LOOK_UP_BYTES; with one load, as nearly always, the
    second pass gives the rows at once, else it writes each text's pairs and every load adds what it knows of them.
    """
    paths = paths or default_paths()
    counts, buckets = pair_counts(docs, paths, text_col)
    width = load(*paths).width
    best = highest_counts(counts, width)
    loads = _loads(counts, LOOK_UP_BYTES)
    kind = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), *[T.StructField(c, T.LongType()) for c in ALIGNED[:-1]]]
    fields.append(T.StructField(ALIGNED[-1], T.StringType()))
    lists = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("_pairs", "_times")]
    rows = docs.select(id_col, F.col(text_col).cast("string"))

    def given(load_: list[int]) -> Any:
        table = counts.where(F.col("_bucket").isin(load_)).select("_bucket", "sizes", "bits", "keys", "counts").collect()
        return docs.sparkSession.sparkContext.broadcast(
            (buckets, [(r[0], list(r[1]), *map(bytes, r[2:])) for r in table], best, width)
        )

    def second(shared: Any, schema: T.StructType) -> Any:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            aligner, table = load(*paths), Counts(*shared.value) if shared else None
            for batch in batches:
                start = 0
                for block in aligner.blocks(batch.column(1).to_pylist()):
                    ok = block.sound
                    sums = [np.where(ok, block.by_text(x), 0) for x in (block.n_a, block.n_b, block.n_groups, block.n_groups)]
                    if table:
                        n = table.look_up(block.pairs)
                        both = block.by_chunk(table.is_best(block.pairs, n)), block.by_chunk(n)
                        sums += [np.where(ok, block.by_text(x), 0) for x in both]
                    else:
                        sums += [np.zeros(len(ok), np.int64)] * 2
                    arrays = [batch.column(0).slice(start, len(ok)), *map(pa.array, sums), pa.array(block.digests(), pa.string())]
                    if not table:
                        arrays += _pair_lists(block)
                    start += len(ok)
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

        return run

    if len(loads) == 1:
        schema = T.StructType(fields)
        return rows.mapInArrow(second(given(loads[0]), schema), schema)
    schema = T.StructType([*fields, *lists])
    out = written(rows.mapInArrow(second(None, schema), schema), "aligned")
    for load_ in loads:
        out = written(out.mapInArrow(_adding(given(load_)), schema), "aligned")
    return out.drop("_pairs", "_times")


def _pair_lists(block: Block) -> list[pa.Array]:
    """Per text its distinct pairs and how often each is linked, as two list columns."""
    pairs, times, cuts = [], [], [0]
    first = np.searchsorted(block.chunk_of_pair, np.arange(len(block.n_a) + 1))
    for ok, a, b in zip(block.sound.tolist(), block.ends.tolist(), block.ends[1:].tolist(), strict=False):
        own, n = np.unique(block.of[a:b] if ok else block.of[:0], return_counts=True)
        at = [np.arange(first[c], first[c + 1]) for c in own.tolist()]
        of = np.concatenate([np.zeros(0, np.int64), *at])
        key, where = np.unique(block.pairs[of], return_inverse=True)
        pairs.append(key)
        times.append(np.bincount(where, np.repeat(n, [len(x) for x in at]), len(key)).astype(np.int64))
        cuts.append(cuts[-1] + len(key))
    offsets = pa.array(cuts, pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (pairs, times)]


def _adding(shared: Any) -> Any:
    """Adds to n_best and count_sum what one load of the table knows of each row's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Counts(*shared.value)
        for batch in batches:
            at = {c: batch.schema.get_field_index(c) for c in ("n_best", "count_sum", "_pairs", "_times")}
            pairs, times = (batch.column(at[c]).flatten().to_numpy() for c in ("_pairs", "_times"))
            lengths = np.array([len(x) for x in batch.column(at["_pairs"])], np.int64)
            n = table.look_up(pairs)
            cuts = np.append(0, np.cumsum(lengths))
            columns = list(batch.columns)
            for c, x in (("n_best", table.is_best(pairs, n) & (n > 0)), ("count_sum", n)):
                sums = np.append(0, np.cumsum(x * times))
                columns[at[c]] = pa.array(batch.column(at[c]).to_numpy() + sums[cuts[1:]] - sums[cuts[:-1]])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run
