"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundset.llm.tables import written

ROUNDS, SEED = 6, 2024


class Permutation:
    """A bijection of 0..size-1 that depends on size and seed alone; arrays in, arrays out.

    A balanced Feistel network permutes the numbers of the next even count of bits, fewer than four times
    `size`; a result beyond `size` is put in again until it falls below, which keeps the map one to one.
    """

    def __init__(self, size: int, seed: int = SEED):
        if size < 1:
            raise ValueError("a permutation needs at least one number")
        self.size = size
        self.half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.random.default_rng([seed, size]).integers(0, 2**63, ROUNDS, np.uint64)

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                a, b = b ^ self._mix(a, key), a
            else:
                a, b = b, a ^ self._mix(b, key)
        return (a << self.half) | b

    def _walk(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(numbers).astype(np.uint64), back)
        while (over := out >= np.uint64(self.size)).any():
            out[over] = self._once(out[over], back)
        return out.astype(np.int64)

    def forward(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def backward(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, True)


def place(row: int, size: int, shards: int, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a global row number, without looking at any row."""
    p = int(Permutation(size, seed).forward(np.array([row]))[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, size: int, shards: int, seed: int = SEED) -> int:
    """The global row number that lies in a slot of a shard: the inverse of `place`."""
    return int(Permutation(size, seed).backward(np.array([slot * shards + shard]))[0])


def with_row_numbers(rows: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Adds gapless numbers from 0 in the order of `order`, without one task seeing all rows.

    Rows are dealt by range and sorted, and written in that order with their part and place; a part's first
    number is the count of the rows before it (one row per part, summed in a window). Rows equal in all of
    `order` get neighbouring numbers in any order. Nulls come first.
    """
    # A running id as the last key lets rows that are equal in all else be dealt to several parts.
    keyed = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    # The id of a row is its partition << 33 plus its place there.
    row_id = F.monotonically_increasing_id()
    parts = written(ranged.withColumn("_row_id", row_id), "ranged").withColumns(
        {"_part": F.shiftright("_row_id", 33), "_place": F.col("_row_id").bitwiseAND((1 << 33) - 1)}
    )
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as partitions.
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return (
        parts.join(F.broadcast(first), "_part")
        .withColumn(name, F.col("_first") + F.col("_place"))
        .drop("_part", "_place", "_first", "_row_id")
    )


def shard(rows: DataFrame, order: list[str], shards: int, seed: int = SEED) -> DataFrame:
    """`rows` with row_number, shard and slot: shards differ by one row at most, slots are gapless from 0.

    The same rows, order and seed give the same places whatever the files or partitions. An empty table gives
    no rows. Columns of the added names are replaced.
    """
    numbered = with_row_numbers(rows.drop("row_number", "shard", "slot"), order)
    size = rows.count()
    if not size:
        return numbered.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("bigint")})

    def permute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        order = Permutation(size, seed)
        for numbers in batches:
            yield pd.Series(order.forward(numbers.to_numpy()))

    permuted = F.pandas_udf(permute, "long")
    return (
        numbered.withColumn("_p", permuted("row_number"))
        .withColumns({"shard": F.pmod("_p", F.lit(shards)).cast("int"), "slot": F.expr(f"_p div {shards}")})
        .drop("_p")
    )
