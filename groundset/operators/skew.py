"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundset.session import cut_lineage

ROWS_PER_TASK = 1_000_000
BROADCAST_KEYS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan of few splits over all cores ahead of heavy per-row work.

    A table with at least one split per core, as any large one, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def join_spread(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread_by: list[str | Column],
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Equi join where rows of a hot left key are dealt over several tasks.

    Left keys are counted first, on the key columns alone. Without a key above `rows_per_task`
    rows this is the plain join. Otherwise hot keys get as many salts as they need and the
    matching right rows are repeated once per salt. There are at most `rows / rows_per_task` hot
    keys; they are broadcast only while few. `how` may be inner or left.
    """
    if left.isStreaming:
        return left.join(right, on, how)
    sizes = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_task)
    hot = cut_lineage(sizes.select(*on, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts")))
    n_hot = hot.count()
    if n_hot == 0:
        return left.join(right, on, how)
    if n_hot <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = left.join(hot, on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int")
    )
    repeated = right.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    joined = dealt.drop("_salts").join(repeated.drop("_salts"), [*on, "_salt"], how)
    return joined.drop("_salt")


def range_blocks(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows sorted into range partitions over (group, order), the partition number in `_block`.

    Blocks are even however the groups are sized, and a group's blocks follow its order. The
    result is checkpointed, since range bounds come from a sample and must not move afterwards.
    """
    ranged = df.repartitionByRange(*group, *order).withColumn("_block", F.spark_partition_id())
    return cut_lineage(ranged)


def with_prefix(
    df: DataFrame,
    group: list[str],
    order: list[str],
    count: str | None = None,
    running_max: dict[str, Column] | None = None,
) -> DataFrame:
    """Running row number and running maxima per group without a one-task window.

    Each block is scanned by itself; block totals (one row per group and block) are combined and
    joined back. `running_max` maps a name to the value whose maximum so far is wanted.
    """
    running_max = running_max or {}
    keys = [*group, "_block"]
    df = range_blocks(df, group, order)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = df.withColumn("_n", F.count(F.lit(1)).over(inside))
    for name, value in running_max.items():
        scanned = scanned.withColumn(f"_in_{name}", F.max(value).over(inside))
    totals = scanned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.max(f"_in_{n}").alias(f"_top_{n}") for n in running_max]
    )
    totals = totals.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    for name in running_max:
        totals = totals.withColumn(f"_top_{name}", F.max(f"_top_{name}").over(before))
    joined = scanned.join(totals.drop("_rows"), keys)
    out = [F.col(c) for c in df.columns if c != "_block"]
    if count:
        out.append((F.col("_offset") + F.col("_n")).alias(count))
    out += [F.greatest(f"_in_{n}", f"_top_{n}").alias(n) for n in running_max]
    return joined.select(*out)
