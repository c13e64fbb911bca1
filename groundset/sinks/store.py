"""Writes to the run store: replace a run, append events, update, sweep and cascade delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundset.sources.store import (
    COMPACTED,
    RUN_VERSIONS,
    TABLES,
    current_by_run,
    folders,
    last_compaction,
    run_versions,
    table_path,
)

#: Rows are written once and stay: codec of the versions and of compacted rows.
PACKED = "zstd"


def append(df: DataFrame, root: str, name: str) -> None:
    df.select(*TABLES[name].fieldNames()).write.mode("append").parquet(table_path(root, name))


def replace_runs(tables: dict[str, DataFrame], root: str, touched: DataFrame, version: int) -> None:
    """Replace all rows of the `touched` runs (`run_id`) in several tables at once.

    The new rows form a version of their own, one folder for all runs. Once every table is written, the
    touched runs are pointed to it in a single write, so readers of `read_current` see all tables switch
    together, and a run without new rows is empty. Versions must grow; writing one again replaces it, until
    `compact` has settled it: from then on it is refused.
    """
    settled = last_compaction(touched.sparkSession, root)
    if settled is not None and version <= settled:
        raise ValueError(f"the store is compacted up to version {settled}; {version} can't be written")
    for name, df in tables.items():
        _write_version(df.select(*TABLES[name].fieldNames()), root, name, version)
    runs = touched.select(F.col("run_id").cast("string").alias("run_id")).distinct()
    _write_version(runs, root, RUN_VERSIONS, version)


def _write_version(df: DataFrame, root: str, name: str, version: int) -> None:
    df.write.mode("overwrite").option("compression", PACKED).parquet(f"{table_path(root, name)}/version={version}")


def compact(spark: SparkSession, root: str, upto: int) -> None:
    """Write the rows current at version `upto` as one folder per table and make it the base of all reads.

    Later versions stay as they are. The list of runs is written last and switches readers over; a compaction
    that broke off before it has no effect and can be run again, as can one that was finished. Rows are ordered
    by run, so a reader of a few runs skips the other files; a run with many rows is split over several.
    """
    settled = last_compaction(spark, root)
    if settled is not None and upto <= settled:
        return
    for name in TABLES:
        path = table_path(root, name)
        if not folders(spark, path, "version") and not folders(spark, path, COMPACTED):
            continue
        by = ["run_id", TABLES[name].fieldNames()[0]]
        rows = current_by_run(spark, root, name, upto).sortWithinPartitions(*by)
        rows.write.mode("overwrite").option("compression", PACKED).parquet(f"{path}/{COMPACTED}={upto}")
    runs = run_versions(spark, root, settled, upto).select("run_id")
    if settled is not None:
        before = spark.read.schema("run_id string").parquet(f"{table_path(root, RUN_VERSIONS)}/{COMPACTED}={settled}")
        runs = runs.unionByName(before).distinct()
    runs.write.mode("overwrite").parquet(f"{table_path(root, RUN_VERSIONS)}/{COMPACTED}={upto}")


def remove_superseded(spark: SparkSession, root: str) -> int:
    """Delete the folders that no reader of today opens; their number.

    Readers that began before the last compaction may still want them: call it when they are through.
    """
    settled = last_compaction(spark, root)
    if settled is None:
        return 0
    gone = []
    for name in (*TABLES, RUN_VERSIONS):
        path = table_path(root, name)
        gone += [f for v, f in folders(spark, path, "version").items() if v <= settled]
        gone += [f for v, f in folders(spark, path, COMPACTED).items() if v < settled]
    for folder in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(gone)


def event_rows(
    df: DataFrame, event_id: Column, run_id: Column, level: str, step: str, message: Column, data: Column | None = None
) -> DataFrame:
    """Rows for the event log; `data` is a struct printed as JSON."""
    return df.select(
        event_id.cast("bigint").alias("id"), run_id.cast("string").alias("run_id"),
        F.lit(level).alias("level"), F.lit(step).alias("step"), message.alias("message"),
        (F.to_json(data) if data is not None else F.lit(None).cast("string")).alias("data"),
        F.current_timestamp().alias("created_at"),
    )


def sweep_stale(runs: DataFrame, message: str = "Server restarted") -> DataFrame:
    """Runs still running or queued become failed."""
    stale = F.col("status").isin("running", "queued")
    return runs.withColumn("error", F.when(stale, message).otherwise(F.col("error"))).withColumn(
        "status", F.when(stale, "failed").otherwise(F.col("status"))
    )


def update_runs(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """Sparse update: attributes given and not null overwrite, the rest stays."""
    given = [c for c in updates.columns if c != "run_id"]
    new = updates.select("run_id", *[F.col(c).alias(f"_{c}") for c in given])
    joined = runs.join(new, "run_id", "left")
    return joined.select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in runs.columns]
    )


def cascade_delete(tables: dict[str, DataFrame], task_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the given tasks and everything that hangs on them."""
    gone_runs = tables["runs"].join(task_ids, "task_id", "left_semi").select("run_id")
    kept = {
        "tasks": tables["tasks"].join(task_ids, "task_id", "left_anti"),
        "runs": tables["runs"].join(task_ids, "task_id", "left_anti"),
    }
    gone_records = tables["records"].join(gone_runs, "run_id", "left_semi").select("record_id")
    kept["record_evidence"] = tables["record_evidence"].join(gone_records, "record_id", "left_anti")
    for name in ("records", "sources", "run_events"):
        kept[name] = tables[name].join(gone_runs, "run_id", "left_anti")
    return kept
