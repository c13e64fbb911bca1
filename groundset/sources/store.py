"""Run-store tables and input scans with declared schemas."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundset.operators.skew import BROADCAST_KEYS, ROWS_PER_TASK
from groundset.session import cut_lineage

_S, _L, _I, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


TABLES = {
    "tasks": _struct(task_id=_S, prompt=_S, spec=_S, created_at=_TS, updated_at=_TS),
    "runs": _struct(
        run_id=_S, task_id=_S, plan=_S, status=_S, stats=_S, run_spec=_S, error=_S, started_at=_TS, finished_at=_TS
    ),
    "run_events": _struct(id=_L, run_id=_S, level=_S, step=_S, message=_S, data=_S, created_at=_TS),
    "sources": _struct(
        source_id=_S, run_id=_S, url=_S, domain=_S, status=_S, http_status=_I, reason=_S, records_found=_L, fetched_at=_TS
    ),
    "records": _struct(
        record_id=_S, run_id=_S, data=T.MapType(_S, _S), dedupe_key=_S, confidence=T.DoubleType(),
        flags=T.ArrayType(_S), created_at=_TS,
    ),
    "record_evidence": _struct(
        record_id=_S, run_id=_S, source_id=_S, snippet=_S,
        position=_struct(absorbed=_I, first_arrival=_L, unfilled=_I, arrival=_L),
    ),
}

# Tables replaced run by run keep every version of a run; this one names the version that counts.
RUN_VERSIONS = "run_versions"
# Folders `compacted=V` hold the rows that were current at version V.
COMPACTED = "compacted"
# Numbers that runs are dealt to by hash when their rows are counted.
RUN_BUCKETS = 4096


def table_path(root: str, name: str) -> str:
    return os.path.join(root, name)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(table_path(root, name))


def folders(spark: SparkSession, path: str, key: str) -> dict[int, str]:
    """The folders `key=number` below a path by number. Their count follows the writes, not the rows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(where) if f.isDirectory()] if files.exists(where) else []
    return {int(n.removeprefix(f"{key}=")): f"{path}/{n}" for n in names if n.startswith(f"{key}=")}


def last_compaction(spark: SparkSession, root: str) -> int | None:
    """The version up to which the store is compacted. The run list is written last, so it says that all is there."""
    found = folders(spark, table_path(root, RUN_VERSIONS), COMPACTED)
    done = [v for v, path in found.items() if _exists(spark, f"{path}/_SUCCESS")]
    return max(done, default=None)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _versions(spark: SparkSession, root: str, name: str, shape: T.StructType, after: int | None, upto: int | None) -> DataFrame:
    """Rows written in the versions of a range, with `version`; only their folders are listed and read."""
    path = table_path(root, name)
    held = folders(spark, path, "version")
    wanted = [f for v, f in sorted(held.items()) if (after is None or v > after) and (upto is None or v <= upto)]
    shape = T.StructType([*shape.fields, T.StructField("version", _L)])
    if not wanted:
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).option("basePath", path).parquet(*wanted)


def run_versions(spark: SparkSession, root: str, after: int | None = None, upto: int | None = None) -> DataFrame:
    """The newest version of each run that was replaced in the range: `(run_id, version)`."""
    written = _versions(spark, root, RUN_VERSIONS, _struct(run_id=_S), after, upto)
    return written.groupBy("run_id").agg(F.max("version").alias("version"))


def read_current(spark: SparkSession, root: str, name: str, upto: int | None = None) -> DataFrame:
    """A table replaced run by run: the rows of each run's newest version, as of version `upto` if given.

    Runs replaced since the last compaction come from their version, all others from the compacted rows; files
    from before the compaction are not listed. A store without versions is empty. Versions older than the last
    compaction can't be asked for.
    """
    base = last_compaction(spark, root)
    if upto is not None and base is not None and upto < base:
        raise ValueError(f"the store is compacted up to version {base}")
    newer = run_versions(spark, root, base, upto)
    rows = _versions(spark, root, name, TABLES[name], base, upto).join(newer, ["run_id", "version"])
    current = rows.select(*TABLES[name].fieldNames())
    path = f"{table_path(root, name)}/{COMPACTED}={base}"
    # A table first written after the compaction has no compacted rows.
    if base is None or not _exists(spark, path):
        return current
    settled = spark.read.schema(TABLES[name]).parquet(path).join(newer, "run_id", "left_anti")
    return settled.select(*TABLES[name].fieldNames()).unionByName(current)


def current_by_run(spark: SparkSession, root: str, name: str, upto: int | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows of `read_current` in ranges of run ids: a run is in one partition, or in several if it has many rows.

    The lists of runs travel with the rows, so each row is moved once: into its range, and not before that to meet them.
    """
    base, keys = last_compaction(spark, root), ["run_id"]
    rows = _versions(spark, root, name, TABLES[name], base, upto).filter("run_id is not null")
    path = f"{table_path(root, name)}/{COMPACTED}={base}"
    if base is not None and _exists(spark, path):
        settled = spark.read.schema(TABLES[name]).parquet(path)
        rows = rows.unionByName(settled.withColumn("version", F.lit(None).cast("bigint")))
    lists = _versions(spark, root, RUN_VERSIONS, _struct(run_id=_S), base, upto).filter("run_id is not null")
    lists = lists.withColumnRenamed("version", "_newest").withColumn("_listed", F.lit(True))
    # Few numbers are counted first, so that runs are only where one of them may have many rows.
    bucket = F.pmod(F.xxhash64("run_id"), F.lit(RUN_BUCKETS)).cast("int")
    counted = rows.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    full = [r["_bucket"] for r in counted.filter(F.col("_n") > rows_per_task).collect()]
    sizes = rows.filter(bucket.isin(full)).groupBy("run_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_task)
    hot = cut_lineage(sizes.select("run_id", F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts")))
    n_hot = hot.count()
    if n_hot:
        hot, salts = (F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot), F.coalesce("_salts", F.lit(1))
        salt = F.pmod(F.xxhash64(TABLES[name].fieldNames()[0]), salts).cast("int")
        rows = rows.join(hot, "run_id", "left").withColumn("_salt", salt).drop("_salts")
        each = F.explode(F.sequence(F.lit(0), salts - 1))
        lists = lists.join(hot, "run_id", "left").withColumn("_salt", each).drop("_salts")
        keys.append("_salt")
    ranged = rows.unionByName(lists, allowMissingColumns=True).repartitionByRange(*keys)
    newest = F.max("_newest").over(Window.partitionBy(*keys))
    found = ranged.withColumn("_newest", newest).filter(F.col("_listed").isNull() & F.col("version").eqNullSafe(F.col("_newest")))
    return found.select(*TABLES[name].fieldNames())


def stream_table(spark: SparkSession, root: str, name: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(TABLES[name])
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(table_path(root, name))


def _search_results(spark: SparkSession, path: str) -> DataFrame:
    """Search results of any provider shape; `_broken` holds a line that is no JSON object, else null."""
    shape = _struct(
        url=_S, href=_S, link=_S, title=_S, content=_S, body=_S, run_id=_S, query_idx=_L, rank=_L, _broken=_S
    )
    reader = spark.read.schema(shape).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
    url = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("url", "href", "link")])
    return reader.json(path).withColumn("url", url)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Search results of any provider shape to `(url, title, snippet)`; `rejected_candidates` has the other lines."""
    return _search_results(spark, path).filter(F.col("url").isNotNull() & F.col("_broken").isNull()).select(
        "run_id", "query_idx", "rank", "url",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("content", "body", F.lit("")).alias("snippet"),
    )


def rejected_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Lines that `read_candidates` leaves out: `(run_id, query_idx, rank, title, reason, line)`.

    `reason` is `broken_line` (no JSON object, or a value of another type; `line` is the text) or `no_url`
    (`line` is null). Blank lines are no lines.
    """
    broken = F.col("_broken").isNotNull()
    return _search_results(spark, path).filter(broken | F.col("url").isNull()).select(
        "run_id", "query_idx", "rank", "title",
        F.when(broken, "broken_line").otherwise("no_url").alias("reason"), F.col("_broken").alias("line"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages with their contract's columns, whatever else the files hold."""
    shape = _struct(url=_S, html=_S, http_status=_I, content_type=_S)
    return spark.read.schema(shape).parquet(path)
