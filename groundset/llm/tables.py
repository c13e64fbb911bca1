"""Intermediate tables and the registry of this subpackage's queries."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundset.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

#: Removes the shuffle files of a statement at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, safe from lost executors, its size known.

    Its size lets Spark choose between broadcasting and shuffling it. The shuffle files it was made from go at once, as
    later steps read the table: else they stand until the driver's JVM happens to collect what refers to them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by `written` that nothing reads any more, so that they don't stand beside later ones."""
    for table in tables:
        spark = table.sparkSession
        for folder in {os.path.dirname(f) for f in table.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def carried(docs: DataFrame, *own: str) -> DataFrame:
    """`own` columns beside one struct `_doc` of all others, so that their names can't clash with ours."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*(others or [F.lit(0).alias("none")])).alias("_doc"))


def restored(df: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    """The columns of `docs` again, from what `carried` made."""
    return df.select(*[F.col(c) if c in own else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
