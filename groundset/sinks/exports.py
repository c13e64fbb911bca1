"""Export files: CSV, JSON lines, and the three-table bundle."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundset.functions.text import safe_cell
from groundset.operators.views import export_json_rows, export_rows, newest_sources, report_rows


def _ordered(rows: DataFrame) -> DataFrame:
    """Most confident first inside each run's folder. Range partitioning keeps big runs spread."""
    return rows.repartitionByRange("run_id", F.col("confidence").desc(), "record_id").sortWithinPartitions(
        "run_id", F.col("confidence").desc(), "record_id"
    )


def write_csv(provenance_rows: DataFrame, names: list[str], path: str) -> None:
    rows = _ordered(export_rows(provenance_rows, names))
    columns = [*names, "confidence", "source_urls", "evidence", "retrieved_at"]
    rows.select("run_id", *columns).write.mode("overwrite").partitionBy("run_id").option("header", True).option(
        "escape", '"'
    ).csv(path)


def write_json(provenance_rows: DataFrame, names: list[str], path: str) -> None:
    rows = _ordered(export_json_rows(provenance_rows, names)).drop("record_id")
    rows.write.mode("overwrite").partitionBy("run_id").option("ignoreNullFields", False).json(path)


def source_sheet(sources: DataFrame) -> DataFrame:
    return newest_sources(sources).select(
        "run_id", safe_cell(F.col("url")).alias("url"), "domain", "status",
        F.coalesce(F.col("http_status").cast("string"), F.lit("")).alias("http_status"),
        F.coalesce("reason", F.lit("")).alias("reason"), "records_found",
        F.coalesce(F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("fetched_at"),
    )


def write_bundle(provenance_rows: DataFrame, names: list[str], sources: DataFrame, stats: DataFrame, path: str) -> None:
    """Records, sources and report rows as three CSV folders."""
    write_csv(provenance_rows, names, os.path.join(path, "records"))
    source_sheet(sources).write.mode("overwrite").partitionBy("run_id").option("header", True).csv(
        os.path.join(path, "sources")
    )
    report = report_rows(stats).repartition("run_id").sortWithinPartitions("run_id", "position")
    report.select("run_id", "metric", "value").write.mode("overwrite").partitionBy("run_id").option("header", True).csv(
        os.path.join(path, "report")
    )
