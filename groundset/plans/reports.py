"""Composite reports over the run store: trust report and diagnostics of every run."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundset.operators import report
from groundset.operators.views import effective_spec
from groundset.sinks.store import update_runs
from groundset.spec import DEFAULT_TARGET, parse_specs, spec_fields


class TrustReport(NamedTuple):
    funnel: DataFrame
    trust_signals: DataFrame
    field_completeness: DataFrame
    sources_summary: DataFrame


def run_specs(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each run with its parsed spec; `spec_reject` tells why a spec cannot be used."""
    return parse_specs(effective_spec(runs, tasks))


def trust_report(runs: DataFrame, tasks: DataFrame, records: DataFrame, sources: DataFrame) -> TrustReport:
    """The four report tables, keyed by run, from the stored tables."""
    stats = report.stats_columns(runs)
    specs = run_specs(runs, tasks).filter(F.col("spec_reject").isNull())
    fields = spec_fields(specs, "run_id")
    reasons = stats.filter("missing_required > 0").select(
        "run_id", F.lit("missing_required").alias("reason"), F.col("missing_required").alias("n")
    )
    return TrustReport(
        report.funnel(stats.drop("missing_required"), reasons),
        report.trust_signals(stats, sources, records, fields),
        report.field_completeness(records, fields),
        report.sources_summary(sources),
    )


def write_back(runs: DataFrame, stats: DataFrame, reasons: DataFrame) -> DataFrame:
    """`runs` with the statistics of the given ones, drop reasons included, as the store keeps them."""
    counts = [c for c in stats.columns if c != "run_id"]
    told = stats.join(report.drop_reason_map(reasons), "run_id", "left").withColumn(
        "dropped_reasons", F.coalesce("dropped_reasons", F.create_map().cast("map<string,bigint>"))
    )
    made = F.to_json(F.struct(*counts, "dropped_reasons"))
    return update_runs(runs, told.select(F.col("run_id").cast("string").alias("run_id"), made.alias("stats")))


def diagnose_runs(
    runs: DataFrame, tasks: DataFrame, sources: DataFrame, gate: float | None = report.LOW_YIELD_SHARE
) -> DataFrame:
    """Why runs below half of their target found little. An unusable spec counts as target 30."""
    usable = F.col("spec_reject").isNull()
    specs = run_specs(runs, tasks).select(
        "run_id",
        F.when(usable, F.col("spec.target_count")).otherwise(DEFAULT_TARGET).alias("target_count"),
        F.when(usable, F.col("spec.filters")).otherwise(F.create_map().cast("map<string,string>")).alias("filters"),
    )
    stats = report.stats_columns(runs).join(specs, "run_id")
    return report.diagnostics(stats, sources, gate)
