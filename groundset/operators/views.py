"""Read side: overviews, filters, pages, provenance and export rows over the run store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundset.functions.text import safe_cell, title_or_prompt

# Page size limits.
PAGE_SIZE = 20
MAX_PAGE_SIZE = 100


def effective_spec(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Runs with the spec that applies: the run's snapshot, else the task's."""
    own = F.nullif(F.nullif(F.col("run_spec"), F.lit("{}")), F.lit(""))
    return runs.join(tasks.select("task_id", F.col("spec").alias("_task_spec")), "task_id", "left").select(
        *[F.col(c) for c in runs.columns], F.coalesce(own, "_task_spec").alias("spec")
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest run per task; runs that never started come last."""
    order = Window.partitionBy("task_id").orderBy(F.col("started_at").desc_nulls_last(), "run_id")
    return runs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == 1).drop("_n")


def count_by(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def run_summaries(runs: DataFrame, records: DataFrame) -> DataFrame:
    """Runs with their record count, for the run list of a task."""
    counts = count_by(records, "run_id", "record_count")
    return runs.join(counts, "run_id", "left").fillna(0, ["record_count"])


def task_overview(tasks: DataFrame, runs: DataFrame, records: DataFrame) -> DataFrame:
    """One row per task: title, region, run count and its latest run."""
    latest = latest_runs(runs).select(
        "task_id", F.col("run_id").alias("latest_run_id"), F.col("status").alias("latest_status"),
        F.col("started_at").alias("latest_started_at"), F.col("finished_at").alias("latest_finished_at"),
        F.col("error").alias("latest_error"),
    )
    counts = count_by(records, "run_id", "latest_record_count").withColumnRenamed("run_id", "latest_run_id")
    latest = latest.join(counts, "latest_run_id", "left")
    df = tasks.join(count_by(runs, "task_id", "run_count"), "task_id", "left").join(latest, "task_id", "left")
    return df.select(
        "task_id",
        title_or_prompt(F.get_json_object("spec", "$.title"), F.col("prompt")).alias("title"),
        "prompt",
        F.coalesce(F.get_json_object("spec", "$.region"), F.lit("GLOBAL")).alias("region"),
        "created_at", "updated_at",
        F.coalesce("run_count", F.lit(0)).alias("run_count"),
        "latest_run_id", "latest_status", "latest_started_at", "latest_finished_at", "latest_error",
        F.coalesce("latest_record_count", F.lit(0)).alias("latest_record_count"),
    )


def search_tasks(tasks: DataFrame, query: str) -> DataFrame:
    """Case-insensitive, literal substring of prompt or spec."""
    wanted = F.lit(query.strip().lower())
    return tasks.filter(F.lower("prompt").contains(wanted) | F.lower("spec").contains(wanted))


def with_latest_status(overview: DataFrame, status: str) -> DataFrame:
    if status.lower() == "all":
        return overview
    return overview.filter(F.lower("latest_status") == status.lower())


def _order(column: Column, descending: bool) -> Column:
    return column.desc_nulls_last() if descending else column.asc_nulls_last()


def page_of(
    df: DataFrame, sort: str, id_column: str, page: int = 1, page_size: int = PAGE_SIZE, descending: bool = True
) -> DataFrame:
    """One page of a list, ordered by `sort` with the id as tie break, then trimmed to the page."""
    if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError("page starts at 1, page_size lies in 1..100")
    return df.orderBy(_order(F.col(sort), descending), id_column).offset((page - 1) * page_size).limit(page_size)


def totals(df: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """`total` and `total_pages` of a filtered list."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("total"), F.greatest(F.lit(1), F.ceil(n / page_size)).cast("bigint").alias("total_pages"))


def page_per_run(
    records: DataFrame, sort: str = "confidence", page: int = 1, page_size: int = PAGE_SIZE, descending: bool = True
) -> DataFrame:
    """The same page of every run at once; rows past the page end are cut before the shuffle."""
    order = Window.partitionBy("run_id").orderBy(_order(F.col(sort), descending), "record_id")
    ranked = records.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= page * page_size)
    return ranked.filter(F.col("position") > (page - 1) * page_size)


def totals_per_run(records: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    n = F.count(F.lit(1))
    return records.groupBy("run_id").agg(
        n.alias("total"), F.greatest(F.lit(1), F.ceil(n / page_size)).cast("bigint").alias("total_pages")
    )


def filter_records(
    records: DataFrame, run_id: str | None = None, min_confidence: float | None = None, q: str | None = None
) -> DataFrame:
    """Run, least confidence, and literal case-insensitive text in any value."""
    if run_id is not None:
        records = records.filter(F.col("run_id") == run_id)
    if min_confidence is not None:
        records = records.filter(F.col("confidence") >= min_confidence)
    if q:
        wanted = F.lit(q.lower())
        records = records.filter(
            F.exists(F.map_values("data"), lambda v: F.coalesce(F.lower(v).contains(wanted), F.lit(False)))
        )
    return records


def project_fields(records: DataFrame, names: list[str]) -> DataFrame:
    """Chosen payload fields as columns, missing ones ''."""
    fields = [F.coalesce(F.try_element_at("data", F.lit(n)), F.lit("")).alias(n) for n in names]
    return records.select(*[c for c in records.columns if c != "data"], *fields)


def audit_sources(sources: DataFrame, kind: str = "ALL") -> DataFrame:
    """Source list filter: ALL, FETCHED, BLOCKED or FAILED."""
    status = F.col("status")
    tests = {
        "FETCHED": status == "fetched",
        "BLOCKED": status.contains("blocked"),
        "FAILED": status == "failed",
    }
    return sources.filter(tests[kind]) if kind in tests else sources


def newest_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy("run_id", F.col("fetched_at").desc(), "source_id")


def record_detail(records: DataFrame, evidence: DataFrame, sources: DataFrame, record_id: str) -> DataFrame:
    """One record with a row per evidence snippet and its source URL."""
    one = records.filter(F.col("record_id") == record_id)
    own = evidence.filter(F.col("record_id") == record_id)
    urls = sources.select("source_id", F.col("url").alias("source_url"))
    return one.join(own.drop("run_id"), "record_id", "left").join(urls, "source_id", "left").orderBy("position")


def record_links(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Source links of records in long form, `(record_id, position, source_url, snippet)`: a row per snippet."""
    urls = sources.select("source_id", F.col("url").alias("source_url"))
    return evidence.join(urls, "source_id", "left").select("record_id", "position", "source_url", "snippet")


def provenance(records: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Records with `source_urls` (in evidence order, repeats kept), `evidence` and `retrieved_at`.

    Needs `evidence(record_id, source_id, snippet, position)`. Always one row per record, so the links of a
    record meet in one cell, as the export format asks; `record_links` has them as rows.
    """
    told = F.col("snippet") != ""
    link = F.when(F.col("source_url").isNotNull(), F.struct("position", "source_url"))
    gathered = record_links(evidence, sources).groupBy("record_id").agg(
        F.min_by("snippet", F.when(told, F.col("position"))).alias("evidence"),
        F.array_join(F.array_sort(F.collect_list(link))["source_url"], " | ").alias("source_urls"),
    )
    return records.join(gathered, "record_id", "left").select(
        *records.columns,
        F.coalesce("source_urls", F.lit("")).alias("source_urls"),
        F.coalesce("evidence", F.lit("")).alias("evidence"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("retrieved_at"),
    )


def export_rows(provenance_rows: DataFrame, names: list[str]) -> DataFrame:
    """CSV columns: fields, confidence, source_urls, evidence, retrieved_at; cells made safe."""
    rows = project_fields(provenance_rows, names)
    columns = [*names, "confidence", "source_urls", "evidence", "retrieved_at"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    cells = [safe_cell(F.col(c)).alias(c) if types[c] == "string" else F.col(c) for c in columns]
    return rows.select("run_id", "record_id", *cells)


def export_json_rows(provenance_rows: DataFrame, names: list[str]) -> DataFrame:
    """JSON shape: fields, confidence, retrieved_at and `evidence` as a list of source and snippet.

    The list holds the first snippet with the first link; no snippet, empty list.
    """
    rows = project_fields(provenance_rows, names)
    url = F.nullif(F.trim(F.substring_index("source_urls", "|", 1)), F.lit(""))
    item = F.struct(url.alias("source_url"), F.col("evidence").alias("snippet"))
    none = F.filter(F.array(item), lambda _: F.lit(False))
    return rows.select(
        "run_id", "record_id", *names, "confidence", "retrieved_at",
        F.when(F.col("evidence") != "", F.array(item)).otherwise(none).alias("evidence"),
    )


def report_rows(stats: DataFrame) -> DataFrame:
    """Metric/value rows of the export bundle; the two timings only where present."""
    # Metric labels in order.
    metrics = (
        ("Raw extracted", "raw_count"),
        ("Verified", "verified_count"),
        ("Valid", "valid_count"),
        ("Deduplicated", "deduped_count"),
        ("Pages fetched", "pages_fetched"),
        ("Pages failed", "pages_failed"),
        ("Hallucinated dropped", "hallucinated_count"),
        ("First record (seconds)", "first_record_seconds"),
        ("Total duration (seconds)", "duration_seconds"),
    )
    items = [
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("metric"), F.col(c).cast("double").alias("value"))
        for i, (label, c) in enumerate(metrics)
        if c in stats.columns
    ]
    rows = stats.select("run_id", F.inline(F.array(*items)))
    timing = F.col("metric").contains("seconds")
    return rows.filter(~timing | (F.coalesce("value", F.lit(0.0)) != 0))


def event_payload(events: DataFrame) -> DataFrame:
    """Event stream rows: event name, id and JSON payload; `data` only where present."""
    has_data = F.coalesce(F.col("data"), F.lit("")) != ""
    payload = F.to_json(
        F.struct(
            "id", "level", "step", "message",
            F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
            F.when(has_data, F.try_parse_json("data")).alias("data"),
        )
    )
    name = F.when(F.col("step") == "records_updated", "records_updated").otherwise("log")
    return events.select("run_id", "id", name.alias("event"), payload.alias("payload"))


def events_after(events: DataFrame, run_id, after: int = 0) -> DataFrame:
    return events.filter((F.col("run_id") == run_id) & (F.col("id") > after)).orderBy("id")
