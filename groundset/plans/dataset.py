"""Composite jobs: build a dataset from verified records, and collect one from pages."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundset.functions.text import sorted_tokens
from groundset.functions.urls import host
from groundset.operators import candidates as cand
from groundset.operators import clean, fuzzy, pages, policy, report, verify
from groundset.operators.skew import with_prefix
from groundset.session import cut_lineage
from groundset.spec import TaskSpec


class Dataset(NamedTuple):
    records: DataFrame
    evidence: DataFrame
    validated: DataFrame


def leaders_by_key(exact: DataFrame, **options) -> DataFrame:
    """`(run_id, dedupe_key, leader_key)` of records a similar earlier one absorbs."""
    nodes = exact.select("run_id", F.col("first_arrival").alias("idx"), sorted_tokens(F.col("fuzzy_key")).alias("s"))
    leads = fuzzy.leaders_of(nodes, **options)
    names = exact.select("run_id", F.col("first_arrival").alias("idx"), "dedupe_key")
    own = leads.join(names, ["run_id", "idx"])
    top = names.withColumnsRenamed({"idx": "leader", "dedupe_key": "leader_key"})
    return own.join(top, ["run_id", "leader"]).select("run_id", "dedupe_key", "leader_key")


def build_dataset(
    pool: DataFrame, spec: TaskSpec, corroborate: bool = True, merge_similar: bool = True, base_url: str | None = None, **options
) -> Dataset:
    """Normalise, validate, merge exact then similar duplicates, score: all runs of the pool at once."""
    # The valid rows feed keys, evidence and clusters: they are computed once.
    validated = cut_lineage(clean.validate_records(clean.normalize_records(pool, spec, base_url), spec))
    valid = validated.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    deduped = clean.merge_exact(valid, spec)
    if merge_similar:
        exact = clean.Deduped(cut_lineage(deduped.records), deduped.evidence)
        deduped = clean.merge_clusters(exact, leaders_by_key(exact.records, **options), spec)
    return Dataset(clean.score_records(deduped, spec, corroborate), clean.evidence_rows(deduped), validated)


def as_store_records(records: DataFrame, spec: TaskSpec) -> DataFrame:
    """Typed record columns to the store row with its text map."""
    entries = []
    for n in spec.names:
        entries += [F.lit(n), F.col(n).cast("string")]
    return records.select(
        "record_id", F.col("run_id").cast("string").alias("run_id"), F.create_map(*entries).alias("data"),
        "dedupe_key", "confidence", "flags", F.current_timestamp().alias("created_at"),
    )


def first_pages(
    verified: DataFrame, spec: TaskSpec, merge_similar: bool = True, base_url: str | None = None, **options
) -> DataFrame:
    """`(run_id, entity, page_order)`: the page on which each entity of the final dataset first appears.

    Leadership depends on earlier records alone, so what later pages bring changes no row.
    """
    pool = verified.filter("verified").drop("verified", "n_nulled", "page_id")
    valid = clean.validate_records(clean.normalize_records(pool, spec, base_url), spec)
    valid = cut_lineage(valid.filter(F.col("reject_reason").isNull()).drop("reject_reason"))
    seen = clean.with_keys(valid, spec).groupBy("run_id", "dedupe_key").agg(F.min("page_order").alias("page_order"))
    if merge_similar:
        exact = cut_lineage(clean.merge_exact(valid, spec).records)
        absorbed = leaders_by_key(exact, **options).select("run_id", "dedupe_key")
        seen = seen.join(absorbed, ["run_id", "dedupe_key"], "left_anti")
    return seen.withColumnRenamed("dedupe_key", "entity")


class Extracted(NamedTuple):
    rows: DataFrame
    verified: DataFrame
    stops: DataFrame


def extract_until(
    texts: DataFrame,
    spec: TaskSpec,
    extractor: pages.Extractor,
    target: int,
    first_wave: int = 8,
    max_chunks: int | None = None,
    corroborate: bool = True,
    **options,
) -> Extracted:
    """Extract and verify pages in their order until each run has `target` entities.

    Pages go in waves of `first_wave`, then twice as many each time, so that few jobs are run and the
    extractor sees at most about twice the pages it must. A run that has reached its target is out of later
    waves, and what its last wave read beyond the stop is dropped: the rows are those of a page-by-page run.
    `stops(run_id, stop)` names the page on which a run reached its target. An empty table gives empty ones.
    """
    runs = texts.select("run_id").distinct().count()
    last = texts.agg(F.max("page_order")).first()[0] or 0
    stops = texts.select("run_id", F.col("page_order").alias("stop")).limit(0)
    rows = verified = None
    taken, size = 0, first_wave
    while rows is None or (taken < last and stops.count() < runs):
        wave = texts.filter((F.col("page_order") > taken) & (F.col("page_order") <= taken + size))
        wave = wave.join(stops.select("run_id"), "run_id", "left_anti")
        found = pages.extract_pages(wave, spec, extractor, max_chunks=max_chunks)
        checked = verify.verify_for_spec(cut_lineage(pages.records_of(found, spec)), wave, spec)
        checked = cut_lineage(checked.withColumn("source_id", F.col("page_id")))
        rows = found if rows is None else rows.unionByName(found)
        verified = checked if verified is None else verified.unionByName(checked)
        # Each wave numbers its own records; pages of later waves come later.
        numbered = cut_lineage(with_prefix(verified.withColumnRenamed("arrival", "_own"), ["run_id"], ["page_order", "_own"], "arrival"))
        open_runs = numbered.join(stops, "run_id", "left_anti")
        reached = cand.target_pages(first_pages(open_runs, spec, **options), target)
        stops = cut_lineage(stops.unionByName(reached))
        taken, size = taken + size, size * 2
    return Extracted(cand.until_stop(rows, stops), cut_lineage(cand.until_stop(numbered, stops).drop("_own")), stops)


class Collected(NamedTuple):
    dataset: Dataset
    sources: DataFrame
    verified: DataFrame
    stats: DataFrame
    drop_reasons: DataFrame
    failures: DataFrame


def collect(
    candidates: DataFrame,
    fetched: DataFrame,
    spec: TaskSpec,
    extractor: pages.Extractor,
    max_pages: int | None = None,
    robots_rules: DataFrame | None = None,
    dns: DataFrame | None = None,
    blocked: tuple[str, ...] = policy.BLOCKED_HOSTS,
    max_response_chars: int | None = None,
    max_text_chars: int | None = None,
    max_chunks: int | None = None,
    limit_per_query: int | None = None,
    redirects: DataFrame | None = None,
    target: int | None = None,
    first_wave: int = 8,
    **options,
) -> Collected:
    """Candidate URLs and fetched pages to a dataset with its sources and statistics.

    `candidates(run_id, query_idx, rank, url, title, snippet)`,
    `fetched(url, html, http_status, content_type)`. A candidate without a fetched page fails. All
    candidates, whole pages and all chunks are used unless a limit is given; `redirects(url, hop, target)`
    are checked like the URLs themselves. Each page's text is extracted once, however many runs want it.
    With a `target` a run ends on the page that brings its last wanted record (`extract_until`); later
    candidates are then no sources.
    """
    spec = spec.with_capped_required()
    if limit_per_query is not None:
        candidates = cand.top_per_query(candidates, limit_per_query)
    gated = policy.with_policy(cand.first_seen(candidates), "url", robots_rules, dns, blocked)
    gated = gated.drop("host").withColumn("domain", F.coalesce(host(F.col("url")), F.lit("")))
    if redirects is not None:
        led = policy.check_redirects(redirects, blocked=blocked).select("url", F.col("reason").alias("_led"))
        gated = gated.join(led.filter("_led is not null"), "url", "left")
        gated = gated.withColumns(
            {
                "reason": F.when(F.col("allowed") & F.col("_led").isNotNull(), F.col("_led")).otherwise(F.col("reason")),
                "allowed": F.col("allowed") & F.col("_led").isNull(),
            }
        ).drop("_led")
    # Visits are numbered within their run, so that later orders need one number.
    gated = cut_lineage(with_prefix(gated, ["run_id"], ["query_idx", "rank", "url"], count="page_order"))
    page = fetched.join(gated.filter("allowed").select("url").distinct(), "url", "left_semi")
    bodies = pages.page_bodies(page, max_response_chars, max_text_chars)
    bodies = cut_lineage(bodies.select("url", "text", "fail_reason", "http_status", F.lit(True).alias("_fetched")))
    found = gated.filter("allowed").join(bodies, "url", "left")
    absent = F.when(F.col("_fetched").isNull(), "Not fetched")
    accepted = pages.with_snippets(found.withColumn("fail_reason", F.coalesce("fail_reason", absent)))
    accepted = accepted.select(*gated.columns, "text", "status", "fail_reason", "http_status")
    shut = gated.filter(~F.col("allowed")).select(
        *gated.columns, F.lit(None).cast("string").alias("text"),
        policy.blocked_status(F.col("reason")).alias("status"),
        F.lit(None).cast("string").alias("fail_reason"), F.lit(None).cast("int").alias("http_status"),
    )
    visits = accepted.unionByName(shut).withColumn("processed", F.col("status").isin("fetched", "via_search_provider"))
    visits = visits.withColumn("source_id", F.sha1(F.concat_ws(":", "run_id", "url")))
    if max_pages is not None:
        visits = cand.within_budget(visits, ["page_order"], max_pages)
    visits = cut_lineage(visits)
    texts = visits.filter("processed").withColumn("page_id", F.col("source_id"))
    if target is None:
        extracted = pages.extract_pages(texts, spec, extractor, max_chunks=max_chunks)
        raw = cut_lineage(pages.records_of(extracted, spec))
        checked = verify.verify_for_spec(raw, texts, spec).withColumn("source_id", F.col("page_id"))
        verified = cut_lineage(checked)
    else:
        extracted, verified, stops = extract_until(texts, spec, extractor, target, first_wave, max_chunks, **options)
        visits = cand.until_stop(visits, stops)
    dataset = build_dataset(verified.filter("verified").drop("verified", "n_nulled", "page_id"), spec, **options)
    audited = visits.select(
        "source_id", F.col("run_id").cast("string").alias("run_id"), "url", "domain", "status", "http_status",
        F.coalesce("fail_reason", F.when(~F.col("allowed"), F.col("reason"))).alias("reason"),
    )
    sources = report.with_records_found(audited, verified)
    stats = report.run_stats(verified, dataset.validated, dataset.records, sources)
    reasons = report.drop_reasons(sources, verified, dataset.validated)
    return Collected(dataset, sources, verified, stats, reasons, pages.failures_of(extracted))
