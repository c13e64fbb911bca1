"""Candidate URLs of a run: union, first seen, limits, page budget, early stop, second wave."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundset.functions.urls import canonical_url

# Fixed value: records below which a run gets a second wave.
WAVE2_YIELD = 10


def top_per_query(results: DataFrame, limit: int) -> DataFrame:
    """First `limit` results of each query; the limit is applied before the shuffle too."""
    order = Window.partitionBy("run_id", "query_idx").orderBy("rank", "url")
    return results.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")


def first_seen(results: DataFrame, canonical: bool = False) -> DataFrame:
    """One row per (run, URL): the earliest by query, then rank."""
    if canonical:
        results = results.withColumn("url", canonical_url(F.col("url")))
    order = Window.partitionBy("run_id", "url").orderBy("query_idx", "rank")
    kept = results.filter(F.col("url") != "").withColumn("_n", F.row_number().over(order))
    return kept.filter(F.col("_n") == 1).drop("_n")


def merge_waves(first: DataFrame, second: DataFrame) -> DataFrame:
    """Second-wave URLs the run has not seen, after the first wave."""
    fresh = first_seen(second).join(first.select("run_id", "url"), ["run_id", "url"], "left_anti")
    return first.withColumn("wave", F.lit(1)).unionByName(fresh.withColumn("wave", F.lit(2)))


def within_budget(visits: DataFrame, order: list[str], max_pages: int | str) -> DataFrame:
    """Candidates visited before the page budget is used up.

    `processed` marks candidates that cost budget; blocked and failed ones do not. The cut is the
    `max_pages`-th processed candidate. Only as many rows per run as the budget (given as a column
    name: the largest one) are kept ahead of the shuffle.
    """
    place = F.struct(*order)
    own = isinstance(max_pages, str)
    most = (visits.agg(F.max(max_pages)).first()[0] or 0) if own else max_pages
    limit = F.col(max_pages) if own else F.lit(max_pages)
    ranked = visits.filter("processed").select("run_id", place.alias("place"), *([max_pages] if own else []))
    ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("run_id").orderBy("place")))
    ranked = ranked.filter(F.col("_n") <= most)
    cut = (
        ranked.filter(F.col("_n") <= limit)
        .groupBy("run_id")
        .agg(F.max("place").alias("last"), (F.max("_n") >= F.max(limit)).alias("used_up"))
    )
    kept = visits.join(cut, "run_id", "left").filter(
        ~F.coalesce("used_up", F.lit(False)) | (place <= F.col("last"))
    )
    return kept.drop("last", "used_up")


def until_target(pages: DataFrame, first_pages: DataFrame, target: int) -> DataFrame:
    """Pages up to the one on which the run reaches `target` distinct entities.

    `first_pages` holds one row per (run, entity) with `page_order`, the page it first appears on.
    With exact keys the count is an upper bound of the fuzzy one; with leaders only it is the
    merged count itself, because leadership depends on earlier records alone.
    """
    return until_stop(pages, target_pages(first_pages, target))


def target_pages(first_pages: DataFrame, target: int) -> DataFrame:
    """`(run_id, stop)` of the runs that reach `target` entities: the page on which they do."""
    order = Window.partitionBy("run_id").orderBy("page_order", "entity")
    return (
        first_pages.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= target)
        .groupBy("run_id")
        .agg(F.max("page_order").alias("stop"), F.count(F.lit(1)).alias("found"))
        .filter(F.col("found") >= target)
        .select("run_id", "stop")
    )


def until_stop(pages: DataFrame, stops: DataFrame) -> DataFrame:
    """Rows up to the page on which their run stops; runs without a stop keep all."""
    kept = pages.join(stops, "run_id", "left")
    return kept.filter(F.col("stop").isNull() | (F.col("page_order") <= F.col("stop"))).drop("stop")


def second_wave_queries(runs: DataFrame) -> DataFrame:
    """Three follow-up queries for runs whose yield fell short with budget left.

    Expects `run_id, title, entity, target_count, deduped_count, pages_processed, max_pages,
    candidates_left`.
    """
    short = (
        (F.col("candidates_left") == 0)
        & (F.col("deduped_count") < F.least(F.lit(WAVE2_YIELD), F.col("target_count")))
        & (F.col("pages_processed") < F.col("max_pages"))
    )
    topic = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("entity"))
    # The three query wordings.
    queries = F.array(
        F.concat(topic, F.lit(" list 2026")),
        F.concat(F.lit("top "), topic, F.lit(" directory")),
        F.concat(F.lit("best "), topic, F.lit(" roundup")),
    )
    return runs.filter(short).select(
        "run_id",
        (F.col("max_pages") - F.col("pages_processed")).alias("remaining_budget"),
        F.posexplode(queries).alias("query_idx", "query"),
    )
