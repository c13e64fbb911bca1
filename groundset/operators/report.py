"""Run statistics, funnel, trust signals, completeness, source summary and diagnostics.

Everything is computed for all runs at once, keyed by `run_id`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Pass marks of the trust signals and the diagnostics gate.
VERIFICATION_RATE_PASS = 0.60
DIVERSITY_PASS = 0.25
CONCENTRATION_PASS = 0.60
COMPLETENESS_PASS = 1.00
DOMAINS_FOR_FULL_DIVERSITY = 4
LOW_YIELD_SHARE = 0.5
MANY_FAILURES = 2

STAT_COUNTS = (
    "raw_count", "verified_count", "valid_count", "deduped_count",
    "pages_fetched", "pages_failed", "hallucinated_count", "fields_nulled",
)


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def run_stats(verified: DataFrame, validated: DataFrame, records: DataFrame, sources: DataFrame) -> DataFrame:
    """Stage counts per run, each stage reduced to one row per run before they meet."""
    v = verified.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("raw_count"),
        _count(F.col("verified")).alias("verified_count"),
        _count(~F.col("verified")).alias("hallucinated_count"),
        F.sum("n_nulled").alias("fields_nulled"),
    )
    ok = validated.groupBy("run_id").agg(_count(F.col("reject_reason").isNull()).alias("valid_count"))
    d = records.groupBy("run_id").agg(F.count(F.lit(1)).alias("deduped_count"))
    s = sources.groupBy("run_id").agg(
        _count(F.col("status") == "fetched").alias("pages_fetched"),
        _count(F.col("status") == "failed").alias("pages_failed"),
    )
    joined = s.join(v, "run_id", "full").join(ok, "run_id", "full").join(d, "run_id", "full")
    return joined.select("run_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in STAT_COUNTS])


def with_records_found(sources: DataFrame, verified: DataFrame) -> DataFrame:
    """Sources with the number of verified records each one gave."""
    found = verified.filter("verified").groupBy("source_id").agg(F.count(F.lit(1)).alias("_found"))
    joined = sources.join(found, "source_id", "left")
    return joined.withColumn("records_found", F.coalesce("_found", F.lit(0))).drop("_found")


def drop_reasons(sources: DataFrame, verified: DataFrame, validated: DataFrame) -> DataFrame:
    """Long histogram `(run_id, reason, n)` of everything that left the flow."""
    status = F.col("status")
    of_sources = sources.select(
        "run_id",
        F.when(status.isin("blocked_by_policy", "blocked_by_robots"), status)
        .when(status == "failed", "fetch_failed").alias("reason"),
    )
    mismatches = verified.filter(~F.col("verified")).select("run_id", F.lit("evidence_mismatch").alias("reason"))
    missing = validated.filter(F.col("reject_reason").isNotNull()).select(
        "run_id", F.lit("missing_required").alias("reason")
    )
    every = of_sources.filter(F.col("reason").isNotNull()).unionByName(mismatches).unionByName(missing)
    return every.groupBy("run_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def drop_reason_map(reasons: DataFrame) -> DataFrame:
    """One map per run; there are only five reasons."""
    entries = F.array_sort(F.collect_list(F.struct("reason", "n")))
    return reasons.groupBy("run_id").agg(F.map_from_entries(entries).alias("dropped_reasons"))


def funnel(stats: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Four stages per run with what each dropped and why."""
    raw, verified, valid, deduped = (
        F.col(c) for c in ("raw_count", "verified_count", "valid_count", "deduped_count")
    )
    if reasons is not None:
        missing = reasons.filter(F.col("reason") == "missing_required").select(
            "run_id", F.col("n").alias("missing_required")
        )
        stats = stats.join(missing, "run_id", "left")
    else:
        stats = stats.withColumn("missing_required", F.lit(None).cast("bigint"))
    none = F.create_map().cast("map<string,bigint>")

    def stage(i, label, count, dropped, why):
        return F.struct(
            F.lit(i).alias("stage"), F.lit(label).alias("label"), count.cast("bigint").alias("count"),
            dropped.cast("bigint").alias("dropped"), why.alias("drop_reasons"),
        )

    # Stage labels and reason names.
    stages = F.array(
        stage(0, "Raw extracted", raw, F.lit(0), none),
        stage(1, "Verified", verified, raw - verified,
              F.create_map(F.lit("evidence_mismatch"), F.col("hallucinated_count").cast("bigint"))),
        stage(2, "Valid", valid, verified - valid,
              F.when(F.col("missing_required").isNotNull(),
                     F.create_map(F.lit("missing_required"), F.col("missing_required").cast("bigint"))).otherwise(none)),
        stage(3, "Deduplicated", deduped, valid - deduped,
              F.create_map(F.lit("duplicate_merged"), (valid - deduped).cast("bigint"))),
    )
    return stats.select("run_id", F.inline(stages))


def domain_shares(sources: DataFrame) -> DataFrame:
    """Per run: share of the top fetched domain and number of domains with records."""
    fetched = sources.filter((F.col("status") == "fetched") & (F.coalesce("domain", F.lit("")) != ""))
    per_domain = fetched.groupBy("run_id", "domain").agg(F.sum("records_found").alias("n"))
    return per_domain.groupBy("run_id").agg(
        F.max("n").alias("top"), F.sum("n").alias("total"), _count(F.col("n") > 0).alias("domains")
    )


def present(data: Column, name: str | Column) -> Column:
    return F.coalesce(F.try_element_at(data, F.lit(name) if isinstance(name, str) else name), F.lit("")) != ""


def required_completeness(records: DataFrame, fields: DataFrame) -> DataFrame:
    """Per run: share of records whose required fields are all present.

    `records.data` is a text map; `fields` the long field table. A run has few fields, so its
    required names travel as one short array.
    """
    required = (
        fields.filter("required").groupBy("run_id").agg(F.sort_array(F.collect_set("name")).alias("names"))
    )
    whole = F.forall("names", lambda n: present(F.col("data"), n))
    return (
        records.select("run_id", "data")
        .join(required, "run_id")
        .groupBy("run_id")
        .agg(_count(whole).alias("complete"), F.count(F.lit(1)).alias("n_records"))
        .select("run_id", (F.col("complete") / F.col("n_records")).alias("required_completeness"))
    )


def trust_signals(stats: DataFrame, sources: DataFrame, records: DataFrame, fields: DataFrame) -> DataFrame:
    """Four signals per run with value, threshold and verdict."""
    df = (
        stats.join(domain_shares(sources), "run_id", "left")
        .join(required_completeness(records, fields), "run_id", "left")
    )
    rate = F.when(F.col("raw_count") > 0, F.col("verified_count") / F.col("raw_count")).otherwise(0.0)
    share = F.when(F.col("total") > 0, F.col("top") / F.col("total")).otherwise(0.0)
    spread = F.least(F.lit(1.0), F.coalesce("domains", F.lit(0)) / F.lit(float(DOMAINS_FOR_FULL_DIVERSITY)))
    diversity = F.when(F.col("deduped_count") > 0, spread).otherwise(0.0)
    complete = F.coalesce("required_completeness", F.lit(1.0))

    def signal(name, label, formula, value, threshold, passed):
        return F.struct(
            F.lit(name).alias("name"), F.lit(label).alias("label"), F.lit(formula).alias("formula"),
            F.bround(value, 3).alias("value"), F.lit(threshold).alias("threshold"), passed.alias("passed"),
        )

    # Names, labels and formulas as the report prints them.
    signals = F.array(
        signal("verification_rate", "Verification rate", "verified ÷ raw", rate,
               VERIFICATION_RATE_PASS, rate >= VERIFICATION_RATE_PASS),
        signal("corroboration", "Source diversity", "distinct fetched domains with records ÷ 4", diversity,
               DIVERSITY_PASS, diversity >= DIVERSITY_PASS),
        signal("source_concentration", "Source concentration", "records from top domain ÷ total sourced", share,
               CONCENTRATION_PASS, share <= CONCENTRATION_PASS),
        signal("required_completeness", "Required completeness", "records with all required fields ÷ total", complete,
               COMPLETENESS_PASS, complete >= COMPLETENESS_PASS),
    )
    return df.select("run_id", F.inline(signals))


def field_completeness(records: DataFrame, fields: DataFrame) -> DataFrame:
    """Filled share of each declared field, `(run_id, ordinal, name, non_null_count, total, share)`.

    Only filled entries are counted, combined per (run, field) before the shuffle.
    """
    filled = (
        records.select("run_id", F.explode(F.map_filter("data", lambda k, v: F.coalesce(v, F.lit("")) != "")).alias("name", "v"))
        .groupBy("run_id", "name")
        .agg(F.count(F.lit(1)).alias("filled"))
    )
    totals = records.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    df = fields.join(filled, ["run_id", "name"], "left").join(totals, "run_id", "left")
    filled_n, total = F.coalesce("filled", F.lit(0)), F.coalesce("n", F.lit(0))
    return df.select(
        "run_id", "ordinal", "name",
        filled_n.cast("bigint").alias("non_null_count"), total.cast("bigint").alias("total"),
        F.when(total > 0, F.bround(filled_n / total, 3)).otherwise(0.0).alias("share"),
    )


def sources_summary(sources: DataFrame) -> DataFrame:
    status = F.col("status")
    return sources.groupBy("run_id").agg(
        _count(status == "fetched").alias("fetched"),
        _count(status == "blocked_by_policy").alias("blocked_by_policy"),
        _count(status == "blocked_by_robots").alias("blocked_by_robots"),
        _count(status == "failed").alias("failed"),
        _count(status == "via_search_provider").alias("via_search_provider"),
        F.count(F.lit(1)).alias("total"),
    )


def low_yield(stats: DataFrame, share: float = LOW_YIELD_SHARE) -> DataFrame:
    """Runs under half of their target."""
    return stats.filter(F.col("deduped_count") < F.col("target_count") * share)


def diagnostics(stats: DataFrame, sources: DataFrame, gate: float | None = LOW_YIELD_SHARE) -> DataFrame:
    """Why a run found little: `(run_id, position, rule, severity, message, action)`.

    `stats` needs the stage counts, `target_count`, `filters` (map) and `missing_required`. With a
    gate only runs below that share of their target are explained.
    """
    if gate is not None:
        stats = low_yield(stats, gate)
    status = F.col("status")
    blocked = status.isin("blocked_by_policy", "blocked_by_robots")
    no_text = (status == "failed") & F.lower("reason").contains("insufficient text")
    s = sources.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_sources"),
        _count(blocked).alias("n_blocked"),
        _count(status == "failed").alias("n_failed"),
        _count(no_text).alias("n_no_text"),
    )
    df = stats.join(s, "run_id", "left").fillna(0, ["n_sources", "n_blocked", "n_failed", "n_no_text"])
    n, b, f = F.col("n_sources"), F.col("n_blocked"), F.col("n_failed")
    raw, verified, valid, deduped = (
        F.col(c) for c in ("raw_count", "verified_count", "valid_count", "deduped_count")
    )
    target, fetched = F.col("target_count"), F.col("pages_fetched")
    entries = F.transform(F.map_entries("filters"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    filters = F.coalesce(F.nullif(F.array_join(entries, ", "), F.lit("")), F.lit("none"))
    missing = F.coalesce("missing_required", F.lit(0))

    def words(*parts):
        return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])

    def rule(when, name, severity, message, action=None):
        return F.when(
            when,
            F.struct(
                F.lit(name).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"),
                F.lit(action).cast("string").alias("action"),
            ),
        )

    all_blocked = (n > 0) & (b == n)
    # Rule names, severities and messages, in order.
    found = F.array_compact(
        F.array(
            rule(all_blocked, "all_blocked", "warning",
                 words("All ", n, " pages were blocked by robots.txt or policy."),
                 "Try adding your own pages as seed URLs."),
            rule(~all_blocked & (fetched == 0) & (F.col("n_no_text") > 0), "no_text", "warning",
                 words("These pages probably need JavaScript to load. No usable text was extracted.")),
            rule(~all_blocked & (fetched > 0) & (raw == 0), "no_extracted", "warning",
                 words("No page contained matching records. Your filters may be too strict: ", filters, "."),
                 "Edit filters in the plan."),
            rule(~all_blocked & (raw > 0) & (verified == 0), "all_hallucinated", "warning",
                 words(raw, " records were dropped because their proof was not on the page."),
                 "View the Report for details."),
            rule(~all_blocked & (verified > 0) & (valid == 0), "all_invalid", "warning",
                 words("Required fields were missing from all ", verified, " verified records.",
                       F.when(missing > 0, words(" (", missing, " dropped for missing required fields.)")).otherwise("")),
                 "Edit the required fields in the plan."),
            rule(~all_blocked & (deduped > 0) & (deduped < target), "below_target", "info",
                 words("Found ", deduped, " of ", target, " requested records. Sources ran out."),
                 "Try finding more records."),
            rule(~all_blocked & (b > 0) & (b < n), "some_blocked", "info",
                 words(b, " of ", n, " pages (", F.bround(b / n * 100, 0).cast("bigint"), "%) were blocked.")),
            rule(~all_blocked & (f > MANY_FAILURES), "many_failures", "info", words(f, " pages failed to load.")),
        )
    )
    return df.select("run_id", F.posexplode(found).alias("position", "d")).select("run_id", "position", "d.*")


def currency_mismatches(records: DataFrame) -> DataFrame:
    """Runs with records whose flags name a currency clash, and how many."""
    clash = F.exists("flags", lambda f: f.contains("currency_mismatch"))
    return (
        records.groupBy("run_id").agg(_count(clash).alias("n_mismatched")).filter(F.col("n_mismatched") > 0)
    )


def platform_totals(tasks: DataFrame, runs: DataFrame, records: DataFrame, sources: DataFrame) -> DataFrame:
    """One row of totals. Every table is reduced to one row, the rows are stacked and summed."""
    names = ("tasks", "runs", "records_verified", "sources_checked", "unsupported_records_blocked")

    def row(df, name, value):
        return df.agg(F.coalesce(value, F.lit(0)).cast("bigint").alias("v")).select(
            *[(F.col("v") if n == name else F.lit(0).cast("bigint")).alias(n) for n in names]
        )

    one = F.count(F.lit(1))
    blocked = F.sum(stat(parsed_stats(F.col("stats"))["hallucinated_count"]))
    parts = [
        row(tasks, names[0], one), row(runs, names[1], one), row(records, names[2], one),
        row(sources, names[3], one), row(runs, names[4], blocked),
    ]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    return stacked.agg(*[F.sum(n).alias(n) for n in names])


def parsed_stats(stats_json: Column) -> Column:
    """Stats JSON read once, values as text: bad JSON gives null, an odd value spoils only itself."""
    fields = ", ".join(f"{c} string" for c in STAT_COUNTS)
    return F.from_json(stats_json, f"{fields}, dropped_reasons map<string,string>")


def stat(value: Column) -> Column:
    """A count, 0 where it cannot be read."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0))


def stats_columns(runs: DataFrame) -> DataFrame:
    """Stats JSON to columns, tolerant of bad JSON, plus `missing_required` from the drop reasons."""
    s = F.col("_stats")
    return runs.withColumn("_stats", parsed_stats(F.col("stats"))).select(
        *runs.columns,
        *[stat(s[c]).alias(c) for c in STAT_COUNTS],
        stat(F.try_element_at(s["dropped_reasons"], F.lit("missing_required"))).alias("missing_required"),
    )


def dashboard_counters(stats: DataFrame) -> DataFrame:
    return stats.select(
        "run_id", F.col("raw_count").alias("raw"), F.col("verified_count").alias("verified"),
        F.col("valid_count").alias("valid"), F.col("deduped_count").alias("deduped"),
        F.col("hallucinated_count").alias("blocked"),
    )


def progress_percent(status: Column, deduped: Column, target: Column) -> Column:
    done = F.floor(deduped * 100 / F.when(target > 0, target).otherwise(30) + 0.5).cast("bigint")
    return F.when(status == "completed", F.lit(100)).otherwise(F.least(F.lit(95), done)).cast("bigint")


def duration_seconds(started: Column, finished: Column) -> Column:
    seconds = (F.unix_millis(finished) - F.unix_millis(started)) / 1000
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0), F.floor(seconds + 0.5)).cast("bigint"))


def run_timing(events: DataFrame) -> DataFrame:
    """Seconds to the first records and in total per run, one decimal.

    `events` needs `run_id, created_at, step, record_count`.
    """
    at = F.unix_micros("created_at") / 1e6
    first = F.min(F.when((F.col("step") == "records_updated") & (F.col("record_count") > 0), at))
    return (
        events.groupBy("run_id")
        .agg(F.min(at).alias("start"), F.max(at).alias("end"), first.alias("first"))
        .select(
            "run_id",
            F.bround(F.col("first") - F.col("start"), 1).alias("first_record_seconds"),
            F.bround(F.col("end") - F.col("start"), 1).alias("duration_seconds"),
        )
    )


def stage_checklist(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Six stages per run, each done or active, from the steps seen and the last one."""
    seen = ("search", "fetch", "extract", "validate", "dedupe")
    facts = events.groupBy("run_id").agg(
        F.max_by("step", "id").alias("last"),
        *[F.bool_or(F.col("step") == s).alias(f"saw_{s}") for s in seen],
    )
    df = runs.select("run_id", "status").join(facts, "run_id", "left").withColumn("last", F.coalesce("last", F.lit("init")))
    over = F.col("status").isin("completed", "failed", "cancelled")

    def stage(i, name, after, active):
        done = over
        for s in after:
            done = done | F.coalesce(f"saw_{s}", F.lit(False))
        return F.struct(
            F.lit(i).alias("stage"), F.lit(name).alias("name"), done.alias("done"),
            (~over & F.col("last").isin(*active)).alias("active"),
        )

    clean = F.struct(
        F.lit(5).alias("stage"), F.lit("clean").alias("name"), (F.col("status") == "completed").alias("done"),
        (~over & F.col("last").isin("dedupe", "validate")).alias("active"),
    )
    # Stages, the steps that finish them and the steps that mark them active.
    stages = F.array(
        stage(0, "understand", ("search", "fetch"), ("init", "preview")),
        stage(1, "search", ("fetch", "extract"), ("search",)),
        stage(2, "fetch", ("extract", "dedupe"), ("fetch",)),
        stage(3, "extract", ("validate", "dedupe"), ("extract",)),
        stage(4, "verify", ("dedupe",), ("verify",)),
        clean,
    )
    return df.select("run_id", F.inline(stages))


def top_records(records: DataFrame, n: int = 5) -> DataFrame:
    """Preview: the `n` most confident records of each run."""
    order = Window.partitionBy("run_id").orderBy(F.col("confidence").desc(), "record_id")
    return records.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
