"""Checked queries: reports, overviews, pages, provenance, exports and store maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundset.operators import report, views
from groundset.plans import reports
from groundset.plans import sqltext as q
from groundset.plans.catalog import query
from groundset.plans.derived import base, derived, derived_sql
from groundset.session import scratch_path
from groundset.sinks import store as sink
from groundset.sinks.exports import source_sheet
from groundset.sources.store import read_candidates, read_current, read_pages, read_table, rejected_candidates

_RUNS, _RECORDS, _SOURCES, _EVIDENCE, _EVENTS, _TASKS = (
    derived_sql(n) for n in ("runs", "records", "sources", "evidence", "run_events", "tasks")
)

# Stats as columns; unreadable JSON counts as zero.
_STATS = f"""{_RUNS}, stats as (select run_id, task_id, status, {', '.join(
    f"case when stats like '{{%' then coalesce(try_cast(json_extract_string(case when stats like '{{%' then stats end, '$.{c}') as bigint), 0) else 0 end as {c}"
    for c in report.STAT_COUNTS)},
    case when stats like '{{%' then coalesce(try_cast(json_extract_string(case when stats like '{{%' then stats end, '$.dropped_reasons.missing_required') as bigint), 0) else 0 end as missing_required,
    case when stats like '{{%' then try_cast(json_extract_string(case when stats like '{{%' then stats end, '$.duration_seconds') as double) end as duration_seconds
    from runs)"""
_SUMMARY = f"""{_SOURCES}, summary as (select run_id, count(*) filter (status = 'fetched') as fetched,
    count(*) filter (status = 'blocked_by_policy') as blocked_by_policy, count(*) filter (status = 'blocked_by_robots') as blocked_by_robots,
    count(*) filter (status = 'failed') as failed, count(*) filter (status = 'via_search_provider') as via_search_provider, count(*) as total,
    count(*) filter (status = 'failed' and lower(reason) like '%insufficient text%') as no_text from sources group by run_id)"""


def _stats(spark, sf):
    return report.stats_columns(derived(spark, sf, "runs"))


def _records(spark, sf):
    df = derived(spark, sf, "records")
    data = F.create_map(F.lit("name"), F.col("name"), F.lit("funding"), F.col("funding"))
    flags = F.filter(F.array("flag"), lambda f: f != "")
    return df.select("record_id", "run_id", data.alias("data"), "confidence", flags.alias("flags"), "created_at")


def _fields(spark, sf):
    """Both fields of the records, declared for every run."""
    both = F.array(
        F.struct(F.lit(0).alias("ordinal"), F.lit("name").alias("name"), F.lit(True).alias("required")),
        F.struct(F.lit(1).alias("ordinal"), F.lit("funding").alias("name"), (F.col("o_orderkey") % 2 == 0).alias("required")),
    )
    orders = base(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), "o_orderkey")
    return orders.select("run_id", F.inline(both))


@query("stats_scan", f"with {_STATS} select run_id, raw_count, deduped_count, hallucinated_count, missing_required from stats")
def stats_scan(spark, sf):
    return _stats(spark, sf).select("run_id", "raw_count", "deduped_count", "hallucinated_count", "missing_required")


@query(
    "funnel",
    f"""with {_STATS} select run_id, 0 as stage, 'Raw extracted' as label, raw_count as count, 0::bigint as dropped, '' as reasons from stats
    union all select run_id, 1, 'Verified', verified_count, raw_count - verified_count, 'evidence_mismatch=' || hallucinated_count from stats
    union all select run_id, 2, 'Valid', valid_count, verified_count - valid_count, case when missing_required > 0 then 'missing_required=' || missing_required else '' end from stats
    union all select run_id, 3, 'Deduplicated', deduped_count, valid_count - deduped_count, 'duplicate_merged=' || (valid_count - deduped_count) from stats""",
)
def funnel(spark, sf):
    stats = _stats(spark, sf)
    reasons = stats.filter("missing_required > 0").select(
        "run_id", F.lit("missing_required").alias("reason"), F.col("missing_required").alias("n")
    )
    rows = report.funnel(stats.drop("missing_required"), reasons)
    shown = F.transform(F.map_entries("drop_reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rows.select("run_id", "stage", "label", "count", "dropped", F.array_join(shown, ",").alias("reasons"))


@query(
    "trust_signals",
    f"""with {_STATS}, {_SOURCES}, {_RECORDS}, dom as (select run_id, domain, sum(records_found) as n from sources where status = 'fetched' group by 1, 2),
    share as (select run_id, max(n)::double as top, sum(n)::double as total, count(*) filter (n > 0) as domains from dom group by 1),
    comp as (select run_id, avg((name <> '' and (run_id::bigint % 2 <> 0 or coalesce(funding, '') <> ''))::int::double) as c from records group by 1),
    v as (select s.run_id, case when raw_count > 0 then verified_count / raw_count::double else 0 end as rate,
      case when deduped_count > 0 then least(1.0::double, coalesce(domains, 0) / 4.0::double) else 0 end as diversity,
      case when total > 0 then top / total else 0 end as concentration, coalesce(c, 1.0) as complete
      from stats s left join share on share.run_id = s.run_id left join comp on comp.run_id = s.run_id)
    select run_id, 'verification_rate' as name, round_even(rate, 3) as value, rate >= 0.6::double as passed from v
    union all select run_id, 'corroboration', round_even(diversity, 3), diversity >= 0.25::double from v
    union all select run_id, 'source_concentration', round_even(concentration, 3), concentration <= 0.6::double from v
    union all select run_id, 'required_completeness', round_even(complete, 3), complete >= 1.0::double from v""",
)
def trust_signals(spark, sf):
    rows = report.trust_signals(_stats(spark, sf), derived(spark, sf, "sources"), _records(spark, sf), _fields(spark, sf))
    return rows.select("run_id", "name", "value", "passed")


@query(
    "field_completeness",
    f"""with {_RECORDS}, t as (select run_id, count(*) as total, count(*) filter (name <> '') as n0, count(*) filter (funding <> '') as n1 from records group by 1),
    a as (select cast(o_orderkey as varchar) as run_id from orders), j as (select a.run_id, coalesce(total, 0) as total, coalesce(n0, 0) as n0, coalesce(n1, 0) as n1 from a left join t on t.run_id = a.run_id)
    select run_id, 0 as ordinal, 'name' as name, n0 as non_null_count, total, case when total > 0 then round_even(n0 / total::double, 3) else 0 end as share from j
    union all select run_id, 1, 'funding', n1, total, case when total > 0 then round_even(n1 / total::double, 3) else 0 end from j""",
)
def field_completeness(spark, sf):
    return report.field_completeness(_records(spark, sf), _fields(spark, sf))


@query(
    "sources_summary",
    f"with {_SUMMARY} select run_id, fetched, blocked_by_policy, blocked_by_robots, failed, via_search_provider, total from summary",
)
def sources_summary(spark, sf):
    return report.sources_summary(derived(spark, sf, "sources"))


_DIAGNOSTICS = f"""{_STATS}, {_SUMMARY}, d as (select s.*, coalesce(m.total, 0) as n, coalesce(m.blocked_by_policy + m.blocked_by_robots, 0) as b,
      coalesce(m.failed, 0) as f, coalesce(m.no_text, 0) as nt, 12 as target from stats s left join summary m on m.run_id = s.run_id),
    e as (select *, n > 0 and b = n as allb from d where deduped_count < 6),
    rules as (
      select run_id, 0 as o, 'all_blocked' as rule, 'warning' as severity, 'All ' || n || ' pages were blocked by robots.txt or policy.' as message, 'Try adding your own pages as seed URLs.' as action from e where allb
      union all select run_id, 1, 'no_text', 'warning', 'These pages probably need JavaScript to load. No usable text was extracted.', null from e where not allb and pages_fetched = 0 and nt > 0
      union all select run_id, 2, 'no_extracted', 'warning', 'No page contained matching records. Your filters may be too strict: city: Pune.', 'Edit filters in the plan.' from e where not allb and pages_fetched > 0 and raw_count = 0
      union all select run_id, 3, 'all_hallucinated', 'warning', raw_count || ' records were dropped because their proof was not on the page.', 'View the Report for details.' from e where not allb and raw_count > 0 and verified_count = 0
      union all select run_id, 4, 'all_invalid', 'warning', 'Required fields were missing from all ' || verified_count || ' verified records.'
        || case when missing_required > 0 then ' (' || missing_required || ' dropped for missing required fields.)' else '' end, 'Edit the required fields in the plan.' from e where not allb and verified_count > 0 and valid_count = 0
      union all select run_id, 5, 'below_target', 'info', 'Found ' || deduped_count || ' of ' || target || ' requested records. Sources ran out.', 'Try finding more records.' from e where not allb and deduped_count > 0 and deduped_count < target
      union all select run_id, 6, 'some_blocked', 'info', b || ' of ' || n || ' pages (' || cast(round_even(b / n::double * 100, 0) as bigint) || '%) were blocked.', null from e where not allb and b > 0 and b < n
      union all select run_id, 7, 'many_failures', 'info', f || ' pages failed to load.', null from e where not allb and f > 2)"""


@query("diagnostics", f"with {_DIAGNOSTICS} select run_id, cast(row_number() over (partition by run_id order by o) - 1 as int) as position, rule, severity, message, action from rules")
def diagnostics(spark, sf):
    stats = _stats(spark, sf).withColumn("target_count", F.lit(12)).withColumn(
        "filters", F.create_map(F.lit("city"), F.lit("Pune"))
    )
    return report.diagnostics(stats, derived(spark, sf, "sources"))


@query("low_yield_runs", f"with {_STATS} select run_id, deduped_count from stats where deduped_count < 15")
def low_yield_runs(spark, sf):
    return report.low_yield(_stats(spark, sf).withColumn("target_count", F.lit(30))).select("run_id", "deduped_count")


@query(
    "platform_stats",
    f"""with {_STATS}, {_TASKS}, {_RECORDS}, {_SOURCES} select (select count(*) from tasks) as tasks, (select count(*) from runs) as runs,
    (select count(*) from records) as records_verified, (select count(*) from sources) as sources_checked,
    cast((select sum(hallucinated_count) from stats) as bigint) as unsupported_records_blocked""",
)
def platform_stats(spark, sf):
    frames = [derived(spark, sf, n) for n in ("tasks", "runs", "records", "sources")]
    return report.platform_totals(*frames)


@query("dashboard_counters", f"with {_STATS} select run_id, raw_count as raw, verified_count as verified, valid_count as valid, deduped_count as deduped, hallucinated_count as blocked from stats")
def dashboard_counters(spark, sf):
    return report.dashboard_counters(_stats(spark, sf))


@query(
    "run_progress",
    f"""with {_STATS}, t as (select s.*, r.started_at, r.finished_at from stats s join runs r on r.run_id = s.run_id)
    select run_id, case when status = 'completed' then 100 else least(95, cast(floor(deduped_count * 100 / 30.0::double + 0.5) as bigint)) end as progress,
    case when finished_at is not null and started_at is not null then cast(cast(greatest(0, floor((epoch_ms(finished_at) - epoch_ms(started_at)) / 1000.0::double + 0.5)) as bigint) as varchar) end as seconds from t""",
)
def run_progress(spark, sf):
    df = _stats(spark, sf)
    seconds = report.duration_seconds(F.col("started_at").cast("timestamp"), F.col("finished_at").cast("timestamp"))
    return df.select(
        "run_id", report.progress_percent(F.col("status"), F.col("deduped_count"), F.lit(30)).alias("progress"),
        seconds.cast("string").alias("seconds"),
    )


@query(
    "run_timing",
    f"""with {_EVENTS}, t as (select run_id, min(epoch_us(created_at)) / 1e6::double as s, max(epoch_us(created_at)) / 1e6::double as e,
      min(epoch_us(created_at)) filter (step = 'records_updated' and record_count > 0) / 1e6::double as f from run_events group by 1)
    select run_id, round_even(f - s, 1) as first_record_seconds, round_even(e - s, 1) as duration_seconds from t""",
)
def run_timing(spark, sf):
    events = derived(spark, sf, "run_events").withColumn("created_at", F.col("created_at").cast("timestamp"))
    return report.run_timing(events)


@query(
    "stage_checklist",
    f"""with {_EVENTS}, {_RUNS}, f as (select run_id, arg_max(step, id) as last, bool_or(step = 'search') as s, bool_or(step = 'fetch') as f,
      bool_or(step = 'extract') as x, bool_or(step = 'validate') as v, bool_or(step = 'dedupe') as d from run_events group by 1),
    j as (select r.run_id, coalesce(last, 'init') as last, coalesce(s, false) as s, coalesce(f, false) as f, coalesce(x, false) as x,
      coalesce(v, false) as v, coalesce(d, false) as d, r.status in ('completed', 'failed', 'cancelled') as over, r.status = 'completed' as comp
      from runs r left join f on f.run_id = r.run_id)
    select run_id, 0 as stage, 'understand' as name, over or s or f as done, not over and last in ('init', 'preview') as active from j
    union all select run_id, 1, 'search', over or f or x, not over and last = 'search' from j
    union all select run_id, 2, 'fetch', over or x or d, not over and last = 'fetch' from j
    union all select run_id, 3, 'extract', over or v or d, not over and last = 'extract' from j
    union all select run_id, 4, 'verify', over or d, not over and last = 'verify' from j
    union all select run_id, 5, 'clean', comp, not over and last in ('dedupe', 'validate') from j""",
)
def stage_checklist(spark, sf):
    return report.stage_checklist(derived(spark, sf, "runs"), derived(spark, sf, "run_events"))


@query(
    "top_records",
    f"with {_RECORDS}, t as (select run_id, record_id, row_number() over (partition by run_id order by confidence desc, record_id) as rank from records) select run_id, record_id, cast(rank as int) as rank from t where rank <= 5",
)
def top_records(spark, sf):
    return report.top_records(_records(spark, sf)).select("run_id", "record_id", "rank")


_LATEST = "select *, row_number() over (partition by task_id order by started_at desc nulls last, run_id) as n from runs"


@query("latest_run", f"with {_RUNS}, t as ({_LATEST}) select task_id, run_id, status from t where n = 1")
def latest_run(spark, sf):
    return views.latest_runs(derived(spark, sf, "runs")).select("task_id", "run_id", "status")


_OVERVIEW = f"""{_TASKS}, {_RUNS}, {_RECORDS}, latest as (select * from ({_LATEST}) where n = 1),
    rc as (select run_id, count(*) as c from records group by 1), tc as (select task_id, count(*) as c from runs group by 1),
    overview as (select t.task_id, coalesce(nullif(json_extract_string(spec, '$.title'), ''), substring(prompt, 1, 50)) as title,
      coalesce(json_extract_string(spec, '$.region'), 'GLOBAL') as region, t.created_at, coalesce(tc.c, 0) as run_count, l.run_id as latest_run_id, l.status as latest_status,
      coalesce(rc.c, 0) as latest_record_count from tasks t left join tc on tc.task_id = t.task_id left join latest l on l.task_id = t.task_id left join rc on rc.run_id = l.run_id)"""
_OVERVIEW_COLUMNS = ["task_id", "title", "region", "run_count", "latest_run_id", "latest_status", "latest_record_count"]


def _overview(spark, sf):
    return views.task_overview(*[derived(spark, sf, n) for n in ("tasks", "runs", "records")])


@query("task_overview", f"with {_OVERVIEW} select {', '.join(_OVERVIEW_COLUMNS)} from overview")
def task_overview(spark, sf):
    return _overview(spark, sf).select(*_OVERVIEW_COLUMNS)


@query("tasks_by_status", f"with {_OVERVIEW} select {', '.join(_OVERVIEW_COLUMNS)} from overview where lower(latest_status) = 'completed'")
def tasks_by_status(spark, sf):
    return views.with_latest_status(_overview(spark, sf), "Completed").select(*_OVERVIEW_COLUMNS)


@query(
    "tasks_page",
    f"with {_OVERVIEW} select {', '.join(_OVERVIEW_COLUMNS)} from overview order by created_at desc, task_id limit 20 offset 40",
)
def tasks_page(spark, sf):
    return views.page_of(_overview(spark, sf), "created_at", "task_id", page=3).select(*_OVERVIEW_COLUMNS)


@query(
    "task_search",
    f"with {_TASKS} select task_id, prompt from tasks where lower(prompt) like '%building%' or lower(spec) like '%building%'",
)
def task_search(spark, sf):
    return views.search_tasks(derived(spark, sf, "tasks"), " BUILDING ").select("task_id", "prompt")


@query(
    "run_summaries",
    f"with {_RUNS}, {_RECORDS}, c as (select run_id, count(*) as n from records group by 1) select r.task_id, r.run_id, r.status, coalesce(n, 0) as record_count from runs r left join c on c.run_id = r.run_id",
)
def run_summaries(spark, sf):
    df = views.run_summaries(derived(spark, sf, "runs"), derived(spark, sf, "records"))
    return df.select("task_id", "run_id", "status", "record_count")


@query(
    "effective_spec",
    f"with {_RUNS}, {_TASKS} select r.run_id, coalesce(nullif(nullif(run_spec, '{{}}'), ''), t.spec) as spec from runs r left join tasks t on t.task_id = r.task_id",
)
def effective_spec(spark, sf):
    return views.effective_spec(derived(spark, sf, "runs"), derived(spark, sf, "tasks")).select("run_id", "spec")


@query(
    "records_page",
    f"""with {_RECORDS}, t as (select run_id, record_id, confidence, row_number() over (partition by run_id order by confidence desc, record_id) as n from records)
    select run_id, record_id, confidence, cast(n as int) as position from t where n > 2 and n <= 4""",
)
def records_page(spark, sf):
    page = views.page_per_run(_records(spark, sf), page=2, page_size=2)
    return page.select("run_id", "record_id", "confidence", "position")


@query(
    "record_totals",
    f"with {_RECORDS} select run_id, count(*) as total, cast(greatest(1, ceil(count(*) / 2.0)) as bigint) as total_pages from records group by 1",
)
def record_totals(spark, sf):
    return views.totals_per_run(_records(spark, sf), page_size=2)


@query(
    "records_filter",
    f"with {_RECORDS} select run_id, record_id from records where confidence >= 0.5::double and (contains(lower(name), 'rt 1') or contains(lower(coalesce(funding, '')), 'rt 1'))",
)
def records_filter(spark, sf):
    return views.filter_records(_records(spark, sf), min_confidence=0.5, q="RT 1").select("run_id", "record_id")


@query("project_fields", f"with {_RECORDS} select record_id, coalesce(funding, '') as funding, '' as missing from records")
def project_fields(spark, sf):
    return views.project_fields(_records(spark, sf), ["funding", "missing"]).select("record_id", "funding", "missing")


@query(
    "audit_sources",
    f"with {_SOURCES} select source_id, status from sources where contains(status, 'blocked')",
)
def audit_sources(spark, sf):
    return views.audit_sources(derived(spark, sf, "sources"), "BLOCKED").select("source_id", "status")


@query(
    "source_sheet",
    f"""with {_SOURCES} select run_id, {q.safe_cell('url')} as url, domain, status, '' as http_status, reason, records_found,
    strftime(fetched_at, '%Y-%m-%dT%H:%M:%S') as fetched_at from sources""",
)
def sources_listed(spark, sf):
    sources = derived(spark, sf, "sources").withColumn("http_status", F.lit(None).cast("int"))
    return source_sheet(sources)


_PROVENANCE = f"""{_RECORDS}, {_EVIDENCE}, {_SOURCES}, links as (select e.record_id, string_agg(s.url, ' | ' order by position, s.url) as source_urls
      from evidence e join sources s on s.source_id = e.source_id group by 1),
    firsts as (select record_id, arg_min(snippet, position) as evidence from evidence where snippet <> '' group by 1),
    prov as (select r.run_id, r.record_id, r.name, coalesce(r.funding, '') as funding, r.confidence, coalesce(source_urls, '') as source_urls,
      coalesce(f.evidence, '') as evidence, strftime(r.created_at, '%Y-%m-%dT%H:%M:%S') as retrieved_at
      from records r left join links l on l.record_id = r.record_id left join firsts f on f.record_id = r.record_id)"""


def _provenance(spark, sf):
    return views.provenance(_records(spark, sf), derived(spark, sf, "evidence"), derived(spark, sf, "sources"))


@query("provenance", f"with {_PROVENANCE} select run_id, record_id, source_urls, evidence, retrieved_at from prov")
def provenance(spark, sf):
    return _provenance(spark, sf).select("run_id", "record_id", "source_urls", "evidence", "retrieved_at")


@query(
    "export_rows",
    f"with {_PROVENANCE} select run_id, record_id, {q.safe_cell('name')} as name, {q.safe_cell('funding')} as funding, confidence, {q.safe_cell('source_urls')} as source_urls, {q.safe_cell('evidence')} as evidence, retrieved_at from prov",
)
def export_rows(spark, sf):
    return views.export_rows(_provenance(spark, sf), ["name", "funding"])


@query(
    "export_json_rows",
    f"""with {_PROVENANCE} select run_id, record_id, name, confidence, case when evidence <> '' then nullif(trim(split_part(source_urls, '|', 1)), '') end as source_url,
    case when evidence <> '' then evidence end as snippet from prov""",
)
def export_json_rows(spark, sf):
    rows = views.export_json_rows(_provenance(spark, sf), ["name"])
    first = F.try_element_at("evidence", F.lit(1))
    return rows.select(
        "run_id", "record_id", "name", "confidence", first["source_url"].alias("source_url"), first["snippet"].alias("snippet")
    )


@query(
    "report_rows",
    f"""with {_STATS} select run_id, metric, value from (
      select run_id, unnest(['Raw extracted', 'Verified', 'Valid', 'Deduplicated', 'Pages fetched', 'Pages failed', 'Hallucinated dropped', 'Total duration (seconds)']) as metric,
      unnest([raw_count::double, verified_count, valid_count, deduped_count, pages_fetched, pages_failed, hallucinated_count, coalesce(duration_seconds, 0)]) as value from stats)
    where metric not like '%seconds%' or value <> 0""",
)
def report_rows(spark, sf):
    duration = F.get_json_object("stats", "$.duration_seconds").try_cast("double")
    return views.report_rows(_stats(spark, sf).withColumn("duration_seconds", duration)).select("run_id", "metric", "value")


@query(
    "event_payload",
    f"""with {_EVENTS} select run_id, id, case when step = 'records_updated' then 'records_updated' else 'log' end as event,
    '{{"id":' || id || ',"level":"' || level || '","step":"' || step || '","message":"' || message || '","created_at":"'
      || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '"' || case when data <> '' then ',"data":' || replace(data, ' ', '') else '' end || '}}' as payload from run_events""",
)
def event_payload(spark, sf):
    return views.event_payload(derived(spark, sf, "run_events"))


@query("events_after", f"with {_EVENTS} select run_id, id, step from run_events where run_id = '7' and id > 40")
def events_after(spark, sf):
    return views.events_after(derived(spark, sf, "run_events"), "7", 40).select("run_id", "id", "step")


@query(
    "stale_sweep",
    f"with {_RUNS} select run_id, case when status in ('running', 'queued') then 'failed' else status end as status, case when status in ('running', 'queued') then 'Server restarted' else error end as error from runs",
)
def stale_sweep(spark, sf):
    return sink.sweep_stale(derived(spark, sf, "runs")).select("run_id", "status", "error")


@query(
    "sparse_update",
    f"with {_RUNS} select run_id, case when run_id::bigint % 3 = 0 then 'cancelled' else status end as status, case when run_id::bigint % 4 = 0 then 'e' || run_id else error end as error from runs",
)
def sparse_update(spark, sf):
    runs = derived(spark, sf, "runs")
    n = F.col("run_id").cast("bigint")
    updates = runs.select(
        "run_id", F.when(n % 3 == 0, "cancelled").alias("status"), F.when(n % 4 == 0, F.concat(F.lit("e"), "run_id")).alias("error")
    )
    return sink.update_runs(runs, updates).select("run_id", "status", "error")


@query(
    "cascade_delete",
    f"""with {_TASKS}, {_RUNS}, {_RECORDS}, {_SOURCES}, {_EVIDENCE}, {_EVENTS}, gone as (select run_id from runs where task_id::bigint % 10 = 3)
    select 'tasks' as name, count(*) as n from tasks where task_id::bigint % 10 <> 3 union all select 'runs', count(*) from runs where task_id::bigint % 10 <> 3
    union all select 'records', count(*) from records where run_id not in (select run_id from gone)
    union all select 'sources', count(*) from sources where run_id not in (select run_id from gone)
    union all select 'record_evidence', count(*) from evidence where run_id not in (select run_id from gone)
    union all select 'run_events', count(*) from run_events where run_id not in (select run_id from gone)""",
)
def cascade_delete(spark, sf):
    names = {"record_evidence": "evidence"}
    tables = {
        n: derived(spark, sf, names.get(n, n))
        for n in ("tasks", "runs", "records", "sources", "record_evidence", "run_events")
    }
    gone = tables["tasks"].filter(F.col("task_id").cast("bigint") % 10 == 3).select("task_id")
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        for n, df in sink.cascade_delete(tables, gone).items()
    ]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    return stacked


@query(
    "replace_runs",
    f"""with {_RECORDS} select run_id, record_id, case when run_id::bigint % 8 = 0 then 0.25::double else confidence end as confidence
    from records where run_id::bigint % 8 <> 4""",
)
def replace_runs(spark, sf):
    """Write the records of all runs, replace those of every eighth run, empty others, read back."""
    root = scratch_path(spark, "store")
    n = F.col("run_id").cast("bigint") % 8
    rows = _records(spark, sf).withColumn("dedupe_key", F.lit("k"))
    sink.replace_runs({"records": rows}, root, rows, 0)
    again = rows.filter(n == 0).withColumn("confidence", F.lit(0.25))
    sink.replace_runs({"records": again}, root, rows.filter(n.isin(0, 4)), 1)
    return read_current(spark, root, "records").select("run_id", "record_id", "confidence")


@query(
    "compacted_runs",
    f"""with {_RECORDS}, n as (select *, run_id::bigint % 35 as k from records),
    v as (select *, case when k % 7 = 6 then 6 when k % 5 = 0 or k % 7 = 5 then 5 else k % 7 end as version from n)
    select run_id, record_id, 2.0::double * version as confidence from v where l_linenumber > version % 3""",
)
def compacted_runs(spark, sf):
    """Seven replacements of overlapping runs, compacted twice on the way and cleared of old files, then read."""
    root, k = scratch_path(spark, "store"), F.col("run_id").cast("bigint") % 35
    line = F.get(F.split("record_id", "-"), 1).cast("int")
    rows = _records(spark, sf).withColumn("dedupe_key", F.lit("k"))
    for version in range(7):
        touched = (k % 7 == version) | ((k % 5 == 0) if version == 5 else F.lit(version == 0))
        new = rows.filter(touched & (line > version % 3)).withColumn("confidence", F.lit(2.0 * version))
        sink.replace_runs({"records": new}, root, rows.filter(touched), version)
        if version in (2, 5):
            sink.compact(spark, root, version)
            sink.remove_superseded(spark, root)
    return read_current(spark, root, "records").select("run_id", "record_id", "confidence")


# Only task specs are complete; a run's own snapshot here lacks its fields and counts as unusable.
_TARGETS = f"""{_STATS}, {_TASKS}, {_SUMMARY}, spec as (select r.run_id, case when r.run_spec not in ('', '{{}}') or t.task_id is null or cast(t.task_id as bigint) % 10 = 9 then null else cast(t.task_id as bigint) end as k
      from runs r left join tasks t on t.task_id = r.task_id), target as (select run_id, k, case when k is null then 30 else 5 + k % 40 end as target from spec)"""


@query("append_events", f"with {derived_sql('run_events')} select run_id, id, step from run_events")
def append_events(spark, sf):
    """Events appended to the store in two writes, then scanned."""
    root, rows = scratch_path(spark, "store"), derived(spark, sf, "run_events")
    for part in (0, 1):
        sink.append(rows.filter(F.col("id") % 2 == part), root, "run_events")
    return read_table(spark, root, "run_events").select("run_id", "id", "step")


@query("scan_candidates", "select page_id % 4 as run_id, url, substring(html, 1, 5) as title, '' as snippet from pages where url <> ''")
def scan_candidates(spark, sf):
    """Search results as their providers spell them, written as JSON lines and read in one shape."""
    path, page = scratch_path(spark, "results"), F.col("page_id")
    named = [F.when(page % 3 == i, F.col("url")).alias(n) for i, n in enumerate(("url", "href", "link"))]
    rows = base(spark, sf, "pages").select((page % 4).alias("run_id"), *named, F.substring("html", 1, 5).alias("title"))
    rows.write.json(path)
    found = read_candidates(spark, path)
    return found.select(F.col("run_id").cast("bigint").alias("run_id"), "url", "title", "snippet")


@query(
    "rejected_candidates",
    """select case when page_id % 3 = 0 then null else page_id % 4 end as run_id, case when page_id % 3 = 0 then 'broken_line' else 'no_url' end as reason,
      case when page_id % 3 = 0 then '{"url": "' || page_id || '", "rank"' end as line from pages where page_id % 3 < 2""",
)
def rejected(spark, sf):
    """Search results of which a third breaks off in the line and a third names no URL."""
    path, page = scratch_path(spark, "results"), F.col("page_id")
    whole = F.to_json(F.struct((page % 4).alias("run_id"), F.when(page % 3 == 2, F.col("url")).alias("url"), F.lit("t").alias("title")))
    cut = F.concat(F.lit('{"url": "'), page.cast("string"), F.lit('", "rank"'))
    base(spark, sf, "pages").select(F.when(page % 3 == 0, cut).otherwise(whole).alias("value")).write.text(path)
    left = rejected_candidates(spark, path)
    return left.select(F.col("run_id").cast("bigint").alias("run_id"), "reason", "line")


@query("scan_pages", "select url, md5(html) as digest, 200 as http_status, cast(null as varchar) as content_type from pages")
def scan_pages(spark, sf):
    """Pages written without one of the contract's columns and with another, scanned under the contract."""
    path = scratch_path(spark, "pages")
    base(spark, sf, "pages").withColumns({"http_status": F.lit(200), "more": F.lit(1)}).write.parquet(path)
    return read_pages(spark, path).select("url", F.md5("html").alias("digest"), "http_status", "content_type")


_RULES = _DIAGNOSTICS[_DIAGNOSTICS.index("rules as (") :]


@query(
    "diagnosed_runs",
    f"""with {_TARGETS}, d as (select s.*, coalesce(m.total, 0) as n, coalesce(m.blocked_by_policy + m.blocked_by_robots, 0) as b,
      coalesce(m.failed, 0) as f, coalesce(m.no_text, 0) as nt, t.target from stats s join target t on t.run_id = s.run_id left join summary m on m.run_id = s.run_id),
    e as (select *, n > 0 and b = n as allb from d where deduped_count < target * 0.5), {_RULES}
    select run_id, cast(row_number() over (partition by run_id order by o) - 1 as int) as position, rule, severity, message, action from rules""",
)
def diagnosed_runs(spark, sf):
    return reports.diagnose_runs(*[derived(spark, sf, n) for n in ("runs", "tasks", "sources")])


def _trust_report(spark, sf):
    frames = [derived(spark, sf, n) for n in ("runs", "tasks")]
    return reports.trust_report(*frames, _records(spark, sf), derived(spark, sf, "sources"))


@query(
    "trust_report_funnel",
    f"""with {_STATS} select run_id, 0 as stage, raw_count as count, 0::bigint as dropped from stats
    union all select run_id, 1, verified_count, raw_count - verified_count from stats
    union all select run_id, 2, valid_count, verified_count - valid_count from stats
    union all select run_id, 3, deduped_count, valid_count - deduped_count from stats""",
)
def trust_report_funnel(spark, sf):
    return _trust_report(spark, sf).funnel.select("run_id", "stage", "count", "dropped")


@query("trust_report_sources", f"with {_SUMMARY} select run_id, fetched, blocked_by_policy, blocked_by_robots, failed, total from summary")
def trust_report_sources(spark, sf):
    return _trust_report(spark, sf).sources_summary.select(
        "run_id", "fetched", "blocked_by_policy", "blocked_by_robots", "failed", "total"
    )


@query(
    "trust_report_signals",
    f"""with {_TARGETS}, {_RECORDS}, dom as (select run_id, domain, sum(records_found) as n from sources where status = 'fetched' group by 1, 2),
    share as (select run_id, max(n)::double as top, sum(n)::double as total, count(*) filter (n > 0) as domains from dom group by 1),
    held as (select distinct run_id from records),
    v as (select s.run_id, case when raw_count > 0 then verified_count / raw_count::double else 0 end as rate,
      case when deduped_count > 0 then least(1.0::double, coalesce(domains, 0) / 4.0::double) else 0 end as diversity,
      case when total > 0 then top / total else 0 end as concentration,
      case when k is not null and h.run_id is not null then 0.0::double else 1.0::double end as complete
      from stats s left join share on share.run_id = s.run_id left join target g on g.run_id = s.run_id left join held h on h.run_id = s.run_id)
    select run_id, 'verification_rate' as name, round_even(rate, 3) as value, rate >= 0.6::double as passed from v
    union all select run_id, 'corroboration', round_even(diversity, 3), diversity >= 0.25::double from v
    union all select run_id, 'source_concentration', round_even(concentration, 3), concentration <= 0.6::double from v
    union all select run_id, 'required_completeness', round_even(complete, 3), complete >= 1.0::double from v""",
)
def trust_report_signals(spark, sf):
    return _trust_report(spark, sf).trust_signals.select("run_id", "name", "value", "passed")


@query(
    "trust_report_fields",
    f"""with {_TARGETS}, {_RECORDS}, t as (select run_id, count(*) as total from records group by 1)
    select g.run_id, 'company_name' as name, 0::bigint as non_null_count, coalesce(total, 0) as total from target g left join t on t.run_id = g.run_id where k is not null
    union all select g.run_id, 'price', 0::bigint, coalesce(total, 0) from target g left join t on t.run_id = g.run_id where k is not null""",
)
def trust_report_fields(spark, sf):
    return _trust_report(spark, sf).field_completeness.select("run_id", "name", "non_null_count", "total")


@query(
    "record_detail",
    f"""with {_RECORDS}, {_EVIDENCE}, {_SOURCES} select r.record_id, r.confidence, e.snippet, s.url as source_url from records r
    join evidence e on e.record_id = r.record_id left join sources s on s.source_id = e.source_id
    where r.record_id = (select max(record_id) from records)""",
)
def record_detail(spark, sf):
    records = _records(spark, sf)
    wanted = records.agg(F.max("record_id")).first()[0]
    rows = views.record_detail(records, derived(spark, sf, "evidence"), derived(spark, sf, "sources"), wanted)
    return rows.select("record_id", "confidence", "snippet", "source_url")


@query(
    "recent_tasks",
    f"with {_TASKS} select task_id, prompt from tasks order by updated_at desc, task_id limit 3",
)
def recent_tasks(spark, sf):
    return views.page_of(derived(spark, sf, "tasks"), "updated_at", "task_id", page_size=3).select("task_id", "prompt")


@query(
    "records_found",
    f"""with {_SOURCES}, v as (select 's' || cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) || '-' || cast(l_partkey as varchar) || '-' || cast(l_suppkey as varchar) as source_id,
      l_returnflag <> 'N' as verified from lineitem), c as (select source_id, count(*) filter (verified) as n from v group by 1)
    select s.source_id, coalesce(n, 0) as records_found from sources s left join c on c.source_id = s.source_id""",
)
def records_found(spark, sf):
    key = F.concat_ws("-", F.concat(F.lit("s"), F.col("l_orderkey").cast("string")), "l_linenumber", "l_partkey", "l_suppkey")
    verified = base(spark, sf, "lineitem").select(key.alias("source_id"), (F.col("l_returnflag") != "N").alias("verified"))
    return report.with_records_found(derived(spark, sf, "sources"), verified).select("source_id", "records_found")
