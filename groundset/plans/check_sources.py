"""Checked queries: policy, robots, page acceptance, candidates, budgets and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundset.operators import candidates as cand
from groundset.operators import policy
from groundset.operators.pages import accept_pages
from groundset.plans import sqltext as q
from groundset.plans.catalog import query
from groundset.plans.check_expressions import _RAW_URL, raw_urls
from groundset.plans.derived import base, derived, derived_sql, texts
from groundset.sources.robots import robots_rules
from groundset.streaming.throttle import throttle

_HOSTS = f"hosts as (select distinct {q.host('url')} as host from pages)"
_CAND = derived_sql("candidates")
BLOCKED = policy.BLOCKED_HOSTS + ("spam-farm.example.org", "example.net")


@query(
    "policy_gate",
    f"""with urls as (select page_id, {_RAW_URL} as raw from pages), t as (select page_id, regexp_replace(raw, '^ +', '') as u from urls)
    select page_id, {q.policy_reason('u', BLOCKED)} as reason,
      case when {q.policy_reason('u', BLOCKED)} = 'OK' then 'allowed' else 'blocked_by_policy' end as status from t""",
)
def policy_gate(spark, sf):
    df = policy.with_policy(raw_urls(spark, sf), "raw", blocked=BLOCKED)
    status = F.when(F.col("allowed"), "allowed").otherwise(policy.blocked_status(F.col("reason")))
    return df.select("page_id", "reason", status.alias("status"))


def _robots_texts(spark, sf):
    """A robots file per crawled host; its shape depends on the length of the host name."""
    from groundset.functions.urls import host

    hosts = texts(spark, sf, "pages").select(host(F.col("url")).alias("host")).distinct()
    kind = F.length("host") % 4
    body = (
        F.when(kind == 0, F.lit("# all\nUser-agent: *\nAllow: /en/1\nDisallow: /en/ # no english\n"))
        .when(kind == 1, F.lit("User-agent: otherbot\nDisallow: /\n\nUser-agent: *\nDisallow: /de\nDisallow:\n"))
        .when(kind == 2, F.lit("User-agent: *\nDisallow: /\n\nuser-agent: GroundsetBot\nuser-agent: x\nDisallow: /fr/\nSitemap: /s\n"))
        .otherwise(F.lit("User-agent: *\nDisallow: /"))
    )
    return hosts.select("host", body.alias("text"), F.when(kind == 3, 404).otherwise(200).alias("http_status"))


# The rules those files give this agent, written out.
_RULES = f"""{_HOSTS}, rules as (
      select host, 2 as rule_idx, true as allow, '/en/1' as path_prefix from hosts where length(host) % 4 = 0
      union all select host, 3, false, '/en/' from hosts where length(host) % 4 = 0
      union all select host, 4, false, '/de' from hosts where length(host) % 4 = 1
      union all select host, 5, true, '' from hosts where length(host) % 4 = 1
      union all select host, 5, false, '/fr/' from hosts where length(host) % 4 = 2)"""


@query("robots_rules", f"with {_RULES} select host, rule_idx, allow, path_prefix from rules")
def rules(spark, sf):
    return robots_rules(_robots_texts(spark, sf))


@query(
    "robots_gate",
    f"""with {_RULES}, p as (select page_id, {q.host('url')} as host, regexp_extract(url, '{q.URI}', 4) as path from pages),
    m as (select p.page_id, arg_min(r.allow, r.rule_idx) as allow from p join rules r on r.host = p.host and starts_with(p.path, r.path_prefix) group by 1)
    select p.page_id, coalesce(m.allow, true) as allowed, case when coalesce(m.allow, true) then 'OK' else 'Disallowed by robots.txt' end as reason
    from p left join m on m.page_id = p.page_id""",
)
def robots_gate(spark, sf):
    pages = base(spark, sf, "pages").select("page_id", "url")
    df = policy.with_policy(pages, robots_rules=robots_rules(_robots_texts(spark, sf)))
    return df.select("page_id", "allowed", "reason")


@query(
    "resolved_addresses",
    f"""with p as (select page_id, {q.host('url')} as host from pages)
    select page_id, case length(host) % 5 when 0 then 'Private/loopback/link-local IP' when 1 then 'Private/loopback/link-local IP' else 'OK' end as reason from p""",
)
def resolved_addresses(spark, sf):
    """Names resolve to two addresses; one private is enough to block, none at all too."""
    pages = base(spark, sf, "pages").select("page_id", "url")
    hosts = policy.with_policy(pages).select("host").distinct()
    kind = F.length("host") % 5
    first = F.when(kind == 0, "10.1.2.3").otherwise("93.184.216.34")
    dns = hosts.filter(kind != 1).select("host", F.explode(F.array(first, F.lit("2606:4700::1111"))).alias("ip"))
    return policy.with_policy(pages, dns=dns).select("page_id", "reason")


@query(
    "redirect_chains",
    """select page_id, case when page_id % 5 = 0 then 'Redirect blocked: Blocked domain: www.facebook.com (https://www.facebook.com/' || page_id || ')'
      when page_id % 6 > 2 then 'Too many redirects' end as reason from pages""",
)
def redirect_chains(spark, sf):
    """Chains of one to six hops; in every fifth chain the first hop leads to a blocked host."""
    pages = texts(spark, sf, "pages")
    hops = pages.select("page_id", F.explode(F.sequence(F.lit(1), (F.col("page_id") % 6 + 1).cast("int"))).alias("hop"))
    blocked = (F.col("page_id") % 5 == 0) & (F.col("hop") == 1)
    target = F.when(blocked, F.concat(F.lit("https://www.facebook.com/"), F.col("page_id").cast("string")))
    chains = hops.select(
        F.col("page_id").cast("string").alias("url"), "hop",
        F.coalesce(target, F.concat(F.lit("https://ok.example.com/"), F.col("hop").cast("string"))).alias("target"),
    )
    return policy.check_redirects(chains).select(F.col("url").cast("bigint").alias("page_id"), "reason")


@query(
    "accept_pages",
    f"""with t as (select page_id, case when page_id % 9 = 0 then 503 else 200 end as http, case when page_id % 10 = 3 then 'application/pdf' else 'text/html; charset=utf-8' end as ct,
      case when page_id % 4 = 0 then repeat('word ', 20) else ' short ' end as snippet, {q.usable_text("case when page_id % 7 = 0 then '<p>tiny</p>' else html end")} as body from pages),
    r as (select *, case when http >= 400 then 'HTTP ' || http when ct = 'application/pdf' then 'Not HTML: application/pdf' when body is null then 'Insufficient text content after extraction' end as reason from t)
    select page_id, reason as fail_reason, case when reason is null then 'fetched' when page_id % 4 = 0 then 'via_search_provider' else 'failed' end as status,
      case when reason is null then body when page_id % 4 = 0 then trim(snippet) end as text from r""",
)
def accepted_pages(spark, sf):
    page = F.col("page_id")
    df = texts(spark, sf, "pages").select(
        "page_id", F.when(page % 7 == 0, "<p>tiny</p>").otherwise(F.col("html")).alias("html"),
        F.when(page % 9 == 0, 503).otherwise(200).alias("http_status"),
        F.when(page % 10 == 3, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"),
        F.when(page % 4 == 0, F.repeat(F.lit("word "), F.lit(20))).otherwise(" short ").alias("snippet"),
    )
    return accept_pages(df).select("page_id", "fail_reason", "status", "text")


_FIRST = f"{_CAND}, seen as (select *, row_number() over (partition by run_id, url order by query_idx, rank) as n from candidates), firsts as (select * from seen where n = 1)"


@query("first_seen_urls", f"with {_FIRST} select run_id, url, query_idx, rank from firsts")
def first_seen_urls(spark, sf):
    return cand.first_seen(derived(spark, sf, "candidates")).select("run_id", "url", "query_idx", "rank")


@query(
    "canonical_first_seen",
    f"""with {_CAND}, c as (select run_id, {q.rebuilt('url', False)} as url, query_idx, rank from candidates),
    n as (select *, row_number() over (partition by run_id, url order by query_idx, rank) as n from c) select run_id, url, query_idx, rank from n where n = 1""",
)
def canonical_first_seen(spark, sf):
    return cand.first_seen(derived(spark, sf, "candidates"), canonical=True).select("run_id", "url", "query_idx", "rank")


@query(
    "top_per_query",
    f"with {_CAND}, n as (select *, row_number() over (partition by run_id, query_idx order by rank, url) as n from candidates) select run_id, query_idx, rank, url from n where n <= 10",
)
def top_per_query(spark, sf):
    return cand.top_per_query(derived(spark, sf, "candidates"), 10).select("run_id", "query_idx", "rank", "url")


@query(
    "page_budget",
    f"""with {_FIRST}, v as (select *, page_id % 3 <> 0 as processed from firsts),
    w as (select *, coalesce(sum(processed::int) over (partition by run_id order by query_idx, rank rows between unbounded preceding and 1 preceding), 0) as used from v)
    select run_id, url, processed from w where used < 8""",
)
def page_budget(spark, sf):
    visits = cand.first_seen(derived(spark, sf, "candidates")).withColumn("processed", F.col("page_id") % 3 != 0)
    kept = cand.within_budget(visits, ["query_idx", "rank"], 8)
    # The cut lies at the last processed page, so nothing after it was visited.
    return kept.select("run_id", "url", "processed")


@query(
    "early_stop",
    """with f as (select p_size % 3 as run_id, p_name || p_type as entity, min(p_partkey // 20) as page_order from part group by 1, 2),
    pages as (select distinct p_size % 3 as run_id, p_partkey // 20 as page_order from part),
    c as (select run_id, page_order, (select count(*) from f where f.run_id = p.run_id and f.page_order < p.page_order) as before from pages p)
    select run_id, page_order from c where before < 60""",
)
def early_stop(spark, sf):
    rows = base(spark, sf, "part").select(
        (F.col("p_size") % 3).alias("run_id"), F.concat("p_name", "p_type").alias("entity"),
        F.floor(F.col("p_partkey") / 20).alias("page_order"),
    )
    first = rows.groupBy("run_id", "entity").agg(F.min("page_order").alias("page_order"))
    return cand.until_target(rows.select("run_id", "page_order").distinct(), first, 60)


@query(
    "wave2_queries",
    """with t as (select c_custkey as run_id, case when c_custkey % 3 = 0 then ' ' else c_mktsegment end as title, 10 + c_custkey % 20 as target, c_custkey % 12 as deduped,
      c_custkey % 9 as processed, c_custkey % 2 as left_over from customer),
    s as (select run_id, coalesce(nullif(trim(title), ''), 'company') as topic, 8 - processed as budget from t where left_over = 0 and deduped < least(10, target) and processed < 8)
    select run_id, budget as remaining_budget, 0 as query_idx, topic || ' list 2026' as query from s
    union all select run_id, budget, 1, 'top ' || topic || ' directory' from s union all select run_id, budget, 2, 'best ' || topic || ' roundup' from s""",
)
def wave2_queries(spark, sf):
    key = F.col("c_custkey")
    runs = base(spark, sf, "customer").select(
        key.alias("run_id"), F.when(key % 3 == 0, " ").otherwise(F.col("c_mktsegment")).alias("title"),
        F.lit("company").alias("entity"), (10 + key % 20).alias("target_count"), (key % 12).alias("deduped_count"),
        (key % 9).alias("pages_processed"), F.lit(8).cast("bigint").alias("max_pages"), (key % 2).alias("candidates_left"),
    )
    return cand.second_wave_queries(runs)


@query(
    "wave2_merge",
    f"""with {_CAND}, a as (select distinct run_id, url from candidates where query_idx < 3), b as (select distinct run_id, url from candidates where query_idx >= 3)
    select run_id, url, 1 as wave from a union all select run_id, url, 2 from (select run_id, url from b except select run_id, url from a)""",
)
def wave2_merge(spark, sf):
    rows = derived(spark, sf, "candidates")
    first = cand.first_seen(rows.filter("query_idx < 3"))
    return cand.merge_waves(first, rows.filter("query_idx >= 3")).select("run_id", "url", "wave")


@query(
    "politeness",
    """with t as (select event_id as request_id, user_id as host, epoch_us(ts) // 100000 as arrival from events),
    n as (select *, row_number() over (partition by host order by arrival, request_id) as i from t)
    select request_id, max(arrival - i * 30000) over (partition by host order by arrival, request_id rows unbounded preceding) + i * 30000 as fetch_s from n""",
)
def politeness(spark, sf):
    arrival = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 100000)
    requests = base(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("host"), arrival.alias("arrival_s")
    )
    return policy.fetch_schedule(requests, delay=30000).select("request_id", "fetch_s")


# Two requests per window: decisions depend on earlier ones, so the walk is written recursively.
_THROTTLE = """with recursive t as (select user_id % 40 as client, event_id as request_id, epoch_us(ts) // 60 as us from events),
    s as (select *, row_number() over (partition by client order by us, request_id) as n from t),
    walk as (select client, 0::bigint as n, 0::bigint as request_id, []::bigint[] as recent, true as accepted, 0::bigint as us from (select distinct client from s)
      union all
      select s.client, s.n, s.request_id,
        case when len(list_filter(w.recent, lambda x: x > s.us - 60000000)) >= 2 then list_filter(w.recent, lambda x: x > s.us - 60000000)
          else list_append(list_filter(w.recent, lambda x: x > s.us - 60000000), s.us) end,
        len(list_filter(w.recent, lambda x: x > s.us - 60000000)) < 2, s.us
      from walk w join s on s.client = w.client and s.n = w.n + 1)
    select client, request_id, accepted, case when not accepted then cast(greatest(1, (60000000 - (us - recent[1])) // 1000000) as varchar) end as retry_after from walk where n > 0"""


@query("throttle", _THROTTLE)
def throttled(spark, sf):
    compressed = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60))
    requests = base(spark, sf, "events").select(
        (F.col("user_id") % 40).alias("client"), F.col("event_id").alias("request_id"), compressed.alias("ts")
    )
    return throttle(requests, limit=2).select(
        "client", "request_id", "accepted", F.col("retry_after").cast("string").alias("retry_after")
    )
