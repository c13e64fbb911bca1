"""Run-store shaped inputs derived from star-schema tables, as SQL both engines read alike.

Used by the registered checks: Spark computes the operators over these frames, the comparison SQL
starts from the same text.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from groundset.operators.skew import spread

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# `@plus(ts, seconds)` is the only construct the two dialects spell differently.
_DERIVED = {
    "tasks": """
        select cast(c_custkey as string) as task_id,
               c_name || ' wants ' || lower(c_mktsegment) as prompt,
               case when c_custkey % 10 = 9 then '{"title": "no fields", "region": "xx"}'
                    else '{"title": "' || case when c_custkey % 3 = 0 then '' else c_mktsegment || ' ' || cast(c_nationkey as string) end
                      || '", "entity": "company", "region": "'
                      || case c_nationkey % 4 when 0 then 'in' when 1 then ' us ' when 2 then 'ZZ' else 'GB' end
                      || '", "target_count": ' || cast(5 + c_custkey % 40 as string)
                      || ', "fields": [{"name": "Company Name", "type": "str", "description": "n", "required": true}'
                      || ', {"name": "price", "type": "float", "description": "p", "required": '
                      || case when c_custkey % 2 = 0 then 'true' else 'false' end || '}]'
                      || ', "filters": {"city": "x' || cast(c_nationkey as string) || '", "top": ' || cast(c_custkey % 5 as string) || '}'
                      || ', "key_fields": ["company_name"]}' end as spec,
               @plus(timestamp '2024-01-01 00:00:00', c_custkey * 60) as created_at,
               @plus(timestamp '2024-01-01 00:00:00', c_custkey * 60 + 5) as updated_at
        from customer""",
    "runs": """
        select cast(o_orderkey as string) as run_id, cast(o_custkey as string) as task_id,
               case o_orderstatus when 'F' then 'completed' when 'O' then 'running'
                    else case when o_orderkey % 2 = 0 then 'failed' else 'queued' end end as status,
               case when o_orderkey % 13 = 0 then 'not json'
                    else '{"raw_count": ' || cast(40 + o_orderkey % 9 as string)
                      || ', "verified_count": ' || cast(case when o_orderkey % 17 = 1 then 0 else 20 + o_orderkey % 20 end as string)
                      || ', "valid_count": ' || cast(case when o_orderkey % 17 < 3 then 0 else 15 + o_orderkey % 5 end as string)
                      || ', "deduped_count": ' || cast(case when o_orderkey % 17 < 3 then 0 else o_orderkey % 16 end as string)
                      || ', "pages_fetched": ' || cast(o_orderkey % 4 as string)
                      || ', "pages_failed": ' || cast(o_orderkey % 3 as string)
                      || ', "hallucinated_count": ' || cast(o_orderkey % 7 as string)
                      || ', "fields_nulled": 1, "dropped_reasons": {"missing_required": ' || cast(o_orderkey % 3 as string) || '}'
                      || case when o_orderkey % 2 = 0 then ', "duration_seconds": ' || cast(o_orderkey % 50 as string) || '.5' else '' end
                      || '}' end as stats,
               case when o_orderkey % 5 = 0 then '{"title": "own", "region": "DE", "target_count": 12}'
                    when o_orderkey % 5 = 1 then '' else '{}' end as run_spec,
               case when o_orderkey % 19 = 0 then 'boom' end as error,
               case when o_orderkey % 11 = 0 then null else o_orderdate end as started_at,
               case when o_orderstatus = 'F' then @plus(o_orderdate, o_orderkey % 3600) end as finished_at
        from orders""",
    "records": """
        select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string) as record_id,
               cast(l_orderkey as string) as run_id, l_linenumber,
               'part ' || cast(l_partkey as string) as name,
               case when l_linenumber % 3 = 0 then '' when l_linenumber % 5 = 0 then null
                    else '=' || cast(l_quantity as string) end as funding,
               l_discount * 10 as confidence,
               case when l_returnflag = 'R' then 'currency_mismatch' when l_returnflag = 'A' then 'invalid_url_site' else '' end as flag,
               @plus(timestamp '2024-02-01 00:00:00', l_linenumber) as created_at
        from lineitem""",
    "sources": """
        select 's' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string) as source_id,
               cast(l_orderkey as string) as run_id,
               'https://d' || cast(l_suppkey % 7 as string) || '.example.com/' || cast(l_partkey as string) as url,
               'd' || cast(l_suppkey % 7 as string) || '.example.com' as domain,
               case (l_orderkey + l_linenumber * l_linenumber) % 6 when 0 then 'blocked_by_policy' when 1 then 'blocked_by_robots'
                    when 2 then 'failed' when 3 then 'via_search_provider' else 'fetched' end as status,
               case when l_linenumber % 2 = 0 then 'Insufficient text content after extraction' else 'HTTP 404' end as reason,
               cast(l_linenumber % 5 as bigint) as records_found,
               @plus(l_shipdate, l_linenumber) as fetched_at
        from lineitem
        union all
        select 'o' || cast(o_orderkey as string) as source_id, cast(o_orderkey as string) as run_id,
               'https://shop.example.com/' || cast(o_orderkey as string) as url, 'shop.example.com' as domain,
               'fetched' as status, 'OK' as reason, cast(o_orderkey % 3 as bigint) as records_found, o_orderdate as fetched_at
        from orders""",
    "evidence": """
        select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string) as record_id, cast(l_orderkey as string) as run_id, 's' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string) as source_id,
               case when l_linenumber % 4 = 0 then '' else 'seen ' || cast(l_suppkey as string) end as snippet,
               cast(0 as bigint) as position
        from lineitem
        union all
        select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string) as record_id, cast(l_orderkey as string) as run_id, 'o' || cast(l_orderkey as string) as source_id,
               'also ' || cast(l_linenumber as string) as snippet, cast(l_linenumber as bigint) as position
        from lineitem where l_linenumber > 1""",
    "run_events": """
        select event_id as id, cast(user_id as string) as run_id,
               case event_type when 'error' then 'error' else 'info' end as level,
               case event_type when 'click' then 'search' when 'view' then 'fetch' when 'signup' then 'extract'
                    when 'purchase' then 'records_updated' else 'dedupe' end as step,
               'value ' || cast(event_id % 100 as string) as message,
               case when event_id % 3 = 0 then props else '' end as data,
               cast(event_id % 4 as bigint) as record_count,
               ts as created_at
        from events""",
    "candidates": """
        select page_id % 4 as run_id, page_id % 3 as query_idx, page_id as rank, url, page_id
        from pages
        union all
        select page_id % 4 as run_id, 3 + page_id % 2 as query_idx, page_id as rank, url, page_id
        from pages where page_id % 3 <> 0
        union all
        select (page_id + 1) % 4 as run_id, page_id % 5 as query_idx, page_id + 7 as rank, url, page_id
        from pages where page_id % 2 = 0""",
    "parts": """
        select p_size % 3 as run_id, p_partkey as arrival, 'src' || cast(p_partkey % 50 as string) as source_id,
               case when p_partkey % 7 = 0 then upper(p_name) || ', Inc.' else p_name end as name,
               p_type as type, p_brand as brand,
               case when p_partkey % 3 = 0 then null else cast(p_size as bigint) end as size,
               case when p_partkey % 11 = 0 then '' else p_name || ' made by ' || p_brand end as evidence
        from part""",
    "money": """
        select o_orderkey, case o_orderkey % 6
                 when 0 then '$' || cast(o_totalprice as string)
                 when 1 then ' INR ' || cast(o_totalprice as string) || ' '
                 when 2 then 'about 12-15'
                 when 3 then cast(o_orderkey as string) || ',500 EUR'
                 when 4 then 'n/a'
                 else '-' || cast(o_orderkey as string) || '.25 pounds' end as raw
        from orders""",
    "requests": """
        select user_id as client, event_id as request_id, ts from events""",
}

_DEPENDS = re.compile(r"\b(?:from|join)\s+(\w+)", re.I)


def _dialect(sql: str, engine: str) -> str:
    if engine == "spark":
        return re.sub(r"@plus\(((?:timestamp '[^']*')|\w+), ([^()]*?)\)", r"timestampadd(SECOND, cast(\2 as bigint), \1)", sql)
    return re.sub(r"@plus\(((?:timestamp '[^']*')|\w+), ([^()]*?)\)", r"(\1 + to_seconds(cast(\2 as bigint)))", sql)


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table whose rows are long texts, dealt over all cores."""
    return spread(base(spark, sf_dir, name))


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived frame; the base tables are bound as frames, not registered by name."""
    sql = _dialect(_DERIVED[name], "spark")
    needed = sorted(set(_DEPENDS.findall(sql)))
    for table in needed:
        sql = re.sub(rf"\b(from|join)\s+{table}\b", rf"\1 {{{table}}}", sql)
    # Literal braces of JSON texts must not be read as frame names.
    keep = {f"{{{t}}}" for t in needed}
    parts = re.split(r"(\{\w+\})", sql)
    sql = "".join(p if p in keep else p.replace("{", "{{").replace("}", "}}") for p in parts)
    return spark.sql(sql, **{t: base(spark, sf_dir, t) for t in needed})


def derived_sql(*names: str) -> str:
    """The same inputs as common table expressions for the comparison SQL."""
    return ",\n".join(f"{n} as ({_dialect(_DERIVED[n], 'duckdb')})" for n in names)
