"""Checked queries: scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundset.functions import text, urls, values
from groundset.operators.pages import chunk_pages, prompt_text, read_responses
from groundset.plans import sqltext as q
from groundset.plans.catalog import query
from groundset.plans.derived import base, derived, derived_sql, texts
from groundset.sources.dimensions import with_region
from groundset.spec import FieldSpec, TaskSpec, parse_specs, spec_fields

COMPANY = TaskSpec(
    entity="company",
    title="Companies",
    fields=(FieldSpec("name", "str", "company name", True), FieldSpec("price", "float", "price asked", False)),
    key_fields=("name",),
    filters={"city": "Pune"},
)

# Every kind of link: foreign scheme, relative, upper case, loopback, blocked host, as crawled.
_RAW_URL = """case page_id % 7 when 0 then 'javascript:' || cast(page_id as string)
  when 1 then '/rel/' || cast(page_id as string) || '?x=1' when 2 then upper(url)
  when 3 then 'http://127.0.0.' || cast(page_id % 250 as string) || '/a?utm_source=z&b=2&c=#f'
  when 4 then '  ' || url || ' ' when 5 then 'https://www.linkedin.com/in/' || cast(page_id as string)
  else url end"""
_URLS = f"urls as (select page_id, {_RAW_URL} as raw from pages)"


def raw_urls(spark, sf):
    return base(spark, sf, "pages").select("page_id", F.expr(_RAW_URL).alias("raw"))


@query(
    "normalize_url",
    f"""with {_URLS}, t as (select page_id, {q.strip('raw')} as u from urls),
    k as (select *, (starts_with(lower(u), 'http://') or starts_with(lower(u), 'https://')) as http,
                 (position(':' in u) > 0 and not starts_with(u, '/')) as danger from t)
    select page_id, case when http then {q.rebuilt('u', True)} when not danger then u end as url,
           (http or not danger) as valid from k""",
)
def normalize_url(spark, sf):
    n = urls.normalize_url(F.col("raw"))
    return raw_urls(spark, sf).select("page_id", n["url"].alias("url"), n["valid"].alias("valid"))


@query("canonical_url", f"select page_id, {q.rebuilt('url', False)} as url from pages")
def canonical_url(spark, sf):
    return texts(spark, sf, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"))


@query(
    "host_base",
    f"""with {_URLS}, t as (select page_id, {q.host("regexp_replace(raw, '^ +', '')")} as host from urls)
    select page_id, host, {q.base_domain('host')} as base from t""",
)
def host_base(spark, sf):
    h = urls.host(F.col("raw"))
    return raw_urls(spark, sf).select("page_id", h.alias("host"), urls.base_domain(h).alias("base"))


@query(
    "safe_href",
    f"""with {_URLS}, t as (select page_id, {q.strip('raw')} as u from urls)
    select page_id, case when {q.scheme('u')} in ('http', 'https') then {q.scheme('u')} || '://' || {q.host('u')}
      || case when regexp_extract(u, '^[^:]*://[^/?#]*(.*)$', 1) = '' then '/' else regexp_extract(u, '^[^:]*://[^/?#]*(.*)$', 1) end end as href
    from t""",
)
def safe_href(spark, sf):
    return raw_urls(spark, sf).select("page_id", urls.safe_href(F.col("raw")).alias("href"))


@query(
    "normalize_number",
    f"""with {derived_sql('money')}, t as (select o_orderkey, raw, regexp_replace(raw, '[^0-9.\\-]', '', 'g') as k from money)
    select o_orderkey, case when regexp_matches(k, '^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') then try_cast(k as double) end as number from t""",
)
def normalize_number(spark, sf):
    return derived(spark, sf, "money").select("o_orderkey", values.normalize_number(F.col("raw")).alias("number"))


@query(
    "detect_currency",
    f"""with {derived_sql('money')} select o_orderkey,
    case when regexp_matches(raw, '(?i)₹|\\b(rs\\.?|inr|rupees?)\\b') then 'inr'
         when regexp_matches(raw, '(?i)\\$|\\b(usd|dollars?)\\b') then 'usd'
         when regexp_matches(raw, '(?i)€|\\b(eur|euros?)\\b') then 'eur'
         when regexp_matches(raw, '(?i)£|\\b(gbp|pounds?)\\b') then 'gbp' end as currency from money""",
)
def detect_currency(spark, sf):
    return derived(spark, sf, "money").select("o_orderkey", values.detect_currency(F.col("raw")).alias("currency"))


_DATE_TEXT = {
    "spark": """case o_orderkey % 5 when 0 then date_format(o_orderdate, 'yyyy-MM-dd')
      when 1 then date_format(o_orderdate, 'MMMM d, yyyy') when 2 then date_format(o_orderdate, 'd MMM yyyy')
      when 3 then date_format(o_orderdate, 'MM/dd/yyyy') else 'soon ' || cast(o_orderkey as string) end""",
    "duckdb": """case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y-%m-%d')
      when 1 then strftime(o_orderdate, '%B %-d, %Y') when 2 then strftime(o_orderdate, '%-d %b %Y')
      when 3 then strftime(o_orderdate, '%m/%d/%Y') else 'soon ' || o_orderkey end""",
}


@query(
    "normalize_date",
    f"""with t as (select o_orderkey, {_DATE_TEXT['duckdb']} as raw from orders)
    select o_orderkey, raw, strftime(try_strptime(raw, ['%Y-%m-%d', '%B %d, %Y', '%d %b %Y', '%m/%d/%Y']), '%Y-%m-%d') as iso from t""",
)
def normalize_date(spark, sf):
    raw = base(spark, sf, "orders").select("o_orderkey", F.expr(_DATE_TEXT["spark"]).alias("raw"))
    return raw.select("o_orderkey", "raw", values.normalize_date(F.col("raw")).alias("iso"))


# Each order's date in one of fourteen spellings, as Spark formats.
_SPELLINGS = (
    "'Jan. 'd, yyyy", "MMMM d'th', yyyy", "d MMM. yyyy", "'Sept 'd, yyyy", "EEEE, MMMM d, yyyy", "yyyy-MM-dd'T'10:00:00.123'Z'",
    "yyyy-MM-dd 10:00", "dd.MM.yyyy", "d-MMM-yyyy", "MM/dd/yy", "MMMM yyyy", "MMM yyyy", "EEE, d MMM yyyy", "yyyy-MM-dd'T'10:00",
)


@query(
    "normalize_date_spellings",
    """select o_orderkey, strftime(case when o_orderkey % 15 in (10, 11) then date_trunc('month', o_orderdate)
      when o_orderkey % 15 = 0 then make_date(year(o_orderdate), 1, day(o_orderdate))
      when o_orderkey % 15 = 3 then make_date(year(o_orderdate), 9, least(day(o_orderdate), 30)) else o_orderdate end, '%Y-%m-%d') as iso
    from orders""",
)
def normalize_date_spellings(spark, sf):
    day, k = F.col("day"), F.col("o_orderkey") % 15
    raw = F.when(F.dayofmonth(day) > 12, F.date_format(day, "d/M/yyyy")).otherwise(F.date_format(day, "M/d/yyyy"))
    for i, form in enumerate(_SPELLINGS):
        shown = F.make_date(F.year(day), F.lit(9), F.least(F.dayofmonth(day), F.lit(30))) if i == 3 else day
        raw = F.when(k == i, F.date_format(shown, form)).otherwise(raw)
    orders = base(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return orders.select("o_orderkey", values.normalize_date(raw).alias("iso"))


@query(
    "normalize_email",
    """select c_custkey, case when c_custkey % 9 <> 0 then lower(trim(case when c_custkey % 2 = 0 then '  ' else '' end
    || replace(c_name, '#', '.') || '@EXAMPLE.com ')) end as email from customer""",
)
def normalize_email(spark, sf):
    raw = F.expr(
        """case when c_custkey % 9 = 0 then '' else case when c_custkey % 2 = 0 then '  ' else '' end
        || replace(c_name, '#', '.') || '@EXAMPLE.com ' end"""
    )
    return base(spark, sf, "customer").select("c_custkey", values.normalize_email(raw).alias("email"))


@query("normalize_string", f"select doc_id, nullif({q.collapse('text')}, '') as text from documents")
def normalize_string(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", text.normalize_string(F.col("text")).alias("text"))


@query("normalize_for_match", f"select conv_id, turn, {q.norm('text')} as text from conversations")
def normalize_for_match(spark, sf):
    return base(spark, sf, "conversations").select("conv_id", "turn", text.normalize_for_match(F.col("text")).alias("text"))


_PARTS = derived_sql("parts")


@query(
    "dedupe_key",
    f"""with {_PARTS} select run_id, arrival, {q.dedupe_key(q.key_text('name'), q.key_text('type'))} as dedupe_key,
    concat_ws(' ', {q.key_text('name')}, {q.key_text('type')}) as fuzzy_key from parts""",
)
def dedupe_key(spark, sf):
    parts = [text.key_text(F.col("name")), text.key_text(F.col("type"))]
    return derived(spark, sf, "parts").select(
        "run_id", "arrival", text.dedupe_key(parts).alias("dedupe_key"), text.fuzzy_key(parts).alias("fuzzy_key")
    )


@query(
    "sorted_tokens",
    f"with {_PARTS} select run_id, arrival, {q.sorted_tokens(q.key_text('name'))} as tokens from parts",
)
def sorted_tokens(spark, sf):
    return derived(spark, sf, "parts").select(
        "run_id", "arrival", text.sorted_tokens(text.key_text(F.col("name"))).alias("tokens")
    )


@query(
    "record_id",
    f"""with {_PARTS} select run_id, arrival, substring(sha1(cast(run_id as varchar) || ':' || {q.dedupe_key(q.key_text('name'))}), 1, 16) as record_id
    from parts""",
)
def record_id(spark, sf):
    key = text.dedupe_key([text.key_text(F.col("name"))])
    return derived(spark, sf, "parts").select("run_id", "arrival", text.record_id(F.col("run_id"), key).alias("record_id"))


@query(
    "chunk_text",
    """with n as (select doc_id, text, case when length(text) <= 2000 then 1 else cast(ceil(length(text) / 1800.0) as int) end as n from documents)
    select doc_id, cast(i as bigint) as chunk_idx, cast(n as bigint) as n_chunks, md5(substring(text, cast(i as int) * 1800 + 1, 2000)) as digest,
           cast(length(substring(text, cast(i as int) * 1800 + 1, 2000)) as bigint) as chars
    from n, unnest(range(n)) as u(i)""",
)
def chunk_text(spark, sf):
    return _chunks(spark, sf, size=2000, overlap=200)


@query(
    "chunk_text_whole",
    """with n as (select doc_id, text, case when length(text) <= 8000 then 1 else cast(ceil(length(text) / 7500.0) as int) end as n from documents)
    select doc_id, cast(i as bigint) as chunk_idx, cast(n as bigint) as n_chunks, md5(substring(text, cast(i as int) * 7500 + 1, 8000)) as digest,
           cast(length(substring(text, cast(i as int) * 7500 + 1, 8000)) as bigint) as chars
    from n, unnest(range(n)) as u(i)""",
)
def chunk_text_whole(spark, sf):
    return _chunks(spark, sf)


def _chunks(spark, sf, **sizes):
    docs = texts(spark, sf, "documents").select("doc_id", "text")
    return chunk_pages(docs, **sizes).select(
        "doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.col("n_chunks").cast("bigint").alias("n_chunks"),
        F.md5("chunk").alias("digest"), F.length("chunk").cast("bigint").alias("chars"),
    )


@query("main_text", f"select page_id, {q.usable_text('html')} as text from pages")
def main_text(spark, sf):
    return texts(spark, sf, "pages").select("page_id", text.usable_text(F.col("html"), None).alias("text"))


@query("first_paragraph", f"select page_id, {q.first_paragraph('html')} as paragraph from pages")
def first_paragraph(spark, sf):
    return texts(spark, sf, "pages").select(
        "page_id", F.try_element_at(text.paragraphs(F.col("html")), F.lit(1)).alias("paragraph")
    )


_CELL = "case doc_id % 5 when 0 then '=' || lang when 1 then '  -' || source when 2 then '@' || lang when 3 then text else source end"


@query("safe_cell", f"with t as (select doc_id, {_CELL} as raw from documents) select doc_id, {q.safe_cell('raw')} as cell from t")
def safe_cell(spark, sf):
    raw = texts(spark, sf, "documents").select("doc_id", F.expr(_CELL).alias("raw"))
    return raw.select("doc_id", text.safe_cell(F.col("raw")).alias("cell"))


_ERROR = """case event_id % 5 when 0 then 'Please retry in ' || cast(event_id % 60 as string) || '.' || cast(event_id % 7 as string) || 's.'
    when 1 then '''retryDelay'': ''' || cast(event_id % 50 as string) || 's''' when 2 then 'Retry after ' || cast(event_id % 40 as string) || ' seconds'
    when 3 then props else event_type end"""


@query(
    "retry_delay",
    f"""with t as (select event_id, {_ERROR} as message from events)
    select event_id, coalesce(try_cast(regexp_extract(message, '(?i)retry in (\\d+(?:\\.\\d+)?)s', 1) as double),
      try_cast(regexp_extract(message, '(?i)retryDelay[''":\\s]+(\\d+(?:\\.\\d+)?)', 1) as double),
      try_cast(regexp_extract(message, '(?i)retry after (\\d+(?:\\.\\d+)?)', 1) as double)) as seconds from t""",
)
def retry_delay(spark, sf):
    raw = base(spark, sf, "events").select("event_id", F.expr(_ERROR).alias("message"))
    return raw.select("event_id", text.retry_delay(F.col("message")).alias("seconds"))


@query(
    "prompt_text",
    """select page_id, 'Task: Companies' || chr(10) || 'Entity: company' || chr(10) || chr(10) || 'Fields to extract:' || chr(10)
    || '- name (str*): company name' || chr(10) || '- price (float): price asked' || chr(10) || chr(10)
    || 'Filters (skip records that don''t match; if an optional detail like stipend or email is not mentioned in the text for an otherwise matching entity, extract it with that field as null):'
    || chr(10) || '- city: Pune' || chr(10) || chr(10) || 'Source URL: ' || url || chr(10) || chr(10) || '<UNTRUSTED_PAGE_DATA>' || chr(10)
    || html || chr(10) || '</UNTRUSTED_PAGE_DATA>' as prompt from pages""",
)
def prompt(spark, sf):
    return texts(spark, sf, "pages").select("page_id", prompt_text(F.col("html"), F.col("url"), COMPANY).alias("prompt"))


_ANSWER = """case p_partkey % 4 when 3 then 'Sorry, no answer' else
    case when p_partkey % 4 = 1 then '```json' || chr(10) else '' end
    || '{"records": [{"name": "' || p_name || '", "price": ' || cast(p_partkey as string) || '.5, "evidence": "' || p_brand || '"}'
    || case when p_partkey % 4 = 2 then ', {"name": null, "evidence": "' || p_type || '"}' else '' end || ']}'
    || case when p_partkey % 4 = 1 then chr(10) || '```' else '' end end"""


@query(
    "read_responses",
    """select p_partkey, case when p_partkey % 4 = 3 then 'unreadable response' end as reject,
       case when p_partkey % 4 <> 3 then p_name end as name, case when p_partkey % 4 <> 3 then p_partkey + 0.5::double end as price,
       case when p_partkey % 4 <> 3 then p_brand end as evidence from part
    union all select p_partkey, null, null, null, p_type from part where p_partkey % 4 = 2""",
)
def responses(spark, sf):
    raw = base(spark, sf, "part").select("p_partkey", F.expr(_ANSWER).alias("response"))
    return read_responses(raw, COMPANY).select("p_partkey", "reject", "name", "price", "evidence")


_TASKS = derived_sql("tasks")


@query(
    "parse_specs",
    f"""with {_TASKS}, t as (select task_id, cast(task_id as bigint) as k from tasks)
    select task_id, case when k % 10 = 9 then 'unreadable spec' end as reject,
      case when k % 10 = 9 then 'no fields' else json_extract_string((select spec from tasks s where s.task_id = t.task_id), '$.title') end as title,
      case when k % 10 = 9 then 'GLOBAL' else case c_nationkey % 4 when 0 then 'IN' when 1 then 'US' when 2 then 'GLOBAL' else 'GB' end end as region,
      cast(case when k % 10 = 9 then 30 else 5 + k % 40 end as bigint) as target_count,
      case when k % 10 = 9 then '' else 'company_name:true,price:false' end as fields,
      case when k % 10 = 9 then '' else 'city=x' || c_nationkey || ',top=' || k % 5 end as filters
    from t join customer on c_custkey = k""",
)
def parsed_specs(spark, sf):
    specs = parse_specs(derived(spark, sf, "tasks"))
    shown = F.array_join(F.transform("spec.fields", lambda f: F.concat(f["name"], F.lit(":"), f["required"].cast("string"))), ",")
    pairs = F.array_sort(F.transform(F.map_entries("spec.filters"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return specs.select(
        "task_id", F.col("spec_reject").alias("reject"), "spec.title", "spec.region",
        F.col("spec.target_count").cast("bigint").alias("target_count"), shown.alias("fields"),
        F.array_join(pairs, ",").alias("filters"),
    )


@query(
    "spec_field_table",
    f"""with {_TASKS} select task_id, cast(i as bigint) as ordinal, case when i = 0 then 'company_name' else 'price' end as name,
    case when i = 0 then 'str' else 'float' end as type, i = 0 as required
    from tasks, unnest([0, 1]) as u(i) where cast(task_id as bigint) % 10 <> 9""",
)
def field_table(spark, sf):
    specs = parse_specs(derived(spark, sf, "tasks"))
    return spec_fields(specs, "task_id").withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query(
    "region_lookup",
    """select c_custkey, case c_nationkey % 5 when 0 then 'IN' when 1 then 'US' when 2 then 'GLOBAL' when 3 then 'JP' else 'GLOBAL' end as region_code,
    case c_nationkey % 5 when 0 then 'India' when 1 then 'United States' when 3 then 'Japan' else 'Worldwide' end as region_name,
    case c_nationkey % 5 when 0 then 'INR' when 1 then 'USD' when 3 then 'JPY' end as currency_hint from customer""",
)
def region_lookup(spark, sf):
    codes = F.expr("case c_nationkey % 5 when 0 then 'in ' when 1 then 'US' when 2 then 'nowhere' when 3 then ' jp' end")
    df = with_region(base(spark, sf, "customer").withColumn("region", codes))
    return df.select("c_custkey", "region_code", "region_name", "currency_hint")
