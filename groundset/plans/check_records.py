"""Checked queries: verification, cleaning, merging and scoring of whole record tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundset.functions import text, urls
from groundset.functions.similarity import with_partial_matches
from groundset.operators import clean, fuzzy, policy, report, verify
from groundset.operators.pages import drop_repeated_evidence, extract_records
from groundset.plans import reports
from groundset.plans import sqltext as q
from groundset.plans.by_spec import build_dataset_by_spec
from groundset.plans.catalog import query
from groundset.plans.dataset import build_dataset, collect, leaders_by_key
from groundset.plans.derived import base, derived, derived_sql, texts
from groundset.session import cut_lineage
from groundset.spec import FieldSpec, TaskSpec

PART_SPEC = TaskSpec(
    entity="part",
    fields=(FieldSpec("name", "str", "", True), FieldSpec("type"), FieldSpec("brand"), FieldSpec("size", "int")),
    key_fields=("name", "type"),
)

CONTACT_SPEC = TaskSpec(
    entity="contact",
    fields=(
        FieldSpec("name", "str", "", True), FieldSpec("email", "email"), FieldSpec("url", "url"),
        FieldSpec("age", "int"), FieldSpec("rating", "float"),
    ),
    key_fields=("name",),
)

_CONTACTS = """select p_size % 3 as run_id, p_partkey as arrival, 's' as source_id, 'e' as evidence,
    case p_partkey % 13 when 0 then '  ' when 1 then null else p_name end as name,
    case p_partkey % 4 when 0 then p_brand when 1 then 'a@b.co' when 2 then '' else 'x @y.z' end as email,
    case p_partkey % 3 when 0 then 'ftp://' || p_type when 1 then 'https://' || p_type || '.com' else 'http://a b' end as url,
    case p_partkey % 4 when 0 then cast(p_size as string) when 1 then cast(p_retailprice as string) when 2 then '+7' else 'old' end as age,
    case p_partkey % 3 when 0 then cast(p_retailprice as string) when 1 then 'high' else null end as rating
    from part"""


def _contacts(spark, sf):
    df = spark.sql(_CONTACTS.replace("from part", "from {part}"), part=base(spark, sf, "part"))
    return df.withColumn("flags", F.array(F.lit("seen")))


@query(
    "validate_flags",
    f"""with t as ({_CONTACTS}), f as (select run_id, arrival, name is null or trim(name) = '' as missing, list_filter([
      'seen',
      case when email <> '' and not regexp_matches(email, '^[^@ ]+@[^@ ]+\\.[^@ ]+$') then 'invalid_email_email' end,
      case when not regexp_matches(url, '^https?://[^ ]+$') then 'invalid_url_url' end,
      case when not regexp_matches(age, '^[+-]?[0-9]+$') then 'invalid_int_age' end,
      case when rating is not null and try_cast(rating as double) is null then 'invalid_float_rating' end], lambda x: x is not null) as flags from t)
    select run_id, arrival, case when missing then 'missing_required_name' else array_to_string(flags, ',') end as flags,
      case when missing then 'missing_required_name' end as reject_reason from f""",
)
def validate_flags(spark, sf):
    return clean.validate_records(_contacts(spark, sf), CONTACT_SPEC).select(
        "run_id", "arrival", F.array_join("flags", ",").alias("flags"), "reject_reason"
    )


OFFER_SPEC = TaskSpec(
    entity="offer",
    fields=(
        FieldSpec("title", "str", "", True), FieldSpec("posted", "date"), FieldSpec("link", "url"),
        FieldSpec("contact", "email"), FieldSpec("price_usd", "float"), FieldSpec("stock", "int"),
    ),
    key_fields=("title",),
)

_OFFERS = """select o_orderkey % 5 as run_id, o_orderkey as arrival, 's' as source_id, 'e' as evidence,
    '  order   ' || o_orderpriority || ' ' as title,
    case o_orderkey % 3 when 0 then '1998-02-0' || cast(1 + o_orderkey % 9 as string) when 1 then 'someday' end as posted,
    case o_orderkey % 3 when 0 then 'HTTP://Shop.Example.com/A?utm_medium=m&id=' || cast(o_orderkey as string) || '#top'
      when 1 then 'mailto:x' else '/p/' || cast(o_orderkey as string) end as link,
    ' Sales' || cast(o_orderkey % 7 as string) || '@Shop.COM ' as contact,
    case o_orderkey % 4 when 0 then '$' || cast(o_orderkey as string) || ',000.50' when 1 then '₹' || cast(o_orderkey as string)
      when 2 then 'call us' else cast(o_orderkey as string) end as price_usd,
    case o_orderkey % 2 when 0 then cast(o_orderkey as string) || '.9 pcs' else '1-2' end as stock
    from orders"""


def _offers(spark, sf):
    df = spark.sql(_OFFERS.replace("from orders", "from {orders}"), orders=texts(spark, sf, "orders"))
    return df.withColumn("flags", F.array().cast("array<string>"))


@query(
    "normalize_records",
    f"""with t as ({_OFFERS})
    select run_id, arrival, {q.collapse('title')} as title, case when arrival % 3 = 0 then posted end as posted,
      case arrival % 3 when 0 then 'http://shop.example.com/A?id=' || arrival when 2 then link end as link,
      lower(trim(contact)) as contact,
      case arrival % 4 when 0 then arrival * 1000.0::double + 0.5 when 3 then arrival::double end as price_usd,
      case when arrival % 2 = 0 then cast(arrival as varchar) end as stock,
      array_to_string(list_filter([case when arrival % 3 = 1 then 'invalid_date_posted' end, case when arrival % 3 = 1 then 'invalid_url_link' end,
        case when arrival % 4 = 1 then 'currency_mismatch,currency_mismatch_price_usd' end, case when arrival % 4 = 2 then 'invalid_number_price_usd' end,
        case when arrival % 2 = 1 then 'invalid_number_stock' end], lambda x: x is not null), ',') as flags from t""",
)
def normalize_records(spark, sf):
    df = clean.normalize_records(_offers(spark, sf), OFFER_SPEC)
    return df.select(
        "run_id", "arrival", "title", "posted", "link", "contact", "price_usd",
        F.col("stock").cast("string").alias("stock"), F.array_join("flags", ",").alias("flags"),
    )


@query(
    "currency_mismatch_runs",
    """select o_orderkey % 5 as run_id, count(*) as n_mismatched from orders where o_orderkey % 4 = 1 group by 1""",
)
def currency_mismatch_runs(spark, sf):
    return report.currency_mismatches(clean.normalize_records(_offers(spark, sf), OFFER_SPEC))


_PARTS = derived_sql("parts")
_KEYED = f"""{_PARTS}, keyed as (select *, {q.dedupe_key(q.key_text('name'), q.key_text('type'))} as dedupe_key,
      concat_ws(' ', {q.key_text('name')}, {q.key_text('type')}) as fuzzy_key,
      (name is not null)::int + (type is not null)::int + (brand is not null)::int + (size is not null)::int as filled from parts),
    ranked as (select *, (10 - filled)::bigint * 1000000000 + arrival as ord from keyed),
    exact as (select run_id, dedupe_key, min(fuzzy_key) as fuzzy_key, min(arrival) as first_arrival, count(*) as n_merged,
      arg_min(name, ord) filter (name is not null) as name, arg_min(type, ord) filter (type is not null) as type,
      arg_min(brand, ord) filter (brand is not null) as brand, arg_min(size, ord) filter (size is not null) as size,
      count(distinct source_id) as n_sources from ranked group by run_id, dedupe_key)"""


def _parts(spark, sf):
    return derived(spark, sf, "parts").withColumn("flags", F.array().cast("array<string>"))


def _exact(spark, sf):
    return clean.merge_exact(_parts(spark, sf), PART_SPEC)


@query(
    "exact_dedupe_merge",
    f"with {_KEYED} select run_id, dedupe_key, name, type, brand, cast(size as varchar) as size, first_arrival, n_merged from exact",
)
def exact_dedupe_merge(spark, sf):
    return _exact(spark, sf).records.select(
        "run_id", "dedupe_key", "name", "type", "brand", F.col("size").cast("string").alias("size"),
        "first_arrival", "n_merged",
    )


@query(
    "merged_evidence",
    f"""with {_KEYED} select substring(sha1(run_id || ':' || dedupe_key), 1, 16) as record_id, source_id, evidence as snippet,
    arrival, filled::int as filled from ranked where evidence <> ''""",
)
def merged_evidence(spark, sf):
    rows = clean.evidence_rows(_exact(spark, sf))
    return rows.select(
        "record_id", "source_id", "snippet", F.col("position.arrival").alias("arrival"),
        (-F.col("position.unfilled")).alias("filled"),
    )


_SCORE = """round_even(0.5::double * ((name is not null)::int + (type is not null)::int + (brand is not null)::int + (size is not null)::int) / 4.0::double
    + 0.3::double * (least({n}, 3) / 3.0::double) + 0.2::double, 3)"""


@query(
    "confidence",
    f"with {_KEYED} select run_id, dedupe_key, n_sources, {_SCORE.format(n='n_sources')} as confidence from exact",
)
def confidence(spark, sf):
    return clean.score_records(_exact(spark, sf), PART_SPEC).select("run_id", "dedupe_key", "n_sources", "confidence")


@query(
    "confidence_uncorroborated",
    f"with {_KEYED} select run_id, dedupe_key, {_SCORE.format(n='0')} as confidence from exact",
)
def confidence_uncorroborated(spark, sf):
    return clean.score_records(_exact(spark, sf), PART_SPEC, corroborate=False).select(
        "run_id", "dedupe_key", "confidence"
    )


@query(
    "keyless_dedupe",
    f"""with {_PARTS} select run_id, {q.dedupe_key(q.key_text('brand'), q.key_text('name'), q.key_text('cast(nullif(size, 0) as varchar)'), q.key_text('type'))} as dedupe_key,
    count(*) as n_merged from parts group by 1, 2""",
)
def keyless_dedupe(spark, sf):
    spec = TaskSpec(PART_SPEC.entity, PART_SPEC.fields)
    return clean.merge_exact(_parts(spark, sf), spec).records.select("run_id", "dedupe_key", "n_merged")


# Similar keys: longest common subsequences row by row, then the greedy pass in order.
_SIMILAR = f"""{_KEYED}, nodes as (select run_id, first_arrival as idx, dedupe_key, {q.sorted_tokens('fuzzy_key')} as s from exact),
    strings as (select run_id, s, min(idx) as idx from nodes where s <> '' group by run_id, s),
    near as (select a.run_id, a.idx as a, b.idx as b, a.s as sa, b.s as sb from strings a join strings b on a.run_id = b.run_id and a.idx < b.idx
      where levenshtein(a.s, b.s) <= 0.1 * (length(a.s) + length(b.s))),
    lcs as (select run_id, a, b, sa, sb, 0 as i, list_transform(range(length(sb) + 1), lambda x: 0::bigint) as line from near
      union all
      select run_id, a, b, sa, sb, i + 1, list_transform(range(1, length(sb) + 2), lambda j: list_max(list_transform(range(1, j + 1),
        lambda t: greatest(line[t], case when t > 1 and substring(sa, i + 1, 1) = substring(sb, (t - 1)::int, 1) then line[t - 1] + 1 else 0 end))))
      from lcs where i < length(sa)),
    pairs as (select run_id, a, b from lcs where i = length(sa) and 200 * line[length(sb) + 1] >= 90 * (length(sa) + length(sb)))"""

_LEADERS = f"""{_SIMILAR}, seq as (select run_id, idx, s, row_number() over (partition by run_id order by idx) as n from strings),
    nbrs as (select p.run_id, p.b as idx, list(p.a) as earlier from pairs p group by 1, 2),
    steps as (select s.run_id, s.idx, s.n, coalesce(nb.earlier, []::bigint[]) as earlier from seq s left join nbrs nb on nb.run_id = s.run_id and nb.idx = s.idx),
    walk as (select run_id, 0::bigint as n, []::bigint[] as leaders from (select distinct run_id from seq)
      union all
      select w.run_id, w.n + 1, case when list_has_any(w.leaders, t.earlier) then w.leaders else list_append(w.leaders, t.idx) end
      from walk w join steps t on t.run_id = w.run_id and t.n = w.n + 1),
    heads as (select run_id, arg_max(leaders, n) as leaders from walk group by run_id),
    by_string as (select t.run_id, s.s, coalesce(list_min(list_intersect(t.earlier, h.leaders)), t.idx) as leader
      from steps t join heads h on h.run_id = t.run_id join seq s on s.run_id = t.run_id and s.idx = t.idx),
    led as (select n.run_id, n.idx, n.dedupe_key, coalesce(b.leader, n.idx) as leader from nodes n left join by_string b on b.run_id = n.run_id and b.s = n.s)"""


def _nodes(spark, sf):
    return _exact(spark, sf).records.select(
        "run_id", F.col("first_arrival").alias("idx"), text.sorted_tokens(F.col("fuzzy_key")).alias("s")
    )


@query("fuzzy_pairs", f"with recursive {_SIMILAR} select run_id, a, b from pairs")
def fuzzy_pairs(spark, sf):
    return fuzzy.similar_pairs(_nodes(spark, sf))


@query("fuzzy_long_keys")
def fuzzy_long_keys(spark, sf):
    """Similar turns of conversations: whole texts as keys, several hundred characters long; first turns are quoted again."""
    key = text.sorted_tokens(text.key_text(F.col("text"))).alias("s")
    turns = base(spark, sf, "conversations")
    nodes = turns.select((F.col("conv_id") % 3).alias("run_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), key)
    return fuzzy.similar_pairs(nodes.unionByName(_quoted(turns)))


def _quoted(turns):
    """The first turn of every conversation once more, without its last word: similar keys at any size of the table."""
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("turn"), F.min_by("text", "turn").alias("text"))
    shorter = text.sorted_tokens(text.key_text(F.regexp_replace("text", r"\s+\S+\s*$", ""))).alias("s")
    return first.select((F.col("conv_id") % 3).alias("run_id"), (F.col("conv_id") * 1000 + 500 + F.col("turn")).alias("idx"), shorter)


@query("fuzzy_leaders", f"with recursive {_LEADERS} select run_id, idx, leader from led where leader <> idx")
def fuzzy_leaders(spark, sf):
    return fuzzy.leaders_of(_nodes(spark, sf))


@query(
    "fuzzy_dedupe",
    f"""with recursive {_LEADERS}, joined as (select e.*, l.leader, (l.leader <> l.idx)::bigint * 1000000000 + e.first_arrival as ord
      from exact e join led l on l.run_id = e.run_id and l.idx = e.first_arrival)
    select run_id, arg_min(dedupe_key, ord) as dedupe_key, arg_min(name, ord) filter (name is not null) as name,
      arg_min(brand, ord) filter (brand is not null) as brand, cast(arg_min(size, ord) filter (size is not null) as varchar) as size,
      min(first_arrival) as first_arrival, cast(sum(n_merged) as bigint) as n_merged from joined group by run_id, leader""",
)
def fuzzy_dedupe(spark, sf):
    exact = _exact(spark, sf)
    merged = clean.merge_clusters(exact, leaders_by_key(exact.records), PART_SPEC)
    return merged.records.select(
        "run_id", "dedupe_key", "name", "brand", F.col("size").cast("string").alias("size"), "first_arrival", "n_merged"
    )


@query(
    "build_dataset",
    f"""with recursive {_LEADERS}, joined as (select e.*, l.leader, (l.leader <> l.idx)::bigint * 1000000000 + e.first_arrival as ord
      from exact e join led l on l.run_id = e.run_id and l.idx = e.first_arrival),
    src as (select j.run_id, j.leader, count(distinct r.source_id) as n_sources from joined j join ranked r on r.run_id = j.run_id and r.dedupe_key = j.dedupe_key group by 1, 2),
    merged as (select run_id, leader, arg_min(dedupe_key, ord) as dedupe_key, arg_min(name, ord) filter (name is not null) as name,
      arg_min(type, ord) filter (type is not null) as type,
      arg_min(brand, ord) filter (brand is not null) as brand, arg_min(size, ord) filter (size is not null) as size from joined group by run_id, leader)
    select m.run_id, substring(sha1(m.run_id || ':' || dedupe_key), 1, 16) as record_id, name, brand, {_SCORE.format(n='n_sources')} as confidence
    from merged m join src s on s.run_id = m.run_id and s.leader = m.leader""",
)
def built(spark, sf):
    data = build_dataset(_parts(spark, sf), PART_SPEC)
    return data.records.select("run_id", "record_id", "name", "brand", "confidence")


# Three runs, each with a spec of its own: (name, type), (name, brand) and (name, type, size).
_SPEC_FIELDS = (
    (0, 0, "name", "str", True, True), (0, 1, "type", "str", False, True),
    (1, 0, "name", "str", True, True), (1, 1, "brand", "str", False, False),
    (2, 0, "name", "str", True, True), (2, 1, "type", "str", False, False), (2, 2, "size", "int", False, True),
)


@query(
    "build_dataset_by_spec",
    f"""with {_PARTS}, f as (select run_id, arrival, source_id, name, case when run_id <> 1 then type end as type,
      case when run_id = 1 then brand end as brand, case when run_id = 2 then size end as size from parts where name is not null and trim(name) <> ''),
    keyed as (select *, case run_id when 0 then {q.dedupe_key(q.key_text('name'), q.key_text('type'))} when 1 then {q.dedupe_key(q.key_text('name'))}
        else {q.dedupe_key(q.key_text('name'), q.key_text("case when size <> 0 then cast(size as varchar) end"))} end as dedupe_key,
      (name is not null)::int + (type is not null)::int + (brand is not null)::int + (size is not null)::int as filled from f),
    ranked as (select *, (10 - filled)::bigint * 1000000000 + arrival as ord from keyed),
    exact as (select run_id, dedupe_key, count(*) as n_merged, arg_min(name, ord) as name, arg_min(type, ord) filter (type is not null) as type,
      arg_min(brand, ord) filter (brand is not null) as brand, arg_min(size, ord) filter (size is not null) as size,
      count(distinct source_id) as n_sources from ranked group by run_id, dedupe_key)
    select run_id, substring(sha1(run_id || ':' || dedupe_key), 1, 16) as record_id, name, type, brand, cast(size as varchar) as size, n_merged,
      round_even(0.5::double * ((name is not null)::int + (type is not null)::int + (brand is not null)::int + (size is not null)::int)
        / case when run_id = 2 then 3.0::double else 2.0::double end + 0.3::double * (least(n_sources, 3) / 3.0::double) + 0.2::double, 3) as confidence from exact""",
)
def built_by_spec(spark, sf):
    parts = _parts(spark, sf)
    cells = [x for n in ("name", "type", "brand", "size") for x in (F.lit(n), F.col(n).cast("string"))]
    pool = parts.select("run_id", "arrival", "source_id", "evidence", "flags", F.create_map(*cells).alias("data"))
    fields = spark.createDataFrame(
        list(_SPEC_FIELDS), "run_id long, ordinal int, name string, type string, required boolean, is_key boolean"
    )
    data, rows = F.col("data"), build_dataset_by_spec(pool, fields, merge_similar=False).records
    return rows.select(
        "run_id", "record_id", *[data[n].alias(n) for n in ("name", "type", "brand", "size")], "n_merged", "confidence"
    )


# Records as an extractor would return them from the pages; every fifth quotes the next page.
PAGE_SPEC = TaskSpec(
    entity="article",
    fields=(
        FieldSpec("title", "str", "", True), FieldSpec("lang"), FieldSpec("site", "url"),
        FieldSpec("code", "int"), FieldSpec("tag"),
    ),
    key_fields=("title", "site"),
)

_TITLE = r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"
_LANG = r'(?i)<html[^>]*\blang="([^"]*)"'

_PAGE_RECORDS = f"""texts as (select page_id % 4 as run_id, page_id, url, {q.usable_text('html')} as text,
      {q.first_paragraph('html')} as para, {q.visible(f"regexp_extract(html, '{_TITLE}', 1)")} as h1, regexp_extract(html, '{_LANG}', 1) as lang from pages),
    raw as (select t.run_id, t.page_id, t.url, t.text, case when t.page_id % 5 = 0 and n.para is not null then n.para else t.para end as evidence,
      case when t.page_id % 6 = 0 then reverse(t.h1) else t.h1 end as title, t.lang, 'https://' || {q.host('t.url')} as site,
      case when t.page_id % 3 = 0 then t.page_id * 1000 + 731 else t.page_id % 50 end as code,
      case when t.page_id % 4 = 0 then 'qzx wvk jjy' else 'ab' end as tag
      from texts t left join texts n on n.page_id = t.page_id + 1),
    normed as (select *, {q.norm('evidence')} as n_ev, {q.norm('text')} as n_text from raw),
    checked as (select *, coalesce(evidence <> '' and text <> '' and contains(n_text, n_ev), false) as verified from normed)"""

_BEFORE = "substring(text, greatest(pos - 200, 1)::int, least(pos - 1, 200)::int)"
_AFTER = "substring(text, (pos + length(evidence))::int, 200)"


def _cut(value: str, index: int) -> str:
    for sep in ("chr(10) || chr(10)", "'---'", "'==='", "'___'", "'###'", "'##'"):
        value = f"string_split({value}, {sep})[{index}]"
    return value


_GROUNDED = f"""{_PAGE_RECORDS}, spot as (select *, strpos(text, evidence) as p1, strpos(lower(text), lower(evidence)) as p2 from checked where verified),
    located as (select *, case when p1 > 0 then p1 else p2 end as pos from spot),
    ctx as (select *, {q.norm(f"case when pos > 0 then {_cut(_BEFORE, -1)} || evidence || {_cut(_AFTER, 1)} else evidence end")} as c from located),
    facts as (select *, {q.plain('c')} as pc, regexp_replace(c, '[^0-9]', '', 'g') as digits, {q.norm('title')} as nt, {q.norm('tag')} as ng from ctx),
    bad as (select *, not (contains(c, nt) or contains(pc, {q.plain('nt')})
        or len(list_filter(string_split({q.plain('nt')}, ' '), lambda w: length(w) >= 3 and not contains(pc, w))) = 0) as bad_title,
      not (length(tag) < 3 or contains(c, ng) or contains(pc, {q.plain('ng')})
        or len(list_filter(string_split({q.plain('ng')}, ' '), lambda w: length(w) >= 3 and not contains(pc, w))) = 0) as bad_tag,
      not (length(cast(code as varchar)) < 3 or contains(digits, cast(code as varchar))) as bad_code from facts)"""


def _page_texts(spark, sf):
    html = F.col("html")
    return texts(spark, sf, "pages").select(
        (F.col("page_id") % 4).alias("run_id"), "page_id", "url", text.usable_text(html, None).alias("text"),
        F.try_element_at(text.paragraphs(html), F.lit(1)).alias("para"),
        text._visible(F.regexp_extract(html, _TITLE, 1)).alias("h1"), F.regexp_extract(html, _LANG, 1).alias("lang"),
    )


def _page_records(own):
    following = own.select((F.col("page_id") - 1).alias("page_id"), F.col("para").alias("next_para"))
    page = F.col("page_id")
    return own.join(following, "page_id", "left").select(
        "run_id", "page_id", page.alias("arrival"), F.concat(F.lit("p"), page.cast("string")).alias("source_id"),
        F.when((page % 5 == 0) & F.col("next_para").isNotNull(), F.col("next_para")).otherwise(F.col("para")).alias("evidence"),
        F.when(page % 6 == 0, F.reverse("h1")).otherwise(F.col("h1")).alias("title"), "lang",
        F.concat(F.lit("https://"), urls.host(F.col("url"))).alias("site"),
        F.when(page % 3 == 0, page * 1000 + 731).otherwise(page % 50).alias("code"),
        F.when(page % 4 == 0, "qzx wvk jjy").otherwise("ab").alias("tag"),
        F.array().cast("array<string>").alias("flags"),
    )


def _verified(spark, sf, **options):
    # Texts feed the records and the pages they are checked against: extracted once.
    own = cut_lineage(_page_texts(spark, sf))
    return verify.verify_for_spec(_page_records(own), own, PAGE_SPEC, **options)


@query("evidence_exact", f"with {_PAGE_RECORDS} select run_id, page_id, verified from checked")
def evidence_exact(spark, sf):
    return _verified(spark, sf, fuzzy=False, ground=False).select("run_id", "page_id", "verified")


@query(
    "ground_fields",
    f"""with {_GROUNDED} select run_id, page_id, case when not bad_title then title end as title, cast(case when not bad_code then code end as varchar) as code,
    case when not bad_tag then tag end as tag, lang, bad_title::int + bad_code::int + bad_tag::int as n_nulled from bad""",
)
def ground_fields(spark, sf):
    rows = _verified(spark, sf).filter("verified")
    return rows.select("run_id", "page_id", "title", F.col("code").cast("string").alias("code"), "tag", "lang", "n_nulled")


# Quotes with every 25th letter lost still match, reversed ones do not.
@query("evidence_fuzzy", "select page_id, page_id % 3 <> 2 as verified from pages")
def evidence_fuzzy(spark, sf):
    own_texts = cut_lineage(_page_texts(spark, sf).select("run_id", "page_id", "text"))
    own = F.substring("text", 11, 240)
    gaps = F.array_join(F.filter(F.split(own, ""), lambda c, i: i % 25 != 24), "")
    kind = F.col("page_id") % 3
    quote = F.when(kind == 0, own).when(kind == 1, gaps).otherwise(F.reverse(own))
    records = own_texts.select("run_id", "page_id", F.col("page_id").alias("arrival"), quote.alias("evidence"))
    return verify.verify_records(records, own_texts, [], ground=False).select("page_id", "verified")


# Names that lost a letter here and there, against the whole line they come from. The SQL scores every
# window: bits of the needle's letters, folded over the window, count the longest common subsequence.
_EDITED_NAMES = """with p as (select p_partkey, p_name || ' made by ' || p_brand as own, p_size from part),
    e as (select p_partkey, own || ', ' || p_size::varchar || ' in a box, ' || p_partkey::varchar as page,
      array_to_string([case when (i * 17 + p_partkey) % (3 + p_size % 13) <> 0 then own[i + 1] when p_partkey % 2 = 0 then '' else 'x' end
        for i in range(length(own))], '') as needle from p),
    b as (select p_partkey, length(needle) as m, length(page) as n, (1::bigint << length(needle)) - 1 as full_bits,
      [list_sum([case when needle[j + 1] = page[i + 1] then 1::bigint << j else 0 end for j in range(length(needle))])::bigint for i in range(length(page))] as bits from e),
    w as (select p_partkey, m, full_bits, bits[greatest(s, 0) + 1 : least(s + m, n)] as part from b, unnest(range(1 - m, n)) as u(s)),
    l as (select p_partkey, m, len(part) as size,
      m - bit_count(list_reduce(list_prepend(full_bits, part), lambda r, x: ((r + (r & x)) | (r - (r & x))) & full_bits)) as lcs from w)
    select p_partkey, bool_or(200 * lcs >= 90 * (m + size)) as close_90, bool_or(200 * lcs >= 85 * (m + size)) as close_85,
      bool_or(200 * lcs >= 70 * (m + size)) as close_70 from l group by 1"""


@query("close_windows", _EDITED_NAMES)
def close_windows(spark, sf):
    own = F.concat("p_name", F.lit(" made by "), "p_brand")
    lost = lambda i: (i * 17 + F.col("p_partkey")) % (3 + F.col("p_size") % 13) == 0
    stand_in = F.when(F.col("p_partkey") % 2 == 0, "").otherwise("x")
    letters = F.transform(F.split(own, ""), lambda c, i: F.when(lost(i), stand_in).otherwise(c))
    page = F.concat(own, F.lit(", "), F.col("p_size"), F.lit(" in a box, "), F.col("p_partkey"))
    rows = base(spark, sf, "part").select("p_partkey", F.array_join(letters, "").alias("needle"), page.alias("page"))
    check = {"close": (F.lit(True), F.col("needle"), F.col("page"))}
    for threshold in (90, 85, 70):
        rows = with_partial_matches(rows, check, threshold).withColumnRenamed("close", f"close_{threshold}")
    return rows.drop("needle", "page")


@query(
    "snippets_in_documents",
    f"""with b as (select item_id, {q.norm('text')} as s from benchmark), d as (select doc_id, {q.norm('text')} as t from documents)
    select item_id as snippet_id, doc_id from b, d where contains(t, s)""",
)
def snippets_in_documents(spark, sf):
    snippets = base(spark, sf, "benchmark").select(F.col("item_id").alias("snippet_id"), "text")
    return verify.snippets_in_documents(snippets, texts(spark, sf, "documents").select("doc_id", "text"))


_LINES = """select doc_id % 3 as run_id, doc_id as page_id, case when n_chars > 2000 then 2 else 1 end as n_chunks, text from documents"""


@query(
    "repeated_evidence",
    f"""with t as ({_LINES}), l as (select run_id, page_id, n_chunks, i as arrival, string_split(text, chr(10))[i + 1] as evidence
      from t, unnest(range(len(string_split(text, chr(10))))) as u(i)),
    k as (select *, lower({q.strip('evidence')}) as key from l),
    r as (select *, row_number() over (partition by page_id, key order by arrival) as n from k)
    select run_id, page_id, cast(arrival as bigint) as arrival, evidence from r where n_chunks = 1 or key = '' or n = 1""",
)
def repeated_evidence(spark, sf):
    docs = spark.sql(_LINES.replace("from documents", "from {d}"), d=texts(spark, sf, "documents"))
    lines = docs.select("run_id", "page_id", "n_chunks", F.posexplode(F.split("text", "\n")).alias("arrival", "evidence"))
    kept = drop_repeated_evidence(lines.withColumn("arrival", F.col("arrival").cast("bigint")))
    return kept.select("run_id", "page_id", "arrival", "evidence")


BLOCKED = ("spam-farm.example.org", "cheap-pills.example.com", "www.cheap-pills.example.com")

_PAGE_DATASET = f"""{_GROUNDED}, open as (select *, {q.policy_reason('url', BLOCKED)} as reason from bad),
    clean as (select run_id, page_id, case when not bad_title then nullif({q.collapse('title')}, '') end as title, nullif({q.collapse('lang')}, '') as lang, site,
      case when not bad_code then code end as code, case when not bad_tag then {q.collapse('tag')} end as tag,
      2 * (bad_title::int + bad_code::int + bad_tag::int) as n_flags from open where reason = 'OK'),
    valid as (select *, {q.dedupe_key(q.key_text('site'), q.key_text('title'))} as dedupe_key,
      1 + (lang is not null)::int + 1 + (code is not null)::int + (tag is not null)::int as filled from clean where title is not null),
    ranked as (select *, (10 - filled)::bigint * 1000000000 + page_id as ord from valid),
    merged as (select run_id, dedupe_key, arg_min(title, ord) as title, arg_min(lang, ord) filter (lang is not null) as lang,
      arg_min(code, ord) filter (code is not null) as code, arg_min(tag, ord) filter (tag is not null) as tag,
      arg_min(n_flags, ord) as n_flags, count(distinct page_id) as n_sources from ranked group by 1, 2)
    select run_id, substring(sha1(run_id || ':' || dedupe_key), 1, 16) as record_id, title, lang,
      round_even(0.5::double * ((2 + (lang is not null)::int + (code is not null)::int + (tag is not null)::int) / 5.0::double)
        + 0.3::double * (least(n_sources, 3) / 3.0::double) + 0.2::double * greatest(1 - 0.25::double * n_flags, 0), 3) as confidence from merged"""


@query("page_dataset", f"with {_PAGE_DATASET}")
def page_dataset(spark, sf):
    """Flagship: pages to text, policy gate, evidence and grounding, merge and score."""
    gate = policy.with_policy(base(spark, sf, "pages").select("page_id", "url"), blocked=BLOCKED)
    open_pages = gate.filter("allowed").select("page_id")
    own = cut_lineage(_page_texts(spark, sf))
    # Blocked pages leave before anything is checked against their text.
    records = _page_records(own).join(open_pages, "page_id", "left_semi")
    verified = verify.verify_for_spec(records, own.join(open_pages, "page_id", "left_semi"), PAGE_SPEC)
    data = build_dataset(verified.filter("verified").drop("verified", "n_nulled", "page_id"), PAGE_SPEC, merge_similar=False)
    return data.records.select("run_id", "record_id", "title", "lang", "confidence")


ARTICLE_SPEC = TaskSpec(
    entity="article", fields=(FieldSpec("title", "str", "", True), FieldSpec("words", "int")), key_fields=("title",)
)


def first_line_extractor(chunk: str, url: str) -> list[dict]:
    """One record per chunk: its first line, quoted."""
    line = chunk.split("\n", 1)[0]
    return [{"title": line[:60], "words": len(line.split()), "evidence": line}] if line else []


@query(
    "extract_records",
    f"""with t as (select page_id % 4 as run_id, page_id, {q.usable_text('html')} as text from pages),
    c as (select run_id, page_id, i, substring(text, cast(i as int) * 7500 + 1, 8000) as chunk,
      case when length(text) <= 8000 then 1 else cast(ceil(length(text) / 7500.0) as int) end as n
      from t, unnest(range(cast(length(text) // 7500 + 1 as int))) as u(i) where text is not null and (i = 0 or (length(text) > 8000 and i * 7500 < length(text)))),
    r as (select run_id, page_id, i, n, string_split(chunk, chr(10))[1] as line from c where string_split(chunk, chr(10))[1] <> ''),
    k as (select *, row_number() over (partition by page_id, lower({q.strip('line')}) order by i) as rn from r)
    select run_id, page_id, substring(line, 1, 60) as title, len(list_filter(string_split_regex(line, '\\s+'), lambda w: w <> '')) as words, line as evidence
    from k where n = 1 or rn = 1 or {q.strip('line')} = ''""",
)
def extracted(spark, sf):
    pages = _page_texts(spark, sf).withColumn("page_order", F.col("page_id"))
    rows = extract_records(pages, ARTICLE_SPEC, first_line_extractor)
    return rows.select("run_id", "page_id", "title", "words", "evidence")


def _collected(spark, sf, **options):
    candidates = derived(spark, sf, "candidates").select(
        "run_id", "query_idx", "rank", "url", F.lit("t").alias("title"),
        F.rpad(F.col("url"), 60, "x").alias("snippet"),
    )
    page = F.col("page_id")
    fetched = texts(spark, sf, "pages").select(
        "url", "html", F.when(page % 9 == 0, 503).otherwise(200).alias("http_status"),
        F.when(page % 10 == 3, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"),
    )
    return collect(candidates, fetched, ARTICLE_SPEC, first_line_extractor, blocked=BLOCKED, **options)


@query("collect_records")
def collect_records(spark, sf):
    return _collected(spark, sf).dataset.records.select("run_id", "record_id", "title", "words", "confidence")


@query("collect_stats")
def collect_stats(spark, sf):
    return _collected(spark, sf).stats


_VISITED = f"""{derived_sql('candidates')},
    seen as (select *, row_number() over (partition by run_id, url order by query_idx, rank) as n from candidates),
    o as (select run_id, url, {q.policy_reason('url', BLOCKED)} as reason,
      row_number() over (partition by run_id order by query_idx, rank, url) as page_order from seen where n = 1 and url <> ''),
    b as (select url, case when page_id % 9 <> 0 and page_id % 10 <> 3 then {q.usable_text('html')} end as body from pages),
    v as (select run_id, url, page_order, case when reason <> 'OK' then 'blocked_by_policy' when body is null then 'via_search_provider' else 'fetched' end as status,
      case when reason = 'OK' then coalesce(body, rpad(url, 60, 'x')) end as text from o left join b using (url)),
    c as (select run_id, url, page_order, i, substring(text, cast(i as int) * 7500 + 1, 8000) as chunk, length(text) <= 8000 as whole
      from v, unnest(range(cast(length(text) // 7500 + 1 as int))) as u(i) where text is not null and (i = 0 or (length(text) > 8000 and i * 7500 < length(text)))),
    r as (select *, string_split(chunk, chr(10))[1] as line from c where string_split(chunk, chr(10))[1] <> ''),
    k as (select *, row_number() over (partition by run_id, url, lower({q.strip('line')}) order by i) as rn from r),
    x as (select run_id, url, page_order, substring(line, 1, 60) as title from k where whole or rn = 1 or {q.strip('line')} = '')"""


@query(
    "collect_until_target",
    f"""with {_VISITED}, f as (select run_id, {q.key_text('title')} as entity, min(page_order) as page_order from x where {q.collapse('title')} <> '' group by 1, 2),
    n as (select *, row_number() over (partition by run_id order by page_order, entity) as n from f), s as (select run_id, page_order as stop from n where n = 12),
    g as (select run_id, url, count(*) as found from x group by 1, 2)
    select v.run_id::varchar as run_id, url, status, coalesce(found, 0) as records_found from v left join g using (run_id, url) left join s using (run_id)
    where stop is null or page_order <= stop""",
)
def collect_until_target(spark, sf):
    """Sources of runs that each end once they have twelve records; exact keys only."""
    out = _collected(spark, sf, target=12, merge_similar=False)
    return out.sources.select("run_id", "url", "status", "records_found")


@query(
    "collect_sources",
    f"""with {_VISITED}, g as (select run_id, url, count(*) as found from x group by 1, 2)
    select v.run_id::varchar as run_id, url, status, coalesce(found, 0) as records_found from v left join g using (run_id, url)""",
)
def collect_sources(spark, sf):
    return _collected(spark, sf, merge_similar=False).sources.select("run_id", "url", "status", "records_found")


@query(
    "run_stats",
    f"""with {_GROUNDED}, s as (select run_id, count(*) as raw_count, count(*) filter (verified) as verified_count, count(*) filter (not verified) as hallucinated_count from checked group by 1),
    g as (select run_id, sum(bad_title::int + bad_code::int + bad_tag::int) as fields_nulled, count(*) filter (not bad_title) as valid_count,
      count(distinct case when not bad_title then {q.key_text('site')} || '|' || {q.key_text('title')} end) as deduped_count from bad group by 1)
    select s.run_id, raw_count, verified_count, coalesce(valid_count, 0) as valid_count, coalesce(deduped_count, 0) as deduped_count,
      (select count(*) from pages p where p.page_id % 4 = s.run_id and p.page_id % 3 <> 0) as pages_fetched,
      (select count(*) from pages p where p.page_id % 4 = s.run_id and p.page_id % 3 = 0) as pages_failed,
      hallucinated_count, cast(coalesce(fields_nulled, 0) as bigint) as fields_nulled from s left join g on g.run_id = s.run_id""",
)
def run_stats(spark, sf):
    return report.run_stats(*_stages(spark, sf))


def _stages(spark, sf):
    verified = cut_lineage(_verified(spark, sf))
    pool = verified.filter("verified").drop("verified", "n_nulled", "page_id")
    validated = cut_lineage(clean.validate_records(clean.normalize_records(pool, PAGE_SPEC), PAGE_SPEC))
    valid = validated.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    records = clean.merge_exact(valid, PAGE_SPEC).records
    sources = texts(spark, sf, "pages").select(
        (F.col("page_id") % 4).alias("run_id"),
        F.when(F.col("page_id") % 3 == 0, "failed").otherwise("fetched").alias("status"),
    )
    return verified, validated, records, sources


@query(
    "stats_write_back",
    f"""with {_GROUNDED}, s as (select run_id, count(*) as raw, count(*) filter (verified) as ok, count(*) filter (not verified) as wrong from checked group by 1),
    m as (select run_id, count(*) filter (bad_title) as missing from bad group by 1)
    select s.run_id::varchar as run_id, raw::bigint as raw_count, ok::bigint as verified_count, nullif(wrong, 0)::bigint as evidence_mismatch, nullif(missing, 0)::bigint as missing_required,
      (select count(*) from pages p where p.page_id % 4 = s.run_id and p.page_id % 3 = 0)::bigint as fetch_failed from s left join m on m.run_id = s.run_id""",
)
def stats_write_back(spark, sf):
    """Statistics and drop reasons put into the rows of the runs, read back from there."""
    verified, validated, records, sources = _stages(spark, sf)
    ids = base(spark, sf, "pages").select((F.col("page_id") % 4).cast("string").alias("run_id")).distinct()
    runs = ids.withColumns({"status": F.lit("completed"), "stats": F.lit("{}")})
    stats = report.run_stats(verified, validated, records, sources)
    stored = reports.write_back(runs, stats, report.drop_reasons(sources, verified, validated))
    told = lambda path: F.get_json_object("stats", f"$.{path}").cast("bigint").alias(path.split(".")[-1])
    return stored.select(
        "run_id", told("raw_count"), told("verified_count"), told("dropped_reasons.evidence_mismatch"),
        told("dropped_reasons.missing_required"), told("dropped_reasons.fetch_failed"),
    )


@query(
    "drop_reasons",
    f"""with {_GROUNDED} select run_id, 'evidence_mismatch' as reason, count(*) as n from checked where not verified group by 1
    union all select run_id, 'missing_required', count(*) from bad where bad_title group by 1
    union all select page_id % 4, 'fetch_failed', count(*) from pages where page_id % 3 = 0 group by 1""",
)
def drop_reasons(spark, sf):
    verified, validated, _, sources = _stages(spark, sf)
    return report.drop_reasons(sources, verified, validated)
