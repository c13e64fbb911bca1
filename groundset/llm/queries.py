"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundset.llm import alignment, bpe, chat, exact, lexical, packing, passages, phrases, quality, secrets, sharding, simhash, warc
from groundset.llm.tables import documents, query


@query("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


@query("op2_bpe_round_trip")
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = bpe.encode_documents(docs, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )



@query("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")



@query("op4_repeated_passages")
def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_spans(documents(spark, sf_dir).select("doc_id", "text"))


OP5_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256
from d join g using (t)
"""


@query("op5_exact_dedup", OP5_SQL)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact.mark_copies(documents(spark, sf_dir).select("doc_id", "text"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SHARDS = 24


@query("op6_feistel_shards")
def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    dealt = sharding.shard(rows, ["doc_id", "text_crc32", "size"], SHARDS)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


OP7_SQL = """
with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as filled,
  list_filter(list_transform(string_split(lower(regexp_replace(t, '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g')), chr(10)),
    lambda x: trim(x, ' ')), lambda x: x <> '') as tidy from d),
win as (select doc_id, p, count(*) over (partition by doc_id, g) as n from (
  select doc_id, unnest(range(1, len(words) - 1)) as p,
    unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) as g
  from w where len(words) >= 3)),
cov as (select doc_id, count(distinct q) as n_repeat_words from (
  select doc_id, unnest([p, p + 1, p + 2]) as q from win where n >= 2) group by doc_id),
hosts as (select host, count(distinct t) as host_docs from d group by host),
lines as (select host, line from (select host, t, unnest(tidy) as line from w) join hosts using (host)
  group by host, line having count(distinct t) >= 20 and count(distinct t) > 0.1 * any_value(host_docs)),
lost as (select doc_id, sum(len(string_split(line, ' '))) as n from (select doc_id, host, unnest(tidy) as line from w)
  join lines using (host, line) group by doc_id),
m as (select w.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
  (len(filled) - len(list_distinct(filled)))::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(lost.n, 0)::bigint as n_lost_words
  from w left join cov on w.doc_id = cov.doc_id left join lost on w.doc_id = lost.doc_id)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_lost_words <= 0.5 * n_words as kept
from m
"""


@query("op7_line_frequency", OP7_SQL)
def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(documents(spark, sf_dir).select("doc_id", "source", "text"))


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_pieces(documents(spark, sf_dir).select("doc_id", "text")))


OP9_SQL = """
with b as (select conv_id, coalesce(trim(role, ' '), '') as speaker, coalesce(turn, 9223372036854775807) as t,
  coalesce(text, '') as x from conversations),
p as (select distinct conv_id, speaker as perspective from b where speaker <> 'system'),
h as (select b.*, p.perspective,
  case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end as as_role
  from b join p on b.conv_id is not distinct from p.conv_id),
r as (select *, '<|im_start|>' || as_role || case when as_role = 'user' then ' name=' || speaker else '' end
  || chr(10) as head from h),
s as (select *, head || x || '<|im_end|>' || chr(10) as segment from r),
o as (select *, row_number() over w - 1 as position, coalesce(sum(length(segment)) over (w rows between unbounded
  preceding and 1 preceding), 0)::bigint as first from s window w as (partition by conv_id, perspective
  order by t, speaker, x))
select conv_id, perspective, position, speaker, as_role, segment, first as start, first + length(segment) as "end",
  case when as_role = 'assistant' then first + length(head) end as train_start,
  case when as_role = 'assistant' then first + length(segment) - 1 end as train_end
from o
"""


@query("op9_chat_perspectives", OP9_SQL)
def op9_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op10_warc_derivatives")
def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir).select("doc_id", "text"))


@query("op12_phrase_fingerprint")
def op12_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.compare_with_next(documents(spark, sf_dir).select("doc_id", "text"))


OP13_SQL = """
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms from documents),
s as (select count(*) filter (len(terms) > 0) as big_n, sum(len(terms))::bigint as l from d),
q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark),
tf as (select doc_id, n, term, count(*) as tf from (select doc_id, len(terms) as n, unnest(terms) as term from d)
  where term in (select term from q) group by all),
df as (select term, count(*) as df from tf group by term),
r as (select item_id, doc_id, sum(floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)))::bigint
    * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // l)))))::bigint as score
  from q join tf using (term) join df using (term) cross join s group by all),
k as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from r where score > 0)
select item_id, rank, doc_id, score from k where rank <= 10
"""


@query("op13_lexical_search", OP13_SQL)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return lexical.search(documents(spark, sf_dir).select("doc_id", "text"), items)
