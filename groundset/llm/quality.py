"""Line-frequency quality rules: template lines of a host go, documents that consist of them go too.

Native columns only. A word is a run of characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundset.llm.tables import carried, restored, written

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BLANK = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"
NOT_SYMBOLS = r"[^#*$%&|<>]+"


@dataclass(frozen=True)
class LineLimits:
    """A line on more than `max_share` of a host's different texts, and on at least `min_docs` of them, goes;
    a document that loses more than `max_loss` of its words goes."""

    max_share: float = 0.1
    min_docs: int = 20
    max_loss: float = 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def _with_repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words within 3-word windows that occur twice or more.

    Texts whose window hashes all differ are done at once. In the others windows are sorted by hash, and
    neighbours of equal hash are compared as strings, so a hash collision counts for nothing. Each step is a
    settled column: a lambda would evaluate an expression anew for every element.
    """
    w = F.col(words)
    hashes = F.transform(
        F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), x),
    )
    keyed = F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("k"), i.alias("p")))),
    )
    window = lambda e: F.struct(
        F.concat_ws(" ", F.get(w, e.p), F.get(w, e.p + 1), F.get(w, e.p + 2)).alias("k"), e.p.alias("p")
    )
    texts = F.sort_array(F.transform(_twins("_by_hash"), window))
    places = F.sort_array(F.transform(_twins("_by_text"), lambda e: e.p))
    covered = F.transform(
        "_places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_places", i + 1) - p, F.lit(3)))
    )
    for name, step in (("_hashes", hashes), ("_by_hash", keyed), ("_by_text", texts), ("_places", places)):
        df = _settled(df, name, step)
    total = F.aggregate(covered, F.lit(0), lambda a, n: a + n)
    return _settled(df, out, F.coalesce(total, F.lit(0)).cast("bigint")).drop(
        "_hashes", "_by_hash", "_by_text", "_places"
    )


def _settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that the optimiser can't write into the expressions and filters above it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _twins(ordered: str) -> Column:
    """Elements of a sorted array of (k, p) whose k is also a neighbour's."""
    return F.filter(
        ordered,
        lambda e, i: F.coalesce(e.k == F.get(ordered, i + 1).k, F.lit(False))
        | F.coalesce(e.k == F.get(ordered, i - 1).k, F.lit(False)),
    )


def base_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long). A null text has no words."""
    own = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    filled = F.filter(F.split(own, "\n", -1), lambda x: x.rlike(NOT_BLANK))
    counted = _settled(_settled(docs, "_words", words_of(own)), "_lines", filled).withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("bigint"),
            "n_symbols": F.char_length(F.regexp_replace(own, NOT_SYMBOLS, "")).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        }
    )
    return _with_repeated_words(counted, "_words", "n_repeat_words").drop("_words", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _tidy(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "))


def measure(
    docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """One narrow row per document, written to the shared folder: _row, the id, _host, _digest (hash of the
    text), the base measures, and of each filled line its hash (lower case, blanks collapsed) and its words.

    The texts are read once; everything after works on this table. A null host is one host of its own.
    """
    own = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.transform(F.split(_tidy(F.col("_own")), "\n", -1), lambda x: F.trim(x))
    narrow = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("_id"),
        F.col(host_col).cast("string").alias("_host"),
        F.xxhash64(own).alias("_digest"),
        own.alias("_own"),
    )
    counted = _settled(base_measures(narrow, "_own"), "_all", lines).withColumn(
        "_lines",
        F.transform(
            F.filter("_all", lambda x: x != ""),
            lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n")),
        ),
    )
    return written(counted.drop("_own", "_all"), "lines")


def _host_key() -> Column:
    """The host as a join key that is never null; a null host differs from every named one, '' included."""
    return F.coalesce(F.concat(F.lit("="), F.col("_host")), F.lit(""))


def template_lines(measured: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """Lines above the limits: _host (as `_host_key` spells it), _line, n_docs (different texts of the host
    that hold the line).

    Copies of a text count once, so that a group of copies does not turn its own lines into templates. Counts
    are aggregations over hashes, combined before each shuffle; no line or host is gathered.
    """
    host = _host_key().alias("_host")
    counts = (
        measured.select(host, "_digest", F.explode("_lines.h").alias("_line"))
        .distinct()
        .groupBy("_host", "_line")
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .where(F.col("n_docs") >= limits.min_docs)
    )
    hosts = (
        measured.select(host, "_digest").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_host_docs"))
    )
    above = counts.join(hosts, "_host").where(F.col("n_docs") > F.col("_host_docs") * limits.max_share)
    return written(above.select("_host", "_line", "n_docs"), "templates")


def judge(measured: DataFrame, lines: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """The rows of `measured` with base_failed, kept, n_lost_words and _gone (hashes of lines to remove).

    Empty and null texts have no words and fail the base rule. Rows that repeat one another are judged each.
    """
    hits = (
        measured.select("_row", _host_key().alias("_host"), F.explode("_lines").alias("_l"))
        .select("_row", "_host", F.col("_l.h").alias("_line"), F.col("_l.n").alias("_n"))
        .join(lines.select("_host", "_line"), ["_host", "_line"])
    )
    # A document's own lines bound the set.
    lost = hits.groupBy("_row").agg(F.sum("_n").alias("_lost"), F.collect_set("_line").alias("_gone"))
    return (
        measured.drop("_lines")
        .join(lost, "_row", "left")
        .withColumns({"base_failed": base_failed(), "n_lost_words": F.coalesce("_lost", F.lit(0).cast("bigint"))})
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= F.col("n_words") * limits.max_loss))
        .drop("_lost")
    )


def quality_verdicts(
    docs: DataFrame,
    limits: LineLimits = LineLimits(),
    id_col: str = "doc_id",
    host_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Per row of `docs`: the id, the measures, base_failed, kept, n_lost_words. Other columns play no part."""
    measured = measure(docs, id_col, host_col, text_col)
    verdicts = judge(measured, template_lines(measured, limits), limits)
    return verdicts.select(F.col("_id").alias(id_col), *MEASURES, "base_failed", "kept", "n_lost_words")


def clean_documents(
    docs: DataFrame,
    limits: LineLimits = LineLimits(),
    id_col: str = "doc_id",
    host_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The kept documents without their template lines; other columns as they were, nulls included."""
    measured = measure(docs, id_col, host_col, text_col)
    verdicts = judge(measured, template_lines(measured, limits), limits)
    # A verdict depends on host and text alone, so rows that repeat an id share one row here.
    changed = (
        verdicts.where("not kept or _gone is not null")
        .groupBy(F.col("_id").alias("_q_id"), F.col("_host").alias("_q_host"), F.col("_digest").alias("_q_digest"))
        .agg(F.first("kept").alias("_q_kept"), F.first("_gone").alias("_q_gone"))
    )
    own = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    same = (
        F.col(id_col).eqNullSafe(F.col("_q_id"))
        & F.col(host_col).cast("string").eqNullSafe(F.col("_q_host"))
        & (own == F.col("_q_digest"))
    )
    left = (
        carried(docs, id_col, host_col, text_col)
        .join(changed, same, "left")
        .where("coalesce(_q_kept, true)")
        .withColumn(text_col, without_lines(F.col(text_col), F.col("_q_gone")))
    )
    return restored(left, docs, id_col, host_col, text_col)


def without_lines(text: Column, gone: Column) -> Column:
    """`text` without the lines whose hash is in `gone`; a null `gone` leaves it as it is."""
    hashed = lambda x: F.xxhash64(
        F.trim(_tidy(x))
    )
    left = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(gone, hashed(x)))
    return F.when(gone.isNull(), text).otherwise(F.array_join(left, "\n"))
