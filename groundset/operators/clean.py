"""Normalise, validate, merge exact duplicates and score records of one declared schema.

A record frame holds one column per spec field plus the meta columns `run_id`, `arrival` (order of
extraction, unique within a run), `source_id`, `evidence` and `flags`.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundset.functions import text, urls, values
from groundset.spec import FieldSpec, TaskSpec

META = ("run_id", "arrival", "source_id", "evidence", "flags")


class Deduped(NamedTuple):
    """Merged records, and their evidence as rows so that no group is ever one array."""

    records: DataFrame
    evidence: DataFrame


def _no_flags() -> Column:
    return F.array().cast("array<string>")


def _flag(when: Column, *names: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.array(*[F.lit(n) for n in names])).otherwise(_no_flags())


def _normalized(spec_field: FieldSpec, data_type: T.DataType, base: Column | None) -> tuple[Column, Column]:
    """Value and flag expressions of one field."""
    name, raw = spec_field.name, F.col(spec_field.name)
    is_text = isinstance(data_type, T.StringType)
    if spec_field.type == "str":
        return (text.normalize_string(raw) if is_text else raw), _no_flags()
    if spec_field.type == "date":
        result = values.normalize_date(raw.cast("string"))
        return result, _flag((raw.cast("string") != "") & result.isNull(), f"invalid_date_{name}")
    if spec_field.type == "url":
        if not is_text:
            return F.lit(None).cast("string"), _no_flags()
        result = urls.normalize_url(raw, base)
        return result["url"], _flag(~result["valid"], f"invalid_url_{name}")
    if spec_field.type == "email":
        return (values.normalize_email(raw) if is_text else F.lit(None).cast("string")), _no_flags()
    if spec_field.type in ("int", "float"):
        clash = values.currency_mismatch(name, raw) if is_text else F.lit(False)
        number = values.normalize_number(raw) if is_text else raw.cast("double")
        result = F.when(~clash, number)
        flags = F.concat(
            _flag(clash, "currency_mismatch", f"currency_mismatch_{name}"),
            _flag(~clash & raw.isNotNull() & number.isNull(), f"invalid_number_{name}"),
        )
        return (result.try_cast("bigint") if spec_field.type == "int" else result), flags
    return raw, _no_flags()


def normalize_records(df: DataFrame, spec: TaskSpec, base_url: str | None = None) -> DataFrame:
    """All fields by declared type in one projection; problems are appended to `flags`."""
    types = {f.name: f.dataType for f in df.schema.fields}
    base = F.col(base_url) if base_url else None
    pairs = {f.name: _normalized(f, types[f.name], base) for f in spec.fields}
    flags = F.concat(F.coalesce(F.col("flags"), _no_flags()), *[p[1] for p in pairs.values()])
    columns = [pairs[c][0].alias(c) if c in pairs else F.col(c) for c in df.columns if c != "flags"]
    return df.select(*columns, flags.alias("flags"))


def _is_blank(name: str, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return F.col(name).isNull() | (text.strip(F.col(name)) == "")
    return F.col(name).isNull()


def reject_reason(df: DataFrame, spec: TaskSpec) -> Column:
    """Flag naming the first missing required field in spec order, else null."""
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [
        F.when(_is_blank(n, types[n]), f"missing_required_{n}") for n in spec.required_names
    ]
    return F.coalesce(*missing) if missing else F.lit(None).cast("string")


def _format_flags(df: DataFrame, spec: TaskSpec) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    flags = []
    for f in spec.fields:
        col, is_text = F.col(f.name), isinstance(types[f.name], T.StringType)
        filled = ~_is_blank(f.name, types[f.name])
        if f.type == "email" and is_text:
            flags.append(_flag(filled & ~col.rlike(values.EMAIL_PATTERN), f"invalid_email_{f.name}"))
        elif f.type == "url" and is_text:
            flags.append(_flag(filled & ~col.rlike(values.URL_PATTERN), f"invalid_url_{f.name}"))
        elif f.type == "int" and is_text:
            whole = text.strip(col).rlike(r"^[+-]?\d+(?:_\d+)*$")
            flags.append(_flag(filled & ~whole, f"invalid_int_{f.name}"))
        elif f.type == "float" and is_text:
            flags.append(_flag(filled & text.strip(col).try_cast("double").isNull(), f"invalid_float_{f.name}"))
    return F.concat(F.coalesce(F.col("flags"), _no_flags()), *flags)


def validate_records(df: DataFrame, spec: TaskSpec) -> DataFrame:
    """Every row, with `reject_reason` (null for valid rows) and `flags`.

    A rejected row carries only its reject reason as flag.
    """
    reason = reject_reason(df, spec)
    return df.withColumn("reject_reason", reason).withColumn(
        "flags",
        F.when(F.col("reject_reason").isNotNull(), F.array("reject_reason")).otherwise(_format_flags(df, spec)),
    )


def filled_count(names: list[str]) -> Column:
    return sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))


def with_keys(df: DataFrame, spec: TaskSpec) -> DataFrame:
    """Add `dedupe_key` and `fuzzy_key`.

    Without key fields every public field is a key; without any field each row is its own key.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    key_names = sorted(spec.key_fields or spec.names)
    if not key_names:
        own = F.concat(F.lit("record_"), F.col("arrival").cast("string"))
        return df.withColumn("dedupe_key", own).withColumn("fuzzy_key", F.lit(""))
    parts = [
        text.key_text(F.col(n), types[n]) if n in types else F.lit("") for n in key_names
    ]
    return df.withColumn("dedupe_key", text.dedupe_key(parts)).withColumn("fuzzy_key", text.fuzzy_key(parts))


def _merge(df: DataFrame, keys: list[str], fields: list[str], order: list[Column], keep: list[Column]) -> DataFrame:
    """One row per key: each field from the first row in order that has it, flags of the first row.

    All aggregates combine before the shuffle, so a key holding a third of the rows sends one
    partial row per task.
    """
    rank = F.struct(*order)
    merged = [F.min_by(f, F.when(F.col(f).isNotNull(), rank)).alias(f) for f in fields]
    return df.groupBy(*keys).agg(*merged, F.min_by("flags", rank).alias("flags"), *keep)


def merge_exact(df: DataFrame, spec: TaskSpec) -> Deduped:
    """Collapse equal dedupe keys of a run, fullest record first, nulls filled by the next.

    `records.first_arrival` is where the key first appeared; `evidence` keeps every snippet with
    the sort columns of its group.
    """
    keyed = with_keys(df, spec).withColumn("unfilled", -filled_count(spec.names))
    records = _merge(
        keyed,
        ["run_id", "dedupe_key"],
        spec.names,
        [F.col("unfilled"), F.col("arrival")],
        [
            F.min("fuzzy_key").alias("fuzzy_key"),
            F.min("arrival").alias("first_arrival"),
            F.count(F.lit(1)).alias("n_merged"),
        ],
    )
    evidence = keyed.select("run_id", "dedupe_key", "unfilled", "arrival", "source_id", F.col("evidence").alias("snippet"))
    return Deduped(records, evidence)


def merge_clusters(exact: Deduped, leaders: DataFrame, spec: TaskSpec) -> Deduped:
    """Fold every absorbed record into its leader, in order of first appearance.

    `leaders` maps absorbed `(run_id, dedupe_key)` to `leader_key`; all others lead themselves. Evidence is as long as
    the pool, and the size Spark guesses for it comes from packed files, far too small: it is merged, never broadcast.
    """
    own = F.coalesce("leader_key", "dedupe_key")
    joined = exact.records.join(leaders, ["run_id", "dedupe_key"], "left").withColumn("leader", own)
    ranked = joined.withColumn("absorbed", (F.col("leader") != F.col("dedupe_key")).cast("int"))
    records = _merge(
        ranked.drop("dedupe_key"),
        ["run_id", "leader"],
        spec.names,
        [F.col("absorbed"), F.col("first_arrival")],
        [
            F.min_by("fuzzy_key", F.struct("absorbed", "first_arrival")).alias("fuzzy_key"),
            F.min("first_arrival").alias("first_arrival"),
            F.sum("n_merged").alias("n_merged"),
        ],
    ).withColumnRenamed("leader", "dedupe_key")
    order = ranked.select("run_id", "dedupe_key", "leader", "absorbed", "first_arrival")
    evidence = (
        exact.evidence.hint("merge").join(order, ["run_id", "dedupe_key"])
        .select(
            "run_id", F.col("leader").alias("dedupe_key"), "absorbed", "first_arrival",
            "unfilled", "arrival", "source_id", "snippet",
        )
    )
    return Deduped(records, evidence)


def confidence(filled: Column, total_fields: int | Column, sources: Column, flag_count: Column) -> Column:
    """Half completeness, three tenths corroboration (three sources saturate), the rest cleanliness."""
    total = F.lit(total_fields) if isinstance(total_fields, int) else total_fields
    completeness = filled / F.greatest(total, F.lit(1)).cast("double")
    corroboration = F.least(sources, F.lit(3)) / F.lit(3.0)
    cleanliness = F.greatest(F.lit(1.0) - flag_count * F.lit(0.25), F.lit(0.0))
    return F.bround(completeness * 0.5 + corroboration * 0.3 + cleanliness * 0.2, 3)


def source_counts(evidence: DataFrame) -> DataFrame:
    """Distinct non-empty sources per record, one row per (record, source) before the count."""
    given = evidence.filter(F.coalesce(F.col("source_id").cast("string"), F.lit("")) != "")
    pairs = given.select("run_id", "dedupe_key", "source_id").distinct()
    return pairs.groupBy("run_id", "dedupe_key").agg(F.count(F.lit(1)).alias("n_sources"))


def score_records(deduped: Deduped, spec: TaskSpec, corroborate: bool = True) -> DataFrame:
    """Records with `n_sources`, `confidence` and the deterministic `record_id`.

    `corroborate=False` leaves corroboration at zero, as a run that lost its source ids scores.
    """
    records = deduped.records.join(source_counts(deduped.evidence), ["run_id", "dedupe_key"], "left")
    n_sources = F.coalesce("n_sources", F.lit(0))
    counted = n_sources if corroborate else F.lit(0)
    score = confidence(filled_count(spec.names), len(spec.fields), counted, F.size("flags"))
    return (
        records.withColumn("n_sources", n_sources)
        .withColumn("confidence", score)
        .withColumn("record_id", text.record_id(F.col("run_id"), F.col("dedupe_key")))
    )


def evidence_rows(deduped: Deduped) -> DataFrame:
    """`record_evidence` rows: snippets with text and source, order columns kept."""
    order = [c for c in ("absorbed", "first_arrival", "unfilled", "arrival") if c in deduped.evidence.columns]
    kept = deduped.evidence.filter((F.col("snippet") != "") & (F.col("source_id").cast("string") != ""))
    return kept.select(
        text.record_id(F.col("run_id"), F.col("dedupe_key")).alias("record_id"),
        "run_id", "source_id", "snippet", F.struct(*order).alias("position"),
    )
