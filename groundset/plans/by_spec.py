"""Datasets of runs with different specs in one job: a record is a map, the spec of its run an array.

Same rules as `build_dataset`, whose specs are Python objects: values arrive as text and leave as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundset.functions import text, urls, values
from groundset.operators import clean
from groundset.plans.dataset import Dataset, leaders_by_key
from groundset.session import cut_lineage


def _none() -> Column:
    return F.array().cast("array<string>")


def _flag(when: Column, *names: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.array(*names)).otherwise(_none())


def _named(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix), name)


def with_fields(pool: DataFrame, fields: DataFrame) -> DataFrame:
    """`pool` with `_spec`, the fields of its run in order: (ordinal, name, type, required, is_key).

    `fields(run_id, ordinal, name, type, required, is_key)`, a few rows per run.
    """
    row = F.struct(F.col("ordinal").cast("int").alias("ordinal"), "name", "type", "required", "is_key")
    specs = fields.groupBy("run_id").agg(F.sort_array(F.collect_list(row)).alias("_spec"))
    none = F.array().cast("array<struct<ordinal:int,name:string,type:string,required:boolean,is_key:boolean>>")
    return pool.join(specs, "run_id", "left").withColumn("_spec", F.coalesce("_spec", none))


def _normalized(f: Column, raw: Column) -> Column:
    """One field's value, as text, and its flags."""
    name, kind = f["name"], f["type"]
    date, number = values.normalize_date(raw), values.normalize_number(raw)
    link = urls.normalize_url(raw, None)
    clash = values.currency_mismatch_of(name, raw)
    is_number = kind.isin("int", "float")
    kept = F.when(~clash, number)
    value = (
        F.when(kind == "str", text.normalize_string(raw))
        .when(kind == "date", date)
        .when(kind == "url", link["url"])
        .when(kind == "email", values.normalize_email(raw))
        .when(kind == "int", kept.try_cast("bigint").cast("string"))
        .when(kind == "float", kept.cast("string"))
        .otherwise(raw)
    )
    flags = F.concat(
        _flag((kind == "date") & (raw != "") & date.isNull(), _named("invalid_date_", name)),
        _flag((kind == "url") & ~link["valid"], _named("invalid_url_", name)),
        _flag(is_number & clash, F.lit("currency_mismatch"), _named("currency_mismatch_", name)),
        _flag(is_number & ~clash & raw.isNotNull() & number.isNull(), _named("invalid_number_", name)),
    )
    return F.struct(name.alias("name"), kind.alias("type"), value.alias("value"), flags.alias("flags"))


def _blank(f: Column) -> Column:
    return f["value"].isNull() | (text.strip(f["value"]) == "")


def _format_flags(f: Column) -> Column:
    kind, value = f["type"], f["value"]
    return F.concat(
        _flag((kind == "email") & ~_blank(f) & ~value.rlike(values.EMAIL_PATTERN), _named("invalid_email_", f["name"])),
        _flag((kind == "url") & ~_blank(f) & ~value.rlike(values.URL_PATTERN), _named("invalid_url_", f["name"])),
    )


def _key_part(f: Column) -> Column:
    kind, value = f["type"], f["value"]
    return (
        F.when(kind == "int", text.key_text(value.try_cast("bigint"), T.LongType()))
        .when(kind == "float", text.key_text(value.try_cast("double"), T.DoubleType()))
        .when(kind == "bool", text.key_text(value.try_cast("boolean"), T.BooleanType()))
        .otherwise(text.key_text(value))
    )


def validate_by_spec(pool: DataFrame, fields: DataFrame) -> DataFrame:
    """Every record `(run_id, arrival, source_id, evidence, flags, data)` normalised and checked by its run's spec.

    Adds `reject_reason`, `dedupe_key`, `fuzzy_key`, `unfilled` and `n_fields`. A key names fields of the spec;
    without any, every field is a key; a run without a spec keeps each record by itself. Rows that repeat a
    run and arrival stay apart, equal ones included; those of a run without a spec share their key.
    """
    # Rows of one run and arrival are told apart by their content; equal ones are counted and told out again.
    own = F.struct("source_id", "evidence", "flags", F.sort_array(F.map_entries("data")).alias("data"))
    whole = F.sha2(F.to_json(own, {"ignoreNullFields": "false"}), 256)
    cells = with_fields(pool, fields).withColumn("_whole", whole).withColumn("_s", F.explode_outer("_spec"))
    cells = cells.withColumn("_v", _normalized(F.col("_s"), F.try_element_at("data", F.col("_s.name"))))
    cell = F.struct(
        F.col("_s.ordinal").alias("ordinal"), F.col("_s.name").alias("name"), F.col("_v.value").alias("value"),
        F.col("_s.is_key").alias("is_key"), F.col("_v.flags").alias("flags"),
        (F.col("_s.required") & _blank(F.col("_v"))).alias("lacks"), _format_flags(F.col("_v")).alias("ill"),
        _key_part(F.col("_v")).alias("part"),
    )
    # A record's cells, as many as its spec has fields, come together again.
    df = cells.groupBy("run_id", "arrival", "_whole").agg(
        F.first("source_id").alias("source_id"),
        F.first("evidence").alias("evidence"),
        F.first("flags").alias("flags"),
        F.sort_array(F.collect_set(F.when(F.col("_s").isNotNull(), cell))).alias("_f"),
        (F.count(F.lit(1)) / F.greatest(F.max(F.size("_spec")), F.lit(1))).cast("int").alias("_n"),
    )
    df = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_n")))
    missing = F.get(F.filter("_f", lambda f: f["lacks"]), 0)["name"]
    own = F.filter("_f", lambda f: f["is_key"])
    keys = F.when(F.size(own) > 0, own).otherwise(F.col("_f"))
    parts = F.sort_array(F.transform(keys, lambda f: F.struct(f["name"].alias("name"), f["part"].alias("part"))))
    df = df.withColumn("_parts", parts["part"]).withColumn("reject_reason", _named("missing_required_", missing))
    raised = F.concat(
        F.coalesce("flags", _none()),
        F.flatten(F.transform("_f", lambda f: f["flags"])),
        F.flatten(F.transform("_f", lambda f: f["ill"])),
    )
    alone = F.size("_parts") == 0
    return df.select(
        "run_id", "arrival", "source_id", "evidence",
        F.when(F.col("reject_reason").isNotNull(), F.array("reject_reason")).otherwise(raised).alias("flags"),
        F.map_from_entries(F.transform("_f", lambda f: F.struct(f["name"], f["value"]))).alias("data"),
        "reject_reason",
        F.when(alone, F.concat(F.lit("record_"), F.col("arrival").cast("string")))
        .otherwise(F.substring(F.sha2(F.array_join("_parts", "|"), 256), 1, 16)).alias("dedupe_key"),
        F.array_join("_parts", " ").alias("fuzzy_key"),
        (-F.size(F.filter("_f", lambda f: f["value"].isNotNull()))).alias("unfilled"),
        F.size("_f").alias("n_fields"),
    )


def _merged(rows: DataFrame, key: str, order: list[str], keep: list[Column]) -> DataFrame:
    """One row per run and key: each field from the first row in order that has it. Combined before the shuffle."""
    rank = F.struct(*order)
    # Flags and value settle rows of one place.
    heads = rows.groupBy("run_id", key).agg(
        F.min_by("flags", F.struct(rank, "flags")).alias("flags"), F.max("n_fields").alias("n_fields"), *keep
    )
    cells = rows.select("run_id", key, *order, F.explode("data").alias("_name", "_value")).filter("_value is not null")
    firsts = cells.groupBy("run_id", key, "_name").agg(F.min_by("_value", F.struct(rank, "_value")).alias("_value"))
    # As many entries as the spec has fields.
    maps = firsts.groupBy("run_id", key).agg(F.map_from_entries(F.collect_list(F.struct("_name", "_value"))).alias("data"))
    empty = F.create_map().cast("map<string,string>")
    return heads.join(maps, ["run_id", key], "left").withColumn("data", F.coalesce("data", empty))


def build_dataset_by_spec(
    pool: DataFrame, fields: DataFrame, corroborate: bool = True, merge_similar: bool = True, **options
) -> Dataset:
    """Normalise, validate, merge and score the records of all runs, each by its own spec, in one job.

    `pool(run_id, arrival, source_id, evidence, flags, data)` and `fields(run_id, ordinal, name, type, required,
    is_key)`. Records hold their fields in `data`, a map without nulls.
    """
    validated = cut_lineage(validate_by_spec(pool, fields))
    valid = validated.filter(F.col("reject_reason").isNull())
    counts = [
        F.min("fuzzy_key").alias("fuzzy_key"), F.min("arrival").alias("first_arrival"),
        F.count(F.lit(1)).alias("n_merged"),
    ]
    records = _merged(valid, "dedupe_key", ["unfilled", "arrival"], counts)
    evidence = valid.select("run_id", "dedupe_key", "unfilled", "arrival", "source_id", F.col("evidence").alias("snippet"))
    if merge_similar:
        records = cut_lineage(records)
        led = records.join(leaders_by_key(records, **options), ["run_id", "dedupe_key"], "left")
        led = led.withColumn("leader", F.coalesce("leader_key", "dedupe_key"))
        led = led.withColumn("absorbed", (F.col("leader") != F.col("dedupe_key")).cast("int"))
        order = ["absorbed", "first_arrival"]
        sums = [
            F.min_by("fuzzy_key", F.struct(*order)).alias("fuzzy_key"),
            F.min("first_arrival").alias("_first"), F.sum("n_merged").alias("n_merged"),
        ]
        place = led.select("run_id", "dedupe_key", "leader", *order)
        records = _merged(led, "leader", order, sums).withColumnsRenamed({"leader": "dedupe_key", "_first": "first_arrival"})
        evidence = evidence.hint("merge").join(place, ["run_id", "dedupe_key"]).drop("dedupe_key").withColumnRenamed("leader", "dedupe_key")
    scored = records.join(clean.source_counts(evidence), ["run_id", "dedupe_key"], "left")
    n_sources = F.coalesce("n_sources", F.lit(0))
    score = clean.confidence(
        F.size("data"), F.col("n_fields"), n_sources if corroborate else F.lit(0), F.size("flags")
    )
    scored = scored.withColumns(
        {
            "n_sources": n_sources,
            "confidence": score,
            "record_id": text.record_id(F.col("run_id"), F.col("dedupe_key")),
        }
    )
    return Dataset(scored, clean.evidence_rows(clean.Deduped(scored, evidence)), validated)
