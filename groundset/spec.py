"""Declared record schema of a task: dataclasses, struct types, and spec-table expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundset.sources.dimensions import REGIONS

# Defaults and limits of a task spec.
DEFAULT_TARGET = 30
DEFAULT_REGION = "GLOBAL"
MAX_REQUIRED_KEYS = 3

_SPARK_TYPES = {
    "str": T.StringType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "date": T.StringType(),
    "url": T.StringType(),
    "email": T.StringType(),
}

FIELD_STRUCT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("required", T.BooleanType()),
    ]
)

# `filters` stays text here: models return it as an object or as a JSON string.
RAW_SPEC = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("fields", T.ArrayType(FIELD_STRUCT)),
        T.StructField("filters", T.StringType()),
        T.StructField("key_fields", T.ArrayType(T.StringType())),
        T.StructField("target_count", T.IntegerType()),
        T.StructField("region", T.StringType()),
        T.StructField("source_hints", T.ArrayType(T.StringType())),
        T.StructField("assumptions", T.ArrayType(T.StringType())),
        T.StructField("clarification", T.StringType()),
    ]
)


# Letters, digits and underscores, one of them no underscore; Java and Python read it alike.
FIELD_NAME = r"_*[^\W_]\w*"


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str = "str"
    description: str = ""
    required: bool = False

    def __post_init__(self):
        if self.type not in _SPARK_TYPES:
            raise ValueError(f"unknown field type: {self.type}")
        object.__setattr__(self, "name", clean_name(self.name))

    @property
    def spark_type(self) -> T.DataType:
        return _SPARK_TYPES[self.type]


@dataclass(frozen=True)
class TaskSpec:
    entity: str
    fields: tuple[FieldSpec, ...]
    key_fields: tuple[str, ...] = ()
    title: str = ""
    filters: dict = field(default_factory=dict)
    target_count: int = DEFAULT_TARGET
    region: str = DEFAULT_REGION

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def required_names(self) -> list[str]:
        return [f.name for f in self.fields if f.required]

    def with_capped_required(self) -> TaskSpec:
        """Only the first three key fields may stay required."""
        keep = set(self.key_fields[:MAX_REQUIRED_KEYS])
        fields = tuple(
            FieldSpec(f.name, f.type, f.description, f.required and f.name in keep) for f in self.fields
        )
        return TaskSpec(
            self.entity, fields, self.key_fields, self.title, self.filters, self.target_count, self.region
        )


def clean_name(name: str) -> str:
    """The name of a field as it is stored: `field_name` and `is_field_name` for one name."""
    stored = name.lower().replace(" ", "_")
    if re.fullmatch(FIELD_NAME, stored) is None:
        raise ValueError(f"a field name is snake_case, letters or digits and underscores: {stored}")
    return stored


def field_name(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def is_field_name(name: Column) -> Column:
    return field_name(name).rlike(f"(?U)^{FIELD_NAME}$")


def region_code(code: Column) -> Column:
    known = F.upper(F.trim(code))
    return F.when(known.isin(*[r[0] for r in REGIONS]), known).otherwise(DEFAULT_REGION)


def cap_required(fields: Column, key_fields: Column) -> Column:
    keep = F.slice(key_fields, 1, MAX_REQUIRED_KEYS)
    return F.transform(
        fields, lambda f: f.withField("required", f["required"] & F.array_contains(keep, f["name"]))
    )


def filter_map(filters: Column) -> Column:
    """JSON object to text map: nulls dropped, lists joined by ', '. A JSON string is read again."""
    text = F.when(filters.startswith('"'), F.from_json(F.concat(F.lit("["), filters, F.lit("]")), "array<string>")[0])
    text = F.coalesce(text, filters)
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    kept = F.filter(entries, lambda e: e["value"].isNotNull())

    def scalar(e):
        value = e["value"]
        listed = F.array_join(F.from_json(value, "array<string>"), ", ")
        spelled = F.when(value == "true", "True").when(value == "false", "False").otherwise(value)
        return F.struct(e["key"], F.when(value.startswith("["), listed).otherwise(spelled).alias("value"))

    return F.coalesce(F.map_from_entries(F.transform(kept, scalar)), F.create_map().cast("map<string,string>"))


def has_nested_filter(filters: Column) -> Column:
    values = F.map_values(F.from_json(filters, "map<string,string>"))
    return F.coalesce(F.exists(values, lambda v: F.coalesce(v.startswith("{"), F.lit(False))), F.lit(False))


def parse_specs(df: DataFrame, column: str = "spec", out: str = "spec") -> DataFrame:
    """Spec JSON column to a typed struct with defaults, plus `<out>_reject` (null when usable)."""
    raw = F.from_json(F.col(column), RAW_SPEC)
    df = df.withColumn("_raw", raw)
    s = F.col("_raw")
    fields = F.transform(
        F.coalesce(s["fields"], F.array().cast(T.ArrayType(FIELD_STRUCT))),
        lambda f: f.withField("name", field_name(f["name"])).withField(
            "required", F.coalesce(f["required"], F.lit(False))
        ),
    )
    keys = F.coalesce(s["key_fields"], F.array().cast("array<string>"))
    reject = (
        F.when(s["entity"].isNull() | s["fields"].isNull(), "unreadable spec")
        .when(F.exists(s["fields"], lambda f: ~F.coalesce(is_field_name(f["name"]), F.lit(False))), "bad field name")
        .when(
            F.exists(s["fields"], lambda f: ~F.coalesce(f["type"].isin(*_SPARK_TYPES), F.lit(False))),
            "bad field type",
        )
        .when(has_nested_filter(s["filters"]), "nested filter")
    )
    spec = F.struct(
        F.coalesce(s["title"], F.lit("")).alias("title"),
        s["entity"].alias("entity"),
        cap_required(fields, keys).alias("fields"),
        filter_map(s["filters"]).alias("filters"),
        keys.alias("key_fields"),
        F.coalesce(s["target_count"], F.lit(DEFAULT_TARGET)).alias("target_count"),
        region_code(F.coalesce(s["region"], F.lit(DEFAULT_REGION))).alias("region"),
        F.coalesce(s["source_hints"], F.array().cast("array<string>")).alias("source_hints"),
        F.coalesce(s["assumptions"], F.array().cast("array<string>")).alias("assumptions"),
        s["clarification"].alias("clarification"),
    )
    return df.withColumn(f"{out}_reject", reject).withColumn(out, spec).drop("_raw")


def spec_fields(specs: DataFrame, key: str = "run_id") -> DataFrame:
    """Long field table `(key, ordinal, name, type, required)` of parsed specs."""
    return specs.select(key, F.posexplode("spec.fields").alias("ordinal", "f")).select(
        key, "ordinal", "f.name", "f.type", "f.required"
    )
