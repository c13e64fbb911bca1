"""Fetched pages to usable text, chunks and extracted records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundset.functions import text
from groundset.operators.skew import with_prefix
from groundset.session import cut_lineage
from groundset.spec import TaskSpec

Extractor = Callable[[str, str], list[dict]]


def accept_pages(
    pages: DataFrame, max_response_chars: int | None = None, max_text_chars: int | None = None
) -> DataFrame:
    """Add `text`, `status` and `fail_reason` to `(url, html, http_status, content_type, snippet)`.

    A page fails on an error status, a non-HTML type or too little text; its search snippet of at
    least 50 characters then stands in. Whole pages are read unless a limit is given.
    """
    return with_snippets(page_bodies(pages, max_response_chars, max_text_chars))


def page_bodies(
    pages: DataFrame, max_response_chars: int | None = None, max_text_chars: int | None = None
) -> DataFrame:
    """Add `text` and `fail_reason` to `(html, http_status, content_type)`: what each page itself gives."""
    html = F.col("html")
    if max_response_chars is not None:
        html = F.substring(html, 1, max_response_chars)
    http_reason = (
        F.when(F.col("http_status") >= 400, F.concat(F.lit("HTTP "), F.col("http_status").cast("string")))
        .when(~F.coalesce(F.col("content_type").contains("text/html"), F.lit(False)),
              F.concat(F.lit("Not HTML: "), F.coalesce("content_type", F.lit(""))))
    )
    body = F.when(http_reason.isNull(), text.usable_text(html, max_text_chars))
    short = F.when(F.col("text").isNull(), "Insufficient text content after extraction")
    return pages.withColumn("text", body).withColumn("fail_reason", F.coalesce(http_reason, short))


def with_snippets(bodies: DataFrame) -> DataFrame:
    """Add `status`; where a page failed, a search `snippet` of at least 50 characters becomes its text."""
    snippet = text.strip(F.col("snippet"))
    failed = F.col("fail_reason").isNotNull()
    stands_in = failed & (F.length(snippet) >= text.MIN_TEXT_CHARS)
    status = F.when(stands_in, "via_search_provider").when(failed, "failed").otherwise("fetched")
    return bodies.withColumn("status", status).withColumn("text", F.coalesce("text", F.when(stands_in, snippet)))


def chunk_pages(pages: DataFrame, text_column: str = "text", **limits) -> DataFrame:
    """One row per chunk, with `chunk_idx` and `n_chunks`."""
    pieces = text.chunks(F.col(text_column), **limits)
    rest = [c for c in pages.columns if c != text_column]
    return (
        pages.select(*rest, pieces.alias("_chunks"))
        .withColumn("n_chunks", F.size("_chunks"))
        .select(*rest, "n_chunks", F.posexplode("_chunks").alias("chunk_idx", "chunk"))
    )


def drop_repeated_evidence(records: DataFrame) -> DataFrame:
    """In pages of several chunks, keep the first record of each evidence text.

    Needs `run_id, page_id, n_chunks, arrival, evidence`. Empty evidence is kept.
    """
    key = F.coalesce(text.lower_trim(F.col("evidence")), F.lit(""))
    bound = (F.col("n_chunks") > 1) & (key != "")
    # A record that nothing can repeat is a group of its own.
    keyed = records.withColumns({"_key": F.when(bound, key), "_own": F.when(~bound, F.col("arrival"))})
    order = Window.partitionBy("run_id", "page_id", "_key", "_own").orderBy("arrival")
    return keyed.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_key", "_own")


def extract_records(
    pages: DataFrame, spec: TaskSpec, extractor: Extractor, **limits
) -> DataFrame:
    """The records of `extract_pages`, typed and in order, without the failed pages."""
    return records_of(extract_pages(pages, spec, extractor, **limits), spec)


def extract_pages(pages: DataFrame, spec: TaskSpec, extractor: Extractor, **limits) -> DataFrame:
    """Run a user extractor once over every chunk: `extractor(chunk, url) -> list of dicts`.

    Pages carry `run_id, page_id, page_order, url, text`. The result has a row per record, its values as
    text, and one row with `error` for a page whose extractor raised. It is checkpointed: the extractor is
    the dearest step and need not be deterministic.
    """
    names = [*spec.names, "evidence"]
    by_type = {f.name: f.type for f in spec.fields}
    schema = T.StructType(
        [
            T.StructField("run_id", pages.schema["run_id"].dataType),
            T.StructField("page_id", pages.schema["page_id"].dataType),
            T.StructField("page_order", T.LongType()),
            T.StructField("n_chunks", T.IntegerType()),
            T.StructField("chunk_idx", T.IntegerType()),
            T.StructField("pos", T.IntegerType()),
            *[T.StructField(n, T.StringType()) for n in names],
            T.StructField("error", T.StringType()),
        ]
    )

    def printed(name, value):
        if value is None or isinstance(value, str):
            return value
        return str(int(value)) if by_type.get(name) == "int" and not isinstance(value, bool) else str(value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch.itertuples(index=False):
                found = []
                try:
                    for i, chunk in enumerate(page.chunks):
                        for pos, rec in enumerate(extractor(chunk, page.url)):
                            values = [printed(n, rec.get(n)) for n in names]
                            found.append((page.run_id, page.page_id, page.page_order, len(page.chunks), i, pos, *values, None))
                except Exception as exc:  # noqa: BLE001 - a broken page must not end the job
                    message = f"{type(exc).__name__}: {exc}"
                    found = [(page.run_id, page.page_id, page.page_order, len(page.chunks), 0, 0, *[None] * len(names), message)]
                rows.extend(found)
            yield pd.DataFrame(rows, columns=schema.names)

    whole = pages.filter(F.col("text").isNotNull()).select(
        "run_id", "page_id", F.col("page_order").cast("bigint").alias("page_order"), "url",
        text.chunks(F.col("text"), **limits).alias("chunks"),
    )
    return cut_lineage(whole.mapInPandas(run, schema))


def records_of(extracted: DataFrame, spec: TaskSpec) -> DataFrame:
    """Typed records of `extract_pages`; `arrival` numbers them by page, chunk and place in the chunk."""
    typed = [
        (F.col(f.name).try_cast(f.spark_type) if f.spark_type != T.StringType() else F.col(f.name)).alias(f.name)
        for f in spec.fields
    ]
    sound = with_prefix(
        extracted.filter("error is null").drop("error"), ["run_id"], ["page_order", "page_id", "chunk_idx", "pos"], "arrival"
    )
    records = sound.select(
        "run_id", "page_id", "page_order", "n_chunks", "arrival",
        *typed, F.coalesce("evidence", F.lit("")).alias("evidence"),
        F.array().cast("array<string>").alias("flags"),
    )
    return drop_repeated_evidence(records)


def failures_of(extracted: DataFrame) -> DataFrame:
    """Pages whose extractor raised: `(run_id, page_id, error)`."""
    return extracted.filter("error is not null").select("run_id", "page_id", "error")


def prompt_text(chunk: Column, url: Column, spec: TaskSpec) -> Column:
    """Extraction request for one chunk, for users who feed a model in batch."""
    wanted = F.array(*[F.struct(*[F.lit(v) for v in (f.name, f.type, f.required, f.description)]) for f in spec.fields])
    kept = F.map_entries(F.create_map(*[F.lit(x) for pair in spec.filters.items() for x in pair]).cast("map<string,string>"))
    return request_text(chunk, url, F.lit(spec.title), F.lit(spec.entity), wanted, kept)


def request_text(chunk: Column, url: Column, title: Column, entity: Column, fields: Column, filters: Column) -> Column:
    """The request from columns, so that rows of runs with different specs go together.

    `fields` is an array of structs (name, type, required, description), `filters` one of (key, value).
    """

    def field_line(f: Column) -> Column:
        name, kind, required, description = (f[f"col{i}"] for i in range(1, 5))
        star = F.when(required, "*").otherwise("")
        return F.concat(F.lit("- "), name, F.lit(" ("), kind, star, F.lit("): "), description)

    listed = F.array_join(F.transform(filters, lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"])), "\n")
    # The wording and layout of the request.
    return F.concat(
        F.when(title != "", F.concat(F.lit("Task: "), title, F.lit("\n"))).otherwise(""),
        F.lit("Entity: "), entity,
        F.lit("\n\nFields to extract:\n"), F.array_join(F.transform(fields, field_line), "\n"),
        F.lit(
            "\n\nFilters (skip records that don't match; if an optional detail like stipend or email is not "
            "mentioned in the text for an otherwise matching entity, extract it with that field as null):\n"
        ),
        F.when(F.size(filters) > 0, listed).otherwise("None"),
        F.lit("\n\nSource URL: "), url,
        F.lit("\n\n<UNTRUSTED_PAGE_DATA>\n"), chunk, F.lit("\n</UNTRUSTED_PAGE_DATA>"),
    )


def read_responses(responses: DataFrame, spec: TaskSpec, column: str = "response") -> DataFrame:
    """Model answers `{"records": [...]}` to typed record rows; unreadable ones get `reject`.

    Each answer keeps its other columns; `pos` is the place in the answer.
    """
    item = T.StructType([*[T.StructField(f.name, f.spark_type) for f in spec.fields], T.StructField("evidence", T.StringType())])
    body = F.from_json(
        text.strip_code_fence(F.col(column)), T.StructType([T.StructField("records", T.ArrayType(item))])
    )
    rest = [c for c in responses.columns if c != column]
    parsed = responses.withColumn("_list", body["records"])
    reject = F.when(F.col("_list").isNull(), F.lit("unreadable response"))
    return parsed.select(*rest, reject.alias("reject"), F.posexplode_outer("_list").alias("pos", "_r")).select(
        *rest, "reject", "pos", "_r.*"
    )
