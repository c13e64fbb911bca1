"""Web archive derivatives: responses become linked metadata and plain-text conversion records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundset.functions.text import whole_page_text

CRLF = "\r\n"
#: The date of responses whose source has none.
NO_DATE = "1970-01-01T00:00:00Z"
#: The base-32 alphabet that digests are written in.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Headers of a record, in the order they are written.
HEADERS = (
    "WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date",
    "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest", "WARC-Block-Digest", "WARC-Source-Payload-Digest",
    "WARC-Source-Block-Digest", "Content-Type", "Content-Length",
)


def digest(data: Column) -> Column:
    """`sha1:` and the 32 base-32 digits of the SHA-1 of the UTF-8 bytes."""
    return F.concat(F.lit("sha1:"), _base32(F.sha1(data)))


def _base32(hex_digits: Column) -> Column:
    """Five hex digits make four base-32 digits; the 40 of a SHA-1 come out even.

    The digits and each group's number are bound to a lambda's variable, else each place would compute them.
    """

    def four(value: Column) -> Column:
        return F.concat(
            *[F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
        )

    def groups(digits: Column) -> Column:
        values = F.array(*[F.conv(F.substring(digits, k, 5), 16, 10).cast("int") for k in range(1, 41, 5)])
        return F.array_join(F.transform(values, four), "")

    return F.transform(F.array(hex_digits), groups)[0]


def record_id(*parts: Column) -> Column:
    """A name-based id: the same parts give the same id, in any run."""
    name = F.sha1(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    digits = r"^(.{8})(.{4})(.{3})(.{3})(.{12}).*$"
    return F.regexp_replace(name, digits, "<urn:uuid:$1-$2-5$3-a$4-$5>")


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def responses(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = NO_DATE
) -> DataFrame:
    """Response records of fetched pages: the id, record_id, uri, date, http_headers, payload, both digests.

    A null payload is an empty one; a null URL stays null and is left out of headers. Ids derive from page id,
    URL and payload, so repeated rows are the same record again.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        _bytes(payload).cast("string"),
        F.lit(CRLF + CRLF),
    )
    rows = pages.select(
        F.col(id_col), F.col(url_col).cast("string").alias("uri"), payload.alias("payload"), head.alias("http_headers")
    )
    return rows.select(
        id_col,
        record_id(F.lit("response"), F.col(id_col), F.col("uri"), F.sha1("payload")).alias("record_id"),
        "uri",
        F.lit(date).alias("date"),
        "http_headers",
        "payload",
        digest(F.col("payload")).alias("payload_digest"),
        digest(F.concat("http_headers", "payload")).alias("block_digest"),
    )


def _metadata_block(payload: Column, http_headers: Column) -> Column:
    """Fields of the page: its source's HTTP headers, title, language and links, one per line."""
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    field = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c, F.lit(CRLF))).otherwise("")
    links = F.regexp_extract_all(payload, F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    sent = F.filter(F.split(http_headers, CRLF), lambda h: h != "")
    return F.concat(
        F.array_join(F.transform(sent, lambda h: F.concat(F.lit("http-header: "), h, F.lit(CRLF))), ""),
        field("title", clean(F.regexp_extract(payload, r"(?is)<title\b[^>]*>(.*?)</title", 1))),
        field("language", F.regexp_extract(payload, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z\-]+)", 1)),
        F.array_join(F.transform(links, lambda u: F.concat(F.lit("outlink: "), u, F.lit(CRLF))), ""),
    )


def derivatives(found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """A metadata and a conversion record for every response, as rows; no shuffle.

    Columns: the id, record_type, record_id, refers_to (the response's id), uri, date, content_type,
    content_length (bytes), block_digest, source_payload_digest, source_block_digest, block. An empty page
    gives both records all the same, with an empty text. Repeated responses give repeated records.
    """
    def record(kind: str, content: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), F.lit(content).alias("content_type"), block.alias("block"))

    both = F.array(
        record("metadata", "application/warc-fields", _metadata_block(F.col("payload"), F.col("http_headers"))),
        record("conversion", "text/plain; charset=utf-8", whole_page_text(F.col("payload"))),
    )
    rows = found.withColumn("_made", F.explode(both))
    kind, block = F.col("_made.record_type"), F.col("_made.block")
    return rows.select(
        id_col,
        kind.alias("record_type"),
        record_id(kind, F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "uri",
        "date",
        F.col("_made.content_type").alias("content_type"),
        _bytes(block).alias("content_length"),
        digest(block).alias("block_digest"),
        F.col("payload_digest").alias("source_payload_digest"),
        F.col("block_digest").alias("source_block_digest"),
        block.alias("block"),
    )


def rendered(records: DataFrame) -> Column:
    """A derived record as it stands in a file, without the two line ends that close it."""
    values = {
        "WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to",
        "WARC-Refers-To-Target-URI": "uri", "WARC-Refers-To-Date": "date", "WARC-Target-URI": "uri",
        "WARC-Date": "date", "WARC-Block-Digest": "block_digest",
        "WARC-Source-Payload-Digest": "source_payload_digest", "WARC-Source-Block-Digest": "source_block_digest",
        "Content-Type": "content_type", "Content-Length": "content_length",
    }
    lines = [
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{h}: "), F.col(c).cast("string"), F.lit(CRLF)))
        for h in HEADERS
        if (c := values.get(h))
    ]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(CRLF), F.col("block"))


def write_derivatives(records: DataFrame, path: str) -> None:
    """Gzipped archive files below `path`, one per partition, written by Spark's text writer."""
    records.select(rendered(records).alias("value")).write.option("lineSep", CRLF * 2).option(
        "compression", "gzip"
    ).text(path)
