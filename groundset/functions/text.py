"""Text expressions: Unicode folding, whitespace, dedupe keys, chunks, HTML to text."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes. Spelled out instead of `\s`, `\w`, `\b`, whose Unicode reach
# differs between regex engines.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
NOT_DIGIT = r"\P{Nd}"
# The same white space as code points.
_SPACE_CHARS = "".join(
    map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)

# Code point ranges that compatibility normalisation leaves alone, or that the
# native expressions below treat alike (no-break spaces, ellipsis). Rows made of these alone
# never leave the JVM.
_STABLE_RANGES = (
    (0x00, 0x7F), (0xA0, 0xA7), (0xA9, 0xA9), (0xAB, 0xAE), (0xB0, 0xB1), (0xB6, 0xB7),
    (0xBB, 0xBB), (0xBF, 0xFF), (0x2007, 0x2007), (0x200B, 0x200D), (0x2013, 0x2014),
    (0x2018, 0x2019), (0x201C, 0x201D), (0x2026, 0x2026), (0x202F, 0x202F), (0x20AC, 0x20AC),
    (0x20B9, 0x20B9), (0x2212, 0x2212), (0xFEFF, 0xFEFF),
)
_STABLE = "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in _STABLE_RANGES)
_NEEDS_NFKC = f"[^{_STABLE}]"
_NEEDS_UNESCAPE = r"&[^\t\n\f <&;]"

# Code points folded for comparison; the empty ones are dropped.
_FOLDED = {
    0x201C: '"', 0x201D: '"', 0xAB: '"', 0xBB: '"',
    0x2018: "'", 0x2019: "'", 0x60: "'", 0xB4: "'",
    0x2013: "-", 0x2014: "-", 0x2212: "-",
    0xA0: " ", 0x2007: " ", 0x202F: " ",
    0x200B: "", 0x200C: "", 0x200D: "", 0xFEFF: "",
}
_ELLIPSIS = chr(0x2026)

# Legal-form words dropped from dedupe keys.
LEGAL_WORDS = (
    "inc", "incorporated", "llc", "ltd", "limited", "pvt", "private",
    "corp", "corporation", "co", "company",
)

# Chunk sizes and least lengths.
CHUNK_SIZE = 8000
CHUNK_OVERLAP = 500
MIN_MAIN_CHARS = 80
MIN_TEXT_CHARS = 50


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _unescape_nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", html.unescape(v)), na_action="ignore")


# Marked non-deterministic so that the optimiser neither repeats them nor moves filters below them.
_nfkc = _nfkc.asNondeterministic()
_unescape_nfkc = _unescape_nfkc.asNondeterministic()


def _only_where(needed: Column, udf, value: Column) -> Column:
    """Send a value to Python only where the native path cannot decide; other rows ship a null."""
    return F.when(needed, udf(F.when(needed, value))).otherwise(value)


def _dots(value: Column) -> Column:
    return F.replace(value, F.lit(_ELLIPSIS), F.lit("..."))


def collapse(value: Column) -> Column:
    """One space for each run of whitespace, none at the ends."""
    return F.trim(F.regexp_replace(value, f"[{SPACE}]+", " "))


def strip(value: Column) -> Column:
    """Drop Unicode whitespace at both ends."""
    return F.btrim(value, F.lit(_SPACE_CHARS))


def _let(value: Column, body) -> Column:
    """Evaluate a costly value once and use it several times in `body`."""
    return F.transform(F.array(value), body)[0]


def lower_trim(value: Column) -> Column:
    return F.lower(strip(value))


def _has_unstable(value: Column) -> Column:
    """Plain ASCII, told by its byte count, skips the pattern."""
    return (F.octet_length(value) != F.length(value)) & value.rlike(_NEEDS_NFKC)


def normalize_string(value: Column) -> Column:
    """NFKC, collapsed whitespace, '' as null."""
    folded = _only_where(_has_unstable(value), _nfkc, value)
    return F.nullif(collapse(_dots(folded)), F.lit(""))


def normalize_for_match(value: Column) -> Column:
    """Comparison form: entities, NFKC, plain quotes and dashes, no zero-width, lower case."""
    value = F.coalesce(value, F.lit(""))
    entity = value.contains("&") & value.rlike(_NEEDS_UNESCAPE)
    folded = _only_where(entity | _has_unstable(value), _unescape_nfkc, value)
    # `translate` drops characters that have no partner, so those come last.
    source = "".join(map(chr, _FOLDED))
    plain = F.translate(_dots(folded), source, "".join(_FOLDED.values()))
    return F.lower(collapse(plain))


def without_punctuation(value: Column, by: str = " ") -> Column:
    return collapse(F.regexp_replace(value, f"[^{WORD}{SPACE}]", by))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, NOT_DIGIT, "")


def as_text(value: Column, data_type: T.DataType) -> Column:
    """A value as the dedupe key prints it: whole doubles keep `.0`, no exponent below 1e16."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e16)
        return F.when(whole, F.concat(value.cast("bigint").cast("string"), F.lit(".0"))).otherwise(
            value.cast("string")
        )
    if isinstance(data_type, T.BooleanType):
        return F.when(value, "True").otherwise("False")
    return value.cast("string")


def key_text(value: Column, data_type: T.DataType | None = None) -> Column:
    """Key part: lower case, no legal-form words, no punctuation. Null, 0, false and '' give ''."""
    data_type = data_type or T.StringType()
    text = as_text(value, data_type)
    if isinstance(data_type, T.NumericType):
        text = F.when(value != 0, text)
    elif isinstance(data_type, T.BooleanType):
        text = F.when(value, text)
    text = lower_trim(F.coalesce(text, F.lit("")))
    words = "|".join(LEGAL_WORDS)
    text = F.regexp_replace(text, f"(?<![{WORD}])(?:{words})(?![{WORD}])", "")
    return without_punctuation(text, by="")


def dedupe_key(parts: list[Column]) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by `|`."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def fuzzy_key(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def sorted_tokens(value: Column) -> Column:
    tokens = F.filter(F.split(value, f"[{SPACE}]+"), lambda t: t != "")
    return F.array_join(F.array_sort(tokens), " ")


def record_id(run_id: Column, key: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", run_id.cast("string"), key)), 1, 16)


def chunks(
    text: Column,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    max_chunks: int | None = None,
) -> Column:
    """Array of overlapping chunks; a text of at most `size` characters is one chunk."""
    step = size - overlap
    n = F.ceil(F.length(text) / F.lit(step)).cast("int")
    if max_chunks is not None:
        n = F.least(n, F.lit(max_chunks))
    n = F.when(F.length(text) <= size, F.lit(1)).otherwise(n)
    return F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size))
    )


# What is markup noise, what breaks a line, and the entities decoded natively.
_NOISE = (
    r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>|noscript\b.*?</noscript\s*>"
    r"|head\b.*?</head\s*>|nav\b.*?</nav\s*>|footer\b.*?</footer\s*>|aside\b.*?</aside\s*>)"
)
_INVISIBLE = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>|head\b.*?</head\s*>)"
_BREAKS = (
    r"(?i)<(?:br|/?p|/?div|/?li|/?ul|/?ol|/?tr|/?table|/?h[1-6]|/?section|/?article|/?blockquote)"
    r"(?:\s[^>]*)?/?>"
)
_TAGS = r"(?s)<[/!?a-zA-Z][^>]*>"
_ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&apos;", "'"), ("&copy;", chr(0xA9)), ("&middot;", chr(0xB7)), ("&amp;", "&"),
)


def _visible(markup: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(markup, _BREAKS, "\n"), _TAGS, "")
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r" ?\n ?", "\n"), r"^\n+|\n+$", "")


def main_text(markup: Column) -> Column:
    """Readable text of the article element, or of the page without navigation and footer."""
    article = F.regexp_extract(markup, r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1)
    body = _let(article, lambda a: F.when(a != "", a).otherwise(markup))
    return _visible(F.regexp_replace(body, _NOISE, ""))


def whole_page_text(markup: Column) -> Column:
    return _visible(F.regexp_replace(markup, _INVISIBLE, ""))


def usable_text(markup: Column, max_chars: int | None = None) -> Column:
    """Main text, else whole-page text when under 80 characters; null below 50."""
    def readable(main):
        return F.when(F.length(strip(main)) < MIN_MAIN_CHARS, whole_page_text(markup)).otherwise(main)

    def enough(text):
        return F.when(F.length(strip(text)) >= MIN_TEXT_CHARS, text)

    text = _let(_let(main_text(markup), readable), enough)
    return text if max_chars is None else F.substring(text, 1, max_chars)


def paragraphs(markup: Column) -> Column:
    """Array of paragraph texts in page order."""
    raw = F.regexp_extract_all(markup, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>"), F.lit(1))
    return F.filter(F.transform(raw, _visible), lambda p: p != "")


def safe_cell(value: Column) -> Column:
    """Quote a cell a spreadsheet would run as a formula."""
    return F.when(value.rlike(r"^[ \t\r\n]*[=+\-@%]"), F.concat(F.lit("'"), value)).otherwise(value)


def strip_code_fence(value: Column) -> Column:
    """Drop a surrounding ``` fence, with or without a language word."""
    text = strip(value)
    opened = F.regexp_replace(text, r"^```[^\n]*(?:\n|$)", "")
    closed = F.regexp_replace(opened, r"(?:^|\n)```[^\n]*$", "")
    return F.when(text.startswith("```"), strip(closed)).otherwise(text)


def retry_delay(message: Column) -> Column:
    """Seconds to wait named in an error message; the first wording that matches wins."""
    # The three wordings, in order.
    wordings = (
        r"(?i)retry in (\d+(?:\.\d+)?)s",
        r"(?i)retryDelay['\":\s]+(\d+(?:\.\d+)?)",
        r"(?i)retry after (\d+(?:\.\d+)?)",
    )
    return F.coalesce(*[F.regexp_extract(message, w, 1).try_cast("double") for w in wordings])


def title_or_prompt(title: Column, prompt: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.substring(prompt, 1, 50))
