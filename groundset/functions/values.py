"""Typed value expressions: e-mail, number, date, currency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundset.functions.text import SPACE, WORD, collapse, lower_trim

# Accepted date shapes with their formats (month first where day and month are
# numbers). The shape is tested first: a failed parse costs far more than a failed pattern.
DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^(?:1[3-9]|2\d|3[01])/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2} \d{4}$", "MMMM d yyyy"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]{4,} \d{4}$", "MMMM yyyy"),
    (r"^[A-Za-z]{3} \d{4}$", "MMM yyyy"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})$", "yyyy-MM-dd'T'HH:mm:ssXXX"),
)

# What spellings of a date may carry beyond those shapes, and what is put in its place, in order.
DATE_SPELLINGS = (
    (r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? (?=[a-z0-9])", ""),
    (r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b", "$1"),
    (r"\b([A-Za-z]{3,})\.", "$1"),
    (r"(?i)\bsept\b", "Sep"),
    (r"^(\d{1,2})-([A-Za-z]{3,})-(\d{4})$", "$1 $2 $3"),
    (r"(:\d{2})\.\d+", "$1"),
    (r"^(\d{1,2}/\d{1,2}/)(69|[7-9]\d)$", "$119$2"),
    (r"^(\d{1,2}/\d{1,2}/)(\d{2})$", "$120$2"),
)

# Currency spellings in order of precedence, and the field suffixes that expect them.
CURRENCY_WORDS = (
    ("inr", "₹", r"rs\.?|inr|rupees?"),
    ("usd", r"\$", r"usd|dollars?"),
    ("eur", "€", r"eur|euros?"),
    ("gbp", "£", r"gbp|pounds?"),
)
CURRENCY_SUFFIXES = {"_inr": "inr", "_usd": "usd", "_eur": "eur", "_gbp": "gbp"}

EMAIL_PATTERN = rf"^[^@{SPACE}]+@[^@{SPACE}]+\.[^@{SPACE}]+\n?$"
URL_PATTERN = rf"^https?://[^{SPACE}]+\n?$"


def normalize_email(value: Column) -> Column:
    return F.when(value != "", lower_trim(value))


def normalize_number(value: Column) -> Column:
    """Double left after dropping all but digits, points and minus signs; null when unreadable."""
    kept = F.regexp_replace(value.cast("string"), r"[^\p{Nd}.\-]", "")
    readable = kept.rlike(r"^-?(?:\d+\.?\d*|\.\d+)$")
    return F.when(readable, kept.try_cast("double"))


def normalize_date(value: Column, formats: tuple[tuple[str, str], ...] = DATE_FORMATS) -> Column:
    """ISO date string of the first shape and format that read the value, else null.

    Weekdays, ordinals, abbreviation points and fractions of seconds are taken off first. Where day and month
    are numbers the month comes first, unless it can't; years of two digits are 1969 to 2068; a month alone is
    its first day.
    """
    text = collapse(value)
    for spelling, plain in DATE_SPELLINGS:
        text = F.regexp_replace(text, spelling, plain)
    read = [F.when(text.rlike(shape), F.try_to_date(text, form)) for shape, form in formats]
    return F.date_format(F.coalesce(*read), "yyyy-MM-dd")


def detect_currency(value: Column) -> Column:
    found = F.lit(None).cast("string")
    for code, symbol, words in reversed(CURRENCY_WORDS):
        pattern = rf"(?i){symbol}|(?<![{WORD}])(?:{words})(?![{WORD}])"
        found = F.when(value.rlike(pattern), code).otherwise(found)
    return found


def expected_currency(field_name: str) -> str | None:
    for suffix, code in CURRENCY_SUFFIXES.items():
        if field_name.lower().endswith(suffix):
            return code
    return None


def currency_mismatch_of(field_name: Column, value: Column) -> Column:
    """`currency_mismatch` for field names held in a column."""
    lowered = F.lower(field_name)
    expected = F.coalesce(*[F.when(lowered.endswith(s), code) for s, code in CURRENCY_SUFFIXES.items()])
    return F.coalesce(detect_currency(value) != expected, F.lit(False))


def currency_mismatch(field_name: str, value: Column) -> Column:
    """True where the field name promises one currency and the text names another."""
    expected = expected_currency(field_name)
    if expected is None:
        return F.lit(False)
    return F.coalesce(detect_currency(value) != expected, F.lit(False))
