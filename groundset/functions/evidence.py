"""Evidence and grounding expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundset.functions.similarity import with_partial_matches
from groundset.functions.text import digits, strip, without_punctuation

# Thresholds, context window and block separators.
EVIDENCE_THRESHOLD = 90
FIELD_THRESHOLD = 85
CONTEXT_WINDOW = 200
BLOCK_SEPARATORS = ("\n\n", "---", "===", "___", "###", "##")
MIN_GROUNDED_LENGTH = 3


def with_evidence_found(
    df: DataFrame, name: str, given: Column, snippet: Column, page: Column, fuzzy: bool = True
) -> DataFrame:
    """Adds `name`: both sides in comparison form, verbatim, else a close window. Of a miss only the parts
    of the page that hold enough of the snippet reach Python.

    `given` says that neither raw text was empty.
    """
    verbatim = page.contains(snippet)
    if not fuzzy:
        return df.withColumn(name, F.coalesce(given & verbatim, F.lit(False)))
    df = with_partial_matches(df, {"_close": (given & ~verbatim, snippet, page)}, EVIDENCE_THRESHOLD)
    return df.withColumn(name, F.coalesce(given & (verbatim | F.col("_close")), F.lit(False))).drop("_close")


def evidence_position(evidence: Column, page: Column) -> Column:
    """Place of the evidence on the page, exact, else ignoring case; 0 when not found."""
    exact = F.instr(page, evidence)
    return F.when(exact > 0, exact).otherwise(F.instr(F.lower(page), F.lower(evidence)))


def grounding_context(evidence: Column, page: Column, at: Column, window: int = CONTEXT_WINDOW) -> Column:
    """Raw text around the evidence, cut at block separators; the evidence alone when not found.

    `at` is the evidence position, best a column of its own: it is used many times.
    """
    before = F.substring(page, F.greatest(at - window, F.lit(1)), F.least(at - 1, F.lit(window)))
    after = F.substring(page, at + F.length(evidence), F.lit(window))
    for separator in BLOCK_SEPARATORS:
        before = F.substring_index(before, separator, -1)
        after = F.substring_index(after, separator, 1)
    found = (F.length(evidence) > 0) & (F.length(page) > 0) & (at > 0)
    return F.when(found, F.concat(before, evidence, after)).otherwise(F.coalesce(evidence, F.lit("")))


def number_grounded(value: Column, data_type: T.DataType, context: Column, context_digits: Column) -> Column:
    """Digit sequence present among the context's digits; under three digits always holds."""
    text = value.cast("string")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        text = F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(text)
    own = digits(text)
    return (F.length(own) < MIN_GROUNDED_LENGTH) | context_digits.contains(own) | context.contains(text)


def text_grounded_natively(
    given: Column, value: Column, context: Column, plain_context: Column
) -> Column:
    """Short, verbatim, verbatim without punctuation, or all longer words present."""
    plain = without_punctuation(value)
    words = F.filter(F.split(plain, " "), lambda w: F.length(w) >= MIN_GROUNDED_LENGTH)
    return (
        (F.length(strip(given)) < MIN_GROUNDED_LENGTH)
        | context.contains(value)
        | plain_context.contains(plain)
        | ((F.size(words) > 0) & F.forall(words, lambda w: plain_context.contains(w)))
    )


def with_text_close(df: DataFrame, checks: dict[str, tuple[Column, Column]], plain_context: Column) -> DataFrame:
    """Adds a column per `(needed, value)`: is the value close to some stretch of the context?"""
    sides = {name: (needed, without_punctuation(value), plain_context) for name, (needed, value) in checks.items()}
    return with_partial_matches(df, sides, FIELD_THRESHOLD)
