"""Text-shape features of one value (built-in expressions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from colprism.fixed_values import (
    DATE_SHAPES,
    DELIMITED_PATTERN,
    DELIMITER_PATTERN,
    EMAIL_PATTERN,
    LONGEST_DATE,
    SECOND_FRACTION_PATTERN,
    STOP_WORDS,
    TOKEN_PATTERN,
    URL_PATTERN,
    YEAR_PATTERN,
)


def is_delimited(v: Column) -> Column:
    """Text, one of ``, ; |``, then more text."""
    return v.rlike(DELIMITED_PATTERN)


def delimiter_count(v: Column) -> Column:
    return F.regexp_count(v, F.lit(DELIMITER_PATTERN))


def word_count(v: Column) -> Column:
    """Pieces between single blanks; empty pieces count.

    One more than the blanks, which spares building the array of pieces.
    """
    return whitespace_count(v) + 1


def char_count(v: Column) -> Column:
    return F.char_length(v)


def whitespace_count(v: Column) -> Column:
    """Only U+0020."""
    return F.char_length(v) - F.char_length(F.replace(v, F.lit(" "), F.lit("")))


def is_url(v: Column) -> Column:
    return v.rlike(URL_PATTERN)


def is_email(v: Column) -> Column:
    return v.rlike(EMAIL_PATTERN)


def is_datetime(v: Column) -> Column:
    """A bare year, or one of the fixed shapes that is also a real date."""
    # Longer text cannot be a date, so only short values reach the parsers.
    short = F.when(F.char_length(v) <= LONGEST_DATE, v)
    plain = F.regexp_replace(short, SECOND_FRACTION_PATTERN, "$1")
    parsed = [
        plain.rlike(shape) & F.try_to_timestamp(plain, F.lit(fmt)).isNotNull()
        for shape, fmt, _ in DATE_SHAPES
    ]
    hit = reduce(Column.__or__, parsed, plain.rlike(YEAR_PATTERN))
    return F.when(v.isNotNull(), F.coalesce(hit, F.lit(False)))


def stopword_count(v: Column) -> Column:
    """Tokens that are English stop words, case-sensitive.

    A piece after an apostrophe keeps it (``it's`` -> ``it``, ``'s``), so clitics do
    not count.  ``isin`` becomes a hash-set test.
    """
    tokens = F.regexp_extract_all(v, F.lit(TOKEN_PATTERN), F.lit(0))
    return F.size(F.filter(tokens, lambda t: t.isin(STOP_WORDS)))


VALUE_FEATURES = {
    "is_delimited": is_delimited,
    "is_url": is_url,
    "is_email": is_email,
    "is_datetime": is_datetime,
    "word_count": word_count,
    "stopword_count": stopword_count,
    "char_count": char_count,
    "whitespace_count": whitespace_count,
    "delimiter_count": delimiter_count,
}


def value_features(v: Column) -> list[Column]:
    """All value features, aliased by name.  Counts are BIGINT, NULL for a NULL value."""
    return [
        (fn(v) if name.startswith("is_") else fn(v).cast("bigint")).alias(name)
        for name, fn in VALUE_FEATURES.items()
    ]
