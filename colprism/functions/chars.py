"""Character n-grams and padded sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colprism.fixed_values import BLANK_RUN_PATTERN, SEQUENCE_LENGTH


def bigrams_sql(column: str) -> str:
    """SQL text of the bigram array of a column, for use in a saved ML pipeline."""
    quoted_name = "`" + column.replace("`", "``") + "`"
    text = (
        f"lower(regexp_replace(coalesce(cast({quoted_name} as string), 'nan'), "
        f"r'{BLANK_RUN_PATTERN}', ' '))"
    )
    # The one-element array binds the characters once; slices keep the work linear.
    return (
        f"flatten(transform(array(split({text}, '')), c -> "
        "CASE WHEN size(c) < 2 THEN cast(array() AS array<string>) "
        "ELSE zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), "
        "(a, b) -> concat(a, b)) END))"
    )


def bigrams(column: str) -> Column:
    """Character bigrams: lower case, runs of white space as one blank, NULL as 'nan'."""
    return F.expr(bigrams_sql(column))


def chars(v: Column) -> Column:
    """Lower-case characters in order; an empty array for an empty text."""
    text = F.lower(F.coalesce(v.cast("string"), F.lit("nan")))
    return F.filter(F.split(text, ""), lambda ch: ch != "")


def pad_front(ids: Column, length: int = SEQUENCE_LENGTH) -> Column:
    """Zeros in front of a short sequence, the last ``length`` items of a long one."""
    missing = F.greatest(F.lit(0), F.lit(length) - F.size(ids))
    start = F.greatest(F.lit(1), F.size(ids) - (length - 1))
    return F.concat(F.array_repeat(F.lit(0), missing), F.slice(ids, start, length))
