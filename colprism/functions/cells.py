"""One cell as text, as a number, as a distinct-count key; and its missing test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprism.fixed_values import NAN_TEXT_PATTERN

SEMANTICS = ("spark", "pandas")

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
_FLOATING = (T.FloatType, T.DoubleType)
_HASHED_AS_ONE_WORD = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.BooleanType,
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
)
_LONGEST_PLAIN_KEY = 64


def quoted(name: str) -> Column:
    """A top-level column, whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def check_semantics(semantics: str) -> None:
    if semantics not in SEMANTICS:
        raise ValueError(f"semantics must be one of {SEMANTICS}, not {semantics!r}")


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, _FLOATING)


def is_numeric(dtype: T.DataType, semantics: str = "spark") -> bool:
    """Numeric types have mean, deviation and range; booleans only in pandas semantics."""
    if isinstance(dtype, T.BooleanType):
        return semantics == "pandas"
    return isinstance(dtype, T.NumericType)


def as_text(c: Column, dtype: T.DataType) -> Column:
    """The cell as a string; nested values as JSON, binary as base64."""
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return c
    if isinstance(dtype, _NESTED):
        return F.to_json(c, {"ignoreNullFields": "false"})
    if isinstance(dtype, T.BinaryType):
        return F.base64(c)
    return c.cast("string")


def as_measure(c: Column, dtype: T.DataType, semantics: str) -> Column:
    """The numeric cell that statistics run on.  pandas semantics skip NaN."""
    if isinstance(dtype, T.BooleanType):
        return c.cast("int")
    if semantics == "pandas" and is_floating(dtype):
        return F.when(~F.isnan(c), c)
    return c


def is_missing(c: Column, dtype: T.DataType, semantics: str) -> Column:
    """NULL or NaN; in spark semantics also '' and the text 'NaN'.

    The text test is a pattern rather than a cast, because a failing string-to-double
    cast costs an exception per cell.
    """
    if is_floating(dtype):
        return c.isNull() | F.isnan(c)
    if semantics == "spark" and isinstance(dtype, T.StringType):
        return c.isNull() | (c == "") | c.rlike(NAN_TEXT_PATTERN)
    return c.isNull()


def is_word(dtype: T.DataType) -> bool:
    """Whether a cell fits one 64-bit word, so that its ``xxhash64`` is one-to-one."""
    return isinstance(dtype, _HASHED_AS_ONE_WORD) or (
        isinstance(dtype, T.DecimalType) and dtype.precision <= 18
    )


def distinct_key(c: Column, dtype: T.DataType) -> Column:
    """Two cells of a column are equal exactly if their keys are; NULL for NULL.

    Fixed-width types go through ``xxhash64``, which is a bijection on a single input of
    up to 64 bits and already folds -0.0 into 0.0 and all NaN into one.  So the key is
    exact, eight bytes wide and never becomes a string.
    Text up to 64 bytes is its own key; longer text is represented by SHA-256, so the
    shuffle never carries whole documents.
    """
    if is_word(dtype):
        return F.when(c.isNotNull(), F.xxhash64(c))
    if isinstance(dtype, T.BinaryType):
        short, digest = F.hex(c), F.sha2(c, 256)
    else:
        short = as_text(c, dtype)
        digest = F.sha2(short.cast("binary"), 256)
    key = F.when(F.octet_length(short) <= _LONGEST_PLAIN_KEY, short).otherwise(
        F.concat(F.lit("sha256:"), digest)
    )
    return F.when(c.isNotNull(), key)


def any_hash(c: Column, dtype: T.DataType) -> Column:
    """A cheap 64-bit hash of the typed cell, without turning it into text."""
    if isinstance(dtype, _NESTED):
        return F.xxhash64(as_text(c, dtype))
    return F.xxhash64(c)
