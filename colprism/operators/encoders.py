"""Vocabularies and dictionaries of characters, and texts encoded with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colprism.fixed_values import SEQUENCE_LENGTH
from colprism.functions.cells import quoted
from colprism.functions.chars import bigrams, chars, pad_front
from colprism.functions.constants import int_array
from colprism.operators.folds import number_rows

#: Characters of the rows that one task counts.
_CHARS = 1 << 20
#: Bigrams of a vocabulary that is sent to every task.
_SENT = 1 << 18
_SALTS = 64


def gram_counts(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """(row_id, gram, n): how often each character bigram occurs in the text of a row.

    Rows are dealt out before they are taken apart, to as many tasks as their characters ask
    for: a small file holds so many bigrams that the counts of one task would fill its memory.
    """
    length = F.coalesce(F.char_length(quoted(column).cast("string")), F.lit(3))
    parts = -(-(df.agg(F.sum(length)).first()[0] or 0) // _CHARS) or 1
    dealt = df.select(quoted(row_id), quoted(column)).repartition(parts, quoted(row_id))
    grams = dealt.select(quoted(row_id), F.explode(bigrams(column)).alias("gram"))
    return grams.groupBy(quoted(row_id), "gram").agg(F.count(F.lit(1)).alias("n"))


def gram_vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(gram, gram_index): all bigrams of a column, numbered in alphabetical order.

    Numbered by first character, so no task holds more than the grams of one character.
    """
    grams = df.select(F.explode(bigrams(column)).alias("gram")).distinct()
    return number_rows(grams, F.substring("gram", 1, 1), [F.col("gram")], "gram_index")


def encode_grams(
    df: DataFrame, row_id: str, column: str, vocabulary: DataFrame
) -> DataFrame:
    """(row_id, gram_index, n): bigram counts in the vocabulary; unknown bigrams drop out.

    Many rows have the same few bigrams, so they are never dealt out by bigram: a vocabulary
    of up to ``_SENT`` goes to every task; of a larger one, each bigram has ``_SALTS`` copies.
    """
    counts = gram_counts(df, row_id, column)
    few = vocabulary.limit(_SENT + 1).collect()
    if len(few) <= _SENT:
        known = counts.join(F.broadcast(df.sparkSession.createDataFrame(few, vocabulary.schema)), "gram")
    else:
        copies = vocabulary.select("*", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("__salt"))
        salt = F.pmod(F.xxhash64(quoted(row_id)), F.lit(_SALTS)).cast("int")
        known = counts.withColumn("__salt", salt).join(copies, ["gram", "__salt"])
    return known.select(quoted(row_id), "gram_index", "n")


def char_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(char, id, n): characters numbered from 1 by falling frequency, ties by character.

    There are at most as many rows as Unicode has characters, so one task may order them.
    """
    counted = (
        df.select(F.explode(chars(quoted(column))).alias("char"))
        .groupBy("char")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_frequency = Window.orderBy(F.col("n").desc(), F.col("char"))
    return counted.select("char", F.row_number().over(by_frequency).alias("id"), "n")


class CharEncoder:
    """A fitted dictionary, looked up by code point in constant time."""

    def __init__(self, dictionary: DataFrame):
        # At most one entry per Unicode character reaches the driver.
        pairs = {
            ord(r["char"]): r["id"] for r in dictionary.select("char", "id").toLocalIterator()
        }
        self.size = len(pairs)
        self._by_code = [pairs.get(code, 0) for code in range(max(pairs, default=0) + 1)]

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> CharEncoder:
        return cls(char_dictionary(df, column))

    def ids(self, text: Column) -> Column:
        """The ids of the characters of a text; unknown characters drop out."""
        table = int_array(self._by_code)
        found = F.transform(chars(text), lambda ch: F.get(table, F.ascii(ch)))
        return F.filter(found, lambda i: i > 0)

    def padded(self, text: Column, length: int = SEQUENCE_LENGTH) -> Column:
        """The last ``length`` ids, with zeros in front of a short sequence."""
        # Binding the ids once in a one-element array avoids looking them up three times.
        return F.get(
            F.transform(F.array(self.ids(text)), lambda ids: pad_front(ids, length)), F.lit(0)
        )
