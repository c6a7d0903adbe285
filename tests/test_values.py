"""Value features against Python's own regular expressions, and on hand-made edges."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colprism.fixed_values import STOP_WORDS
from colprism.functions.chars import bigrams
from colprism.functions.numeric import abs_limit_1000, finite
from colprism.functions.values import value_features

ALPHABET = "ab Z9,;|.@:/-_+%é😀\n\t'" + "http://"
WORD = r"[^\W]"


def expected(v):
    return {
        "is_delimited": bool(re.match(r"[^,;|]+[,;|][^,;|]", v)),
        "is_url": bool(re.match(r"(http|ftp|https)://[\w-]+\.[\w-]", v)),
        "is_email": bool(re.match(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,6}\b", v)),
        "word_count": len(v.split(" ")),
        "char_count": len(v),
        "whitespace_count": v.count(" "),
        "delimiter_count": sum(v.count(d) for d in ",;|"),
    }


def measure(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.asDict() for r in df.select("i", *value_features(F.col("v"))).orderBy("i").collect()]


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.one_of(
            st.text(ALPHABET, max_size=20),
            st.from_regex(r"(https?|ftp)://[a-z_-]{0,4}\.?[a-z]{0,3}[ /]?", fullmatch=True),
            st.from_regex(r"[a-z.%+-]{0,4}@[a-z.-]{1,5}\.[A-Za-z]{1,8}[ _9]?", fullmatch=True),
        ),
        min_size=30,
        max_size=120,
    )
)
def test_like_python(spark, values):
    for v, got in zip(values, measure(spark, values)):
        want = expected(v)
        assert {k: got[k] for k in want} == want, repr(v)


def test_edges(spark):
    dates = {
        "2020-01-02": True, "2020-13-02": False, "2021-02-29": False, "2020-1-2": False, "1999": True,
        "2020-01-02 03:04:05": True, "2020-01-02T03:04:05.123": True, "2020-01-02 25:00:00": False,
        "Jan 5, 2020": True, "5 Jan 2020": True, "Foo 5, 2020": False, "12/31/2020": True,
        "31/12/2020": False, "": False, "2020-01-02\n": False,
    }
    got = measure(spark, list(dates))
    assert [g["is_datetime"] for g in got] == list(dates.values())
    null, many = measure(spark, [None, "a" + ",b" * 100_000])
    assert null["word_count"] is None and null["is_url"] is None and null["is_datetime"] is None
    assert many["is_delimited"] and many["delimiter_count"] == 100_000


def test_stop_words(spark):
    texts = {"the cat and the dog": 3, "it's not what you're after": 5, "The": 0, "don't": 1, "": 0}
    assert [g["stopword_count"] for g in measure(spark, list(texts))] == list(texts.values())
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 153


def test_bigrams(spark):
    texts = {"Ab": ["ab"], "a": [], "": [], "x  y": ["x ", " y"], "é😀z": ["é😀", "😀z"], None: ["na", "an"]}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(bigrams("t")).collect()]
    assert got == list(texts.values())


def test_clip_and_finite(spark):
    inf = float("inf")
    df = spark.createDataFrame([(-5000.0,), (3.0,), (inf,), (float("nan"),), (None,)], "x double")
    clipped = [r[0] for r in df.select(abs_limit_1000(F.col("x"))).collect()]
    assert clipped[:3] == [-1000.0, 3.0, 1000.0] and clipped[3] != clipped[3] and clipped[4] is None
    fixed = [r[0] for r in df.select(finite(F.col("x"))).collect()]
    assert fixed[2] == 1.7976931348623157e308 and fixed[3] == 0.0
