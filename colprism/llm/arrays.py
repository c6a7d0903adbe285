"""Array expressions that several operators use; all of them built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK = 256


def _running(values: Column) -> Column:
    start = F.array().cast("array<bigint>")
    return F.aggregate(
        values, start, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + x))
    )


def with_sums_before(df: DataFrame, **of: str) -> DataFrame:
    """New array columns: for each number of the array ``of`` names the sum of those before it.

    Appending to an array copies it, so the sums are run in chunks, and over the chunks.
    Null arrays give null.
    """
    last = lambda a: F.greatest(F.ceil(F.size(a) / _CHUNK).cast("int") - 1, F.lit(0))
    cut = lambda a: F.transform(F.sequence(F.lit(0), last(a)), lambda i: F.slice(a, i * _CHUNK + 1, _CHUNK))
    df = df.withColumns({f"{new}__c": F.when(F.col(a).isNotNull(), cut(a)) for new, a in of.items()})
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    df = df.withColumns({f"{new}__t": F.transform(f"{new}__c", total) for new in of})
    df = df.withColumns({f"{new}__u": _running(F.col(f"{new}__t")) for new in of})
    inside = lambda c: F.zip_with(_running(c), c, lambda up, x: up - x)
    df = df.withColumns(
        {
            new: F.flatten(
                F.zip_with(
                    F.zip_with(f"{new}__u", f"{new}__t", lambda up, own: up - own),
                    f"{new}__c",
                    lambda base, part: F.transform(inside(part), lambda x: x + base),
                )
            )
            for new in of
        }
    )
    return df.drop(*[f"{new}__{x}" for new in of for x in "ctu"])


def with_matches(df: DataFrame, text: str, wanted: dict[str, tuple[str, int, Column]]) -> DataFrame:
    """New columns array<struct<start, end, found, part>>: matches left to right, without overlap.

    ``wanted``: column to (pattern, group, where to look); null where not looked.
    ``start`` and ``end`` (exclusive) count code points; ``part`` is the group.  What
    splitting by the pattern leaves lies between the matches, so their places are running
    sums of lengths.  The pattern must not match the empty text.  The steps are columns
    of their own, so that each regex runs once for each of its uses.
    """
    steps = {}
    for new, (pattern, group, when) in wanted.items():
        steps[f"{new}__f"] = F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumns(steps)
    steps = {}
    for new, (pattern, group, _) in wanted.items():
        some = F.size(f"{new}__f") > 0
        steps[f"{new}__p"] = F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else F.col(f"{new}__f")
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("bigint"))
        steps[f"{new}__g"] = F.when(some, gaps)
        steps[f"{new}__l"] = F.when(some, F.transform(f"{new}__f", lambda m: F.length(m).cast("bigint")))
    df = df.withColumns(steps)
    # Before match i lie the gaps 0..i and the matches 0..i-1.
    both = lambda g, m: g + F.coalesce(m, F.lit(0).cast("bigint"))
    df = df.withColumns({f"{new}__s": F.zip_with(f"{new}__g", f"{new}__l", both) for new in wanted})
    df = with_sums_before(df, **{f"{new}__b": f"{new}__s" for new in wanted})
    starts = {f"{new}__a": F.zip_with(f"{new}__b", f"{new}__g", lambda s, g: s + g) for new in wanted}
    df = df.withColumns(starts)
    df = df.withColumns(
        {
            new: F.transform(
                F.arrays_zip(
                    F.slice(f"{new}__a", F.lit(1), F.size(f"{new}__f")).alias("start"),
                    F.col(f"{new}__f").alias("found"),
                    F.col(f"{new}__p").alias("part"),
                ),
                lambda z: F.struct(
                    z["start"].alias("start"),
                    (z["start"] + F.length(z["found"])).alias("end"),
                    z["found"].alias("found"),
                    z["part"].alias("part"),
                ),
            )
            for new in wanted
        }
    )
    return df.drop(*[f"{new}__{x}" for new in wanted for x in "fpglsba"])
