"""Profiles that grow: the state of a table's columns, stored, merged and finished later.

A day of new rows is described alone and its state is merged with the state of all
earlier days; no old row is read again.  Moments are merged exactly (but for rounding),
counts and ranges exactly, distinct counts as sketches whose union is the sketch of all
rows, samples as the smallest by the sample's own order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprism.fixed_values import PROFILE_NAMES, SAMPLE_COUNT
from colprism.functions.cells import as_measure, check_semantics, distinct_key, is_floating, is_missing, is_numeric, quoted
from colprism.operators.longform import chosen_fields
from colprism.operators.profile import with_percents
from colprism.operators.sampling import order_hash, sample_rows

#: The sketches have 2 to this power registers: a relative error of about 0.8 %.
SKETCH_BITS = 14
_COLUMNS = 64


def _parts(f: T.StructField, semantics: str, bits: int) -> dict[str, Column]:
    c = quoted(f.name)
    counted = F.when(~F.isnan(c), c) if semantics == "pandas" and is_floating(f.dataType) else c
    parts = {
        "count": F.count(F.lit(1)) if semantics == "pandas" else F.count(c),
        "nans": F.count_if(is_missing(c, f.dataType, semantics)),
        "sketch": F.hll_sketch_agg(distinct_key(counted, f.dataType), F.lit(bits)),
    }
    if not is_numeric(f.dataType, semantics):
        none = F.lit(None).cast("double")
        return parts | {"n": F.lit(0).cast("bigint"), "mean": none, "m2": none, "min": none, "max": none}
    x = as_measure(c, f.dataType, semantics)
    real = x.cast("double")
    return parts | {
        "n": F.count(real),
        "mean": F.avg(real),
        "m2": F.var_pop(real) * F.count(real),
        "min": F.min(x).cast("double"),
        "max": F.max(x).cast("double"),
    }


def profile_state(
    df: DataFrame, columns: Sequence[str] | None = None, *, semantics: str = "spark", samples: int = SAMPLE_COUNT, bits: int = SKETCH_BITS
) -> DataFrame:
    """One row per column, to be stored: what :func:`merged` and :func:`finished` need, a few kilobytes each.

    A table without rows has a state too, which changes nothing when it is merged.
    """
    check_semantics(semantics)
    fields = chosen_fields(df, columns)
    passes = []
    for first in range(0, len(fields), _COLUMNS):
        aggs, rows = [], []
        for i, f in enumerate(fields[first : first + _COLUMNS]):
            parts = _parts(f, semantics, bits)
            aggs += [e.alias(f"{i}_{k}") for k, e in parts.items()]
            told = [F.lit(first + i).alias("pos"), F.lit(f.name).alias("name"), F.lit(semantics).alias("semantics")]
            told.append(F.lit(is_numeric(f.dataType, semantics)).alias("numeric"))
            rows.append(F.struct(*told, *[F.col(f"`{i}_{k}`").alias(k) for k in parts]))
        passes.append(df.agg(*aggs).select(F.inline(F.array(*rows))))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rn", "value"))), lambda s: s["value"])
    shown = sample_rows(df, samples, [f.name for f in fields]).groupBy(F.col("column").alias("name")).agg(listed.alias("samples"))
    # One row per column on both sides: the broadcast is bounded by the schema.
    states = reduce(DataFrame.unionByName, passes).join(F.broadcast(shown), "name", "left")
    none = F.array().cast("array<string>")
    return states.withColumns({"samples": F.coalesce("samples", none), "size": F.lit(samples)})


def _together(a: Column, b: Column) -> Column:
    """The (n, mean, m2) of two sets of numbers from those of each."""
    n = a["n"] + b["n"]
    gap = b["mean"] - a["mean"]
    mean = a["mean"] + gap * b["n"] / n
    m2 = a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n
    both = F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))
    return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(both)


def merged(*states: DataFrame) -> DataFrame:
    """The state of all rows together, column by column by name.

    States of one semantics and sketch size; what a column has no row for is not
    counted there.  Per column the number of states is what meets in one place.
    """
    rows = reduce(DataFrame.unionByName, states)
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    # In a fixed order, so that a merge gives the same bits each time.
    moments = F.sort_array(F.collect_list(F.struct("n", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("m2", F.lit(0.0)).alias("m2"))))
    every = F.array_distinct(F.flatten(F.collect_list("samples")))
    found = rows.groupBy("name", "semantics").agg(
        F.min("pos").alias("pos"),
        F.bool_or("numeric").alias("numeric"),
        F.sum("count").alias("count"),
        F.sum("nans").alias("nans"),
        F.hll_union_agg("sketch").alias("sketch"),
        F.aggregate(moments, start, _together).alias("moments"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.max("size").alias("size"),
        every.alias("every"),
    )
    order = F.transform("every", lambda v: F.struct(order_hash(F.col("name"), v).alias("h"), v.alias("v")))
    first = F.transform(F.slice(F.sort_array(order), F.lit(1), F.col("size")), lambda s: s["v"])
    some = F.col("moments.n") > 0
    found = found.withColumns(
        {
            "n": F.col("moments.n"),
            "mean": F.when(some, F.col("moments.mean")),
            "m2": F.when(some, F.col("moments.m2")),
            "samples": first,
        }
    )
    return found.select(*rows.columns)


def finished(state: DataFrame, use_legacy_names: bool = False) -> DataFrame:
    """The profile that a state stands for, with the distinct counts its sketches estimate."""
    pandas = F.col("semantics") == "pandas"
    some = F.when(pandas, F.sqrt(F.col("m2") / F.col("n"))).otherwise(F.sqrt(F.try_divide(F.col("m2"), F.col("n") - 1)))
    zero = F.lit(0.0)
    stats = {
        "distinct": F.hll_sketch_estimate("sketch"),
        "std": F.when(pandas, F.coalesce(some, zero)).otherwise(some),
        "min": F.when(pandas, F.coalesce("min", zero)).otherwise(F.col("min")),
        "max": F.when(pandas, F.coalesce("max", zero)).otherwise(F.col("max")),
        "mean": F.col("mean"),
    }
    shown = {k: F.when(F.col("numeric"), e).otherwise(zero) if k != "distinct" else e for k, e in stats.items()}
    names = PROFILE_NAMES if use_legacy_names else {k: k for k in PROFILE_NAMES}
    return with_percents(state.withColumns(shown)).select(*[F.col(k).alias(v) for k, v in names.items()])


def samples_of(state: DataFrame) -> DataFrame:
    """(column, value, rn) of a state, as from :func:`sample_rows`."""
    return state.select(F.col("name").alias("column"), F.posexplode("samples").alias("i", "value")).select(
        "column", "value", (F.col("i") + 1).alias("rn")
    )
