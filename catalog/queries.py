"""Registered queries: Spark plans, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog import sql
from colprism.fixed_values import (
    STATS_19,
    STATS_19_SCALED,
    STATS_25,
)
from colprism.functions.cells import quoted
from colprism.functions.numeric import abs_limit_1000, abs_limit_10000
from colprism.functions.values import VALUE_FEATURES, value_features
from colprism.operators import encoders, evaluate, folds, neighbours, prep, quality, scaleout, states
from colprism.operators.longform import melt
from colprism.operators.profile import column_agg, distinct_counts, melt_profile, profile, profile_wide
from colprism.operators.samplefeatures import sample_features
from colprism.operators.sampling import filled_samples, sample_rows, sample_values
from colprism.plans import classify, semantic
from colprism.plans.extract import extract_features, featurize_table
from colprism.sources.tables import read_csv_rescued, scratch_folder, select_described, union_all

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def steady(x: Column) -> Column:
    """Rounded by size, since engines differ in the last bits of a sum."""
    big = (F.abs(x) >= 1000) & ~F.isnan(x)
    return F.when(big, F.round(x, 4)).otherwise(F.round(x, 8))


def steadied(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            steady(quoted(c)).alias(c) if t == "double" else quoted(c)
            for c, t in df.dtypes
        ]
    )


# ---------------------------------------------------------------- profiles

for _t in ("lineitem", "orders", "events", "customer", "part"):
    query(f"profile_{_t}", sql.profile(_t, sql.TABLE_COLUMNS[_t]))(
        lambda spark, d, t=_t: steadied(profile(table(spark, d, t)))
    )

query("profile_wide_customer", sql.wide(sql.profile("customer", sql.TABLE_COLUMNS["customer"]), sql.TABLE_COLUMNS["customer"]))(
    lambda spark, d: steadied(profile_wide(table(spark, d, "customer")))
)


@query("profile_melted_supplier", sql.profile("supplier", sql.TABLE_COLUMNS["supplier"], legacy=True))
def _(spark, d):
    df = table(spark, d, "supplier")
    wide = profile_wide(df, use_legacy_names=True)
    return steadied(melt_profile(wide, df.columns, use_legacy_names=True))


_HOLES = (
    "(SELECT event_id, nullif(event_type, 'error') AS event_type, "
    "CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN 'NaN'::DOUBLE ELSE value END AS value, "
    "CASE WHEN event_type = 'view' THEN '' WHEN event_type = 'click' THEN 'NaN' "
    "WHEN event_type = 'error' THEN NULL ELSE props END AS props FROM events)"
)
_HOLES_COLUMNS = {"event_id": "i", "event_type": "s", "value": "f", "props": "s"}


def _with_holes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        "event_id",
        F.nullif(kind, F.lit("error")).alias("event_type"),
        F.when(kind == "click", F.lit(None))
        .when(kind == "view", F.lit(float("nan")))
        .otherwise(F.col("value"))
        .alias("value"),
        F.when(kind == "view", F.lit(""))
        .when(kind == "click", F.lit("NaN"))
        .when(kind == "error", F.lit(None))
        .otherwise(F.col("props"))
        .alias("props"),
    )


for _s in ("spark", "pandas"):
    query(f"profile_nulls_{_s}", sql.profile(_HOLES, _HOLES_COLUMNS, _s))(
        lambda spark, d, s=_s: steadied(profile(_with_holes(spark, d), semantics=s))
    )

def _halves(spark: SparkSession, d: str, name: str, key: str) -> list[DataFrame]:
    rows = table(spark, d, name)
    return [states.profile_state(rows.where(F.col(key) % 3 == i)) for i in range(3)]


@query(
    "profile_merged_orders",
    f'SELECT name, "count", nans, nans_percent, mean, std, "min", "max", true AS close FROM ({sql.profile("orders", sql.TABLE_COLUMNS["orders"])})',
)
def _(spark, d):
    """The merged states of three parts are the profile of the whole; distinct counts within a twentieth."""
    whole = distinct_counts(table(spark, d, "orders")).withColumnRenamed("distinct", "exact")
    state = states.merged(*_halves(spark, d, "orders", "o_orderkey"))
    found = states.finished(state).join(state.select("name", "pos"), "name").join(whole, "pos")
    close = F.abs(F.col("distinct") - F.col("exact")) <= F.col("exact") * 0.05
    return steadied(found.select("name", "count", "nans", "nans_percent", "mean", "std", "min", "max", close.alias("close")))


query("samples_merged_customer", sql.samples("customer", sql.TABLE_COLUMNS["customer"], 5))(
    lambda spark, d: states.samples_of(states.merged(*_halves(spark, d, "customer", "c_custkey"))).withColumn("rn", F.col("rn").cast("bigint"))
)

_TORN = "c_custkey % 7 = 3"


@query(
    "csv_rescued_customer",
    "SELECT c_mktsegment, count(*) FILTER (NOT torn) AS good, sum(c_custkey) FILTER (NOT torn) AS keys, "
    "count(*) FILTER (torn) AS rescued FROM "
    f"(SELECT *, {_TORN} OR c_custkey % 11 = 5 AS torn FROM customer) GROUP BY c_mktsegment",
)
def _(spark, d):
    """The table as CSV lines, some torn and some with a word for a number: read back in two lanes."""
    rows = table(spark, d, "customer")
    number = F.when(F.col("c_custkey") % 11 == 5, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string"))
    line = F.concat_ws(",", "c_custkey", "c_name", "c_nationkey", number, "c_mktsegment")
    line = F.when(F.expr(_TORN), F.concat_ws(",", "c_custkey", "c_mktsegment")).otherwise(line)
    path = scratch_folder(spark)
    rows.select(line).write.text(path)
    good, rescued = read_csv_rescued(spark, path, rows.schema, header=False)
    good = good.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("good"), F.sum("c_custkey").cast("decimal(38,0)").alias("keys"))
    bad = rescued.groupBy(F.element_at(F.split("record", ","), -1).alias("c_mktsegment")).agg(F.count(F.lit(1)).alias("rescued"))
    return good.join(bad, "c_mktsegment", "left").fillna(0, ["rescued"])


query("profile_approx_lineitem")(
    lambda spark, d: profile(table(spark, d, "lineitem"), distinct="approx")
)


@query(
    "profile_approx_close",
    f'SELECT name, "count", true AS close FROM ({sql.profile("lineitem", sql.TABLE_COLUMNS["lineitem"])})',
)
def _(spark, d):
    """Approximate distinct counts are within a fifth of the exact ones."""
    rows = table(spark, d, "lineitem")
    exact = profile(rows).select("name", F.col("distinct").alias("true_distinct"))
    gap = F.abs(F.col("distinct") - F.col("true_distinct"))
    return profile(rows, distinct="approx").join(exact, "name").select(
        "name", "count", (gap <= F.col("true_distinct") * 0.2).alias("close")
    )


@query(
    "profile_custom_aggregate",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, CAST({e} AS DOUBLE) AS total FROM orders"
        for c, e in {
            "o_orderkey": "sum(o_orderkey)", "o_custkey": "sum(o_custkey)", "o_orderstatus": "min(0)",
            "o_totalprice": "round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2)",
            "o_orderdate": "min(0)", "o_orderpriority": "min(0)",
        }.items()
    ),
)
def _(spark, d):
    total = column_agg("total", numeric_only=True)(
        lambda c: F.sum(c.cast("decimal(18,2)"))
    )
    return profile(table(spark, d, "orders"), extra=[total]).select("name", "total")


query("melt_nation", sql.cells("nation", sql.TABLE_COLUMNS["nation"], keep_null=True))(
    lambda spark, d: melt(table(spark, d, "nation"))
)
query("melt_without_nulls", sql.cells(_HOLES, ["event_type", "props"]))(
    lambda spark, d: melt(_with_holes(spark, d), ["event_type", "props"], keep_null=False)
)

# ---------------------------------------------------------------- samples


def _pairs(text: str) -> str:
    return f'SELECT "column", value FROM ({text})'


for _t in ("customer", "part", "events", "orders"):
    query(f"sample_values_{_t}", _pairs(sql.samples(_t, sql.TABLE_COLUMNS[_t], 5)))(
        lambda spark, d, t=_t: sample_values(table(spark, d, t))
    )
query(
    "sample_values_with_null",
    _pairs(sql.samples(_HOLES, ["event_type", "props"], 3, keep_null=True)),
)(
    lambda spark, d: sample_values(_with_holes(spark, d), 3, ["event_type", "props"], keep_null=True)
)
query(
    "sample_first_seen",
    _pairs(sql.samples("customer", sql.TABLE_COLUMNS["customer"], 5, order="c_custkey")),
)(lambda spark, d: sample_values(table(spark, d, "customer"), order_by="c_custkey"))


@query(
    "sample_filled",
    " UNION ALL ".join(
        sql.filled(t, [c])
        for t, c in (("orders", "o_orderstatus"), ("documents", "lang"), ("conversations", "role"))
    ),
)
def _(spark, d):
    return union_all(
        *[
            filled_samples(sample_rows(table(spark, d, t), 5, [c]), 5)
            for t, c in (("orders", "o_orderstatus"), ("documents", "lang"), ("conversations", "role"))
        ]
    )


# ---------------------------------------------------------------- value features

for _t, _keys, _c in (
    ("documents", ["doc_id"], "text"),
    ("pages", ["page_id"], "url"),
    ("conversations", ["conv_id", "turn"], "text"),
    ("benchmark", ["item_id"], "text"),
    ("events", ["event_id"], "props"),
):
    query(
        f"value_features_{_t}",
        f"SELECT {', '.join(_keys)}, {sql.listed(sql.value_features(_c))} FROM {_t}",
    )(
        lambda spark, d, t=_t, keys=_keys, c=_c: table(spark, d, t).select(
            *keys, *value_features(F.col(c))
        )
    )

# Dates in every accepted shape, in shapes that are not accepted, and impossible ones.
_DATE_FORMATS = [
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm:ss'.25'", "%Y-%m-%dT%H:%M:%S.25"),
    ("yyyy/MM/dd", "%Y/%m/%d"),
    ("MM/dd/yyyy", "%m/%d/%Y"),
    ("dd/MM/yyyy", "%d/%m/%Y"),
    ("yyyy", "%Y"),
    ("MMM d, yyyy", "%b %-d, %Y"),
    ("d MMM yyyy", "%-d %b %Y"),
    ("yyyy-dd-MM", "%Y-%d-%m"),
]


@query(
    "is_datetime_orders",
    " UNION ALL ".join(
        f"SELECT o_orderkey, {i} AS shape, {sql.is_datetime(f'strftime(o_orderdate, {sql.quote(f)})')}"
        " AS is_datetime FROM orders"
        for i, (_, f) in enumerate(_DATE_FORMATS)
    ),
)
def _(spark, d):
    orders = table(spark, d, "orders")
    shapes = F.array(
        *[F.date_format("o_orderdate", f) for f, _ in _DATE_FORMATS]
    )
    return orders.select("o_orderkey", F.posexplode(shapes).alias("shape", "text")).select(
        "o_orderkey", "shape", VALUE_FEATURES["is_datetime"](F.col("text")).alias("is_datetime")
    )


_CONTACTS = (
    "(SELECT c_custkey, lower(c_mktsegment) || '@' || replace(c_name, '#', '.') || '.org' AS a, "
    "'https://' || c_nationkey || '.example.org/' || c_name AS b, "
    "c_mktsegment || ';' || c_nationkey || ',' || c_name AS c FROM customer)"
)


@query(
    "value_features_contacts",
    " UNION ALL ".join(
        f"SELECT c_custkey, '{c}' AS kind, {sql.listed(sql.value_features(c))} FROM {_CONTACTS}"
        for c in "abc"
    ),
)
def _(spark, d):
    made = table(spark, d, "customer").select(
        "c_custkey",
        F.concat(F.lower("c_mktsegment"), F.lit("@"), F.replace("c_name", F.lit("#"), F.lit(".")), F.lit(".org")).alias("a"),
        F.concat(F.lit("https://"), F.col("c_nationkey"), F.lit(".example.org/"), F.col("c_name")).alias("b"),
        F.concat_ws(",", F.concat_ws(";", "c_mktsegment", "c_nationkey"), "c_name").alias("c"),
    )
    return made.unpivot(["c_custkey"], ["a", "b", "c"], "kind", "v").select(
        "c_custkey", "kind", *value_features(F.col("v"))
    )


# ---------------------------------------------------------------- column features

for _t in ("customer", "part", "orders"):
    query(f"column_features_{_t}", sql.column_features(_t, sql.TABLE_COLUMNS[_t]))(
        lambda spark, d, t=_t: steadied(extract_features(table(spark, d, t)))
    )

query(
    "column_features_tablewide",
    sql.column_features("customer", sql.TABLE_COLUMNS["customer"], spread="table"),
)(lambda spark, d: steadied(extract_features(table(spark, d, "customer"), spread="table")))

query(
    "column_features_legacy",
    sql.column_features(
        "customer", sql.TABLE_COLUMNS["customer"], "pandas", order="c_custkey", legacy=True
    ),
)(lambda spark, d: steadied(featurize_table(table(spark, d, "customer"), order_by="c_custkey")))

query(
    "sample_features_supplier",
    sql.sample_features("supplier", sql.TABLE_COLUMNS["supplier"], legacy=True),
)(
    lambda spark, d: steadied(
        sample_features(sample_values(table(spark, d, "supplier")), use_legacy_names=True)
    )
)

# ---------------------------------------------------------------- quality, filters, unions

_BAD = f"regexp_matches(coalesce(text, ''), {sql.quote(sql.UNPRINTABLE_PATTERN)})"
query("bad_rows_mask", f"SELECT doc_id, {_BAD} AS is_bad FROM documents")(
    lambda spark, d: quality.find_bad_rows(table(spark, d, "documents"), ["text"]).select(
        "doc_id", "is_bad"
    )
)
query("bad_rows_dropped", f"SELECT doc_id, n_chars FROM documents WHERE NOT {_BAD}")(
    lambda spark, d: quality.drop_bad_rows(
        table(spark, d, "documents"), ["text", "lang", "source"]
    ).select("doc_id", "n_chars")
)
query("filter_by_source", "SELECT doc_id, lang FROM documents WHERE source = 'src3'")(
    lambda spark, d: table(spark, d, "documents").where(F.col("source") == "src3").select("doc_id", "lang")
)
@query("select_described", "SELECT p_partkey, p_size, p_retailprice FROM part")
def _(spark, d):
    """The numeric columns of parts, as a profile describes them."""
    part = table(spark, d, "part")
    described = profile(part).select(
        (F.col("mean") != 0).cast("int").alias("Record_id"), F.col("name").alias("Attribute_name")
    )
    return select_described(part, described, 1)


query("distinct_sources", "SELECT DISTINCT source FROM documents")(
    lambda spark, d: table(spark, d, "documents").select("source").distinct()
)
query(
    "union_all_parties",
    "SELECT c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer "
    "UNION ALL SELECT s_nationkey, s_acctbal FROM supplier",
)(
    lambda spark, d: union_all(
        table(spark, d, "customer").select(
            F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal")
        ),
        table(spark, d, "supplier").select(
            F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal")
        ),
    )
)
query("scale_out_nation", "SELECT nation.* FROM nation, range(8)")(
    lambda spark, d: scaleout.scaled(table(spark, d, "nation"), 4)
)
query(
    "scale_out_profile",
    sql.profile("(SELECT supplier.* FROM supplier, range(4))", sql.TABLE_COLUMNS["supplier"]),
)(lambda spark, d: steadied(profile(scaleout.scaled(table(spark, d, "supplier"), 3))))

# ---------------------------------------------------------------- preparation

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _clipped(c: str, limit: int) -> str:
    return f"greatest(least(CAST({c} AS DOUBLE), {limit}.0), -{limit}.0)"


def _z(c: str, e: str | None = None) -> str:
    e = e or f'"{c}"'
    scaled = f"({e} - avg({e}) OVER ()) / coalesce(nullif(stddev_pop({e}) OVER (), 0), 1)"
    return f'round({scaled}, 6) + 0.0::DOUBLE AS "{c}"'  # + 0.0 turns -0.0 into 0.0


@query(
    "clip_scale_lineitem",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    + ", ".join(_z(c, _clipped(c, 10000)) for c in _MEASURES)
    + " FROM lineitem",
)
def _(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    out = prep.process_stats(
        table(spark, d, "lineitem"), normalize=True, abs_limit=abs_limit_10000,
        columns=_MEASURES, keep=keys,
    )
    return out.select(*keys, *[(F.round(c, 6) + 0.0).alias(c) for c in _MEASURES])


def _all_column_features(spark: SparkSession, d: str) -> DataFrame:
    """Column features of four tables: a small table of described columns."""
    tables = ("customer", "supplier", "part", "orders")
    return union_all(*[featurize_table(table(spark, d, t)) for t in tables])


_ALL_COLUMNS_SQL = " UNION ALL ".join(
    sql.column_features(t, sql.TABLE_COLUMNS[t], "pandas", legacy=True, steady=False)
    for t in ("customer", "supplier", "part", "orders")
)


def _as_number(c: str) -> str:
    return f'coalesce(CAST("{c}" AS DOUBLE), 0)'


_FLAGS = ("has_delimiters", "has_url", "has_email", "has_date", "is_list", "is_long_sentence")


@query(
    "column_stats_scaled",
    'SELECT "Attribute_name", '
    + ", ".join(
        _z(c, _as_number(c) if c in _FLAGS else _clipped(_as_number(c), 1000)) for c in STATS_25
    )
    + f" FROM ({_ALL_COLUMNS_SQL})",
)
def _(spark, d):
    out = prep.process_stats(
        _all_column_features(spark, d), normalize=True, abs_limit=abs_limit_1000,
        keep=["Attribute_name"],
    )
    return out.select("Attribute_name", *[(F.round(quoted(c), 6) + 0.0).alias(c) for c in STATS_25])


@query(
    "column_stats_partly_scaled",
    'SELECT "Attribute_name", '
    + ", ".join(
        _z(m, _clipped(_as_number(c), 10000))
        if m in STATS_19_SCALED
        else f'round({_as_number(c)}, 6) AS "{m}"'
        for c, m in STATS_19.items()
    )
    + f" FROM ({_ALL_COLUMNS_SQL})",
)
def _(spark, d):
    out = prep.process_statistics(_all_column_features(spark, d), keep=["Attribute_name"])
    return out.select(
        "Attribute_name", *[(F.round(quoted(m).cast("double"), 6) + 0.0).alias(m) for m in STATS_19.values()]
    )


# 'view' is left out: an unknown label has no code.
_EVENT_CODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3}


@query(
    "label_map",
    "SELECT event_id, CAST(CASE event_type "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _EVENT_CODES.items())
    + " END AS DOUBLE) AS event_type FROM events",
)
def _(spark, d):
    return prep.process_targets(
        table(spark, d, "events"), "event_type", _EVENT_CODES
    ).select("event_id", "event_type")


# ---------------------------------------------------------------- encoders

_GRAMS = (
    "SELECT p_partkey, unnest(list_transform(range(1, length(t)), lambda i: substring(t, i, 2))) AS gram "
    "FROM (SELECT p_partkey, lower(p_name) AS t FROM part)"
)
query(
    "gram_vocabulary",
    f"SELECT gram, row_number() OVER (ORDER BY gram) - 1 AS gram_index FROM (SELECT DISTINCT gram FROM ({_GRAMS}))",
)(lambda spark, d: encoders.gram_vocabulary(table(spark, d, "part"), "p_name"))


@query(
    "name_bigrams",
    f"WITH g AS ({_GRAMS}), v AS (SELECT gram, row_number() OVER (ORDER BY gram) - 1 AS gram_index "
    "FROM (SELECT DISTINCT gram FROM g)) "
    "SELECT p_partkey, gram_index, count(*) AS n FROM g JOIN v USING (gram) GROUP BY ALL",
)
def _(spark, d):
    part = table(spark, d, "part")
    return encoders.encode_grams(
        part, "p_partkey", "p_name", encoders.gram_vocabulary(part, "p_name")
    )


_CHARS = "SELECT unnest(string_split(lower({c}), '')) AS ch FROM {t}"
_DICTIONARY = (
    "SELECT ch AS char, CAST(row_number() OVER (ORDER BY count(*) DESC, ch) AS INTEGER) AS id, "
    "count(*) AS n FROM ({chars}) WHERE ch <> '' GROUP BY ch"
)
query("char_dictionary", _DICTIONARY.format(chars=_CHARS.format(c="text", t="documents")))(
    lambda spark, d: encoders.char_dictionary(table(spark, d, "documents"), "text")
)

_IDS = (
    f"WITH dict AS ({_DICTIONARY.format(chars=_CHARS.format(c='p_name', t='part'))}), "
    "lookup AS (SELECT map(list(char), list(id)) AS m FROM dict), "
    "ids AS (SELECT p_partkey, list_transform(string_split(lower(p_name), ''), lambda c: m[c]) AS x "
    "FROM part, lookup) "
)


def _part_encoder(spark: SparkSession, d: str) -> tuple[DataFrame, encoders.CharEncoder]:
    part = table(spark, d, "part")
    return part, encoders.CharEncoder.fit(part, "p_name")


@query("char_ids", _IDS + "SELECT p_partkey, array_to_string(x, ' ') AS ids FROM ids")
def _(spark, d):
    part, encoder = _part_encoder(spark, d)
    return part.select("p_partkey", F.array_join(encoder.ids(F.col("p_name")), " ").alias("ids"))


@query(
    "padded_ids",
    _IDS + "SELECT p_partkey, array_to_string(list_concat("
    "list_transform(range(greatest(0, 256 - len(x))), lambda i: 0), x[greatest(1, len(x) - 255):]), ' ') "
    "AS ids FROM ids",
)
def _(spark, d):
    part, encoder = _part_encoder(spark, d)
    return part.select("p_partkey", F.array_join(encoder.padded(F.col("p_name")), " ").alias("ids"))


@query(
    "padded_ids_documents",
    _IDS.replace("p_name", "text").replace("p_partkey", "doc_id").replace("part", "documents")
    + "SELECT doc_id, array_to_string(list_concat("
    "list_transform(range(greatest(0, 256 - len(x))), lambda i: 0), x[greatest(1, len(x) - 255):]), ' ') "
    "AS ids FROM ids",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    encoder = encoders.CharEncoder.fit(docs, "text")
    return docs.select("doc_id", F.array_join(encoder.padded(F.col("text")), " ").alias("ids"))


# ---------------------------------------------------------------- folds

_HASH = "md5('100|' || c_custkey)"
query(
    "shuffle_customer",
    f"SELECT c_custkey, row_number() OVER (ORDER BY {_HASH}, c_custkey) - 1 AS place FROM customer",
)(
    lambda spark, d: folds.number_rows(
        table(spark, d, "customer"),
        F.substring(folds.shuffle_hash(F.col("c_custkey")), 1, 4),
        [folds.shuffle_hash(F.col("c_custkey")), F.col("c_custkey")],
        "place",
    ).select("c_custkey", "place")
)
query(
    "kfold_customer",
    f"SELECT c_custkey, CAST(ntile(5) OVER (ORDER BY {_HASH}, c_custkey) - 1 AS INTEGER) AS fold FROM customer",
)(lambda spark, d: folds.kfold(table(spark, d, "customer"), "c_custkey").select("c_custkey", "fold"))
query(
    "kfold_documents",
    "SELECT doc_id, CAST(ntile(7) OVER (ORDER BY md5('3|' || doc_id), doc_id) - 1 AS INTEGER) AS fold FROM documents",
)(
    lambda spark, d: folds.kfold(table(spark, d, "documents"), "doc_id", folds=7, seed=3).select(
        "doc_id", "fold"
    )
)
query(
    "holdout_customer",
    f"SELECT c_custkey, substring({_HASH}, 1, 8) < '40000000' AS in_holdout FROM customer",
)(
    lambda spark, d: table(spark, d, "customer").select(
        "c_custkey", folds.in_holdout(F.col("c_custkey")).alias("in_holdout")
    )
)

# ---------------------------------------------------------------- neighbours

_PART_TYPES = {"ECONOMY": 0, "LARGE": 1, "MEDIUM": 2, "PROMO": 3, "SMALL": 4, "STANDARD": 5}
_PART_POINT = neighbours.PointColumns("p_partkey", "p_name", ("p_size", "price"), "label")


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Parts with two statistics of like size and a label."""
    return table(spark, d, "part").select(
        "p_partkey",
        "p_name",
        F.col("p_size").cast("double").alias("p_size"),
        (F.col("p_retailprice") / 10).alias("price"),
        prep.label_code(F.col("p_type"), _PART_TYPES).alias("label"),
    )


_POINTS = (
    "SELECT p_partkey AS id, p_name AS name, CAST(p_size AS DOUBLE) AS a, p_retailprice / 10 AS b, "
    "CASE p_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _PART_TYPES.items())
    + " END AS label, substring(md5('100|' || p_partkey), 1, 8) < '40000000' AS test, "
    "CAST(ntile(5) OVER (ORDER BY md5('100|' || p_partkey), p_partkey) - 1 AS INTEGER) AS fold FROM part"
)
_EUCLID = "sqrt((q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b))"


def _nearest_sql(alpha: float, k: int) -> str:
    distance = f"levenshtein(q.name, t.name) + CAST({alpha!r} AS DOUBLE) * {_EUCLID}"
    if alpha == 0:
        distance = "CAST(levenshtein(q.name, t.name) AS DOUBLE)"
    return (
        f"SELECT * FROM (SELECT q.id AS query_id, CAST(row_number() OVER (PARTITION BY q.id ORDER BY {distance}, t.id) AS INTEGER) "
        f"AS place, t.id AS neighbour_id, {distance} AS distance, t.label FROM points q, points t "
        f"WHERE q.test AND NOT t.test) WHERE place <= {k}"
    )


def _nearest(spark: SparkSession, d: str, k: int, alpha: float) -> DataFrame:
    train, test = folds.holdout_split(_points(spark, d), "p_partkey")
    return neighbours.nearest(test, train, _PART_POINT, k=k, alpha=alpha)


for _name, _alpha in (("knn_edit", 0.0), ("knn_combined", 1.0)):
    query(
        _name,
        f"WITH points AS ({_POINTS}) SELECT query_id, place, neighbour_id, round(distance, 6) AS distance "
        f"FROM ({_nearest_sql(_alpha, 3)})",
    )(
        lambda spark, d, a=_alpha: _nearest(spark, d, 3, a).select(
            "query_id", "place", "neighbour_id", F.round("distance", 6).alias("distance")
        )
    )


_HOLED = _POINTS.replace("CAST(p_size AS DOUBLE) AS a", "CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size END AS DOUBLE) AS a")


@query(
    "knn_nulls",
    f"WITH points AS ({_HOLED}) SELECT query_id, place, neighbour_id, round(distance, 6) AS distance "
    f"FROM ({_nearest_sql(1.0, 3)})",
)
def _(spark, d):
    """Missing statistics, in training rows and in queries, count as 0; no query is lost."""
    holed = _points(spark, d).withColumn("p_size", F.when(F.col("p_size") % 7 != 0, F.col("p_size")))
    train, test = folds.holdout_split(holed, "p_partkey")
    return neighbours.nearest(test, train, _PART_POINT, k=3, alpha=1.0).select(
        "query_id", "place", "neighbour_id", F.round("distance", 6).alias("distance")
    )


@query(
    "knn_predict",
    f"WITH points AS ({_POINTS}), votes AS (SELECT query_id, label, count(*) AS v FROM ({_nearest_sql(1.0, 5)}) GROUP BY ALL) "
    "SELECT query_id, label AS predicted FROM (SELECT *, row_number() OVER "
    "(PARTITION BY query_id ORDER BY v DESC, label) AS r FROM votes) WHERE r = 1",
)
def _(spark, d):
    train, test = folds.holdout_split(_points(spark, d), "p_partkey")
    return neighbours.predict_label(test, train, _PART_POINT, k=5, alpha=1.0)


_GRID_POINT = neighbours.PointColumns("p_partkey", "p_name", ("p_size", "price"), "label", "fold")
_GRID_SQL = (
    f"WITH points AS ({_POINTS}), pairs AS (SELECT q.id AS qid, q.fold, q.label AS actual, t.id, t.label, "
    f"levenshtein(q.name, t.name) AS e, {_EUCLID} AS x FROM points q JOIN points t ON q.fold <> t.fold), "
    "near AS ("
    + " UNION ALL ".join(
        f"SELECT * FROM (SELECT qid, fold, actual, label, CAST({a!r} AS DOUBLE) AS alpha, row_number() OVER "
        f"(PARTITION BY qid ORDER BY e + CAST({a!r} AS DOUBLE) * x, id) AS place FROM pairs) WHERE place <= 10"
        for a in sql.ALPHAS
    )
    + "), votes AS (SELECT qid, fold, actual, alpha, CAST(k AS INTEGER) AS k, label, count(*) AS v "
    f"FROM near JOIN (SELECT unnest({sql.COUNTS}) AS k) ON place <= k GROUP BY ALL), "
    "won AS (SELECT *, row_number() OVER (PARTITION BY qid, alpha, k ORDER BY v DESC, label) AS r FROM votes), "
    "grid AS (SELECT fold, alpha, k, round(avg(CAST(actual = label AS INTEGER)), 8) AS accuracy "
    "FROM won WHERE r = 1 GROUP BY ALL) "
)


def _grid(spark: SparkSession, d: str) -> DataFrame:
    train = folds.kfold(_points(spark, d), "p_partkey")
    scores = neighbours.neighbour_grid(train, _GRID_POINT)
    return scores.withColumn("accuracy", F.round("accuracy", 8))


query("knn_grid", _GRID_SQL + "SELECT fold, alpha, k, accuracy FROM grid")(_grid)


# ---------------------------------------------------------------- evaluation

_THRESHOLDS = [10, 20, 40, 80, 160, 320, 640]
_RULES = (
    "WITH entities AS (SELECT doc_id, n_chars, quality, toxic, CAST(ntile(5) OVER (ORDER BY md5('100|' || doc_id), doc_id) - 1 "
    "AS INTEGER) AS fold FROM documents JOIN labels USING (doc_id)), "
    f"rules AS (SELECT *, CAST(n_chars > threshold AS INTEGER) AS predicted FROM entities, (SELECT unnest({_THRESHOLDS}) AS threshold)), "
    "scores AS (SELECT fold, threshold, avg(CAST(predicted = quality AS INTEGER)) AS accuracy FROM rules GROUP BY ALL), "
    "best AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY accuracy DESC, threshold) AS r FROM scores) WHERE r = 1) "
)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")


def _rules(spark: SparkSession, d: str) -> DataFrame:
    """Predict quality by text length, for a grid of thresholds."""
    entities = folds.kfold(_labelled(spark, d).select("doc_id", "n_chars", "quality", "toxic"), "doc_id")
    grid = F.explode(F.array(*[F.lit(t) for t in _THRESHOLDS])).alias("threshold")
    return entities.select("*", grid).withColumn(
        "predicted", (F.col("n_chars") > F.col("threshold")).cast("int")
    )


def _rule_scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.accuracy(_rules(spark, d), "quality", "predicted", ["fold", "threshold"])


def _best_rules(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.best_of_grid(_rule_scores(spark, d), ["fold"], "accuracy", ["threshold"])


query("accuracy", _RULES + "SELECT fold, threshold, round(accuracy, 8) AS accuracy FROM scores")(
    lambda spark, d: _rule_scores(spark, d).withColumn("accuracy", F.round("accuracy", 8))
)
query(
    "confusion_matrix",
    "SELECT a.actual, "
    + ", ".join(f"count(l.doc_id) FILTER (WHERE l.toxic = {p}) AS predicted_{p}" for p in (0, 1, 2))
    + " FROM (SELECT unnest([0, 1, 2]) AS actual) a LEFT JOIN (SELECT doc_id, quality, toxic FROM documents "
    "JOIN labels USING (doc_id)) l ON l.quality = a.actual GROUP BY a.actual",
)(
    lambda spark, d: evaluate.confusion_matrix(_labelled(spark, d), "quality", "toxic", [0, 1, 2])
)
query("best_of_grid", _RULES + "SELECT fold, threshold, round(accuracy, 8) AS accuracy FROM best")(
    lambda spark, d: _best_rules(spark, d).withColumn("accuracy", F.round("accuracy", 8))
)
query("winner_counts", _RULES + "SELECT threshold, count(*) AS wins FROM best GROUP BY threshold")(
    lambda spark, d: evaluate.winner_counts(_best_rules(spark, d), "threshold")
)
query(
    "fold_average",
    _RULES + "SELECT threshold, round(avg(accuracy), 8) AS mean_accuracy FROM scores GROUP BY threshold",
)(
    lambda spark, d: evaluate.fold_averages(_rule_scores(spark, d), ["threshold"], ["accuracy"]).withColumn(
        "mean_accuracy", F.round("mean_accuracy", 8)
    )
)


@query(
    "argmax_embeddings",
    "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS predicted FROM embeddings",
)
def _(spark, d):
    return table(spark, d, "embeddings").select(
        "vec_id", evaluate.argmax(F.col("embedding")).alias("predicted")
    )


@query(
    "trial_summary",
    "SELECT name, "
    + ", ".join(f"round(sum({e}) / sum(iterations), 8) AS {c}" for c, e in (
        ("prepare", "prepare"), ("run", "run"), ("total", "prepare + run")))
    + " FROM (SELECT event_type AS name, value AS prepare, value / 4 AS run, 1 + user_id AS iterations FROM events) GROUP BY name",
)
def _(spark, d):
    trials = table(spark, d, "events").select(
        F.col("event_type").alias("name"),
        F.col("value").alias("prepare"),
        (F.col("value") / 4).alias("run"),
        (1 + F.col("user_id")).alias("iterations"),
    )
    return steadied(evaluate.trial_summary(trials))


# ---------------------------------------------------------------- learning

_LAYOUT = classify.FeatureLayout(
    stats=tuple(VALUE_FEATURES), name="source", samples=("lang",), scaled=tuple(VALUE_FEATURES)
)
_RAW_LAYOUT = classify.FeatureLayout(stats=tuple(VALUE_FEATURES), name="source")


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents: value features as statistics, source as name, lang as sample."""
    # Texts end here, so none are shuffled to meet their labels.
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", *value_features(F.col("text")))
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return docs.join(labels, "doc_id").select("doc_id", "source", "lang", "label", *VALUE_FEATURES)


def _search(spark, d, layout, grid) -> classify.GridResult:
    train, holdout = folds.holdout_split(_entities(spark, d), "doc_id")
    features = classify.fit_features(train, layout)
    rows = folds.kfold(features.transform(train), "doc_id")
    return classify.grid_search(rows, grid, row_id="doc_id", holdout=features.transform(holdout))


_FOLDED = (
    "WITH entities AS (SELECT doc_id, quality, md5('100|' || doc_id) AS h, md5('101|' || doc_id) AS h2 FROM documents JOIN labels USING (doc_id)), "
    "held AS (SELECT * FROM entities WHERE substr(h, 1, 8) < '40000000'), "
    "rest AS (SELECT *, CAST(ntile(5) OVER (ORDER BY h, doc_id) - 1 AS INTEGER) AS fold FROM entities WHERE substr(h, 1, 8) >= '40000000'), "
    "folds AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold), "
    "share AS (SELECT f.fold, count(*) FILTER (substr(h2, 1, 8) < '40000000') AS choosing, "
    "greatest(avg(quality) FILTER (substr(h2, 1, 8) < '40000000'), 1 - avg(quality) FILTER (substr(h2, 1, 8) < '40000000')) AS majority "
    "FROM folds f JOIN rest r ON r.fold <> f.fold GROUP BY f.fold) "
)


def _points_sql(grid: dict[str, list]) -> str:
    """(place, one column for each parameter) of the grid points, the last parameter running fastest."""
    points = list(itertools.product(*grid.values()))
    rows = ", ".join("(" + ", ".join([str(i), *[f"CAST({x!r} AS DOUBLE)" for x in p]]) + ")" for i, p in enumerate(points))
    return f"(SELECT * FROM (VALUES {rows}) AS p(place, {', '.join(grid)}))"


def _tried_sql(grid: dict[str, list]) -> str:
    """Every fold and point; the accuracy of a point is a share of the rows that choose, the best is no worse than the majority."""
    return (
        _FOLDED + f"SELECT fold, place, {', '.join(grid)}, choosing, true AS is_share, true AS best_beats_majority "
        f"FROM share, {_points_sql(grid)}"
    )


def _tried(spark: SparkSession, d: str, layout: classify.FeatureLayout, grid: list[classify.Candidate]) -> DataFrame:
    """The scores of a search, as far as they do not hang on the way a loss is brought down."""
    train, _ = folds.holdout_split(_labelled(spark, d).select("doc_id", F.col("quality").alias("label")), "doc_id")
    rows = folds.kfold(train, "doc_id").withColumn("choosing", folds.in_holdout(F.col("doc_id"), seed=101))
    every = F.explode(F.array(*[F.lit(f) for f in range(5)])).alias("of")
    told = rows.select("*", every).where("fold <> of AND choosing").groupBy(F.col("of").alias("fold"))
    told = told.agg(F.count(F.lit(1)).alias("choosing"), F.avg("label").alias("good"))
    scores = _search(spark, d, layout, grid).scores.join(told, "fold")
    hits = F.col("accuracy") * F.col("choosing")
    best = F.max("accuracy").over(Window.partitionBy("fold"))
    return scores.select(
        "fold", "place", *grid[0].params, "choosing",
        (F.abs(hits - F.round(hits)) < 1e-6).alias("is_share"),
        (best >= F.greatest("good", 1 - F.col("good")) - 1e-9).alias("best_beats_majority"),
    )


_LOGISTIC = {"c": sql.LOGISTIC_C}
_RADIAL = {"c": sql.SVM_C, "gamma": sql.SVM_GAMMA}

query("logistic_grid_scores", _tried_sql(_LOGISTIC))(
    lambda spark, d: _tried(spark, d, _LAYOUT, classify.logistic_grid())
)
query("radial_svm_grid", _tried_sql(_RADIAL))(
    lambda spark, d: _tried(spark, d, _LAYOUT, classify.radial_svm_grid())
)
query("logistic_grid")(
    lambda spark, d: _search(spark, d, _LAYOUT, classify.logistic_grid()).scores
)
query("forest_grid")(
    lambda spark, d: _search(spark, d, _RAW_LAYOUT, classify.forest_grid()).best
)
query("svm_grid")(
    lambda spark, d: _search(spark, d, _RAW_LAYOUT, classify.svm_grid()).best
)


@query("perceptron_score")
def _(spark, d):
    train, test = folds.holdout_split(_entities(spark, d), "doc_id")
    features = classify.fit_features(train, _LAYOUT)
    size = features.transform(train).select("features").first()["features"].size
    model = classify.fit_pipeline(train, _LAYOUT, classify.perceptron(size, 2))
    return classify.score(test, model, ["source", "lang"]).select("doc_id", "label", "prediction")


def _typed_columns(spark: SparkSession, d: str) -> DataFrame:
    """Features and hand-written types of all columns of all tables, stored once as they are read by every step of a fit."""
    parts = []
    for name, types in sql.COLUMN_TYPES.items():
        named = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
        rows = featurize_table(table(spark, d, name)).withColumn("table_name", F.lit(name))
        parts.append(rows.withColumn(semantic.LABEL, F.try_element_at(named, F.col("Attribute_name"))))
    # One row per column: a handful of partitions, whatever those of the tables are.
    return union_all(*parts).coalesce(2).persist()


@query(
    "column_types",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{t}', '{c}', '{k}')" for t, types in sql.COLUMN_TYPES.items() for c, k in types.items())
    + ") AS v(table_name, column_name, predicted)",
)
def _(spark, d):
    """Types of all columns of all tables, from the raw tables by one pipeline that was fitted on them."""
    labelled = _typed_columns(spark, d)
    model = semantic.fit_types(labelled, classify.logistic(100.0, labelled.count(), iterations=50), drop_bad=False)
    labelled.unpersist()
    found = [
        semantic.predict_types(table(spark, d, t), model).select(
            F.lit(t).alias("table_name"), F.col("Attribute_name").alias("column_name"), "predicted"
        )
        for t in sql.COLUMN_TYPES
    ]
    return union_all(*found)
