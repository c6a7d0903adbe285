"""Pieces of DuckDB SQL that say the same as the Spark plans."""

from __future__ import annotations

from colprism.fixed_values import COUNT_FEATURES, FLAG_FEATURES, PROFILE_NAMES, SAMPLE_FEATURE_NAMES

# Fixed values, written out here once more so that SQL does not inherit a wrong pattern; the names of
# columns above are shared.
DELIMITED_PATTERN = r"^[^,;|]+[,;|][^,;|]"
DELIMITER_PATTERN = r"[,;|]"
URL_PATTERN = r"^(http|ftp|https)://[\p{L}\p{N}_-]+\.[\p{L}\p{N}_-]"
EMAIL_PATTERN = r"^[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,6}([^\p{L}\p{N}_]|$)"
TOKEN_PATTERN = r"'?[\p{L}\p{N}_]+"
UNPRINTABLE_PATTERN = r"[^\x09-\x0d\x20-\x7e]"
NAN_TEXT_PATTERN = r"^[\x00-\x20]*([+-]?NaN|[nN][aA][nN])[\x00-\x20]*\z"
DATE_SHAPES = [
    (r"^\d{4}-\d{2}-\d{2}\z", "%Y-%m-%d"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z", "%Y-%m-%d %H:%M:%S"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\z", "%Y-%m-%dT%H:%M:%S"),
    (r"^\d{4}/\d{2}/\d{2}\z", "%Y/%m/%d"),
    (r"^\d{2}/\d{2}/\d{4}\z", "%m/%d/%Y"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}\z", "%b %-d, %Y"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}\z", "%-d %b %Y"),
]
YEAR_PATTERN = r"^[0-9]{4}\z"
SECOND_FRACTION_PATTERN = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})\.\d{1,9}\z"
LONGEST_DATE = 29
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what "
    "which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn "
    "hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()
ALPHAS = [0.001, 0.01, 0.1, 1, 10, 100, 1000]
COUNTS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
LOGISTIC_C = [0.0001, 0.001, 0.01, 0.1, 1, 10, 100, 1000, 10000, 100000]
SVM_C = [0.1, 1, 10, 100, 1000]
SVM_GAMMA = [0.0001, 0.001, 0.01, 0.1, 1, 10]

# Columns of the test tables with their kind: i(nteger), f(loat), s(tring), t(imestamp).
TABLE_COLUMNS = {
    "nation": {"n_nationkey": "i", "n_name": "s", "n_regionkey": "i"},
    "customer": {
        "c_custkey": "i", "c_name": "s", "c_nationkey": "i", "c_acctbal": "f", "c_mktsegment": "s",
    },
    "supplier": {"s_suppkey": "i", "s_name": "s", "s_nationkey": "i", "s_acctbal": "f"},
    "part": {
        "p_partkey": "i", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "i",
        "p_retailprice": "f",
    },
    "orders": {
        "o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "s", "o_totalprice": "f",
        "o_orderdate": "t", "o_orderpriority": "s",
    },
    "lineitem": {
        "l_orderkey": "i", "l_partkey": "i", "l_suppkey": "i", "l_linenumber": "i",
        "l_quantity": "f", "l_extendedprice": "f", "l_discount": "f", "l_tax": "f",
        "l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "t",
    },
    "events": {
        "event_id": "i", "ts": "t", "user_id": "i", "event_type": "s", "value": "f", "props": "s",
    },
}


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rounded(x: str) -> str:
    """As :func:`catalog.queries.steady`: digits by size, since engines differ in the last bits."""
    return (
        f"CASE WHEN abs({x}) >= 1000 AND NOT isnan({x}) THEN round({x}, 4) "
        f"ELSE round({x}, 8) END"
    )


def is_datetime(v: str) -> str:
    plain = (
        f"regexp_replace(CASE WHEN length({v}) <= {LONGEST_DATE} THEN {v} END, "
        f"{quote(SECOND_FRACTION_PATTERN)}, '\\1')"
    )
    tests = [f"regexp_matches({plain}, {quote(YEAR_PATTERN)})"] + [
        f"(regexp_matches({plain}, {quote(shape)}) "
        f"AND try_strptime({plain}, {quote(fmt)}) IS NOT NULL)"
        for shape, fmt in DATE_SHAPES
    ]
    return f"CASE WHEN {v} IS NOT NULL THEN coalesce({' OR '.join(tests)}, false) END"


def value_features(v: str) -> dict[str, str]:
    blanks = f"length({v}) - length(replace({v}, ' ', ''))"
    stops = ", ".join(map(quote, STOP_WORDS))
    return {
        "is_delimited": f"regexp_matches({v}, {quote(DELIMITED_PATTERN)})",
        "is_url": f"regexp_matches({v}, {quote(URL_PATTERN)})",
        "is_email": f"regexp_matches({v}, {quote(EMAIL_PATTERN)})",
        "is_datetime": is_datetime(v),
        "word_count": f"CAST(len(string_split({v}, ' ')) AS BIGINT)",
        "stopword_count": (
            f"CAST(len(list_filter(regexp_extract_all({v}, {quote(TOKEN_PATTERN)}), "
            f"lambda w: list_contains([{stops}], w))) AS BIGINT)"
        ),
        "char_count": f"CAST(length({v}) AS BIGINT)",
        "whitespace_count": f"CAST({blanks} AS BIGINT)",
        "delimiter_count": (
            f"CAST(len(regexp_extract_all({v}, {quote(DELIMITER_PATTERN)})) AS BIGINT)"
        ),
    }


def listed(features: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {k}" for k, e in features.items())


def profile(
    source: str,
    columns: dict[str, str],
    semantics: str = "spark",
    legacy: bool = False,
    steady: bool = True,
) -> str:
    """One select per column, united."""
    selects = []
    for c, kind in columns.items():
        number = kind in "if"
        if semantics == "spark":
            bad = {
                "f": f"{c} IS NULL OR isnan({c})",
                "s": f"{c} IS NULL OR {c} = '' OR regexp_matches({c}, {quote(NAN_TEXT_PATTERN)})",
            }.get(kind, f"{c} IS NULL")
            n, x, spread = f"count({c})", c, "stddev_samp"
            distinct = f"count(DISTINCT {c})"
        else:
            bad = f"{c} IS NULL OR isnan({c})" if kind == "f" else f"{c} IS NULL"
            x = f"(CASE WHEN NOT isnan({c}) THEN {c} END)" if kind == "f" else c
            n, spread, distinct = "count(*)", "stddev_pop", f"count(DISTINCT {x})"
        if number and semantics == "spark" and kind == "f":
            # Spark carries NaN through; DuckDB's deviation would refuse it.
            nan = f"bool_or(isnan({c}))"
            real = f"(CASE WHEN NOT isnan({c}) THEN {c} END)"
            mean = f"CASE WHEN {nan} THEN 'NaN'::DOUBLE ELSE avg({real}) END"
            std = f"CASE WHEN {nan} THEN 'NaN'::DOUBLE ELSE {spread}({real}) END"
            low, high = f"min({c})", f"max({c})"
        elif number:
            mean, std, low, high = f"avg({x})", f"{spread}({x})", f"min({x})", f"max({x})"
        else:
            mean = std = low = high = "0"
        stats = {
            "name": quote(c),
            "count": n,
            "nans": f"count(*) FILTER (WHERE {bad})",
            "nans_percent": f"100.0::DOUBLE * count(*) FILTER (WHERE {bad}) / nullif({n}, 0)",
            "distinct": distinct,
            "distinct_percent": f"100.0::DOUBLE * {distinct} / nullif({n}, 0)",
            "mean": f"CAST({mean} AS DOUBLE)",
            "std": f"CAST({std} AS DOUBLE)",
            "min": f"CAST({low} AS DOUBLE)",
            "max": f"CAST({high} AS DOUBLE)",
        }
        selects.append(
            "SELECT " + ", ".join(f'{e} AS "{k}"' for k, e in stats.items()) + f" FROM {source}"
        )
    whole = " UNION ALL ".join(selects)
    names = PROFILE_NAMES if legacy else {k: k for k in PROFILE_NAMES}
    shown = []
    for k, v in names.items():
        fractional = k in ("nans_percent", "distinct_percent", "mean", "std", "min", "max")
        shown.append(
            (rounded(f'"{k}"') if fractional and steady else f'"{k}"') + f' AS "{v}"'
        )
    return f"SELECT {', '.join(shown)} FROM ({whole})"


def wide(long: str, columns) -> str:
    """A profile as one row."""
    shown = ", ".join(
        f"max(CASE WHEN name = {quote(c)} THEN \"{s}\" END) AS \"{c}::{s}\"" for s in list(PROFILE_NAMES)[1:] for c in columns
    )
    return f"SELECT {shown} FROM ({long})"


def cells(source: str, columns, order: str | None = None, keep_null: bool = False) -> str:
    extra = f", {order} AS o" if order else ""
    parts = [
        f'SELECT {quote(c)} AS "column", CAST({c} AS VARCHAR) AS value{extra} FROM {source}'
        for c in columns
    ]
    union = " UNION ALL ".join(parts)
    return union if keep_null else f"SELECT * FROM ({union}) WHERE value IS NOT NULL"


def samples(source: str, columns, n: int, order: str | None = None, keep_null: bool = False) -> str:
    """("column", value, rn)."""
    by = "min(o)" if order else "0"
    return (
        'SELECT "column", value, rn FROM (SELECT "column", value, row_number() OVER '
        f"(PARTITION BY \"column\" ORDER BY r, md5(\"column\" || '|' || coalesce(value, '')), "
        f'value NULLS FIRST) AS rn FROM (SELECT "column", value, {by} AS r '
        f'FROM ({cells(source, columns, order, keep_null)}) GROUP BY "column", value)) '
        f"WHERE rn <= {n}"
    )


def filled(source: str, columns, n: int = 5, order: str | None = None) -> str:
    """("column", i, value) with exactly n rows per column."""
    return (
        f'SELECT s."column", CAST(g.i AS INTEGER) AS i, s.value FROM '
        f'(SELECT *, count(*) OVER (PARTITION BY "column") AS d '
        f"FROM ({samples(source, columns, n, order)})) s "
        f"JOIN (SELECT range AS i FROM range({n})) g ON g.i % s.d + 1 = s.rn"
    )


def sample_features(
    source: str, columns, order: str | None = None, spread: str = "column", legacy: bool = False,
    steady: bool = True,
) -> str:
    features = value_features("value")
    measured = f'SELECT "column", i, value, {listed(features)} FROM ({filled(source, columns, 5, order)})'
    shown = ", ".join(f"max(value) FILTER (WHERE i = {i}) AS sample_{i}" for i in range(5))
    votes = ", ".join(f"count(*) FILTER (WHERE {f}) >= 3 AS {f}" for f in FLAG_FEATURES)
    if spread == "column":
        spreads = ", ".join(
            f"avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}" for c in COUNT_FEATURES
        )
        per = f'SELECT "column", {shown}, {votes}, {spreads} FROM ({measured}) GROUP BY "column"'
    else:
        sums = ", ".join(f"sum({c}) AS {c}" for c in COUNT_FEATURES)
        spreads = ", ".join(
            f"avg({c}) OVER () AS mean_{c}, stddev_samp({c}) OVER () AS std_{c}"
            for c in COUNT_FEATURES
        )
        per = (
            f'SELECT *, {spreads} FROM (SELECT "column", {shown}, {votes}, {sums} '
            f'FROM ({measured}) GROUP BY "column")'
        )
    out = []
    for k, v in SAMPLE_FEATURE_NAMES.items():
        e = {
            "is_list": "is_delimited AND mean_char_count < 100",
            "is_long_sentence": "mean_word_count > 10",
        }.get(k, k)
        if steady and k.startswith(("mean_", "std_")):
            e = rounded(e)
        out.append(f'{e} AS "{v if legacy else k}"')
    return f'SELECT "column", {", ".join(out)} FROM ({per})'


def column_features(
    source: str, columns: dict[str, str], semantics: str = "spark", order: str | None = None,
    spread: str = "column", legacy: bool = False, steady: bool = True,
) -> str:
    key = PROFILE_NAMES["name"] if legacy else "name"
    return (
        f"SELECT p.*, s.* EXCLUDE (\"column\") FROM "
        f"({profile(source, columns, semantics, legacy, steady)}) p JOIN "
        f"({sample_features(source, columns, order, spread, legacy, steady)}) s "
        f'ON p."{key}" = s."column"'
    )


# The semantic type of every column of the test tables, written by hand.
COLUMN_TYPES = {
    "region": {"r_regionkey": "not-generalizable", "r_name": "categorical"},
    "nation": {"n_nationkey": "not-generalizable", "n_name": "categorical", "n_regionkey": "categorical"},
    "customer": {
        "c_custkey": "not-generalizable", "c_name": "embedded-number", "c_nationkey": "categorical",
        "c_acctbal": "numeric", "c_mktsegment": "categorical",
    },
    "supplier": {
        "s_suppkey": "not-generalizable", "s_name": "embedded-number", "s_nationkey": "categorical", "s_acctbal": "numeric",
    },
    "part": {
        "p_partkey": "not-generalizable", "p_name": "context-specific", "p_brand": "categorical", "p_type": "categorical",
        "p_size": "numeric", "p_retailprice": "numeric",
    },
    "orders": {
        "o_orderkey": "not-generalizable", "o_custkey": "not-generalizable", "o_orderstatus": "categorical",
        "o_totalprice": "numeric", "o_orderdate": "datetime", "o_orderpriority": "categorical",
    },
    "lineitem": {
        "l_orderkey": "not-generalizable", "l_partkey": "not-generalizable", "l_suppkey": "not-generalizable",
        "l_linenumber": "categorical", "l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric",
        "l_tax": "numeric", "l_returnflag": "categorical", "l_linestatus": "categorical", "l_shipdate": "datetime",
    },
    "events": {
        "event_id": "not-generalizable", "ts": "datetime", "user_id": "not-generalizable", "event_type": "categorical",
        "value": "numeric", "props": "context-specific",
    },
    "documents": {
        "doc_id": "not-generalizable", "text": "sentence", "lang": "categorical", "source": "categorical", "n_chars": "numeric",
    },
    "embeddings": {"vec_id": "not-generalizable", "embedding": "list", "label": "categorical"},
    "pages": {"page_id": "not-generalizable", "url": "url", "html": "context-specific"},
    "benchmark": {"item_id": "not-generalizable", "text": "sentence"},
    "labels": {"doc_id": "not-generalizable", "quality": "categorical", "toxic": "categorical"},
    "conversations": {"conv_id": "not-generalizable", "turn": "numeric", "role": "categorical", "text": "sentence"},
}
