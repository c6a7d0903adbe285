"""Small tables held by the driver as constants of a plan.

Written as SQL constructors, which the optimizer folds into one literal (a parsed JSON
text would be read again for every row).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_double(value: float | None) -> str:
    return "cast(null AS double)" if value is None else f"cast('{value!r}' AS double)"


def sql_doubles(values: Sequence[float | None]) -> str:
    return f"cast(array({', '.join(map(sql_double, values))}) AS array<double>)"


def int_array(values: Sequence[int]) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")


def struct_array(rows: Sequence[dict[str, str]]) -> Column:
    """An array of structs; the fields are given as SQL text."""
    structs = (
        "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in row.items()) + ")" for row in rows
    )
    return F.expr(f"array({', '.join(structs)})")
