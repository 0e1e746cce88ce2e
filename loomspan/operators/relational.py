"""Projection, filter, join and aggregate as DataFrame compositions.

They only build plans: pushdown, pruning, join order and build sides are
Catalyst's, and joins may be told a strategy by a hint.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.errors import EngineError
from loomspan.functions.aggregates import AGGREGATES

COMPARE = {
    "=": operator.eq, "<>": operator.ne, "!=": operator.ne,
    "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
}
FLIPPED = {"=": "=", "<>": "<>", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
HINTS = ("broadcast", "shuffle_hash", "merge")


def compare(left: Column, op: str, right: Column) -> Column:
    if op not in COMPARE:
        raise EngineError(f"Unknown comparison {op}")
    return COMPARE[op](left, right)


def project(df: DataFrame, columns: list[str | tuple[str, str]]) -> DataFrame:
    """Keeps, orders and renames columns: names, or (name, alias)."""
    return df.select(*[F.col(c) if isinstance(c, str) else F.col(c[0]).alias(c[1]) for c in columns])


def check_literal(df: DataFrame, column: str, value: object) -> None:
    """A literal must be of its column's kind; strings and numbers never compare."""
    text = isinstance(df.schema[column].dataType, T.StringType)
    if text != isinstance(value, str):
        raise EngineError(f"Cannot compare {column} with {value!r}")


def filter_compare(df: DataFrame, column: str, op: str, value: object) -> DataFrame:
    """Rows where ``column op value``."""
    check_literal(df, column, value)
    return df.where(compare(F.col(column), op, F.lit(value)))


def filter_all(df: DataFrame) -> DataFrame:
    """The predicate that is always true."""
    return df.where(F.lit(True))


def join(left: DataFrame, right: DataFrame, on: tuple[str, str, str], hint: str | None = None) -> DataFrame:
    """Inner join on ``left column, op, right column``; output is the left columns, then the right ones.

    Equality joins shuffle or broadcast on the key, as sizes tell; other
    comparisons have no key and suit a small side only. Null keys match nothing.
    """
    if hint is not None and hint not in HINTS:
        raise EngineError(f"Unknown join hint {hint}")
    a, op, b = on
    right = right.hint(hint) if hint else right
    return left.join(right, compare(left[a], op, right[b]), "inner")


def aggregate(df: DataFrame, group_by: list[str], aggs: list[tuple[str, str, str]]) -> DataFrame:
    """Groups by columns, or the whole input, and computes (function, column, alias).

    avg is the truncating integer average; sum and avg refuse strings. Over no
    rows and without groups there is one row: count 0, the others null. Groups
    without aggregates are the distinct keys.
    """
    made = []
    for name, column, alias in aggs:
        f = AGGREGATES.get(name.lower())
        if f is None:
            raise EngineError(f"Unsupported SQL function {name}")
        if name.lower() in ("sum", "avg") and isinstance(df.schema[column].dataType, T.StringType):
            raise EngineError(f"{name} needs a number; {column} is a string")
        made.append(f(column).alias(alias))
    if not made:
        if not group_by:
            raise EngineError("Nothing to aggregate")
        return df.select(*group_by).distinct()
    return df.groupBy(*group_by).agg(*made)


def delete(df: DataFrame, condition: str) -> DataFrame:
    """The rows for which ``condition`` is not true; where it is null the row stays."""
    return df.where(f"not coalesce({condition}, false)")


def update(df: DataFrame, column: str, value: str, condition: str) -> DataFrame:
    """The rows with ``column`` set to an expression, in its own type, where ``condition`` is true."""
    if column not in df.columns:
        raise EngineError(f"Column {column} is not present")
    kind = df.schema[column].dataType.simpleString()
    new = f"case when {condition} then cast({value} as {kind}) else `{column}` end as `{column}`"
    return df.selectExpr(*[new if c == column else f"`{c}`" for c in df.columns])
