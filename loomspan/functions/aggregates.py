"""Aggregates with the engine's own semantics, as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_avg(col: Column | str) -> Column:
    """Average that truncates toward zero, as BIGINT; null over no rows.

    ``div`` of two aggregates: partial sums and counts are combined map-side.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.call_function("div", F.sum(c).cast("bigint"), F.count(c))


AGGREGATES = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": int_avg}
