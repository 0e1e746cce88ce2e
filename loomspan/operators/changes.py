"""Versioned tables as a change log (key, ts, op, value): 'U' upserts, 'D' deletes.

An extension: state as of a time, the changes of a time range, compaction and
merging, all by one pre-aggregated pass over the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.errors import EngineError


def _latest(log: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The last change of each key; of equal times the larger row wins. max_by combines map-side, so hot keys stay small."""
    rest = [c for c in log.columns if c not in keys]
    order = F.struct(ts, *[c for c in rest if c != ts])
    return log.groupBy(*keys).agg(F.max(order).alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def as_of(log: DataFrame, keys: list[str], at: object, ts: str = "ts", op: str = "op") -> DataFrame:
    """Live rows after all changes up to and including ``at``."""
    return _latest(log.where(F.col(ts) <= F.lit(at)), keys, ts).where(F.col(op) != "D").drop(op)


def diffs(log: DataFrame, low: object, high: object, ts: str = "ts") -> DataFrame:
    """Changes with low <= ts < high."""
    return log.where((F.col(ts) >= F.lit(low)) & (F.col(ts) < F.lit(high)))


def compact(log: DataFrame, keys: list[str], at: object, ts: str = "ts") -> DataFrame:
    """The log with what is older than ``at`` reduced to the last change of each key."""
    old, new = log.where(F.col(ts) <= F.lit(at)), log.where(F.col(ts) > F.lit(at))
    return _latest(old, keys, ts).unionByName(new)


def merge(log: DataFrame, keys: list[str], value: str, how: str | Column = "take_last", ts: str = "ts") -> DataFrame:
    """One value per key: ``none`` keeps all, ``take_last`` the latest, a column expression merges them."""
    if isinstance(how, Column):
        return log.groupBy(*keys).agg(how.alias(value))
    if how == "none":
        return log.select(*keys, value)
    if how == "take_last":
        return log.groupBy(*keys).agg(F.max_by(value, F.struct(ts, value)).alias(value))
    raise EngineError(f"Unknown merge {how}")


def last_update(log: DataFrame, ts: str = "ts") -> object:
    """The latest time in the log, or None."""
    return log.agg(F.max(ts)).first()[0]


def add_delta(log: DataFrame, rows: DataFrame, at: object, op: str = "U", ts: str = "ts") -> DataFrame:
    """The log with ``rows`` (keys and values) as changes of the time ``at``; of deletes the values may be missing."""
    if op not in ("U", "D"):
        raise EngineError(f"Unknown change {op}")
    made = rows.withColumns({ts: F.lit(at).cast(log.schema[ts].dataType), "op": F.lit(op)})
    return log.unionByName(made, allowMissingColumns=op == "D").select(log.columns)


def keys_upto(log: DataFrame, keys: list[str], at: object, ts: str = "ts") -> DataFrame:
    """Keys changed up to and including ``at``."""
    return log.where(F.col(ts) <= F.lit(at)).select(*keys).distinct()


def keys_between(log: DataFrame, keys: list[str], low: object, high: object, ts: str = "ts") -> DataFrame:
    """Keys changed at low <= ts < high."""
    return diffs(log, low, high, ts).select(*keys).distinct()


def read_key(log: DataFrame, key: dict[str, object], at: object, ts: str = "ts") -> DataFrame:
    """The last change of one key up to and including ``at``: one row, or none."""
    found = log.where(F.col(ts) <= F.lit(at))
    for column, value in key.items():
        found = found.where(F.col(column) == F.lit(value))
    return _latest(found, list(key), ts)


def outdated(containers: dict[str, DataFrame], watermark: object, ts: str = "ts") -> list[str]:
    """Names of the logs that have rows and were last changed before ``watermark``; one number each comes to the driver."""
    return [name for name, log in containers.items() if (last := last_update(log, ts)) is not None and last < watermark]
