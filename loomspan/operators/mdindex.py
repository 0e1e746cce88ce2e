"""Multi-dimensional point queries: exact match, closed box and k nearest neighbours.

An index is a view over a table and its columns, never a snapshot: queries are
predicates that see current rows and reach the Parquet scan. ``write_layout`` stores the rows in
Z-order, after which min/max statistics skip the row groups that a box misses. Whole rows are
returned, and results compose with other operators.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.errors import EngineError
from loomspan.functions.zorder import z_layout

KINDS = ("KD", "R")
#: Query points that every task of one scan may hold.
POINTS = 10_000


def _nearest(points: np.ndarray, width: int, k: int):
    """Per task and point the k nearest rows, whose first ``width`` columns are the indexed ones and whose order breaks ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store: pa.Table | None = None
        d2s = [np.empty(0, points.dtype) for _ in points]
        refs = [np.empty(0, np.int64) for _ in points]
        reach = np.full(len(points), np.inf)
        for batch in batches:
            if not batch.num_rows or not len(points):
                continue
            first = 0 if store is None else store.num_rows
            table = pa.Table.from_batches([batch])
            store = table if store is None else pa.concat_tables([store, table])
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(points.dtype) for c in batch.columns[:width]], axis=1)
            order = np.argsort(rows[:, 0], kind="stable")
            rows = rows[order]
            low = np.searchsorted(rows[:, 0], points[:, 0] - reach, "left")
            high = np.searchsorted(rows[:, 0], points[:, 0] + reach, "right")
            for p in np.flatnonzero(high > low):
                gap = rows[low[p] : high[p]] - points[p]
                d2 = (gap * gap).sum(axis=1)
                near = np.flatnonzero(d2 <= reach[p] * reach[p]) if np.isfinite(reach[p]) else np.arange(len(d2))
                d2s[p] = np.concatenate([d2s[p], d2[near]])
                refs[p] = np.concatenate([refs[p], order[low[p] + near] + first])
                if len(d2s[p]) > k:
                    keep = _least(d2s[p], refs[p], store, k)
                    d2s[p], refs[p] = d2s[p][keep], refs[p][keep]
                if len(d2s[p]) == k:  # a little more, as a root may be rounded down
                    reach[p] = np.sqrt(float(d2s[p].max())) * (1 + 1e-12)
            used = np.unique(np.concatenate(refs))
            store = store.take(pa.array(used))
            refs = [np.searchsorted(used, r) for r in refs]
        if store is None:
            return
        for at in range(0, len(points), 1000):
            some = refs[at : at + 1000]
            number = pa.array(np.repeat(np.arange(at, at + len(some)), [len(r) for r in some]))
            for out in store.take(pa.array(np.concatenate(some))).combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([number, *out.columns], names=["_n", *out.schema.names])

    return run


def _least(d2: np.ndarray, refs: np.ndarray, store: pa.Table, k: int) -> np.ndarray:
    """Which k of the rows come first, by distance and then by the columns of ``store``, nulls first."""
    kth = np.partition(d2, k - 1)[k - 1]
    sure, tied = np.flatnonzero(d2 < kth), np.flatnonzero(d2 == kth)
    need = k - len(sure)
    if len(tied) > need:
        names = [(str(i), "ascending") for i in range(store.num_columns)]
        rows = store.take(pa.array(refs[tied])).rename_columns([n for n, _ in names])
        tied = tied[pc.sort_indices(rows, sort_keys=names, null_placement="at_start").to_numpy()[:need]]
    return np.concatenate([sure, tied])


class MDIndex:
    """Point queries over ``columns`` of ``df``; kind R takes two or three integer columns."""

    def __init__(self, df: DataFrame, columns: Sequence[str], kind: str = "KD") -> None:
        if kind not in KINDS:
            raise EngineError(f"Unknown index kind {kind}")
        if not columns or len(set(columns)) != len(columns):
            raise EngineError("An index needs columns, each once")
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise EngineError(f"Column {missing[0]} is not present")
        if kind == "R":
            if len(columns) not in (2, 3):
                raise EngineError("An R index has two or three columns")
            if not all(isinstance(df.schema[c].dataType, T.IntegralType) for c in columns):
                raise EngineError("An R index needs integer columns")
        self.df, self.columns, self.kind = df, list(columns), kind

    def _checked(self, point: Sequence) -> Sequence:
        if len(point) != len(self.columns):
            raise EngineError(f"Expected {len(self.columns)} values, got {len(point)}")
        for c, v in zip(self.columns, point):
            if isinstance(self.df.schema[c].dataType, T.StringType) != isinstance(v, str):
                raise EngineError(f"Cannot compare {c} with {v!r}")
        return point

    def eq(self, point: Sequence) -> DataFrame:
        """All rows at the point, duplicates included."""
        tests = [F.col(c) == F.lit(v) for c, v in zip(self.columns, self._checked(point))]
        return self.df.where(reduce(lambda a, b: a & b, tests))

    def exists(self, point: Sequence) -> bool:
        return not self.eq(point).limit(1).isEmpty()

    def range(self, low: Sequence, high: Sequence) -> DataFrame:
        """Rows in the box, both bounds included."""
        bounds = zip(self.columns, self._checked(low), self._checked(high))
        return self.df.where(reduce(lambda a, b: a & b, [F.col(c).between(F.lit(x), F.lit(y)) for c, x, y in bounds]))

    def without(self, point: Sequence) -> DataFrame:
        """All rows but those at the point."""
        tests = [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(self.columns, self._checked(point))]
        return self.df.where(~reduce(lambda a, b: a & b, tests))

    def with_rows(self, rows: DataFrame) -> MDIndex:
        """The index over these rows too."""
        return MDIndex(self.df.unionByName(rows), self.columns, self.kind)

    def _distance(self, values: Sequence[Column]) -> Column:
        parts = []
        for c, v in zip(self.columns, values):
            kind = self.df.schema[c].dataType
            if isinstance(kind, T.StringType):
                raise EngineError(f"{c} is a string and has no distance")
            gap = (F.col(c) - v) if isinstance(kind, (T.DoubleType, T.FloatType)) else (F.col(c).cast("bigint") - v.cast("bigint"))
            parts.append(gap * gap)
        return reduce(lambda a, b: a + b, parts)

    def _order(self) -> list[str]:
        return [*self.columns, *[c for c in self.df.columns if c not in self.columns]]

    def _present(self) -> DataFrame:
        return self.df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in self.columns]))

    def knn(self, point: Sequence, k: int) -> DataFrame:
        """The k rows of least squared distance; ties by the indexed, then the other columns.

        Each task keeps its own k rows and only those meet. Rows with a null in
        an indexed column take no part; k beyond the table gives all rows.
        """
        if k <= 0:
            raise EngineError("k must be positive")
        d2 = self._distance([F.lit(v) for v in self._checked(point)])
        return self._present().orderBy(d2, *self._order()).limit(k)

    def knn_join(self, points: DataFrame, k: int, point_id: str = "point_id", bound: int = POINTS) -> DataFrame:
        """For every row of ``points`` (an id and the indexed columns) its k nearest rows, with ``rank`` and ``d2``.

        Up to ``bound`` points go to every task of one scan: it sorts each batch by the first column and
        looks only at rows nearer there than the k-th found so far, so a task keeps k rows per point and,
        over a table in Z-order, skips most of them. More points are cut into parts of one scan each.
        Points with a null are left out; of rows at equal distance the first by the indexed, then the other columns count.
        """
        if k <= 0:
            raise EngineError("k must be positive")
        self._distance([F.lit(0)] * len(self.columns))  # refuses strings
        named = points.select(F.col(point_id).alias("_pid"), *[F.col(c).alias(f"_q_{c}") for c in self.columns])
        named = named.where(reduce(lambda a, b: a & b, [F.col(f"_q_{c}").isNotNull() for c in self.columns]))
        held = named.limit(bound + 1).collect()
        if len(held) > bound:
            n = 2 * -(-points.count() // bound)
            parts = [points.where(F.pmod(F.xxhash64(point_id), F.lit(n)) == b) for b in range(n)]
            return reduce(DataFrame.unionByName, [self.knn_join(part, k, point_id, 2 * bound) for part in parts])
        rows = self._present().select(*self._order())
        schema = T.StructType([T.StructField("_n", T.LongType()), *rows.schema.fields])
        whole = all(isinstance(rows.schema[c].dataType, T.IntegralType) for c in self.columns)
        at = np.array([p[1:] for p in held], np.int64 if whole else np.float64).reshape(len(held), len(self.columns))
        kept = rows.mapInArrow(_nearest(at, len(self.columns), k), schema)
        numbered = T.StructType([schema["_n"], *named.schema.fields])
        listed = self.df.sparkSession.createDataFrame([(n, *p) for n, p in enumerate(held)], numbered)
        near = kept.join(F.broadcast(listed), "_n").withColumn("d2", self._distance([F.col(f"_q_{c}") for c in self.columns]))
        order = Window.partitionBy("_n").orderBy("d2", *self._order())
        ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select(F.col("_pid").alias(point_id), "rank", "d2", *self.df.columns)

    def write_layout(self, path: str, partitions: int) -> MDIndex:
        """Writes the rows in Z-order to Parquet and returns the index over that table."""
        z_layout(self.df, self.columns, partitions).write.mode("errorifexists").parquet(path)
        spark = self.df.sparkSession
        return MDIndex(spark.read.parquet(path), self.columns, self.kind)
