"""Z-order keys: the bits of several integer columns interleaved, as a column expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def z_key(columns: list[str], bits: int = 16) -> Column:
    """Interleaves the top ``bits`` of the columns, shifted to be unsigned 32-bit; nulls count as least.

    At most 63 bits in all. Values beyond 32 bits are clipped for the layout only.
    """
    bits = min(bits, 63 // len(columns))
    parts = []
    for place, name in enumerate(columns):
        low = F.lit(-(1 << 31)).cast("bigint")
        clipped = F.greatest(F.least(F.coalesce(F.col(name).cast("bigint"), low), F.lit((1 << 31) - 1).cast("bigint")), low)
        top = F.shiftright(clipped + F.lit(1 << 31).cast("bigint"), 32 - bits)
        for b in range(bits):
            bit = F.shiftright(top, b).bitwiseAND(F.lit(1).cast("bigint"))
            parts.append(F.shiftleft(bit, b * len(columns) + place))
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def z_layout(df: DataFrame, columns: list[str], partitions: int) -> DataFrame:
    """Rows clustered by Z-order, so that Parquet min/max statistics prune boxes in every dimension."""
    key = "_z"
    return df.withColumn(key, z_key(columns)).repartitionByRange(partitions, key).sortWithinPartitions(key).drop(key)
