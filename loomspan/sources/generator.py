"""Generated tables, distributed and repeatable by their seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CARDINALITY = (10, 100, 1000, 10_000)


def _word(n: Column, least: int, most: int) -> Column:
    """An alphanumeric string of a number, equal for equal numbers."""
    full = F.sha2(n.cast("string"), 256)
    return F.substring(full, F.lit(1), F.lit(least) + F.pmod(F.xxhash64(n), F.lit(most - least + 1)).cast("int"))


def generate(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """id, ints ia1..ia4 and strings sa1..sa4 of cardinality 10, 100, 1000 and 10000."""
    pick = lambda salt, size: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(size)).cast("int")
    ints = [pick(i, size).alias(f"ia{i + 1}") for i, size in enumerate(CARDINALITY)]
    strings = [_word(pick(10 + i, size) + F.lit(i * 100_000), 10, 29 if i == 3 else 19).alias(f"sa{i + 1}") for i, size in enumerate(CARDINALITY)]
    return spark.range(n).select(F.col("id").cast("int").alias("id"), *ints, *strings)


def random_ints(spark: SparkSession, columns: int, n: int, seed: int = 42) -> DataFrame:
    """Columns f0.. of uniform non-negative ints."""
    top = (1 << 31) - 1
    return spark.range(n).select(*[F.pmod(F.xxhash64("id", F.lit(seed), F.lit(c)), F.lit(top)).cast("int").alias(f"f{c}") for c in range(columns)])
