"""CSV import, export and rendering: no header, commas, fields typed by the declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.errors import EngineError


def read_csv(spark: SparkSession, path: str, schema: T.StructType, skip_malformed: bool = False) -> DataFrame:
    """Rows of a file or folder. Empty strings stay empty strings; fields beyond the schema are dropped.

    A record with too few fields or a number that can't be read fails the whole
    read, or is skipped; nothing is half imported. Lines without any character are no records.
    """
    width = len(schema)
    if width == 0:
        raise EngineError("A table needs columns")
    text = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    whole = T.StructType([*text.fields, T.StructField("_record", T.StringType())])
    options = {"header": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_record", "columnPruning": "false"}
    raw = spark.read.options(**options).schema(whole).csv(path)
    # Spark keeps the text of a record whose number of fields differs; a mark behind it then tells whether it has too few.
    given = F.from_csv(F.concat("_record", F.lit(f",{_END}")), ", ".join(f"_c{i} string" for i in range(width)), {"mode": "PERMISSIVE"})
    short = F.col("_record").isNotNull() & F.array_contains(F.array(*[F.coalesce(given[f"_c{i}"], F.lit("")) for i in range(width)]), _END)
    bad, cols = short, []
    for i, f in enumerate(schema):
        c = F.col(f"_c{i}")
        if isinstance(f.dataType, T.StringType):
            cols.append(F.coalesce(c, F.lit("")).alias(f.name, metadata=f.metadata))
        else:
            value = c.try_cast(f.dataType)
            bad = bad | value.isNull()
            cols.append(value.alias(f.name, metadata=f.metadata))
    if skip_malformed:
        return raw.where(~bad).select(*cols)
    near = F.coalesce("_record", F.col("_c0"), F.lit("(empty)"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("Malformed record near "), near)).cast("boolean")).otherwise(F.lit(True))
    return raw.where(checked).select(*cols)


#: Stands behind the last field of a record; no field of a text file holds it.
_END = "\x02"


def write_csv(df: DataFrame, path: str, header: bool = False) -> None:
    """Distributed export; fails if the folder exists."""
    df.write.mode("errorifexists").option("header", str(header).lower()).csv(path)


def render(df: DataFrame, header: bool = False) -> str:
    """A result as text: comma-joined fields, a line per row, no quoting and no newline at the end.

    Rows come to the driver one partition at a time; only the text is held.
    """
    lines = [",".join("" if v is None else str(v) for v in row) for row in df.toLocalIterator()]
    return "\n".join([",".join(df.columns), *lines] if header else lines)


def from_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """In-memory rows as a table."""
    return spark.createDataFrame(rows, schema)
