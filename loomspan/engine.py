"""The engine: databases, tables, SQL, indexes, saved queries and backslash commands over one session.

Databases are catalog databases and tables are Parquet tables of the warehouse, so every executor
reads them in parallel. Each stored row has the load version that wrote it, which queries don't see: it
tells what is new since a watermark. The rest of the state is a file in the warehouse, and a new
engine over the same warehouse goes on where the last one ended.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.errors import EngineError
from loomspan.operators import relational as rel
from loomspan.operators.mdindex import MDIndex
from loomspan.plans.saved import Registry
from loomspan.plans.sql import run_select
from loomspan.plans.state import StateFile, warehouse
from loomspan.schema import parse_create_table, split_top
from loomspan.sources import csv_io, generator
from loomspan.streaming.incremental import new_since

_NAME = re.compile(r"^[A-Za-z_]\w*$")
#: The column of stored tables with the load version of a row.
VERSION = "_version"


class Engine:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.indexes: dict[tuple[str, str], tuple[str, str, list[str]]] = {}
        self.views: dict[tuple[str, str], dict] = {}
        self.saved = Registry()
        self.version = 0
        self.quiet = False
        self.made: list[str] = []
        self.file = StateFile(spark)
        self._restore()

    # state

    def _keep(self) -> None:
        """Writes the state; called after every change of it."""
        tables = {}
        for base in self.made:
            for t in self.spark.catalog.listTables(base):
                if not t.isTemporary:
                    tables[f"{base}.{t.name}"] = self.spark.table(f"`{base}`.`{t.name}`").schema.json()
        self.file.write(
            {
                "version": self.version,
                "made": self.made,
                "tables": tables,
                "indexes": [[*k, *v] for k, v in self.indexes.items()],
                "views": [[*k, v] for k, v in self.views.items()],
                "saved": self.saved.dump(),
            }
        )

    def _restore(self) -> None:
        """Takes up the state of the warehouse; tables that the catalog has forgotten are declared again over their files."""
        kept = self.file.read()
        self.version = kept.get("version", 0)
        self.made = list(kept.get("made", []))
        self.indexes = {(d, i): (kind, t, cols) for d, i, kind, t, cols in kept.get("indexes", [])}
        self.views = {(d, n): v for d, n, v in kept.get("views", [])}
        self.saved.load(kept.get("saved", []))
        for base in self.made:
            if not self.spark.catalog.databaseExists(base):
                self.spark.sql(f"CREATE DATABASE `{base}`")
        for full, schema in kept.get("tables", {}).items():
            base, name = full.split(".")
            path = f"{warehouse(self.spark)}/{base}.db/{name}".lower()
            path = path if self.file.holds(path) else f"{warehouse(self.spark)}/{base}.db/{name}"
            if not self.spark.catalog.tableExists(f"`{base}`.`{name}`") and self.file.holds(path):
                kind = T.StructType.fromJson(json.loads(schema))
                self.spark.catalog.createTable(f"`{base}`.`{name}`", path, "parquet", kind)

    # databases and tables

    def create_database(self, name: str) -> None:
        if not _NAME.match(name):
            raise EngineError(f"Invalid database name {name}")
        if self.spark.catalog.databaseExists(name):
            raise EngineError(f"Database {name} already exists")
        self.spark.sql(f"CREATE DATABASE `{name}`")
        self.made.append(name)
        self._keep()

    def connect(self, name: str) -> None:
        if not self.spark.catalog.databaseExists(name):
            raise EngineError(f"Database {name} does not exist")
        self.spark.catalog.setCurrentDatabase(name)

    def close(self) -> None:
        """Ends the use of a database; the default one is current again."""
        self.spark.catalog.setCurrentDatabase("default")

    def databases(self) -> list[str]:
        return sorted(d.name for d in self.spark.catalog.listDatabases())

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables() if not t.isTemporary)

    def _stored(self, name: str) -> DataFrame:
        if not _NAME.match(name) or not self.spark.catalog.tableExists(name):
            old = f"{name}__old"
            if not _NAME.match(name) or not self.spark.catalog.tableExists(old):
                raise EngineError(f"Missing table {name}")
            self.spark.sql(f"ALTER TABLE `{old}` RENAME TO `{name}`")  # a rewrite ended between its two renames
        return self.spark.table(name)

    def table(self, name: str) -> DataFrame:
        return self._stored(name).drop(VERSION)

    def new_rows(self, name: str, low: int, high: int) -> DataFrame:
        """Rows written by load versions after ``low``, up to and including ``high``."""
        return new_since(self._stored(name), low, high, VERSION).drop(VERSION)

    def create_table(self, sql: str) -> None:
        made = parse_create_table(sql)
        if VERSION in made.schema.names:
            raise EngineError(f"Column name {VERSION} is reserved")
        if self.spark.catalog.tableExists(made.name):
            raise EngineError(f"Table {made.name} already exists")
        schema = T.StructType([*made.schema.fields, T.StructField(VERSION, T.IntegerType())])
        self.spark.createDataFrame([], schema).write.format("parquet").saveAsTable(made.name)
        self._keep()

    def drop_table(self, name: str) -> None:
        self._stored(name)
        self.spark.sql(f"DROP TABLE `{name}`")
        self._keep()

    def _append(self, name: str, rows: DataFrame) -> int:
        rows.withColumn(VERSION, F.lit(self.version + 1)).write.mode("append").format("parquet").saveAsTable(name)
        self.spark.catalog.refreshTable(name)
        self.version += 1
        self._keep()
        return self.version

    def import_csv(self, path: str, name: str, skip_malformed: bool = False) -> int:
        """Appends the rows of a CSV file, all or none; returns the new load version."""
        return self._append(name, csv_io.read_csv(self.spark, path, self.table(name).schema, skip_malformed))

    def insert(self, name: str, rows: list[tuple]) -> int:
        return self._append(name, self.spark.createDataFrame(rows, self.table(name).schema))

    def delete(self, name: str, condition: str) -> None:
        """Rewrites the table without the rows for which ``condition`` is true."""
        self._rewrite(name, rel.delete(self._stored(name), condition))

    def update(self, name: str, column: str, value: str, condition: str) -> None:
        """Rewrites the table with ``column`` set to an expression where ``condition`` is true; such rows are new."""
        df = rel.update(self._stored(name).withColumn("_hit", F.expr(f"coalesce({condition}, false)")), column, value, "_hit")
        self._rewrite(name, rel.update(df, VERSION, str(self.version + 1), "_hit").drop("_hit"))

    def _rewrite(self, name: str, df: DataFrame) -> None:
        """Writes the new rows aside and swaps the tables by name: readers find the old or the new one whole."""
        schema, aside, old = self._stored(name).schema, f"{name}__new", f"{name}__old"
        self.spark.sql(f"DROP TABLE IF EXISTS `{aside}`")
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema]).write.format("parquet").saveAsTable(aside)
        self.spark.sql(f"ALTER TABLE `{name}` RENAME TO `{old}`")
        self.spark.sql(f"ALTER TABLE `{aside}` RENAME TO `{name}`")
        self.spark.sql(f"DROP TABLE `{old}`")
        self.version += 1
        self._keep()

    # materialized views

    def materialize(self, name: str, sql: str) -> None:
        """Stores the result of a SELECT as a table that ``refresh`` brings up to date."""
        if not _NAME.match(name) or self.spark.catalog.tableExists(name):
            raise EngineError(f"Cannot make a view {name}")
        used: list[str] = []
        df = run_select(sql, lambda t: (used.append(t), self.table(t))[1])
        df.withColumn(VERSION, F.lit(self.version)).write.format("parquet").saveAsTable(name)
        self.views[self.spark.catalog.currentDatabase(), name] = {"sql": sql, "tables": used, "watermark": self.version}
        self._keep()

    def outdated(self) -> list[str]:
        """Views of the current database with a table that was written after their watermark."""
        here = self.spark.catalog.currentDatabase()
        return [n for (base, n), v in self.views.items() if base == here and any(self.last_update(t) > v["watermark"] for t in v["tables"])]

    def last_update(self, name: str) -> int:
        """The latest load version among the rows of a table, 0 without any."""
        return self._stored(name).agg(F.max(VERSION)).first()[0] or 0

    def refresh(self, name: str) -> bool:
        """Recomputes a view if it is out of date; whether it was."""
        view = self.views.get((self.spark.catalog.currentDatabase(), name))
        if view is None:
            raise EngineError(f"{name} is not a view")
        stale = name in self.outdated()
        if stale:
            self._rewrite(name, run_select(view["sql"], self.table).withColumn(VERSION, F.lit(self.version)))
        view["watermark"] = self.version
        self._keep()
        return stale

    # queries

    def sql(self, text: str) -> DataFrame | None:
        """Runs one statement: CREATE TABLE or a SELECT of the strict language."""
        if re.match(r"\s*create\s+table\b", text, re.I):
            self.create_table(text)
            return None
        return run_select(text, self.table)

    # indexes

    def create_index(self, kind: str, index: str, table: str, columns: list[str]) -> None:
        key = (self.spark.catalog.currentDatabase(), index)
        if key in self.indexes:
            raise EngineError(f"Index {index} already exists")
        MDIndex(self.table(table), columns, kind)
        self.indexes[key] = (kind, table, columns)
        self._keep()

    def index(self, kind: str, index: str, table: str) -> MDIndex:
        found = self.indexes.get((self.spark.catalog.currentDatabase(), index))
        if found is None or found[:2] != (kind, table):
            raise EngineError(f"No {kind} index {index} on {table}")
        return MDIndex(self.table(table), found[2], kind)

    # commands

    def run(self, line: str) -> str:
        """Runs a command or a statement and returns its text."""
        line = line.strip()
        if not line.startswith("\\"):
            df = self.sql(line)
            if df is None:
                return "Table created"
            if self.quiet:
                df.write.format("noop").mode("overwrite").save()
                return ""
            return csv_io.render(df)
        name, *args = line[1:].split()
        handler = _COMMANDS.get(name)
        if handler is None:
            raise EngineError(f"Invalid command \\{name}")
        least, most, f = handler
        if not least <= len(args) <= most:
            raise EngineError(f"Wrong number of arguments for \\{name}")
        out = f(self, args, line)
        return "OK" if out is None else out

    def script(self, text: str) -> list[str]:
        """Runs ``;``-separated commands and statements in order."""
        return [self.run(part) for part in _statements(text)]

    def reset(self) -> None:
        """Drops every database of this engine and of those before it on the warehouse, and forgets all else."""
        self.saved.reset()
        self.indexes.clear()
        self.views.clear()
        self.close()
        for name in self.made:
            self.spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
            self.file.remove_folder(f"{warehouse(self.spark)}/{name}.db")
        self.made.clear()
        self.version = 0
        self.file.remove()

    def run_saved(self, name: str, upto: int | None = None) -> DataFrame:
        """Runs a registered query in full and moves its watermark."""
        return self._run_saved(name, self.table, self.version if upto is None else upto)

    def run_partial(self, name: str, low: int | None = None, high: int | None = None) -> DataFrame:
        """Runs a registered query over the rows of load versions after ``low`` (its watermark) up to ``high`` (all)."""
        query = self.saved.queries.get(name)
        if query is None:
            raise EngineError(f"Query {name} is not registered")
        low, high = query.watermark if low is None else low, self.version if high is None else high
        return self._run_saved(name, lambda t: self.new_rows(t, low, high), high)

    def _run_saved(self, name: str, lookup: Callable[[str], DataFrame], version: int) -> DataFrame:
        query, done = self.saved.begin(name), None
        try:
            df = run_select(query.sql, lookup)
            df.write.format("noop").mode("overwrite").save()
            done = version
        finally:
            self.saved.finish(name, done)
        self._keep()
        return df


def _statements(text: str) -> list[str]:
    parts, quoted, last = [], False, 0
    for i, c in enumerate(text):
        quoted ^= c == "'"
        if c == ";" and not quoted:
            parts.append(text[last:i])
            last = i + 1
    return [p.strip() for p in [*parts, text[last:]] if p.strip()]


def _point(engine: Engine, table: str, columns: list[str], text: str) -> list:
    if not re.fullmatch(r"\([^()]*\)", text):
        raise EngineError(f"Expected a point like (1,2), got {text}")
    values = split_top(text[1:-1])
    kinds = {f.name: f.dataType.typeName() for f in engine.table(table).schema}
    try:
        return [v if kinds[c] == "string" else float(v) if kinds[c] in ("double", "float") else int(v) for c, v in zip(columns, values, strict=True)]
    except ValueError as error:
        raise EngineError(f"Cannot read the point {text}") from error


def _create_index(engine: Engine, args: list[str], line: str) -> str:
    kind, index, table, columns = args
    if not re.fullmatch(r"\([^()]+\)", columns):
        raise EngineError("Columns are given as (a,b)")
    engine.create_index(kind, index, table, split_top(columns[1:-1]))
    return f"Index {index} created"


def _use_index(engine: Engine, args: list[str], line: str) -> str:
    kind, how, index, table, given, *rest = args
    used = engine.index(kind, index, table)
    point = lambda text: _point(engine, table, used.columns, text)
    if how == "EQ":
        return csv_io.render(used.eq(point(given)))
    if how == "RANGE":
        low, sep, high = given.partition(";")
        if not sep:
            raise EngineError("A range is given as (mins);(maxs)")
        return csv_io.render(used.range(point(low), point(high)))
    if how == "KNN":
        if not rest or not re.fullmatch(r"-?\d+", rest[0]):
            raise EngineError("KNN needs a number of neighbours")
        return csv_io.render(used.knn(point(given), int(rest[0])))
    raise EngineError(f"Unknown index query {how}")


def _convert(engine: Engine, args: list[str], line: str) -> str:
    path, _, sql = line.partition(" ")[2].partition("|")
    if not sql.strip():
        raise EngineError("Expected \\convert file | sql")
    run_select(sql, engine.table)
    Registry.write(path.strip(), sql.strip())
    return f"Query written to {path.strip()}"


def _register(engine: Engine, args: list[str], line: str) -> str:
    run_select(Registry.read(args[0]), engine.table)
    engine.saved.register(args[1], args[0])
    engine._keep()
    return f"Query {args[1]} registered"


def _generate(engine: Engine, args: list[str], line: str) -> str:
    if not args[1].isdigit():
        raise EngineError("Expected a number of rows")
    if "://" not in args[0] and Path(args[0]).exists():
        raise EngineError(f"{args[0]} already exists")
    csv_io.write_csv(generator.generate(engine.spark, int(args[1])), args[0])
    return f"{args[1]} rows written"


def _quiet(engine: Engine, args: list[str], line: str) -> None:
    engine.quiet = not engine.quiet


def _run_full(engine: Engine, args: list[str], line: str) -> str:
    engine.run_saved(args[0], int(args[2]) if len(args) > 2 and args[2].isdigit() else None)
    return f"Query {args[0]} ran"


def _run_partial(engine: Engine, args: list[str], line: str) -> str:
    bounds = [int(a) if a.isdigit() else None for a in args[2:]] + [None, None]
    df = engine.run_partial(args[0], bounds[0], bounds[1])
    return "" if engine.quiet else csv_io.render(df)


#: Command to least and most arguments and handler.
_COMMANDS = {
    "r": (1, 1, lambda e, a, _: e.create_database(a[0])),
    "c": (1, 1, lambda e, a, _: e.connect(a[0])),
    "i": (2, 2, lambda e, a, _: f"Imported, version {e.import_csv(a[0], a[1])}"),
    "l": (0, 0, lambda e, a, _: ",".join(e.databases())),
    "dt": (0, 0, lambda e, a, _: "\n".join(e.tables()) or "No tables"),
    "dq": (0, 0, lambda e, a, _: e.saved.listing()),
    "register": (2, 2, _register),
    "runFull": (1, 3, _run_full),
    "runPartial": (1, 4, _run_partial),
    "t": (0, 0, lambda e, a, _: "Test"),
    "close": (0, 0, lambda e, a, _: e.close()),
    "convert": (2, 1000, _convert),
    "createIndex": (4, 4, _create_index),
    "useIndex": (5, 6, _use_index),
    "generate": (2, 2, _generate),
    "reset": (0, 0, lambda e, a, _: e.reset()),
    "quiet": (0, 0, _quiet),
    "shutdown": (0, 0, lambda e, a, _: e.spark.stop()),
}
