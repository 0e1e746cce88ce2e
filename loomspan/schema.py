"""Table definitions: a checked CREATE TABLE and the mapping of its types.

Types are INT and VARCHAR(n), the length being advisory. A primary key is
required, declared once, inline or at the end; it is metadata and not enforced, so imports
keep rows that repeat it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from loomspan.errors import EngineError

_CREATE = re.compile(r"^\s*create\s+table\s+(\S+?)\s*\((.*)\)\s*;?\s*$", re.I | re.S)
_NAME = re.compile(r"^[A-Za-z_]\w*$")


@dataclass(frozen=True)
class TableDef:
    name: str
    schema: T.StructType

    @property
    def primary_key(self) -> list[str]:
        return [f.name for f in self.schema if f.metadata.get("constraint") == "PrimaryKey"]


def spark_type(text: str) -> T.DataType:
    word = text.strip().lower()
    if word in ("int", "integer"):
        return T.IntegerType()
    if re.fullmatch(r"varchar(\s*\(\s*\d+\s*\))?", word):
        return T.StringType()
    raise EngineError(f"Unsupported data type {text.strip()}")


def split_top(text: str, mark: str = ",") -> list[str]:
    """Splits at ``mark`` outside parentheses."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == mark and depth == 0:
            parts.append(text[last:i])
            last = i + 1
    return [p.strip() for p in [*parts, text[last:]]]


def parse_create_table(sql: str) -> TableDef:
    """Parses a CREATE TABLE statement; refuses it unless exactly one primary key is declared."""
    m = _CREATE.match(sql)
    if not m:
        raise EngineError("Expected CREATE TABLE name (column type, ...)")
    name = m[1]
    if not _NAME.match(name):
        raise EngineError(f"Invalid table name {name}")
    columns: list[tuple[str, T.DataType]] = []
    inline: list[str] = []
    ends: list[list[str]] = []
    for part in split_top(m[2]):
        if key := re.match(r"^primary\s+key\s*\((.*)\)$", part, re.I | re.S):
            ends.append([c.strip() for c in key[1].split(",")])
            continue
        col = re.match(r"^(\S+)\s+(.+?)(\s+primary\s+key)?$", part, re.I | re.S)
        if not col or not _NAME.match(col[1]):
            raise EngineError(f"Cannot read column definition {part!r}")
        columns.append((col[1], spark_type(col[2])))
        if col[3]:
            inline.append(col[1])
    if len(inline) + len(ends) != 1:
        raise EngineError("A table needs exactly one primary key")
    key = inline or ends[0]
    names = [c for c, _ in columns]
    if len(set(names)) != len(names):
        raise EngineError("A column is declared twice")
    if missing := [k for k in key if k not in names]:
        raise EngineError(f"Primary key column {missing[0]} is not a column")
    fields = [T.StructField(c, t, True, {"constraint": "PrimaryKey" if c in key else "None"}) for c, t in columns]
    return TableDef(name, T.StructType(fields))
