"""The strict SQL facade: a small SELECT language with explicit errors for everything else.

``SELECT cols | * | aggregates FROM t [AS a] [JOIN u [AS b] ON x op y]...
[WHERE boolean tree of comparisons] [GROUP BY cols]``. Names are resolved
against the tables in scope, each literal against its column, and a DataFrame is built; Catalyst
does the rest. Constructs outside this language are refused, never dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.errors import EngineError
from loomspan.functions.aggregates import AGGREGATES
from loomspan.operators.relational import compare

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+)|'(?P<str>(?:[^']|'')*)'|(?P<name>[A-Za-z_]\w*)|(?P<op><>|!=|<=|>=|[=<>(),.*;+/-]))")
_REFUSED = {
    "distinct": "Distinct not supported", "union": "Set operations not supported", "intersect": "Set operations not supported",
    "except": "Set operations not supported", "having": "Having not supported", "order": "Order by not supported",
    "limit": "Limit not supported", "offset": "Offset not supported", "fetch": "Fetch not supported", "with": "Common table expressions not supported",
    "over": "Window functions not supported", "left": "Unsupported join type", "right": "Unsupported join type", "full": "Unsupported join type",
    "cross": "Unsupported join type", "natural": "Unsupported join type", "using": "Unsupported join type",
    "in": "Unsupported expression IN", "between": "Unsupported expression BETWEEN", "like": "Unsupported expression LIKE",
    "is": "Unsupported expression IS", "not": "Unsupported expression NOT", "exists": "Unsupported expression EXISTS", "case": "Unsupported expression CASE",
    "insert": "Inserts not currently supported", "update": "Not supported", "delete": "Not supported", "drop": "Not supported", "values": "Not supported",
}
_OPS = ("=", "<>", "!=", "<", "<=", ">", ">=")


def tokens(sql: str) -> list[tuple[str, str]]:
    out, at = [], 0
    sql = sql.strip()
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise EngineError(f"Cannot read {sql[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup].replace("''", "'") if m.lastgroup == "str" else m[m.lastgroup]))
        at = m.end()
        while at < len(sql) and sql[at].isspace():
            at += 1
    return out


@dataclass
class _Scope:
    """Tables in FROM order under their names; each column has a unique internal name."""

    frames: dict[str, DataFrame] = field(default_factory=dict)
    types: dict[str, dict[str, T.DataType]] = field(default_factory=dict)

    def add(self, name: str, df: DataFrame) -> DataFrame:
        if name in self.frames:
            raise EngineError(f"Table name {name} is used twice; give one an alias")
        self.types[name] = {f.name: f.dataType for f in df.schema}
        self.frames[name] = df.select(*[F.col(c).alias(f"{name}.{c}") for c in df.columns])
        return self.frames[name]

    def resolve(self, parts: list[str]) -> tuple[str, str]:
        """(table, column) of a one- or two-part name."""
        if len(parts) > 2:
            raise EngineError("A column name has at most two parts")
        if len(parts) == 2:
            table, column = parts
            if table not in self.types:
                raise EngineError(f"Table {table} is not in the query")
            if column not in self.types[table]:
                raise EngineError(f"Column {column} is not present in {table}")
            return table, column
        found = [t for t, cols in self.types.items() if parts[0] in cols]
        if not found:
            raise EngineError(f"Column {parts[0]} is not present")
        if len(found) > 1:
            raise EngineError(f"Column {parts[0]} could refer to more than one table")
        return found[0], parts[0]

    def type_of(self, ref: tuple[str, str]) -> T.DataType:
        return self.types[ref[0]][ref[1]]


class _Parser:
    def __init__(self, sql: str, lookup: Callable[[str], DataFrame]) -> None:
        self.rest, self.lookup, self.scope = tokens(sql), lookup, _Scope()
        if self.rest and self.rest[-1] == ("op", ";"):
            self.rest.pop()
        if ("op", ";") in self.rest:
            raise EngineError("One statement at a time")
        if not self.rest:
            raise EngineError("Empty statement")
        self.at = self.literals = 0

    def peek(self) -> tuple[str, str]:
        return self.rest[self.at] if self.at < len(self.rest) else ("end", "")

    def word(self) -> str:
        kind, text = self.peek()
        return text.lower() if kind == "name" else ""

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def take(self, *words: str) -> bool:
        if self.word() in words or self.peek()[0] == "op" and self.peek()[1] in words:
            self.at += 1
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            self.refuse()
            raise EngineError(f"Expected {words[0].upper()} before {self.peek()[1]!r}")

    def refuse(self) -> None:
        if self.word() in _REFUSED:
            raise EngineError(_REFUSED[self.word()])

    def name(self) -> str:
        self.refuse()
        kind, text = self.next()
        if kind != "name":
            raise EngineError("Unsupported expression" if kind != "end" else "Statement ends early")
        return text

    def dotted(self) -> list[str]:
        parts = [self.name()]
        while self.take("."):
            if self.peek() == ("op", "*"):
                raise EngineError("Qualified wildcards are not supported")
            parts.append(self.name())
        return parts

    def statement(self) -> DataFrame:
        self.need("select")
        self.refuse()
        items, star = self.items()
        self.need("from")
        df = self.table()
        if self.peek() == ("op", ","):
            raise EngineError("Cross product not supported")
        while self.word() in ("join", "inner", "left", "right", "full", "cross", "natural"):
            df = self.joined(df)
        if self.take("where"):
            df = df.where(self.either())
        groups = None
        if self.take("group"):
            self.need("by")
            groups = [self.scope.resolve(self.dotted())]
            while self.take(","):
                groups.append(self.scope.resolve(self.dotted()))
        if self.peek()[0] != "end":
            self.refuse()
            raise EngineError(f"Unexpected {self.peek()[1]!r}")
        return self.select(df, items, star, groups)

    def items(self) -> tuple[list, bool]:
        if self.take("*"):
            if self.peek() == ("op", ","):
                raise EngineError("A wildcard cannot be mixed with other columns")
            return [], True
        out = [self.item()]
        while self.take(","):
            if self.peek() == ("op", "*"):
                raise EngineError("A wildcard cannot be mixed with other columns")
            out.append(self.item())
        return out, False

    def item(self) -> tuple[str | None, list[str], str | None]:
        parts, func = self.dotted(), None
        if self.take("("):
            if len(parts) > 1 or parts[0].lower() not in AGGREGATES:
                raise EngineError(f"Unsupported SQL function {'.'.join(parts)}")
            func = parts[0].lower()
            if self.peek() == ("op", "*"):
                raise EngineError("Aggregates over * are not supported")
            parts = self.dotted()
            if self.peek() == ("op", ","):
                raise EngineError(f"{func} takes one column")
            self.need(")")
            self.refuse()
        alias = self.name() if self.take("as") else None
        if self.peek()[0] == "op" and self.peek()[1] in (*_OPS, "+", "-", "/", "*"):
            raise EngineError("Unsupported expression")
        return func, parts, alias

    def table(self) -> DataFrame:
        if self.peek() == ("op", "("):
            raise EngineError("Nested queries are not supported")
        parts = self.dotted()
        if len(parts) > 1:
            raise EngineError("Table names have one part")
        alias = self.name() if self.take("as") else parts[0]
        if self.peek()[0] == "name" and self.word() not in {"join", "inner", "on", "where", "group", *_REFUSED}:
            alias = self.name()
        return self.scope.add(alias, self.lookup(parts[0]))

    def joined(self, df: DataFrame) -> DataFrame:
        self.take("inner")
        self.need("join")
        right = self.table()
        self.refuse()
        self.need("on")
        one = self.scope.resolve(self.dotted())
        op = self.operator()
        if self.peek()[0] in ("num", "str"):
            raise EngineError("A join compares two columns")
        two = self.scope.resolve(self.dotted())
        if self.word() in ("and", "or"):
            raise EngineError("A join has exactly one comparison")
        self.same_kind(self.scope.type_of(one), self.scope.type_of(two))
        return df.join(right, compare(self.column(one), op, self.column(two)), "inner")

    def operator(self) -> str:
        self.refuse()
        kind, text = self.next()
        if kind != "op" or text not in _OPS:
            raise EngineError("Expected binary operation")
        return text

    def column(self, ref: tuple[str, str]) -> Column:
        return F.col(f"`{ref[0]}.{ref[1]}`")

    @staticmethod
    def same_kind(a: T.DataType, b: T.DataType) -> None:
        if isinstance(a, T.StringType) != isinstance(b, T.StringType):
            raise EngineError("Strings and numbers cannot be compared")

    def either(self) -> Column:
        out = self.both()
        while self.take("or"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.test()
        while self.take("and"):
            out = out & self.test()
        return out

    def test(self) -> Column:
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        (left, a), op, (right, b) = self.operand(), self.operator(), self.operand()
        if self.literals == 2:
            raise EngineError("A test needs a column")
        self.literals = 0
        self.same_kind(a, b)
        return compare(left, op, right)

    def operand(self) -> tuple[Column, T.DataType]:
        sign = -1 if self.take("-") else 1
        kind, text = self.peek()
        if kind == "num" or kind == "str" and sign == 1:
            self.literals += 1
        if kind == "num":
            self.next()
            return F.lit(sign * int(text)), T.IntegerType()
        if kind == "str" and sign == 1:
            self.next()
            return F.lit(text), T.StringType()
        if sign == -1:
            raise EngineError("Unsupported expression")
        parts = self.dotted()
        if self.peek() == ("op", "("):
            raise EngineError("Aggregates are not allowed in WHERE" if parts[0].lower() in AGGREGATES else f"Unsupported SQL function {parts[0]}")
        ref = self.scope.resolve(parts)
        return self.column(ref), self.scope.type_of(ref)

    def select(self, df: DataFrame, items: list, star: bool, groups: list | None) -> DataFrame:
        if star:
            if groups:
                raise EngineError("A wildcard cannot be grouped")
            return self.named(df, [(self.column((t, c)), c) for t, cols in self.scope.types.items() for c in cols])
        refs = [(func, self.scope.resolve(parts), alias) for func, parts, alias in items]
        for func, ref, _ in refs:
            if func in ("sum", "avg") and isinstance(self.scope.type_of(ref), T.StringType):
                raise EngineError(f"{func} needs a number; {ref[1]} is a string")
        if groups is None and not any(f for f, _, _ in refs):
            return self.named(df, [(self.column(r), alias or r[1]) for _, r, alias in refs])
        for func, ref, _ in refs:
            if func is None and ref not in (groups or []):
                raise EngineError(f"{ref[1]} must be part of an aggregate function or group by")
        keys = [self.column(g).alias(f"k{i}") for i, g in enumerate(groups or [])]
        aggs = [AGGREGATES[f](self.column(r)).alias(f"a{i}") for i, (f, r, _) in enumerate(refs) if f]
        df = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
        out = []
        for i, (func, ref, alias) in enumerate(refs):
            if func:
                out.append((F.col(f"a{i}"), alias or f"{func}_{ref[1]}"))
            else:
                out.append((F.col(f"k{(groups or []).index(ref)}"), alias or ref[1]))
        return self.named(df, out)

    @staticmethod
    def named(df: DataFrame, columns: list[tuple[Column, str]]) -> DataFrame:
        return df.select(*[c.alias(n) for c, n in columns])


def run_select(sql: str, lookup: Callable[[str], DataFrame]) -> DataFrame:
    """Builds the DataFrame of a SELECT; ``lookup`` gives a table by name or raises EngineError."""
    return _Parser(sql, lookup).statement()
