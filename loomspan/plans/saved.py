"""Saved queries: named SQL text kept as JSON, validated when registered, with run bookkeeping.

Each query has a watermark, the load version up to which it has run; a query that is in
progress can not begin again.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from pathlib import Path

from loomspan.errors import EngineError


@dataclass
class SavedQuery:
    name: str
    sql: str
    source: str
    watermark: int = 0
    running: bool = False


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, SavedQuery] = {}

    @staticmethod
    def write(path: str, sql: str) -> None:
        Path(path).write_text(json.dumps({"sql": sql}, indent=1))

    @staticmethod
    def read(path: str) -> str:
        try:
            sql = json.loads(Path(path).read_text())["sql"]
        except (OSError, ValueError, KeyError, TypeError) as error:
            raise EngineError(f"{path} holds no saved query") from error
        return sql

    def register(self, name: str, path: str) -> SavedQuery:
        if name in self.queries:
            raise EngineError(f"Query {name} is already registered")
        self.queries[name] = SavedQuery(name, self.read(path), path)
        return self.queries[name]

    def dump(self) -> list[dict]:
        """What is kept of the queries; a run does not outlive its process."""
        return [asdict(q) | {"running": False} for q in self.queries.values()]

    def load(self, kept: list[dict]) -> None:
        self.queries = {q["name"]: SavedQuery(**q) for q in kept}

    def begin(self, name: str) -> SavedQuery:
        query = self.queries.get(name)
        if query is None:
            raise EngineError(f"Query {name} is not registered")
        if query.running:
            raise EngineError(f"Query {name} is in progress")
        query.running = True
        return query

    def finish(self, name: str, version: int | None) -> None:
        """Ends a run; ``version`` None leaves the watermark where it was, as after an error."""
        query = self.queries[name]
        query.running = False
        if version is not None:
            query.watermark = max(query.watermark, version)

    def reset(self) -> None:
        if any(q.running for q in self.queries.values()):
            raise EngineError("A query is in progress")
        self.queries.clear()

    def listing(self) -> str:
        return "\n".join(f"{q.name}\t{q.source}" for q in self.queries.values()) or "No registered queries"
