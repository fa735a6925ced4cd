"""The annotation of a database: semantic types, keys, temporal columns and tasks, as JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from enum import IntEnum
from pathlib import Path


class SType(IntEnum):
    """Semantic types by their stored number."""

    IDENTIFIER = 0
    NUMERICAL = 1
    TIMESTAMP = 2
    BOOLEAN = 3
    CATEGORICAL = 4
    TEXT = 5
    IGNORED = 6


TARGETS = (SType.NUMERICAL, SType.TIMESTAMP, SType.BOOLEAN, SType.CATEGORICAL)


def stype_of(name: str) -> SType:
    """The type named, in any case; an unknown name is IGNORED."""
    return SType.__members__.get(name.upper(), SType.IGNORED)


@dataclass
class Column:
    name: str
    stype: SType
    foreign_key: str | None = None
    description: str | None = None
    index: int = -1

    @property
    def target(self) -> tuple[str, str] | None:
        """(table, column) that the foreign key names, parted at the first dot."""
        if not self.foreign_key or "." not in self.foreign_key:
            return None
        table, column = self.foreign_key.split(".", 1)
        return table, column


@dataclass
class Table:
    name: str
    columns: dict[str, Column]
    primary_key: str | None = None
    temporal_column: str | None = None
    index: int = -1


@dataclass
class Task:
    name: str
    query: str
    anchor_table: str
    anchor_key: str
    target_column: str
    target_stype: SType
    observation_time_column: str | None = None


@dataclass
class Annotation:
    name: str
    tables: dict[str, Table]
    tasks: dict[str, Task] = field(default_factory=dict)

    def __post_init__(self) -> None:
        number = 0
        for i, table in enumerate(self.tables.values()):
            table.index = i
            for column in table.columns.values():
                column.index = number
                number += 1

    @classmethod
    def parse(cls, text: str) -> Annotation:
        raw = json.loads(text)
        tables = {}
        for name, t in raw["tables"].items():
            columns = {c: Column(c, stype_of(x["stype"]), x.get("foreign_key"), x.get("description")) for c, x in t["columns"].items()}
            tables[name] = Table(name, columns, t.get("primary_key"), t.get("temporal_column"))
        tasks = {
            n: Task(n, t["query"], t["anchor_table"], t["anchor_key"], t["target_column"], stype_of(t["target_stype"]), t.get("observation_time_column"))
            for n, t in raw.get("tasks", {}).items()
        }
        return cls(raw["name"], tables, tasks)

    @classmethod
    def load(cls, path: str | Path) -> Annotation:
        return cls.parse(Path(path).read_text())

    def dump(self) -> str:
        """JSON with an indent of 4 that leaves out what is not set."""

        def lean(x: dict) -> dict:
            return {k: v for k, v in x.items() if v is not None}

        out = {
            "name": self.name,
            "tables": {
                t.name: lean(
                    {
                        "primary_key": t.primary_key,
                        "temporal_column": t.temporal_column,
                        "columns": {c.name: lean({"stype": c.stype.name.lower(), "foreign_key": c.foreign_key, "description": c.description}) for c in t.columns.values()},
                    }
                )
                for t in self.tables.values()
            },
            "tasks": {
                t.name: lean(
                    {
                        "query": t.query,
                        "anchor_table": t.anchor_table,
                        "anchor_key": t.anchor_key,
                        "observation_time_column": t.observation_time_column,
                        "target_column": t.target_column,
                        "target_stype": t.target_stype.name.lower(),
                    }
                )
                for t in self.tasks.values()
            },
        }
        return json.dumps(out, indent=4)

    def save(self, path: str | Path, force: bool = False) -> None:
        """Write to path; an existing file is an error unless force is set."""
        path = Path(path)
        if path.exists() and not force:
            raise FileExistsError(f"{path} exists")
        path.write_text(self.dump())

    def column_list(self) -> list[tuple[Table, Column]]:
        """All columns in the order of their global numbers."""
        return [(t, c) for t in self.tables.values() for c in t.columns.values()]

    def resolve(self, reference: str | None) -> int | None:
        """The global number of "table.column", or None where there is no such column."""
        if not reference or "." not in reference:
            return None
        table, column = reference.split(".", 1)
        found = self.tables.get(table)
        c = found.columns.get(column) if found else None
        return c.index if c else None

    def foreign_keys(self) -> list[tuple[Table, Column, Table]]:
        """(table, column, table referred to) for every foreign key whose table is known."""
        out = []
        for t, c in self.column_list():
            if c.target and c.target[0] in self.tables:
                out.append((t, c, self.tables[c.target[0]]))
        return out
