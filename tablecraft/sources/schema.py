"""Schema snapshots, fingerprints and differences."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame

from ..errors import SchemaDriftError, UnknownNameError
from .tables import ColumnDef, ForeignKey, TableDef, UniqueKey


class Difference(Enum):
    """Kinds of differences, and whether code that relied on the expected schema breaks."""

    TABLE_MISSING = ("table missing", True)
    TABLE_ADDED = ("table added", False)
    KIND_CHANGED = ("table became a view or the reverse", True)
    COLUMN_MISSING = ("column missing", True)
    COLUMN_ADDED = ("column added", False)
    REQUIRED_COLUMN_ADDED = ("column without default and null added", True)
    TYPE_CHANGED = ("type changed", True)
    NULLABLE = ("column became nullable", True)
    NOT_NULLABLE = ("column became not nullable", False)
    IDENTITY_CHANGED = ("identity changed", True)
    COMPUTED_CHANGED = ("computed changed", True)
    VERSION_CHANGED = ("row version changed", True)
    DEFAULT_CHANGED = ("default came or went", False)
    PRIMARY_KEY_CHANGED = ("primary key changed", True)
    UNIQUE_KEY_MISSING = ("unique key missing", True)
    UNIQUE_KEY_ADDED = ("unique key added", False)
    FOREIGN_KEY_CHANGED = ("foreign key changed", False)

    @property
    def breaking(self) -> bool:
        return self.value[1]


@dataclass(frozen=True)
class Finding:
    kind: Difference
    table: str
    subject: str = ""

    def __str__(self) -> str:
        return f"{self.table}{'.' + self.subject if self.subject else ''}: {self.kind.value[0]}"


def _table_json(t: TableDef) -> dict[str, Any]:
    column = lambda c: {
        "name": c.name, "type": c.type_name, "nullable": c.nullable, "identity": c.identity, "computed": c.computed,
        "row_version": c.row_version, "read_only": c.read_only, "default": c.default is not None,
    }
    return {
        "name": t.name,
        "view": t.is_view,
        "columns": [column(c) for c in t.columns],
        "primary_key": list(t.primary_key),
        "unique_keys": [{"name": k.name, "columns": list(k.columns), "filtered": k.filtered, "disabled": k.disabled} for k in sorted(t.unique_keys, key=lambda k: k.name)],
        "foreign_keys": [{"name": k.name, "columns": list(k.columns), "target": k.target, "target_columns": list(k.target_columns)} for k in sorted(t.foreign_keys, key=lambda k: k.name)],
    }


def fingerprint(table: TableDef) -> str:
    """A digest of what code relies on."""
    return hashlib.sha256(json.dumps(_table_json(table), sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class SchemaSnapshot:
    tables: tuple[TableDef, ...]

    def to_json(self) -> str:
        return json.dumps([_table_json(t) for t in sorted(self.tables, key=lambda t: t.name.lower())], indent=1, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> SchemaSnapshot:
        from ..functions.expr import Lit

        tables = []
        for t in json.loads(text):
            columns = tuple(
                ColumnDef(c["name"], c["type"], c["nullable"], c["identity"], c["computed"], c["row_version"], c["read_only"], Lit(None) if c["default"] else None)
                for c in t["columns"]
            )
            uniques = tuple(UniqueKey(k["name"], tuple(k["columns"]), k["filtered"], k["disabled"]) for k in t["unique_keys"])
            foreign = tuple(ForeignKey(k["name"], tuple(k["columns"]), k["target"], tuple(k["target_columns"])) for k in t["foreign_keys"])
            tables.append(TableDef(t["name"], columns, tuple(t["primary_key"]), uniques, foreign, is_view=t["view"]))
        return SchemaSnapshot(tuple(tables))

    def table(self, name: str) -> TableDef:
        for t in self.tables:
            if t.name.lower() == name.lower():
                return t
        raise UnknownNameError(f"no table {name}")

    def ambiguous_names(self) -> list[str]:
        """Names that differ in case alone."""
        seen: dict[str, set[str]] = {}
        for t in self.tables:
            seen.setdefault(t.name.lower(), set()).add(t.name)
        return sorted(n for names in seen.values() if len(names) > 1 for n in names)


def table_from_frame(name: str, df: DataFrame, key: tuple[str, ...] = ()) -> TableDef:
    """A definition from what a frame's schema says; keys are not in it and may be given."""
    short = {"bigint": "bigint", "integer": "int"}
    return TableDef(name, tuple(ColumnDef(f.name, short.get(f.dataType.simpleString(), f.dataType.simpleString()), f.nullable) for f in df.schema), key)


def read_tables(engine: Any, names: list[str] | None = None, keys: dict[str, tuple[str, ...]] | None = None) -> SchemaSnapshot:
    """Definitions of tables the engine knows; without names, of all in its store and the session's catalog."""
    if names is None:
        names = engine.store.tables() if engine.store is not None else []
        names += [t.name for t in engine.spark.catalog.listTables() if t.name not in names]
    return SchemaSnapshot(tuple(table_from_frame(n, engine.table(n), (keys or {}).get(n, ())) for n in names))


def diff_tables(expected: TableDef, actual: TableDef) -> list[Finding]:
    out: list[Finding] = []
    add = lambda kind, subject="": out.append(Finding(kind, expected.name, subject))
    if expected.is_view != actual.is_view:
        add(Difference.KIND_CHANGED)
    have = {c.name.lower(): c for c in actual.columns}
    for c in expected.columns:
        other = have.pop(c.name.lower(), None)
        if other is None:
            add(Difference.COLUMN_MISSING, c.name)
            continue
        if c.type_name != other.type_name:
            add(Difference.TYPE_CHANGED, c.name)
        if c.nullable != other.nullable:
            add(Difference.NULLABLE if other.nullable else Difference.NOT_NULLABLE, c.name)
        for flag, kind in (("identity", Difference.IDENTITY_CHANGED), ("computed", Difference.COMPUTED_CHANGED), ("row_version", Difference.VERSION_CHANGED)):
            if getattr(c, flag) != getattr(other, flag):
                add(kind, c.name)
        if (c.default is None) != (other.default is None):
            add(Difference.DEFAULT_CHANGED, c.name)
    for c in have.values():
        required = not c.nullable and c.default is None and c.writable
        add(Difference.REQUIRED_COLUMN_ADDED if required else Difference.COLUMN_ADDED, c.name)
    if [k.lower() for k in expected.primary_key] != [k.lower() for k in actual.primary_key]:
        add(Difference.PRIMARY_KEY_CHANGED)
    sets = [{frozenset(c.lower() for c in k.columns) for k in t.unique_keys if k.guarantees} for t in (expected, actual)]
    for k in sets[0] - sets[1]:
        add(Difference.UNIQUE_KEY_MISSING, ",".join(sorted(k)))
    for k in sets[1] - sets[0]:
        add(Difference.UNIQUE_KEY_ADDED, ",".join(sorted(k)))
    if set(expected.foreign_keys) != set(actual.foreign_keys):
        add(Difference.FOREIGN_KEY_CHANGED)
    return out


def diff_schemas(expected: SchemaSnapshot, actual: SchemaSnapshot) -> list[Finding]:
    have = {t.name.lower(): t for t in actual.tables}
    out: list[Finding] = []
    for t in expected.tables:
        other = have.pop(t.name.lower(), None)
        out += [Finding(Difference.TABLE_MISSING, t.name)] if other is None else diff_tables(t, other)
    return out + [Finding(Difference.TABLE_ADDED, t.name) for t in have.values()]


def verify(engine: Any, table: TableDef) -> list[Finding]:
    """Differences of a definition from the live table, by columns and types; breaking ones raise."""
    live = table_from_frame(table.name, engine.table(table.name), table.primary_key)
    found = [f for f in diff_tables(table, live) if f.kind in (Difference.COLUMN_MISSING, Difference.COLUMN_ADDED, Difference.TYPE_CHANGED, Difference.REQUIRED_COLUMN_ADDED)]
    if breaking := [f for f in found if f.kind.breaking]:
        raise SchemaDriftError("; ".join(map(str, breaking)))
    return found


__all__ = ["Difference", "Finding", "SchemaSnapshot", "diff_schemas", "diff_tables", "fingerprint", "read_tables", "table_from_frame", "verify"]
