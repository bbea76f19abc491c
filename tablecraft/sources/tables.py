"""Declared tables: columns, keys, implicit predicates, stamps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from ..errors import ArgumentError, QueryShapeError, UnknownNameError
from ..functions.expr import Condition, Expr
from ..functions.temporal import Clock, Now
from ..functions.typed import Converter, TypedCol, family_of


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type_name: str
    nullable: bool = True
    identity: bool = False
    computed: bool = False
    row_version: bool = False
    read_only: bool = False
    default: Expr | None = None
    converter: Converter | None = None
    members: type[Enum] | None = None

    @property
    def writable(self) -> bool:
        return not (self.identity or self.computed or self.row_version or self.read_only)


@dataclass(frozen=True)
class UniqueKey:
    name: str
    columns: tuple[str, ...]
    filtered: bool = False
    disabled: bool = False

    @property
    def guarantees(self) -> bool:
        return not (self.filtered or self.disabled)


@dataclass(frozen=True)
class ForeignKey:
    name: str
    columns: tuple[str, ...]
    target: str
    target_columns: tuple[str, ...]


class Trashed(Enum):
    WITHOUT, WITH, ONLY = "without", "with", "only"


@dataclass(frozen=True)
class SoftDelete:
    """A marker column: null means alive, or one value means alive and another deleted."""

    column: str
    alive_value: Any = None
    deleted_value: Any = None

    @property
    def by_timestamp(self) -> bool:
        return self.alive_value is None and self.deleted_value is None

    def alive(self, col: TypedCol) -> Condition:
        return col.is_null() if self.by_timestamp else col.eq(self.alive_value)

    def deleted(self, col: TypedCol) -> Condition:
        return col.is_not_null() if self.by_timestamp else col.eq(self.deleted_value)

    def condition(self, col: TypedCol, mode: Trashed) -> Condition | None:
        return {Trashed.WITHOUT: lambda: self.alive(col), Trashed.ONLY: lambda: self.deleted(col), Trashed.WITH: lambda: None}[mode]()


@dataclass(frozen=True)
class NamedScope:
    """A predicate that every read and write of a table carries; built once per operation."""

    name: str
    build: Callable[[TableDef], Condition]


@dataclass(frozen=True)
class Timestamps:
    created: str | None = None
    updated: str | None = None
    clock: Clock = Clock.UTC

    def now(self) -> Expr:
        return Now(self.clock)


@dataclass(frozen=True)
class ScopeSelection:
    trashed: Trashed = Trashed.WITHOUT
    off: frozenset[str] = frozenset()
    no_globals: bool = False

    def without(self, name: str) -> ScopeSelection:
        return replace(self, off=self.off | {name})


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[ColumnDef, ...]
    primary_key: tuple[str, ...] = ()
    unique_keys: tuple[UniqueKey, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    soft_delete: SoftDelete | None = None
    timestamps: Timestamps | None = None
    scopes: tuple[NamedScope, ...] = ()
    relations: dict[str, Any] = field(default_factory=dict, compare=False)
    is_view: bool = False
    fingerprint: str | None = None

    def __post_init__(self) -> None:
        names = [c.name.lower() for c in self.columns]
        if len(set(names)) != len(names):
            raise QueryShapeError(f"{self.name}: a column is declared twice")
        for key in self.primary_key:
            self.column_def(key)

    def column_def(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise UnknownNameError(f"{self.name} has no column {name}")

    @property
    def label(self) -> str:
        return self.name.rsplit(".", 1)[-1]

    def __getitem__(self, name: str) -> TypedCol:
        c = self.column_def(name)
        return TypedCol(c.name, self, c.type_name, c.converter, c.members)

    def __hash__(self) -> int:
        return hash((self.name, self.columns, self.primary_key))

    def as_source(self, as_: str | None = None) -> Any:
        from ..operators.query import Source, name_parts

        return Source(name_parts(self.name), as_, ref=self)

    def for_table(self, schema: str | None = None, table: str | None = None) -> TableDef:
        """The same definition over another table, as of another tenant; what was known of the old one goes."""
        if not schema and not table:
            raise ArgumentError("say which schema or table")
        parts = self.name.split(".")
        new = table or parts[-1]
        schema = schema or (parts[-2] if len(parts) > 1 else None)
        return replace(self, name=f"{schema}.{new}" if schema else new, fingerprint=None)

    def uniqueness(self, columns: tuple[str, ...]) -> UniqueKey | None:
        """The key, not filtered or disabled, that makes rows of these columns unique."""
        given = {c.lower() for c in columns}
        if self.primary_key and {c.lower() for c in self.primary_key} <= given:
            return UniqueKey("primary", self.primary_key)
        return next((k for k in self.unique_keys if k.guarantees and {c.lower() for c in k.columns} <= given), None)

    def is_unique(self, columns: tuple[str, ...]) -> bool:
        return self.uniqueness(columns) is not None

    # Implicit predicates.
    def global_conditions(self, selection: ScopeSelection = ScopeSelection()) -> list[Condition]:
        known = {s.name for s in self.scopes}
        if selection.off - known:
            raise UnknownNameError(f"{self.name} has no scope {sorted(selection.off - known)}")
        return [] if selection.no_globals else [s.build(self) for s in self.scopes if s.name not in selection.off]

    def read_conditions(self, selection: ScopeSelection = ScopeSelection()) -> list[Condition]:
        out = self.global_conditions(selection)
        if self.soft_delete is None:
            if selection.trashed is not Trashed.WITHOUT:
                raise QueryShapeError(f"{self.name} has no soft delete")
            return out
        own = self.soft_delete.condition(self[self.soft_delete.column], selection.trashed)
        return out if own is None else [own, *out]


def table_of(name: str, columns: dict[str, str], key: tuple[str, ...] | str = (), **options: Any) -> TableDef:
    """A definition from names and Spark types."""
    key = (key,) if isinstance(key, str) else tuple(key)
    defs = tuple(ColumnDef(c, t, nullable=c not in key) for c, t in columns.items())
    for c in defs:
        if family_of(c.type_name) is None and not c.type_name.startswith(("array", "interval")):
            raise ArgumentError(f"{name}.{c.name}: {c.type_name} is no known type")
    return TableDef(name, defs, key, **options)


__all__ = [
    "ColumnDef", "ForeignKey", "NamedScope", "ScopeSelection", "SoftDelete", "TableDef", "Timestamps", "Trashed", "UniqueKey", "table_of",
]
