"""Relations: eager loading, filters and aggregates that never multiply parents.

A relation is lowered to a frame of child rows with link columns, one row per
child and parent key. Includes group it into arrays, filters semi-join it,
aggregates pre-aggregate it; each is one left, semi or anti join on the parent.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentError, RelationError, UnknownMorphError
from ..functions.aggregates import Aggregate
from ..functions.expr import Condition, Order, Scope, order_term
from ..sources.tables import ScopeSelection, TableDef, Trashed


class RelationKind(Enum):
    BELONGS_TO, HAS_ONE, HAS_MANY, BELONGS_TO_MANY = "belongs_to", "has_one", "has_many", "belongs_to_many"
    HAS_ONE_THROUGH, HAS_MANY_THROUGH = "has_one_through", "has_many_through"
    MORPH_TO, MORPH_ONE, MORPH_MANY, MORPH_TO_MANY = "morph_to", "morph_one", "morph_many", "morph_to_many"

    @property
    def to_one(self) -> bool:
        return self.value in ("belongs_to", "has_one", "has_one_through", "morph_one", "morph_to")

    @property
    def through(self) -> bool:
        return self.value in ("belongs_to_many", "has_one_through", "has_many_through", "morph_to_many")


class UnknownMorph(Enum):
    ERROR, IGNORE = "error", "ignore"


def _tuple(x: str | Sequence[str]) -> tuple[str, ...]:
    return (x,) if isinstance(x, str) else tuple(x)


@dataclass(frozen=True)
class Relation:
    """``local`` columns of the parent equal ``foreign`` ones of the child, or of the pivot between them."""

    name: str
    kind: RelationKind
    target: TableDef | None
    local: tuple[str, ...]
    foreign: tuple[str, ...]
    pivot: TableDef | None = None
    pivot_far: tuple[str, ...] = ()  # of the pivot, equal to target_key
    target_key: tuple[str, ...] = ()
    morph_column: str | None = None
    morph_value: Any = None
    morph_targets: tuple[tuple[Any, TableDef, tuple[str, ...]], ...] = ()
    unknown: UnknownMorph = UnknownMorph.ERROR
    orders: tuple[Order, ...] = ()
    conditions: tuple[Condition, ...] = ()
    take: int | None = None
    most_rows: int | None = None
    selection: ScopeSelection = ScopeSelection()
    nested: tuple[Relation, ...] = ()

    def ordered(self, *terms: Any) -> Relation:
        return replace(self, orders=tuple(map(order_term, terms)))

    def filtered(self, *conditions: Condition) -> Relation:
        return replace(self, conditions=(*self.conditions, *conditions))

    def take_per_parent(self, n: int) -> Relation:
        if n < 1:
            raise ArgumentError("at least one row per parent")
        if not self.orders:
            raise RelationError(f"{self.name}: the first rows per parent need an order")
        return replace(self, take=n)

    def max_loaded_rows(self, n: int) -> Relation:
        if n < 1:
            raise ArgumentError("a ceiling is at least 1")
        return replace(self, most_rows=n)

    def joined(self) -> Relation:
        """Every include is a join; to-many relations have no single row to join."""
        if not self.kind.to_one:
            raise RelationError(f"{self.name} is to-many")
        return self

    def with_trashed(self) -> Relation:
        return replace(self, selection=replace(self.selection, trashed=Trashed.WITH))

    def only_trashed(self) -> Relation:
        return replace(self, selection=replace(self.selection, trashed=Trashed.ONLY))

    def then(self, *relations: Relation) -> Relation:
        return replace(self, nested=merge_includes(self.nested, relations))

    def select(self, *columns: Any) -> Relation:
        raise RelationError("rows of a relation come whole; project the query instead")

    # Frames.
    def children(self, engine: Any) -> DataFrame:
        """The target's rows in scope and filter, under their own names."""
        if self.kind is RelationKind.MORPH_TO:
            raise RelationError(f"{self.name} has several targets")
        df = engine.table(self.target.name).alias(self.target.label)
        scope = Scope({self.target.label: tuple(df.columns)}, None, engine, {self.target: self.target.label})
        for c in [*self.target.read_conditions(self.selection), *self.conditions]:
            df = df.where(c.to_column(scope))
        if self.morph_column and not self.kind.through:
            df = df.where(F.col(self.morph_column) == F.lit(self.morph_value))
        return df

    def linked(self, engine: Any) -> DataFrame:
        """``__l0..`` and ``row``, and ``pivot`` for through relations: a row per child and parent key."""
        df = self.children(engine)
        names = df.columns
        for inner in self.nested:
            df = inner.include(engine, df)
        row = F.struct(*[df[c] for c in df.columns]).alias("row")
        orders = []
        scope = Scope({self.target.label: tuple(names)}, None, engine, {self.target: self.target.label})
        if self.nested:
            scope = Scope({}, None, engine)
            strip = lambda o: Order(type(o.expr)(o.expr.output_name()), o.descending, o.nulls)
            terms = [strip(o) for o in self.orders]
        else:
            terms = list(self.orders)
        for i, o in enumerate(terms):
            orders.append(o.expr.to_column(scope).alias(f"__o{i}"))
        if not self.kind.through:
            links = [df[c].alias(f"__l{i}") for i, c in enumerate(self.foreign)]
            return df.select(*links, *orders, row)
        keys = [df[c].alias(f"__t{i}") for i, c in enumerate(self.target_key)]
        pivot = engine.table(self.pivot.name).alias("pivot")
        for c in self.pivot.read_conditions():
            pivot = pivot.where(c.to_column(Scope({"pivot": tuple(pivot.columns)}, None, engine, {self.pivot: "pivot"})))
        if self.morph_column:
            pivot = pivot.where(F.col(self.morph_column) == F.lit(self.morph_value))
        links = [F.col(c).alias(f"__l{i}") for i, c in enumerate(self.foreign)]
        far = [F.col(c).alias(f"__p{i}") for i, c in enumerate(self.pivot_far)]
        between = pivot.select(*links, *far, F.struct(*pivot.columns).alias("pivot"))
        targets = df.select(*keys, *orders, row)
        on = [between[f"__p{i}"] == targets[f"__t{i}"] for i in range(len(self.pivot_far))]
        return between.join(targets, on).drop(*[f"__p{i}" for i in range(len(far))], *[f"__t{i}" for i in range(len(keys))])

    def _links(self) -> list[str]:
        return [f"__l{i}" for i in range(len(self.local))]

    def _on(self, parent: DataFrame, other: DataFrame) -> list[Column]:
        return [parent[c] == other[k] for c, k in zip(self.local, self._links(), strict=True)]

    def include(self, engine: Any, parent: DataFrame) -> DataFrame:
        """The parent with a column of this name: a struct, or an array of structs, in the child order."""
        if self.kind is RelationKind.MORPH_TO:
            return self._include_morph_to(engine, parent)
        rows = self.linked(engine)
        terms = [o.apply(F.col(f"__o{i}")) for i, o in enumerate(self.orders)]
        whole = F.struct("row", "pivot") if self.kind.through and not self.kind.to_one else F.col("row")
        truncated = None
        if self.most_rows is not None:
            # Reaching the ceiling counts as truncated.
            rows = engine.settled(rows.orderBy(*self._links(), *terms).limit(self.most_rows))
            truncated = rows.count() >= self.most_rows
        if terms:
            place = Window.partitionBy(*self._links()).orderBy(*terms)
            rows = rows.withColumn("__n", F.row_number().over(place))
        else:
            rows = rows.withColumn("__n", F.lit(0))
        if self.take is not None:
            rows = rows.where(F.col("__n") <= self.take)
        grouped = rows.groupBy(*self._links()).agg(
            F.sort_array(F.collect_list(F.struct(F.col("__n"), whole.alias("value")))).alias("__all")
            if terms
            else F.collect_list(F.struct(F.col("__n"), whole.alias("value"))).alias("__all")
        )
        listed = F.transform("__all", lambda x: x["value"])
        if self.kind.to_one:
            many = F.raise_error(F.lit(f"{self.name}: more than one row behind a to-one relation"))
            value = F.when(F.size("__all") > 1, many.cast(rows.schema["row"].dataType)).otherwise(F.get(listed, F.lit(0)))
        else:
            value = listed
        found = grouped.select(*self._links(), value.alias(self.name))
        out = parent.join(found, self._on(parent, found), "left")
        kept = [parent[c] for c in parent.columns]
        loaded = found[self.name]
        if not self.kind.to_one:
            loaded = F.coalesce(loaded, F.array().cast(found.schema[self.name].dataType))
        flag = [] if truncated is None else [F.lit(truncated).alias(f"{self.name}_truncated")]
        return out.select(*kept, loaded.alias(self.name), *flag)

    def _include_morph_to(self, engine: Any, parent: DataFrame) -> DataFrame:
        known = [v for v, _, _ in self.morph_targets]
        kind = F.col(self.morph_column)
        if self.unknown is UnknownMorph.ERROR:
            odd = parent.where(kind.isNotNull() & ~kind.isin(known)).select(self.morph_column).limit(1).collect()
            if odd:
                raise UnknownMorphError(f"{self.name}: no target for {odd[0][0]!r}")
        out = parent
        for value, target, keys in self.morph_targets:
            one = Relation(f"{self.name}_{target.label}", RelationKind.BELONGS_TO, target, self.local, keys, selection=self.selection)
            rows = one.linked(engine)
            own = [*one._on(out, rows), out[self.morph_column] == F.lit(value)]
            out = out.join(rows, own, "left").select(*[out[c] for c in out.columns], rows["row"].alias(one.name))
        return out

    def keys(self, engine: Any) -> DataFrame:
        """Link columns of parents that have a child, with the filters of nested relations."""
        if self.kind is RelationKind.MORPH_TO:
            raise RelationError(f"{self.name} has several targets and cannot filter")
        bare = replace(self, nested=(), orders=())
        rows = bare.linked(engine)
        for inner in self.nested:
            own = inner.keys(engine)
            on = [rows[f"row.{c}"] == own[k] for c, k in zip(inner.local, inner._links(), strict=True)]
            rows = rows.join(own, on, "left_semi")
        return rows

    def has(self, engine: Any, parent: DataFrame, none: bool = False) -> DataFrame:
        rows = self.keys(engine).select(*self._links())
        return parent.join(rows, self._on(parent, rows), "left_anti" if none else "left_semi")

    def aggregate(self, engine: Any, parent: DataFrame, alias: str, agg: Aggregate | None, exists: bool = False) -> DataFrame:
        """The parent with one more column; of a through relation the target's rows count."""
        rows = self.keys(engine)
        flat = rows.select(*self._links(), "row.*")
        scope = Scope({}, None, engine)
        bare = None
        if agg is not None and agg.operand is not None:
            from ..functions.expr import Col
            from ..functions.typed import TypedCol

            bare = agg.operand
            if isinstance(bare, TypedCol):
                bare = TypedCol(bare.output_name(), None, bare.type_name)
            elif isinstance(bare, Col):
                bare = Col(bare.output_name())
            agg = replace(agg, operand=bare)
        value = agg.to_column(scope) if agg is not None else F.count(F.lit(1))
        found = flat.groupBy(*self._links()).agg(value.alias("__value"))
        out = parent.join(found, self._on(parent, found), "left")
        v = found["__value"]
        if exists:
            v = v.isNotNull()
        elif agg is None or agg.name == "count":
            v = F.coalesce(v, F.lit(0))
        return out.select(*[parent[c] for c in parent.columns], v.alias(alias))


def merge_includes(current: Sequence[Relation], extra: Sequence[Relation]) -> tuple[Relation, ...]:
    """One relation per name; the same one twice folds its nested relations, different ones of a name conflict."""
    out = {r.name: r for r in current}
    for r in extra:
        have = out.get(r.name)
        if have is not None:
            if replace(have, nested=()) != replace(r, nested=()):
                raise RelationError(f"{r.name} is included twice in different ways")
            r = replace(r, nested=merge_includes(have.nested, r.nested))
        out[r.name] = r
    return tuple(out.values())


def belongs_to(name: str, target: TableDef, local: Any, foreign: Any) -> Relation:
    return Relation(name, RelationKind.BELONGS_TO, target, _tuple(local), _tuple(foreign))


def has_one(name: str, target: TableDef, local: Any, foreign: Any) -> Relation:
    return Relation(name, RelationKind.HAS_ONE, target, _tuple(local), _tuple(foreign))


def has_many(name: str, target: TableDef, local: Any, foreign: Any) -> Relation:
    return Relation(name, RelationKind.HAS_MANY, target, _tuple(local), _tuple(foreign))


def _through(kind: RelationKind, name: str, target: TableDef, local: Any, pivot: TableDef, near: Any, far: Any, key: Any, **morph: Any) -> Relation:
    return Relation(name, kind, target, _tuple(local), _tuple(near), pivot, _tuple(far), _tuple(key), **morph)


def belongs_to_many(name: str, target: TableDef, local: Any, pivot: TableDef, near: Any, far: Any, key: Any) -> Relation:
    return _through(RelationKind.BELONGS_TO_MANY, name, target, local, pivot, near, far, key)


def has_one_through(name: str, target: TableDef, local: Any, pivot: TableDef, near: Any, far: Any, key: Any) -> Relation:
    return _through(RelationKind.HAS_ONE_THROUGH, name, target, local, pivot, near, far, key)


def has_many_through(name: str, target: TableDef, local: Any, pivot: TableDef, near: Any, far: Any, key: Any) -> Relation:
    return _through(RelationKind.HAS_MANY_THROUGH, name, target, local, pivot, near, far, key)


def morph_to(name: str, column: str, local: Any, targets: dict[Any, tuple[TableDef, Any]], unknown: UnknownMorph = UnknownMorph.ERROR) -> Relation:
    known = tuple((v, t, _tuple(k)) for v, (t, k) in targets.items())
    return Relation(name, RelationKind.MORPH_TO, None, _tuple(local), (), morph_column=column, morph_targets=known, unknown=unknown)


def morph_one(name: str, target: TableDef, local: Any, foreign: Any, column: str, value: Any) -> Relation:
    return Relation(name, RelationKind.MORPH_ONE, target, _tuple(local), _tuple(foreign), morph_column=column, morph_value=value)


def morph_many(name: str, target: TableDef, local: Any, foreign: Any, column: str, value: Any) -> Relation:
    return Relation(name, RelationKind.MORPH_MANY, target, _tuple(local), _tuple(foreign), morph_column=column, morph_value=value)


def morph_to_many(name: str, target: TableDef, local: Any, pivot: TableDef, near: Any, far: Any, key: Any, column: str, value: Any) -> Relation:
    return _through(RelationKind.MORPH_TO_MANY, name, target, local, pivot, near, far, key, morph_column=column, morph_value=value)


__all__ = [
    "Relation", "RelationKind", "UnknownMorph", "belongs_to", "belongs_to_many", "has_many", "has_many_through", "has_one",
    "has_one_through", "merge_includes", "morph_many", "morph_one", "morph_to", "morph_to_many",
]
