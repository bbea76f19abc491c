"""Entity queries: a declared table with its implicit predicates, relations, pages and cursors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import nullcontext
from dataclasses import dataclass, replace
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import ArgumentError, MultipleRowsError, QueryShapeError, RowNotFoundError
from ..functions.aggregates import Aggregate, IntegerAverage, avg, max_, min_, sum_
from ..functions.expr import Alias, Condition, Expr, LikePosition, Like, Order, Scope, order_term, where_any
from ..sources.tables import ScopeSelection, TableDef, Trashed
from .keyset import Cursor, after, filter_signature, order_signature, require_named, reverse_orders, with_tie_break
from .query import Cte, Query, TypedCte
from .relations import Relation, merge_includes


class Consistency(Enum):
    """Whether a page and its count may see different versions of the data."""

    COMMITTED, SNAPSHOT = "committed", "snapshot"


@dataclass(frozen=True)
class Page:
    rows: list[Any]
    offset: int
    size: int
    has_more: bool
    total: int | None = None


@dataclass(frozen=True)
class CursorPage:
    rows: list[Any]
    has_more: bool
    next: Cursor | None
    previous: Cursor | None


@dataclass(frozen=True)
class ProjectionColumn:
    alias: str
    expr: Expr
    required: bool = False


@dataclass(frozen=True)
class Projection:
    """Named columns and what is made of a row."""

    name: str
    columns: tuple[ProjectionColumn, ...]
    build: Callable[[Row], Any] | None = None

    def __post_init__(self) -> None:
        if not self.columns:
            raise QueryShapeError(f"{self.name}: a projection needs a column")
        if len({c.alias.lower() for c in self.columns}) != len(self.columns):
            raise QueryShapeError(f"{self.name}: an alias occurs twice")

    def made(self, row: Row) -> Any:
        for c in self.columns:
            if c.required and row[c.alias] is None:
                raise RowNotFoundError(f"{self.name}.{c.alias} is null")
        return self.build(row) if self.build else row


@dataclass(frozen=True)
class RelationAggregate:
    alias: str
    relation: Relation
    aggregate: Aggregate | None = None
    exists: bool = False


class _Paging:
    """Terminals of entity and projected queries."""

    engine: Any

    def frame(self) -> DataFrame:
        raise NotImplementedError

    def _made(self, rows: Iterable[Row]) -> list[Any]:
        return list(rows)

    def _snapshot(self, consistency: Consistency) -> Any:
        return self.engine.snapshot() if consistency is Consistency.SNAPSHOT else nullcontext()

    def get(self) -> list[Any]:
        return self._made(self.frame().collect())

    def first(self) -> Any | None:
        return next(iter(self._made(self.frame().limit(1).collect())), None)

    def first_or_fail(self) -> Any:
        row = self.first()
        if row is None:
            raise RowNotFoundError("no row")
        return row

    def single_or_none(self) -> Any | None:
        rows = self._made(self.frame().limit(2).collect())
        if len(rows) > 1:
            raise MultipleRowsError("more than one row")
        return rows[0] if rows else None

    def single(self) -> Any:
        row = self.single_or_none()
        if row is None:
            raise RowNotFoundError("no row")
        return row

    def exists(self) -> bool:
        return not self.frame().isEmpty()

    def stream(self) -> Iterator[Any]:
        for row in self.frame().toLocalIterator(prefetchPartitions=True):
            yield from self._made([row])

    def chunk(self, size: int = 500) -> Iterator[list[Any]]:
        """Pages by key, one after the other; each one is read when it is asked for."""
        if size < 1:
            raise ArgumentError("a chunk has a row")
        cursor = None
        while True:
            page = self.cursor_page(size, cursor)  # type: ignore[attr-defined]
            if page.rows:
                yield page.rows
            if not page.has_more:
                return
            cursor = page.next

    chunk_by_id = chunk

    def lazy(self, size: int = 500) -> Iterator[Any]:
        for rows in self.chunk(size):
            yield from rows


@dataclass(frozen=True)
class EntityQuery(_Paging):
    engine: Any
    table: TableDef
    selection: ScopeSelection = ScopeSelection()
    conditions: tuple[Condition, ...] = ()
    orders: tuple[Order, ...] = ()
    includes: tuple[Relation, ...] = ()
    filters: tuple[tuple[Relation, bool], ...] = ()
    aggregates: tuple[RelationAggregate, ...] = ()
    ctes: tuple[Cte, ...] = ()

    # Building.
    def at(self, schema: str | None = None, table: str | None = None) -> EntityQuery:
        if self.conditions or self.orders or self.includes or self.filters or self.aggregates or self.ctes:
            raise QueryShapeError("the table is chosen before anything else")
        return replace(self, table=self.table.for_table(schema, table))

    def where(self, condition: Condition | Callable[[TableDef], Condition] | None) -> EntityQuery:
        built = condition(self.table) if callable(condition) and not isinstance(condition, Expr) else condition
        return self if built is None else replace(self, conditions=(*self.conditions, built))

    def where_if(self, test: bool, build: Callable[[TableDef], Condition]) -> EntityQuery:
        return self.where(build) if test else self

    def where_if_not_null(self, value: Any, build: Callable[[TableDef, Any], Condition]) -> EntityQuery:
        return self if value is None else self.where(build(self.table, value))

    def where_in_if_not_empty(self, values: Sequence[Any], build: Callable[[TableDef, Sequence[Any]], Condition]) -> EntityQuery:
        return self.where(build(self.table, values)) if values else self

    def search(self, term: str | None, columns: Sequence[str], position: LikePosition = LikePosition.ANYWHERE) -> EntityQuery:
        """Any of the columns holds the term, as it is; a blank term asks for nothing."""
        if term is None or not term.strip():
            return self
        if not columns:
            raise QueryShapeError("a search needs columns")
        return self.where(where_any([self.table[c] for c in columns], lambda c: Like(c, term, position)))

    def order_by(self, *terms: Any) -> EntityQuery:
        return replace(self, orders=self._terms(terms))

    def then_by(self, *terms: Any) -> EntityQuery:
        return replace(self, orders=(*self.orders, *self._terms(terms)))

    def order_by_named(self, column: str, descending: bool = False) -> EntityQuery:
        return replace(self, orders=(Order(self.table[column], descending),))

    def _terms(self, terms: Sequence[Any]) -> tuple[Order, ...]:
        if len(terms) == 1 and callable(terms[0]) and not isinstance(terms[0], Expr):
            terms = terms[0](self.table)
        return tuple(order_term(self.table[t] if isinstance(t, str) else t) for t in terms)

    def with_trashed(self) -> EntityQuery:
        return self._trash(Trashed.WITH)

    def only_trashed(self) -> EntityQuery:
        return self._trash(Trashed.ONLY)

    def without_trashed(self) -> EntityQuery:
        return self._trash(Trashed.WITHOUT)

    def _trash(self, mode: Trashed) -> EntityQuery:
        return replace(self, selection=replace(self.selection, trashed=mode))

    def without_scope(self, name: str) -> EntityQuery:
        return replace(self, selection=self.selection.without(name))

    def without_global_scopes(self) -> EntityQuery:
        return replace(self, selection=replace(self.selection, no_globals=True))

    def with_typed_cte(self, cte: TypedCte) -> EntityQuery:
        return replace(self, ctes=(*self.ctes, cte.to_cte()))

    def _relation(self, r: Relation | str) -> Relation:
        if isinstance(r, Relation):
            return r
        if r not in self.table.relations:
            raise QueryShapeError(f"{self.table.name} has no relation {r}")
        return self.table.relations[r]

    def include(self, *relations: Relation | str) -> EntityQuery:
        return replace(self, includes=merge_includes(self.includes, [self._relation(r) for r in relations]))

    def where_has(self, relation: Relation | str) -> EntityQuery:
        return replace(self, filters=(*self.filters, (self._relation(relation), True)))

    def where_doesnt_have(self, relation: Relation | str) -> EntityQuery:
        return replace(self, filters=(*self.filters, (self._relation(relation), False)))

    def with_where_has(self, relation: Relation | str) -> EntityQuery:
        return self.where_has(relation).include(relation)

    def with_aggregates(self, *specs: RelationAggregate) -> EntityQuery:
        names = [c.name.lower() for c in self.table.columns] + [a.alias.lower() for a in (*self.aggregates, *specs)]
        if len(set(names)) != len(names):
            raise QueryShapeError("an aggregate's name is taken")
        return replace(self, aggregates=(*self.aggregates, *specs))

    def _with(self, kind: str, relation: Relation | str, agg: Aggregate | None, alias: str | None, exists: bool = False) -> EntityQuery:
        r = self._relation(relation)
        return self.with_aggregates(RelationAggregate(alias or f"{r.name}_{kind}", r, agg, exists))

    def with_count(self, relation: Relation | str, alias: str | None = None) -> EntityQuery:
        return self._with("count", relation, None, alias)

    def with_exists(self, relation: Relation | str, alias: str | None = None) -> EntityQuery:
        return self._with("exists", relation, None, alias, True)

    def with_sum(self, relation: Relation | str, operand: Any, alias: str | None = None) -> EntityQuery:
        return self._with("sum", relation, sum_(operand), alias)

    def with_min(self, relation: Relation | str, operand: Any, alias: str | None = None) -> EntityQuery:
        return self._with("min", relation, min_(operand), alias)

    def with_max(self, relation: Relation | str, operand: Any, alias: str | None = None) -> EntityQuery:
        return self._with("max", relation, max_(operand), alias)

    def with_avg_exact(self, relation: Relation | str, operand: Any, alias: str | None = None, exact_scale: int = 6) -> EntityQuery:
        return self._with("avg", relation, avg(operand, integers=IntegerAverage.EXACT_DECIMAL, exact_scale=exact_scale), alias)

    def with_avg_truncating(self, relation: Relation | str, operand: Any, alias: str | None = None) -> EntityQuery:
        return self._with("avg", relation, avg(operand, integers=IntegerAverage.TRUNCATING), alias)

    # Lowering.
    def _scope(self, df: DataFrame) -> Scope:
        label = self.table.label
        scope = Scope({label: tuple(df.columns)}, None, self.engine, {self.table: label})
        for cte in self.ctes:
            scope = replace(scope, ctes=scope.ctes | {cte.name: cte.lower(Scope(engine=self.engine, ctes=scope.ctes), 100)})
        return scope

    def all_conditions(self) -> list[Condition]:
        return [*self.table.read_conditions(self.selection), *self.conditions]

    def scoped(self, extra: Sequence[Condition] = ()) -> DataFrame:
        """The table's columns, in scope and filter; no order, no relations loaded."""
        df = self.engine.table(self.table.name)
        scope = self._scope(df)
        df = df.alias(self.table.label).select(*[F.col(f"{self.table.label}.`{c.name}`") for c in self.table.columns]).alias(self.table.label)
        for c in [*self.all_conditions(), *extra]:
            df = df.where(c.to_column(scope))
        for relation, wanted in self.filters:
            df = relation.has(self.engine, df, not wanted)
        return df

    def _ordered(self, df: DataFrame, orders: Sequence[Order]) -> DataFrame:
        if not orders:
            return df
        return df.orderBy(*[o.apply(F.col(f"`{o.expr.output_name()}`") if o.expr.output_name() else o.expr.to_column(Scope(engine=self.engine))) for o in orders])

    def _loaded(self, df: DataFrame) -> DataFrame:
        for spec in self.aggregates:
            df = spec.relation.aggregate(self.engine, df, spec.alias, spec.aggregate, spec.exists)
        for relation in self.includes:
            df = relation.include(self.engine, df)
        return df

    def frame(self) -> DataFrame:
        return self._ordered(self._loaded(self.scoped()), self.orders)

    def compile(self) -> str:
        return self.frame()._jdf.queryExecution().optimizedPlan().toString()

    def stable_orders(self) -> tuple[Order, ...]:
        """The order, ended by the key; without an order, the key; without both, refused."""
        if not self.table.primary_key and not self.orders:
            raise QueryShapeError(f"{self.table.name} has no key: a page needs an order")
        return with_tie_break(self.orders, [self.table[k] for k in self.table.primary_key])

    # Terminals.
    def count(self) -> int:
        return self.scoped().count()

    def exists(self) -> bool:
        return not self.scoped().isEmpty()

    def _page_of(self, df: DataFrame, orders: Sequence[Order], size: int, offset: int = 0) -> list[Row]:
        """The rows of a page and one more; relations are loaded for these alone."""
        rows = self._ordered(df, orders)
        rows = rows.offset(offset).limit(size + 1) if offset else rows.limit(size + 1)
        return self._ordered(self._loaded(rows), orders).collect()

    def page(self, size: int = 25, offset: int = 0, total: bool = False, consistency: Consistency = Consistency.COMMITTED) -> Page:
        if size < 1 or offset < 0:
            raise ArgumentError("a page starts at 0 or later and has a row")
        orders = self.stable_orders()
        with self._snapshot(consistency):
            df = self.scoped()
            rows = self._page_of(df, orders, size, offset)
            n = df.count() if total else None
        return Page(rows[:size], offset, size, len(rows) > size, n)

    def cursor_page(
        self, size: int = 25, after_: Cursor | None = None, before: Cursor | None = None, consistency: Consistency = Consistency.COMMITTED
    ) -> CursorPage:
        if size < 1:
            raise ArgumentError("a page has a row")
        if after_ is not None and before is not None:
            raise ArgumentError("a page is after a cursor or before one")
        orders = self.stable_orders()
        require_named(orders, "a cursor")
        conditions = self.all_conditions()
        at, way = (before, reverse_orders(orders)) if before is not None else (after_, orders)
        if at is not None:
            at.check(orders, conditions)
        with self._snapshot(consistency):
            df = self.scoped([after(way, at.keys)] if at is not None else [])
            rows = self._page_of(df, way, size)
        more, rows = len(rows) > size, rows[:size]
        if before is not None:
            rows = rows[::-1]
        mark = lambda row: Cursor(order_signature(orders), filter_signature(conditions), tuple(row[o.expr.output_name()] for o in orders))
        later = more if before is None else bool(rows)
        return CursorPage(rows, more, mark(rows[-1]) if rows and later else None, mark(rows[0]) if rows and (at is not None) else None)

    def attach_includes(self, rows: DataFrame) -> DataFrame:
        return self._loaded(rows)

    def load_missing(self, rows: DataFrame, relations: Sequence[Relation | str]) -> DataFrame:
        for r in map(self._relation, relations):
            if r.name not in rows.columns:
                rows = r.include(self.engine, rows)
        return rows

    def select(self, *columns: Any, distinct: bool = False) -> ProjectedQuery:
        """A read-only query of columns, of a projection, or of what a function of the table names."""
        if len(columns) == 1 and isinstance(columns[0], Projection):
            return ProjectedQuery(self, columns[0], distinct)
        if len(columns) == 1 and callable(columns[0]) and not isinstance(columns[0], Expr):
            columns = tuple(columns[0](self.table))
        made = tuple(ProjectionColumn(self._alias(i, c), self.table[c] if isinstance(c, str) else c) for i, c in enumerate(columns))
        return ProjectedQuery(self, Projection("columns", made), distinct)

    def _alias(self, i: int, c: Any) -> str:
        return c if isinstance(c, str) else c.output_name() or f"c{i}"

    def select2(self, build: Callable[[TableDef], Sequence[Expr]]) -> ProjectedQuery:
        return self._tuple(build, 2)

    def select3(self, build: Callable[[TableDef], Sequence[Expr]]) -> ProjectedQuery:
        return self._tuple(build, 3)

    def select4(self, build: Callable[[TableDef], Sequence[Expr]]) -> ProjectedQuery:
        return self._tuple(build, 4)

    def _tuple(self, build: Callable[[TableDef], Sequence[Expr]], n: int) -> ProjectedQuery:
        exprs = build(self.table)
        if len(exprs) != n:
            raise QueryShapeError(f"{n} columns were to come, {len(exprs)} did")
        return ProjectedQuery(self, Projection("tuple", tuple(ProjectionColumn(f"c{i}", e) for i, e in enumerate(exprs)), tuple))

    def watch(self, strategy: Any = None, interval: float = 5.0, tables: Sequence[str] | None = None) -> Any:
        from ..streaming.watch import Watch, WatchStrategy

        names = list(tables or [self.table.name, *(r.target.name for r in self.includes if r.target is not None)])
        return Watch(self.get, names, self.engine.hub, strategy or WatchStrategy.LOCAL_WRITES, interval)

    def repository(self) -> Any:
        from .repository import Repository

        return Repository(self.engine, self.table, self.selection)


@dataclass(frozen=True)
class ProjectedQuery(_Paging):
    """Columns of an entity query; it cannot write or load relations."""

    base: EntityQuery
    projection: Projection
    distinct: bool = False
    groups: tuple[Expr, ...] = ()
    having_: Condition | None = None
    orders: tuple[Order, ...] | None = None

    @property
    def engine(self) -> Any:  # type: ignore[override]
        return self.base.engine

    def group_by(self, *columns: Expr) -> ProjectedQuery:
        return replace(self, groups=tuple(columns))

    def having(self, condition: Condition) -> ProjectedQuery:
        return replace(self, having_=condition)

    def order_by(self, *terms: Any) -> ProjectedQuery:
        return replace(self, orders=tuple(map(order_term, terms)))

    @property
    def _orders(self) -> tuple[Order, ...]:
        return self.base.orders if self.orders is None else self.orders

    def _query(self, extra: Sequence[Condition] = (), orders: Sequence[Order] = ()) -> Query:
        from .query import Source

        q = Query(Source((), self.base.table.label, frame=self.base.scoped(extra), ref=self.base.table))
        columns = [Alias(c.expr.expr if isinstance(c.expr, Alias) else c.expr, c.alias) for c in self.projection.columns]
        q = q.select_distinct(*columns) if self.distinct else q.select(*columns)
        q = q.group_by(*self.groups) if self.groups else q
        q = q.having(self.having_) if self.having_ is not None else q
        return q.order_by(*orders) if orders else q

    def frame(self) -> DataFrame:
        return self._query(orders=self._orders).frame(self.engine)

    def _made(self, rows: Iterable[Row]) -> list[Any]:
        return [self.projection.made(r) for r in rows]

    def count(self) -> int:
        return self._query().count(self.engine)

    def _check_order(self, what: str) -> tuple[Order, ...]:
        if not self._orders:
            raise QueryShapeError(f"{what} of a projection needs an order")
        if self.distinct or self.groups:
            have = {c.alias.lower() for c in self.projection.columns} | {c.expr.text() for c in self.projection.columns}
            for o in self._orders:
                if (o.expr.output_name() or "").lower() not in have and o.expr.text() not in have:
                    raise QueryShapeError(f"{what} of distinct or grouped rows is ordered by their own columns")
        return self._orders

    def page(self, size: int = 25, offset: int = 0, total: bool = False, consistency: Consistency = Consistency.COMMITTED) -> Page:
        orders = self._check_order("a page")
        with self._snapshot(consistency):
            q = self._query(orders=orders)
            rows = q.paged(offset, size + 1).frame(self.engine).collect()
            n = q.count(self.engine) if total else None
        return Page(self._made(rows[:size]), offset, size, len(rows) > size, n)

    def cursor_page(self, size: int = 25, after_: Cursor | None = None, before: Cursor | None = None, consistency: Consistency = Consistency.COMMITTED) -> CursorPage:
        orders = self._check_order("a cursor")
        require_named(orders, "a cursor")
        names = {c.expr.text(): c.alias for c in self.projection.columns}
        aliases = {c.alias.lower(): c.alias for c in self.projection.columns}
        place = [names.get(o.expr.text()) or aliases.get(o.expr.output_name().lower()) for o in orders]
        if None in place:
            raise QueryShapeError("a cursor is ordered by columns of the projection")
        conditions = self.base.all_conditions()
        at, way = (before, reverse_orders(orders)) if before is not None else (after_, orders)
        extra = []
        if at is not None:
            at.check(orders, conditions)
            extra = [after(way, at.keys)]
        with self._snapshot(consistency):
            rows = self._query(extra, way).top(size + 1).frame(self.engine).collect()
        more, rows = len(rows) > size, rows[:size]
        rows = rows[::-1] if before is not None else rows
        mark = lambda row: Cursor(order_signature(orders), filter_signature(conditions), tuple(row[p] for p in place))
        later = more if before is None else bool(rows)
        return CursorPage(self._made(rows), more, mark(rows[-1]) if rows and later else None, mark(rows[0]) if rows and at is not None else None)

    def watch(self, tables: Sequence[str], strategy: Any = None, interval: float = 5.0) -> Any:
        from ..streaming.watch import Watch, WatchStrategy

        return Watch(lambda: self.frame().collect(), list(tables), self.engine.hub, strategy or WatchStrategy.LOCAL_WRITES, interval)


__all__ = ["Consistency", "CursorPage", "EntityQuery", "Page", "ProjectedQuery", "Projection", "ProjectionColumn", "RelationAggregate"]
