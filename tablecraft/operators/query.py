"""Immutable queries, lowered to DataFrames.

Every builder call gives a new query. Lowering checks the shape, then declares
one logical plan; nothing runs before a terminal. Catalyst chooses the joins.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import ArgumentError, CapabilityError, QueryShapeError, RecursionLimitError, ResultTypeError, RowNotFoundError
from ..functions.aggregates import Aggregate, avg, count, count_all, max_, min_, sum_
from ..functions.expr import Alias, Col, Condition, Expr, Lit, Order, Scope, order_term
from ..functions.typed import TypedCol

MOST_PARTS = 4
HINTS = ("broadcast", "merge", "shuffle_hash", "shuffle_replicate_nl", "coalesce", "repartition", "rebalance")
SYSTEM_LOCKS = ("update lock", "shared lock")
LONGEST_RECURSION = 32767


class JoinKind(Enum):
    INNER, LEFT, RIGHT, FULL, CROSS = "inner", "left", "right", "full", "cross"


def name_parts(identifier: str | Sequence[str]) -> tuple[str, ...]:
    """Parts of a dotted name; dots within brackets or backticks belong to a part."""
    if not isinstance(identifier, str):
        parts = tuple(identifier)
    else:
        parts, part, quote = (), "", ""
        for ch in identifier:
            if quote:
                quote, part = ("", part) if ch == quote else (quote, part + ch)
            elif ch in "[`":
                quote = {"[": "]", "`": "`"}[ch]
            elif ch == ".":
                parts, part = (*parts, part), ""
            else:
                part += ch
        if quote:
            raise ArgumentError(f"{identifier!r}: a quote is not closed")
        parts = (*parts, part)
    if not 1 <= len(parts) <= MOST_PARTS or any(not p.strip() for p in parts):
        raise ArgumentError(f"{identifier!r} is not a name of 1 to {MOST_PARTS} parts")
    return parts


@dataclass(frozen=True)
class Source:
    """What FROM reads: a table by its parts, a query, or a frame, under an alias."""

    parts: tuple[str, ...] = ()
    alias: str | None = None
    query: Any = None
    frame: DataFrame | None = None
    ref: Any = None

    @property
    def label(self) -> str:
        return self.alias or (self.parts[-1] if self.parts else "source")

    def lower(self, scope: Scope) -> DataFrame:
        if self.frame is not None:
            return self.frame
        if self.query is not None:
            self.query.require_named_columns("a derived table")
            return self.query.lower(replace(scope, sources={}, bindings={}, outer=scope.outer))
        common = {k.lower(): v for k, v in scope.ctes.items()}
        if len(self.parts) == 1 and self.parts[0].lower() in common:
            return common[self.parts[0].lower()]
        if scope.engine is None:
            raise QueryShapeError(f"{'.'.join(self.parts)}: an engine is needed to find tables")
        return scope.engine.table(self.parts)

    def text(self) -> str:
        inner = self.query.text() if self.query is not None else ".".join(self.parts).lower() or f"frame{id(self.frame)}"
        return f"{inner} as {self.label}"


def source(of: Any, as_: str | None = None, ref: Any = None) -> Source:
    """A source from a name, parts, a query, a frame, a table definition or a typed common table."""
    if isinstance(of, Source):
        return replace(of, alias=as_ or of.alias)
    if isinstance(of, str):
        return Source(name_parts(of), as_, ref=ref)
    if isinstance(of, Query | SetQuery):
        if not as_:
            raise QueryShapeError("a derived table needs an alias")
        return Source((), as_, query=of, ref=ref)
    if isinstance(of, DataFrame):
        return Source((), as_ or "frame", frame=of, ref=ref)
    if hasattr(of, "as_source"):
        return of.as_source(as_)
    return Source(name_parts(of), as_, ref=ref)


@dataclass(frozen=True)
class Join:
    kind: JoinKind
    source: Source
    on: Condition | None


@dataclass(frozen=True)
class Cte:
    """A named query; a recursive one has a second member that reads the name."""

    name: str
    query: Any
    columns: tuple[str, ...] = ()
    recursive: Any = None

    def __post_init__(self) -> None:
        if self.recursive is not None and not self.columns:
            raise QueryShapeError(f"{self.name}: a recursive table needs its column list")
        if len({c.lower() for c in self.columns}) != len(self.columns):
            raise QueryShapeError(f"{self.name}: a column is listed twice")

    def lower(self, scope: Scope, most: int) -> DataFrame:
        named = lambda df: self._named(df)
        first = named(self.query.lower(scope))
        if self.recursive is None:
            return first
        # Level by level, each cut off from the plan before it.
        level = _settled(first, scope.engine)
        levels, depth = [level], 0
        while not level.isEmpty():
            depth += 1
            if most and depth > most:
                raise RecursionLimitError(f"{self.name} did not end within {most} levels")
            step = self.recursive.lower(replace(scope, ctes=scope.ctes | {self.name: level}))
            level = _settled(named(step), scope.engine)
            levels.append(level)
        out = levels[0]
        for level in levels[1:]:
            out = out.union(level)
        return out

    def _named(self, df: DataFrame) -> DataFrame:
        if not self.columns:
            return df
        if len(self.columns) != len(df.columns):
            raise QueryShapeError(f"{self.name} lists {len(self.columns)} columns, its query has {len(df.columns)}")
        return df.toDF(*self.columns)


def _settled(df: DataFrame, engine: Any) -> DataFrame:
    return engine.settled(df) if engine is not None else df


class _Readable:
    """What queries and set queries share: terminals, and use as a source."""

    def lower(self, scope: Scope) -> DataFrame:
        raise NotImplementedError

    def frame(self, engine: Any = None) -> DataFrame:
        return self.lower(Scope(engine=engine))

    def compile(self, engine: Any = None) -> str:
        """The optimised plan as text; nothing runs."""
        return self.frame(engine)._jdf.queryExecution().optimizedPlan().toString()

    # Terminals.
    def get(self, engine: Any = None) -> list[Row]:
        return self.frame(engine).collect()

    def get_as(self, build: Callable[[Row], Any], engine: Any = None) -> list[Any]:
        return [build(r) for r in self.get(engine)]

    def stream(self, engine: Any = None) -> Iterator[Row]:
        return self.frame(engine).toLocalIterator(prefetchPartitions=True)

    def chunk(self, size: int = 500, engine: Any = None) -> Iterator[list[Row]]:
        """The rows in runs of ``size``: one ordered pass, a partition at a time on the driver."""
        if size < 1:
            raise ArgumentError("a chunk has a row")
        if not self.orders:  # type: ignore[attr-defined]
            raise QueryShapeError("chunks need an order")
        rows = self.stream(engine)
        while run := list(itertools.islice(rows, size)):
            yield run

    def lazy(self, size: int = 500, engine: Any = None) -> Iterator[Row]:
        for run in self.chunk(size, engine):
            yield from run

    def first(self, engine: Any = None) -> Row | None:
        return next(iter(self.frame(engine).limit(1).collect()), None)

    def first_or_fail(self, engine: Any = None) -> Row:
        row = self.first(engine)
        if row is None:
            raise RowNotFoundError("no row")
        return row

    def value(self, column: str, engine: Any = None) -> Any:
        row = self.frame(engine).select(column).limit(1).collect()
        return row[0][0] if row else None

    def pluck(self, column: str, engine: Any = None) -> list[Any]:
        return [r[0] for r in self.frame(engine).select(column).collect()]

    def exists(self, engine: Any = None) -> bool:
        return not self._unordered().frame(engine).isEmpty()

    def doesnt_exist(self, engine: Any = None) -> bool:
        return not self.exists(engine)

    def count(self, engine: Any = None) -> int:
        return self.count_rows().frame(engine).first()[0]

    def count_distinct_columns(self, columns: Sequence[str], engine: Any = None) -> int:
        return self.count_distinct(columns).frame(engine).first()[0]

    def _one(self, agg: Aggregate, engine: Any, as_: type | None) -> Any:
        got = self.aggregate_rows(agg).frame(engine).first()[0]
        if as_ is None or got is None or isinstance(got, as_):
            return got
        if as_(got) != got:
            raise ResultTypeError(f"{got!r} is no {as_.__name__} without loss")
        return as_(got)

    def sum(self, column: str, engine: Any = None, as_: type | None = None) -> Any:
        return self._one(sum_(column), engine, as_)

    def avg(self, column: str, engine: Any = None, as_: type | None = None) -> Any:
        return self._one(avg(column), engine, as_)

    def min(self, column: str, engine: Any = None, as_: type | None = None) -> Any:
        return self._one(min_(column), engine, as_)

    def max(self, column: str, engine: Any = None, as_: type | None = None) -> Any:
        return self._one(max_(column), engine, as_)

    # Shapes of a count follow the rows that come back.
    def count_rows(self) -> Query:
        return Query(Source((), "counted", query=self)).select(count_all().as_("count"))

    def aggregate_rows(self, agg: Aggregate) -> Query:
        return Query(Source((), "rows", query=self)).select(agg.as_("value"))

    def count_distinct(self, keys: Sequence[str | Expr]) -> Query:
        """Distinct keys among the rows; of several parts a null is a value like others."""
        if not keys:
            raise QueryShapeError("a distinct count needs a key")
        columns = [Col(k) if isinstance(k, str) else k for k in keys]
        rows = Query(Source((), "keyed", query=self))
        if len(columns) == 1:
            return rows.select(count(columns[0], distinct=True).as_("count"))
        return rows.select_distinct(*[c.as_(f"k{i}") for i, c in enumerate(columns)]).count_rows()

    def _unordered(self) -> Any:
        return self

    def require_named_columns(self, what: str) -> None:
        names = self.output_names()
        if names is None:
            return
        if None in names:
            raise QueryShapeError(f"{what}: every column needs a name")
        if len({n.lower() for n in names}) != len(names):
            raise QueryShapeError(f"{what}: a column name occurs twice")

    def require_one_column(self, what: str) -> None:
        names = self.output_names()
        if names is not None and len(names) != 1:
            raise QueryShapeError(f"{what} needs one column, not {len(names)}")

    def output_names(self) -> list[str | None] | None:
        """Names of the columns, None for those without; None if all columns of the source come."""
        raise NotImplementedError


@dataclass(frozen=True)
class Query(_Readable):
    source: Source
    joins: tuple[Join, ...] = ()
    projection: tuple[Expr, ...] = ()
    conditions: tuple[Condition, ...] = ()
    groups: tuple[Expr, ...] = ()
    having_: Condition | None = None
    orders: tuple[Order, ...] = ()
    distinct: bool = False
    offset_: int | None = None
    rows_: int | None = None
    top_: int | None = None
    hints: tuple[str, ...] = ()
    ctes: tuple[Cte, ...] = ()
    max_recursion: int = 100
    raw_names: dict = field(default_factory=dict, compare=False, repr=False)

    # Building.
    def select(self, *columns: str | Expr) -> Query:
        return replace(self, projection=_exprs(columns), distinct=False)

    def select_distinct(self, *columns: str | Expr) -> Query:
        return replace(self, projection=_exprs(columns), distinct=True)

    def join(self, kind: JoinKind, of: Any, as_: str | None = None, on: Condition | None = None) -> Query:
        if (kind is JoinKind.CROSS) != (on is None):
            raise QueryShapeError("a cross join takes no condition, every other join needs one")
        return replace(self, joins=(*self.joins, Join(kind, source(of, as_), on)))

    def inner_join(self, of: Any, as_: str | None = None, on: Condition | None = None) -> Query:
        return self.join(JoinKind.INNER, of, as_, on)

    def left_join(self, of: Any, as_: str | None = None, on: Condition | None = None) -> Query:
        return self.join(JoinKind.LEFT, of, as_, on)

    def right_join(self, of: Any, as_: str | None = None, on: Condition | None = None) -> Query:
        return self.join(JoinKind.RIGHT, of, as_, on)

    def full_join(self, of: Any, as_: str | None = None, on: Condition | None = None) -> Query:
        return self.join(JoinKind.FULL, of, as_, on)

    def cross_join(self, of: Any, as_: str | None = None) -> Query:
        return self.join(JoinKind.CROSS, of, as_)

    def join_sub(self, kind: JoinKind, query: Any, as_: str, on: Condition | None = None) -> Query:
        return self.join(kind, query, as_, on)

    def where(self, condition: Condition | None) -> Query:
        return self if condition is None else replace(self, conditions=(*self.conditions, condition))

    def group_by(self, *columns: str | Expr) -> Query:
        return replace(self, groups=_exprs(columns))

    def having(self, condition: Condition) -> Query:
        return replace(self, having_=condition)

    def order_by(self, *terms: str | Expr | Order) -> Query:
        return replace(self, orders=tuple(map(order_term, terms)))

    def paged(self, offset: int, rows: int) -> Query:
        if offset < 0 or rows < 1:
            raise ArgumentError("a page starts at 0 or later and has a row")
        if self.top_ is not None:
            raise QueryShapeError("TOP and a page exclude each other")
        return replace(self, offset_=offset, rows_=rows)

    def top(self, n: int) -> Query:
        if n < 1:
            raise ArgumentError("TOP needs a row")
        if self.offset_ is not None:
            raise QueryShapeError("TOP and a page exclude each other")
        return replace(self, top_=n)

    def when(self, test: bool, build: Callable[[Query], Query], otherwise: Callable[[Query], Query] | None = None) -> Query:
        return build(self) if test else otherwise(self) if otherwise else self

    def unless(self, test: bool, build: Callable[[Query], Query]) -> Query:
        return self.when(not test, build)

    def when_not_null(self, value: Any, build: Callable[[Query, Any], Query]) -> Query:
        return self if value is None else build(self, value)

    def with_hint(self, hint: str) -> Query:
        """A hint that Spark knows; a lock has no counterpart and is only kept as a note."""
        name = hint.split("(")[0].strip().lower()
        if name not in HINTS and name not in SYSTEM_LOCKS:
            raise CapabilityError(f"Spark has no hint {hint!r}")
        if self.source.query is not None:
            raise QueryShapeError("a derived table takes no hint")
        return replace(self, hints=(*self.hints, name))

    def shared_lock(self) -> Query:
        return self.with_hint("shared lock")

    def lock_for_update(self) -> Query:
        return self.with_hint("update lock")

    def with_cte(self, name: str, query: Any, columns: Sequence[str] = ()) -> Query:
        return self.with_expression(Cte(name, query, tuple(columns)))

    def with_recursive_cte(self, name: str, anchor: Any, recursive: Any, columns: Sequence[str], max_recursion: int = 100) -> Query:
        return self.with_expression(Cte(name, anchor, tuple(columns), recursive), max_recursion)

    def with_expression(self, cte: Cte, max_recursion: int | None = None) -> Query:
        if cte.name.lower() in {c.name.lower() for c in self.ctes}:
            raise QueryShapeError(f"{cte.name} is there already")
        if max_recursion is not None and not 0 <= max_recursion <= LONGEST_RECURSION:
            raise ArgumentError(f"a recursion limit is from 0 (none) to {LONGEST_RECURSION}")
        most = self.max_recursion if max_recursion is None else max_recursion
        return replace(self, ctes=(*self.ctes, cte), max_recursion=most)

    def with_typed_cte(self, cte: TypedCte) -> Query:
        return self.with_expression(cte.to_cte())

    def union(self, other: Any) -> SetQuery:
        return SetQuery((self,)).union(other)

    def union_all(self, other: Any) -> SetQuery:
        return SetQuery((self,)).union_all(other)

    # Shape.
    @property
    def is_paged(self) -> bool:
        return self.offset_ is not None or self.top_ is not None

    @property
    def is_grouped(self) -> bool:
        return bool(self.groups) or self.having_ is not None or any(e.is_aggregate for e in self.projection)

    @property
    def is_raw(self) -> bool:
        return any(e.is_raw for e in (*self.projection, *self.conditions, *self.groups)) or bool(self.hints)

    def output_names(self) -> list[str | None] | None:
        return [e.output_name() for e in self.projection] if self.projection else None

    def _unordered(self) -> Query:
        return self if self.is_paged else replace(self, orders=())

    def text(self) -> str:
        parts = [
            self.source.text(),
            *(f"{j.kind.value} {j.source.text()} on {j.on.text() if j.on else ''}" for j in self.joins),
            *(e.text() for e in (*self.projection, *self.conditions, *self.groups)),
            self.having_.text() if self.having_ else "",
            *(o.text() for o in self.orders),
            f"{self.distinct} {self.offset_} {self.rows_} {self.top_}",
        ]
        return "|".join(parts)

    def validate(self) -> None:
        if self.offset_ is not None and not self.orders:
            raise QueryShapeError("a page needs an order")
        if self.is_grouped and not self.projection:
            raise QueryShapeError("a grouped query needs its columns")
        labels = [self.source.label.lower(), *(j.source.label.lower() for j in self.joins)]
        if len(set(labels)) != len(labels):
            raise QueryShapeError(f"a source name occurs twice: {labels}")

    # Lowering.
    def lower(self, scope: Scope) -> DataFrame:
        self.validate()
        for cte in self.ctes:
            scope = replace(scope, ctes=scope.ctes | {cte.name: cte.lower(replace(scope, sources={}, bindings={}), self.max_recursion)})
        base = scope
        frames = [(s, s.lower(base)) for s in (self.source, *(j.source for j in self.joins))]
        scope = replace(
            base,
            sources={s.label: tuple(df.columns) for s, df in frames},
            bindings={s.ref: s.label for s, _ in frames if s.ref is not None},
        )
        df = frames[0][1].alias(frames[0][0].label)
        for hint in self.hints:
            df = df if hint in SYSTEM_LOCKS else df.hint(hint)
        for join, (s, other) in zip(self.joins, frames[1:], strict=True):
            other = other.alias(s.label)
            if join.on is None:
                df = df.crossJoin(other)
            else:
                df = df.join(other, join.on.to_column(scope), join.kind.value)
        for condition in self.conditions:
            df = df.where(condition.to_column(scope))
        return self._grouped(df, scope) if self.is_grouped else self._projected(df, scope)

    def _names(self) -> list[str]:
        return [e.output_name() or f"column{i + 1}" for i, e in enumerate(self.projection)]

    def _order_place(self, order: Order) -> int | None:
        """The output column that an order term means, if there is one."""
        name, text = order.expr.output_name(), order.expr.text()
        for i, e in enumerate(self.projection):
            bare = e.expr if isinstance(e, Alias) else e
            if bare.text() == text or (isinstance(order.expr, Col) and isinstance(e, Alias) and "." not in order.expr.name and e.name.lower() == name.lower()):
                return i
        return None

    def _finish(self, df: DataFrame, orders: list) -> DataFrame:
        if orders:
            df = df.orderBy(*orders)
        if self.top_ is not None:
            df = df.limit(self.top_)
        if self.offset_ is not None:
            df = df.offset(self.offset_).limit(self.rows_)
        return df

    def _projected(self, df: DataFrame, scope: Scope) -> DataFrame:
        if not self.projection:
            df = df.distinct() if self.distinct else df
            return self._finish(df, [o.apply(o.expr.to_column(scope)) for o in self.orders])
        out = [e.to_column(scope).alias(f"__s{i}") for i, e in enumerate(self.projection)]
        orders, hidden = [], []
        for i, o in enumerate(self.orders):
            place = self._order_place(o)
            if place is None:
                if self.distinct:
                    raise QueryShapeError("a distinct query is ordered by its own columns")
                hidden.append(o.expr.to_column(scope).alias(f"__o{i}"))
            orders.append(o.apply(F.col(f"__o{i}" if place is None else f"__s{place}")))
        df = df.select(*out, *hidden)
        df = df.distinct() if self.distinct else df
        df = self._finish(df, orders)
        return df.select(*[F.col(f"__s{i}").alias(n) for i, n in enumerate(self._names())])

    def _grouped(self, df: DataFrame, scope: Scope) -> DataFrame:
        out = [e.to_column(scope).alias(f"__s{i}") for i, e in enumerate(self.projection)]
        extra, orders = [], []
        if self.having_ is not None:
            extra.append(self.having_.to_column(scope).alias("__having"))
        for i, o in enumerate(self.orders):
            place = self._order_place(o)
            if place is None:
                extra.append(o.expr.to_column(scope).alias(f"__o{i}"))
            orders.append(o.apply(F.col(f"__o{i}" if place is None else f"__s{place}")))
        keys = [g.to_column(scope) for g in self.groups]
        if keys:
            got = df.groupBy(*keys).agg(*out, *extra)
            names = [*(f"__k{i}" for i in range(len(keys))), *(f"__s{i}" for i in range(len(out)))]
            got = got.toDF(*names, *got.columns[len(names) :])
        else:
            got = df.select(*out, *extra)  # stays open for references to an outer query
        if self.having_ is not None:
            got = got.where("__having")
        visible = [f"__s{i}" for i in range(len(out))]
        if self.distinct:
            if any(self._order_place(o) is None for o in self.orders):
                raise QueryShapeError("a distinct query is ordered by its own columns")
            got = got.select(*visible).distinct()
        named = [F.col(v).alias(n) for v, n in zip(visible, self._names(), strict=True)]
        return self._finish(got, orders).select(*named)


def _exprs(columns: Sequence[str | Expr]) -> tuple[Expr, ...]:
    return tuple(Col(c) if isinstance(c, str) else c for c in columns)


def from_(of: Any, as_: str | None = None) -> Query:
    """A query over a table name, parts, a query, a frame or a definition."""
    return Query(source(of, as_))


query = from_


def from_parts(parts: Sequence[str], as_: str | None = None) -> Query:
    return Query(Source(name_parts(tuple(parts)), as_))


def from_sub(inner: Any, as_: str) -> Query:
    return Query(source(inner, as_))


def from_source(of: Source) -> Query:
    return Query(of)


@dataclass(frozen=True)
class SetQuery(_Readable):
    """Members from left to right; each boundary says whether it keeps duplicates."""

    members: tuple[Any, ...]
    all_flags: tuple[bool, ...] = ()
    orders: tuple[Order, ...] = ()
    offset_: int | None = None
    rows_: int | None = None

    def union(self, other: Any) -> SetQuery:
        return replace(self, members=(*self.members, other), all_flags=(*self.all_flags, False))

    def union_all(self, other: Any) -> SetQuery:
        return replace(self, members=(*self.members, other), all_flags=(*self.all_flags, True))

    def order_by(self, *terms: str | Expr | Order) -> SetQuery:
        return replace(self, orders=tuple(map(order_term, terms)))

    def paged(self, offset: int, rows: int) -> SetQuery:
        if offset < 0 or rows < 1:
            raise ArgumentError("a page starts at 0 or later and has a row")
        return replace(self, offset_=offset, rows_=rows)

    @property
    def is_paged(self) -> bool:
        return self.offset_ is not None

    def output_names(self) -> list[str | None] | None:
        return self.members[0].output_names()

    def _unordered(self) -> SetQuery:
        return self if self.is_paged else replace(self, orders=())

    def text(self) -> str:
        return f"set({'|'.join(m.text() for m in self.members)};{self.all_flags};{[o.text() for o in self.orders]};{self.offset_},{self.rows_})"

    def validate(self) -> None:
        if len(self.members) < 2:
            raise QueryShapeError("a set query needs two members")
        arities = {len(n) for m in self.members if (n := m.output_names()) is not None}
        if len(arities) > 1:
            raise QueryShapeError(f"members have different numbers of columns: {sorted(arities)}")
        if any(m.orders or m.is_paged for m in self.members):
            raise QueryShapeError("a member of a set query is neither ordered nor paged; wrap it in a derived table")
        if self.is_paged and not self.orders:
            raise QueryShapeError("a page needs an order")

    def lower(self, scope: Scope) -> DataFrame:
        self.validate()
        own = replace(scope, sources={}, bindings={})
        df = self.members[0].lower(own)
        for member, keep in zip(self.members[1:], self.all_flags, strict=True):
            df = df.union(member.lower(own))
            df = df if keep else df.distinct()
        if self.orders:
            inside = replace(scope, sources={"set": tuple(df.columns)})
            df = df.orderBy(*[o.apply(o.expr.to_column(inside)) for o in self.orders])
        return df.offset(self.offset_).limit(self.rows_) if self.is_paged else df


@dataclass(frozen=True)
class TypedCte:
    """A common table with declared columns; its members are checked when it is read."""

    name: str
    fields: tuple[tuple[str, str], ...]
    query: Any
    recursive: Any = None

    def column(self, name: str) -> TypedCol:
        for n, kind in self.fields:
            if n.lower() == name.lower():
                return TypedCol(f"{self.name}.{n}", None, kind)
        raise ArgumentError(f"{self.name} has no column {name}")

    def read(self, as_: str | None = None) -> Query:
        return Query(Source((self.name,), as_)).with_typed_cte(self)

    def to_cte(self) -> Cte:
        for member in (self.query, self.recursive):
            names = member.output_names() if member is not None else None
            if names is not None and len(names) != len(self.fields):
                raise QueryShapeError(f"{self.name} declares {len(self.fields)} columns, a member has {len(names)}")
            for (field_name, kind), e in zip(self.fields, getattr(member, "projection", ()), strict=False):
                from ..functions.typed import family_of

                have = family_of(e.kind)
                if have and family_of(kind) and have != family_of(kind):
                    raise QueryShapeError(f"{self.name}.{field_name} is {kind}, a member gives {e.kind}")
        return Cte(self.name, self.query, tuple(n for n, _ in self.fields), self.recursive)


def exists_probe(of: Query) -> Query:
    """The query reduced to whether it has a row."""
    return replace(of._unordered(), projection=(Lit(1).as_("probe"),))


__all__ = [
    "Cte", "Join", "JoinKind", "Query", "SetQuery", "Source", "TypedCte", "exists_probe", "from_", "from_parts", "from_source",
    "from_sub", "name_parts", "query", "source",
]
