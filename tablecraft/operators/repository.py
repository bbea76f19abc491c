"""Guarded writes of entities: scopes restrict them, counts are checked before anything is published."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import (
    AffectedRowsError,
    ArgumentError,
    ConcurrencyError,
    QueryShapeError,
    RelationError,
    RowNotFoundError,
    UniqueKeyError,
    UnsafeWriteError,
)
from ..functions.expr import Col, Condition, Expr, Raw
from ..sources.tables import ScopeSelection, TableDef, Trashed, UniqueKey
from .entity import EntityQuery, Page
from .relations import Relation, RelationKind
from .writes import Delete, Insert, InsertSelect, Output, Update, Upsert, WriteOutcome, fitted, patch_values, target_of, value_column


class CycleWrite(Enum):
    """What writing a graph does about rows that name each other."""

    REFUSE, NULL_THEN_UPDATE = "refuse", "null_then_update"


@dataclass(frozen=True)
class Graph:
    """A row to be written with its parents (before it), children (after it) and pivot partners."""

    repository: Any
    values: dict[str, Any]
    parents: tuple[tuple[Relation, Any], ...] = ()
    children: tuple[tuple[Relation, Any], ...] = ()
    name: str = ""


@dataclass(frozen=True)
class Repository:
    engine: Any
    table: TableDef
    selection: ScopeSelection = ScopeSelection()

    # Reading.
    def query(self) -> EntityQuery:
        return EntityQuery(self.engine, self.table, self.selection)

    def _key_condition(self, key: Any) -> list[Condition]:
        names = self.table.primary_key
        if not names:
            raise QueryShapeError(f"{self.table.name} has no key")
        values = tuple(key[n] for n in names) if isinstance(key, dict | Row) else key if isinstance(key, tuple) else (key,)
        if len(values) != len(names):
            raise ArgumentError(f"the key of {self.table.name} has {len(names)} parts")
        return [self.table[n].eq(v) for n, v in zip(names, values, strict=True)]

    def _by_key(self, key: Any) -> EntityQuery:
        q = self.query()
        for c in self._key_condition(key):
            q = q.where(c)
        return q

    def find_by_id(self, key: Any, include: Sequence[Any] = ()) -> Row | None:
        return self._by_key(key).include(*include).first()

    def get_by_id(self, key: Any, include: Sequence[Any] = ()) -> Row:
        row = self.find_by_id(key, include)
        if row is None:
            raise RowNotFoundError(f"{self.table.name} has no row {key!r}")
        return row

    def find_where(self, condition: Condition, order_by: Sequence[Any] = (), include: Sequence[Any] = ()) -> list[Row]:
        return self.query().where(condition).order_by(*order_by).include(*include).get()

    def find_all(self, order_by: Sequence[Any] = (), include: Sequence[Any] = ()) -> list[Row]:
        return self.query().order_by(*order_by).include(*include).get()

    def first_where(self, condition: Condition, order_by: Sequence[Any] = ()) -> Row | None:
        return self.query().where(condition).order_by(*order_by).first()

    def exists(self, key: Any) -> bool:
        return self._by_key(key).exists()

    def exists_where(self, condition: Condition) -> bool:
        return self.query().where(condition).exists()

    def count(self, condition: Condition | None = None) -> int:
        return self.query().where(condition).count()

    def page(self, rows: int, offset: int = 0, order_by: Sequence[Any] = (), where: Condition | None = None, total: bool = False, include: Sequence[Any] = ()) -> Page:
        return self.query().where(where).order_by(*order_by).include(*include).page(rows, offset, total)

    def trashed(self, key: Any) -> bool:
        if self.table.soft_delete is None:
            raise QueryShapeError(f"{self.table.name} has no soft delete")
        return replace(self, selection=replace(self.selection, trashed=Trashed.ONLY))._by_key(key).exists()

    # Helpers of writes.
    def _stamped(self, values: dict[str, Any], new: bool) -> dict[str, Any]:
        stamps, out = self.table.timestamps, dict(values)
        if stamps is not None:
            if new and stamps.created and stamps.created not in out:
                out[stamps.created] = stamps.now()
            if stamps.updated and stamps.updated not in out:
                out[stamps.updated] = stamps.now()
        return out

    def _output(self) -> Output:
        return Output.of(inserted=[c.name for c in self.table.columns])

    def _update(self, conditions: Sequence[Condition], values: dict[str, Any], live_only: bool = True) -> Update:
        if not conditions:
            raise UnsafeWriteError(f"{self.table.name}: a scope is no predicate; say which rows")
        scopes = self.table.read_conditions(self.selection) if live_only else self.table.global_conditions(self.selection)
        return Update(self.table, tuple(conditions)).within(scopes).set_of(values)

    def _version_column(self) -> str:
        for c in self.table.columns:
            if c.row_version:
                return c.name
        raise QueryShapeError(f"{self.table.name} has no version column")

    @contextmanager
    def _atomic(self) -> Iterator[None]:
        with self.engine.transaction():
            yield

    def _check_unique(self, rows: DataFrame) -> None:
        """New rows against the key and the unique keys that hold, and against each other."""
        keys = [UniqueKey("primary", self.table.primary_key)] if self.table.primary_key else []
        there = self.engine.table(self.table.name)
        for k in [*keys, *(u for u in self.table.unique_keys if u.guarantees)]:
            if any(self.table.column_def(c).identity for c in k.columns):
                continue
            columns = list(k.columns)
            mine = rows.select(*columns)
            if not mine.groupBy(*columns).count().where("count > 1").isEmpty():
                raise UniqueKeyError(f"{self.table.name}: two new rows have one {k.name} key")
            hits = there.select(*[F.col(c).alias(f"__{c}") for c in columns]).join(mine, [F.col(f"__{c}").eqNullSafe(mine[c]) for c in columns], "left_semi")
            if not hits.isEmpty():
                raise UniqueKeyError(f"{self.table.name}: a row with this {k.name} key is there")

    # Inserting.
    def insert(self, values: dict[str, Any]) -> Row:
        """One row; gives it as it is stored."""
        statement = Insert(self.table).values_of(self._stamped(values, True)).returning(self._output())
        self._check_unique(statement.new_rows(self.engine))
        return self.engine.execute(statement).rows[0]

    insert_assignments = insert

    def insert_all(self, rows: Sequence[dict[str, Any]]) -> WriteOutcome:
        return self.create_many(rows)

    def create_many(self, rows: Sequence[dict[str, Any]], return_rows: bool = False) -> WriteOutcome:
        """Rows in the order given; identities follow that order."""
        if not rows:
            return WriteOutcome(0)
        statement = Insert(self.table)
        for r in rows:
            statement = statement.values_of(self._stamped(r, True))
        self._check_unique(statement.new_rows(self.engine))
        return self.engine.execute(statement.returning(self._output()) if return_rows else statement)

    def bulk_load(self, frame: DataFrame) -> WriteOutcome:
        """A frame's rows as they are, without stamps."""
        df = self.engine.table(self.table.name)
        rows = fitted(df, frame, self.table, self.engine)
        n = rows.count()
        self.engine.put({self.table.name: df.unionByName(rows)})
        return WriteOutcome(n)

    def insert_select(self, columns: Sequence[str], query: Any) -> WriteOutcome:
        return self.engine.execute(InsertSelect(self.table, tuple(columns), query))

    # Updating.
    def update(self, row: dict[str, Any], columns: Sequence[str] | None = None) -> WriteOutcome:
        return self._update_row(row, columns, None)

    def _update_row(self, row: dict[str, Any], columns: Sequence[str] | None, expected: int | None) -> WriteOutcome:
        key = {k: row[k] for k in self.table.primary_key}
        values = {k: v for k, v in row.items() if k not in key and self.table.column_def(k).writable and (columns is None or k in columns)}
        statement = self._update(self._key_condition(key), self._stamped(values, False))
        return self.engine.execute(statement if expected is None else statement.expect(expected))

    def update_one(self, row: dict[str, Any]) -> WriteOutcome:
        return self._update_row(row, None, 1)

    def update_patch(self, key: Any, patch: dict[str, Any], expected_version: int | None = None) -> WriteOutcome:
        return self._patched(self._key_condition(key), patch, None, expected_version)

    def update_matching(self, where: Condition, patch: dict[str, Any], expect_affected: int | None = None, expected_version: int | None = None) -> WriteOutcome:
        return self._patched([where], patch, expect_affected, expected_version)

    def _patched(self, conditions: list[Condition], patch: dict[str, Any], expected: int | None, version: int | None) -> WriteOutcome:
        values = patch_values(patch)
        if not values:
            return WriteOutcome(0)
        if version is not None:
            conditions = [*conditions, self.table[self._version_column()].eq(version)]
        statement = self._update(conditions, self._stamped(values, False))
        out = self.engine.execute(statement if expected is None else statement.expect(expected))
        if version is not None and not out.affected:
            raise ConcurrencyError(f"{self.table.name}: no row with version {version}")
        return out

    def update_where(self, where: Condition, values: dict[str, Any], expect_affected: int | None = None) -> WriteOutcome:
        statement = self._update([where], self._stamped(values, False))
        return self.engine.execute(statement if expect_affected is None else statement.expect(expect_affected))

    def update_many(self, patches: Sequence[tuple[Any, dict[str, Any]]], expect_affected: int | None = None) -> WriteOutcome:
        """Patches by key in one pass: a join with what is set and which fields are."""
        keys = self.table.primary_key
        made = []
        for key, patch in patches:
            parts = key if isinstance(key, tuple) else (key,)
            made.append((parts, self._plain(patch_values(patch))))
        if len({p for p, _ in made}) != len(made):
            raise QueryShapeError("two patches have one key")
        df = self.engine.table(self.table.name)
        fields = sorted({f for _, v in made for f in v})
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        schema = ", ".join([*(f"`k_{k}` {kinds[k]}" for k in keys), *(f"`v_{f}` {kinds[f]}, `p_{f}` boolean" for f in fields)])
        rows = [(*p, *(x for f in fields for x in (v.get(f), f in v))) for p, v in made]
        patch = self.engine.spark.createDataFrame(rows, schema)
        marked, scope = self._marked()
        joined = marked.join(patch, [F.col(k) == F.col(f"k_{k}") for k in keys], "left")
        hit = F.col("__live") & F.col(f"k_{keys[0]}").isNotNull()
        n = joined.where(hit).count()
        if expect_affected is not None and n != expect_affected:
            raise AffectedRowsError("update_many", expect_affected, n)
        new = self._touched(scope)
        for f in fields:
            new[f] = F.when(F.col(f"p_{f}"), F.col(f"v_{f}")).otherwise(new.get(f, F.col(f"`{f}`")))
        if n:
            self.engine.put({self.table.name: self._written(df, joined, hit, new)})
        return WriteOutcome(n)

    def _marked(self) -> tuple[DataFrame, Any]:
        """The table and whether each row is within the scopes, ``__live``."""
        df, scope = target_of(self.engine, self.table)
        live = F.lit(True)
        for c in self.table.read_conditions(self.selection):
            live = live & c.to_column(scope)
        return df.withColumn("__live", F.coalesce(live, F.lit(False))), scope

    def _touched(self, scope: Any) -> dict[str, Any]:
        """New stamps and versions of a row that is written."""
        out = {k: value_column(self.table, k, v, scope) for k, v in self._stamped({}, False).items()}
        for c in self.table.columns:
            if c.row_version:
                out[c.name] = F.coalesce(F.col(c.name), F.lit(0)) + 1
        return out

    def _written(self, df: DataFrame, joined: DataFrame, hit: Any, new: dict[str, Any]) -> DataFrame:
        """``joined`` with the columns of ``df``, new values where ``hit``."""
        return joined.select(
            *[
                F.when(hit, new[f.name].cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in new else F.col(f"`{f.name}`")
                for f in df.schema
            ]
        )

    def _plain(self, values: dict[str, Any]) -> dict[str, Any]:
        for k, v in values.items():
            if isinstance(v, Expr):
                raise QueryShapeError(f"{k}: many patches take values, not expressions")
            self.table.column_def(k)
        return values

    def increment(self, key: Any, column: str, by: Any = 1) -> WriteOutcome:
        return self.engine.execute(self._update(self._key_condition(key), self._stamped({column: Col(column) + by}, False)))

    def decrement(self, key: Any, column: str, by: Any = 1) -> WriteOutcome:
        return self.engine.execute(self._update(self._key_condition(key), self._stamped({column: Col(column) - by}, False)))

    def decrement_quantities(self, key_column: str, quantity_column: str, requests: Sequence[tuple[Any, int]]) -> WriteOutcome:
        """Takes quantities where all that is asked for is there; otherwise nothing changes."""
        if not requests or any(q < 1 for _, q in requests):
            raise ArgumentError("quantities are positive")
        df = self.engine.table(self.table.name)
        kind = df.schema[key_column].dataType.simpleString()
        asked = self.engine.spark.createDataFrame(list(requests), f"__key {kind}, __q long").groupBy("__key").agg(F.sum("__q").alias("__q"))
        marked, scope = self._marked()
        joined = marked.join(asked, F.col(key_column) == F.col("__key"), "left")
        hit = F.col("__live") & F.col("__q").isNotNull()
        n = asked.count()
        covered = joined.where(hit & (F.col(quantity_column) >= F.col("__q"))).count()
        if covered != n:
            raise AffectedRowsError("decrement_quantities", n, covered)
        new = self._touched(scope) | {quantity_column: F.col(quantity_column) - F.col("__q")}
        self.engine.put({self.table.name: self._written(df, joined, hit, new)})
        return WriteOutcome(n)

    # Deleting.
    def delete(self, key: Any) -> WriteOutcome:
        return self._delete(self._key_condition(key))

    def delete_where(self, where: Condition) -> WriteOutcome:
        return self._delete([where])

    def _delete(self, conditions: list[Condition]) -> WriteOutcome:
        soft = self.table.soft_delete
        if soft is None:
            scopes = self.table.read_conditions(self.selection)
            return self.engine.execute(Delete(self.table, tuple(conditions)).within(scopes))
        stamp = self.table.timestamps.now() if self.table.timestamps is not None else Raw("current_timestamp()")
        marker = stamp if soft.by_timestamp else soft.deleted_value
        live = [*conditions, soft.alive(self.table[soft.column])]
        values = self._stamped({soft.column: marker}, False)
        statement = Update(self.table, tuple(live)).within(self.table.global_conditions(self.selection)).set_of(values)
        return self.engine.execute(statement)

    def force_delete(self, key: Any) -> WriteOutcome:
        scopes = self.table.global_conditions(self.selection)
        return self.engine.execute(Delete(self.table, tuple(self._key_condition(key))).within(scopes))

    def restore(self, key: Any) -> WriteOutcome:
        soft = self.table.soft_delete
        if soft is None:
            raise QueryShapeError(f"{self.table.name} has no soft delete")
        gone = [*self._key_condition(key), soft.deleted(self.table[soft.column])]
        return self.engine.execute(self._update(gone, self._stamped({soft.column: soft.alive_value}, False), live_only=False))

    # Finding or making.
    def first_or_new(self, where: Condition, build: Callable[[], dict[str, Any]]) -> Row | dict[str, Any]:
        return self.first_where(where) or build()

    def first_or_create(self, where: Condition, build: Callable[[], dict[str, Any]]) -> Row:
        return self.first_where(where) or self.insert(build())

    def update_or_create(self, where: Condition, build: Callable[[Row | None], dict[str, Any]]) -> Row:
        row = self.first_where(where)
        if row is None:
            return self.insert(build(None))
        values = {k: v for k, v in build(row).items() if k not in self.table.primary_key}
        self.engine.execute(self._update(self._key_condition(row), self._stamped(values, False)))
        return self.get_by_id(row)

    def create_or_first(self, where: Condition, build: Callable[[], dict[str, Any]]) -> Row:
        try:
            return self.insert(build())
        except UniqueKeyError:
            row = self.first_where(where)
            if row is None:
                raise
            return row

    def get_or_create(self, key: str, create: dict[str, Any], restore_existing: bool = False, include_deleted: bool = False) -> Row:
        """The row that has the values of a unique key, or a new one."""
        found = next((k for k in self.table.unique_keys if k.name == key and k.guarantees), None)
        if found is None:
            raise QueryShapeError(f"{self.table.name} has no unique key {key} that holds")
        if any(create.get(c) is None for c in found.columns):
            raise ArgumentError(f"{key}: every part needs a value")
        with_all = replace(self, selection=replace(self.selection, trashed=Trashed.WITH if self.table.soft_delete else Trashed.WITHOUT))
        q = with_all.query()
        for c in found.columns:
            q = q.where(self.table[c].eq(create[c]))
        row = q.first()
        if row is None:
            return self.insert(create)
        if self.table.soft_delete is not None and with_all.trashed(row) and not include_deleted:
            if not restore_existing:
                raise UniqueKeyError(f"{self.table.name}: the row with this {key} is deleted")
            self.restore(row)
            return self.get_by_id(row)
        return row

    def upsert(self, matching: dict[str, Any], insert: dict[str, Any] | None = None, update: dict[str, Any] | None = None) -> WriteOutcome:
        scopes = tuple(self.table.global_conditions(self.selection))
        statement = Upsert(self.table, matching, self._stamped(insert or {}, True), self._stamped(update or {}, False), scopes)
        return self.engine.execute(statement.returning(self._output()))

    # Graphs and relations.
    def create_graph(self, graph: Graph, cycle: CycleWrite = CycleWrite.REFUSE) -> Row:
        """Parents, the row, children and pivots, in one transaction."""
        with self._atomic():
            return _write_graph(graph, cycle, [], [])

    def related(self, parent: Any, relation: Relation) -> RelatedWrites:
        return RelatedWrites(self, parent, relation)


def _write_graph(graph: Graph, cycle: CycleWrite, path: list[int], pending: list[tuple]) -> Row:
    """``pending`` are rows written without a key of a row that comes later: relation, the later graph, repository and row."""
    if id(graph) in path:
        raise RelationError("a graph names itself")
    values, repo, later = dict(graph.values), graph.repository, []
    for relation, parent in graph.parents:
        if isinstance(parent, Graph) and id(parent) in path:
            if cycle is CycleWrite.REFUSE:
                raise RelationError(f"{relation.name}: rows that name each other")
            values |= dict.fromkeys(relation.local)
            later.append((relation, parent))
            continue
        row = _write_graph(parent, cycle, [*path, id(graph)], pending) if isinstance(parent, Graph) else parent
        values |= {c: row[f] for c, f in zip(relation.local, relation.foreign, strict=True)}
    row = repo.insert(values)
    pending += [(relation, parent, repo, row) for relation, parent in later]
    for item in [p for p in pending if p[1] is graph]:
        relation, _, behind, written = item
        behind.update_patch(written, {c: row[f] for c, f in zip(relation.local, relation.foreign, strict=True)})
        pending.remove(item)
    for relation, child in graph.children:
        own = {f: row[c] for c, f in zip(relation.local, relation.foreign, strict=True)}
        if relation.kind.through:
            target = _write_graph(child, cycle, [*path, id(graph)], pending)
            pivot = Repository(repo.engine, relation.pivot)
            pivot.insert(own | {p: target[t] for p, t in zip(relation.pivot_far, relation.target_key, strict=True)})
        else:
            _write_graph(replace(child, values=child.values | own), cycle, [*path, id(graph)], pending)
    return row


@dataclass(frozen=True)
class RelatedWrites:
    """Writes through a relation of one parent row."""

    repository: Repository
    parent: Any
    relation: Relation
    extra: dict[str, Any] = field(default_factory=dict)

    @property
    def _engine(self) -> Any:
        return self.repository.engine

    def _own(self) -> dict[str, Any]:
        return {f: self.parent[c] for c, f in zip(self.relation.local, self.relation.foreign, strict=True)}

    def _morph(self) -> dict[str, Any]:
        return {self.relation.morph_column: self.relation.morph_value} if self.relation.morph_column else {}

    def _need(self, through: bool) -> None:
        if self.relation.kind.through != through:
            raise RelationError(f"{self.relation.name} is {'not ' if through else ''}behind a pivot")

    def create(self, values: dict[str, Any], pivot: dict[str, Any] | None = None) -> Row:
        target = Repository(self._engine, self.relation.target)
        if not self.relation.kind.through:
            return target.insert(values | self._own() | self._morph())
        with self._engine.transaction():
            row = target.insert(values)
            self.attach(row, pivot or {})
        return row

    def associate(self, child: Any) -> WriteOutcome:
        """Writes the foreign key: on this row for belongs_to, on the child otherwise."""
        self._need(False)
        r = self.relation
        if r.kind is RelationKind.BELONGS_TO:
            values = {c: child[f] for c, f in zip(r.local, r.foreign, strict=True)}
            return self.repository.update_patch(self.parent, values)
        return Repository(self._engine, r.target).update_patch(child, self._own() | self._morph())

    def dissociate(self, child: Any = None) -> WriteOutcome:
        self._need(False)
        r = self.relation
        if r.kind is RelationKind.BELONGS_TO:
            return self.repository.update_patch(self.parent, dict.fromkeys(r.local))
        if child is None and not r.kind.to_one:
            raise RelationError(f"{r.name}: say which row")
        target = Repository(self._engine, r.target)
        where = [r.target[f].eq(v) for f, v in self._own().items()]
        if child is not None:
            where += target._key_condition(child)
        return self._engine.execute(target._update(where, dict.fromkeys(r.foreign)))

    def _pivot_values(self, child: Any) -> dict[str, Any]:
        r = self.relation
        return self._own() | self._morph() | {p: child[t] for p, t in zip(r.pivot_far, r.target_key, strict=True)}

    def attach(self, child: Any, pivot: dict[str, Any] | None = None) -> Row:
        self._need(True)
        return Repository(self._engine, self.relation.pivot).insert(self._pivot_values(child) | (pivot or {}))

    def _pivot_where(self, values: dict[str, Any]) -> list[Condition]:
        return [self.relation.pivot[k].eq(v) for k, v in values.items()]

    def detach(self, child: Any) -> WriteOutcome:
        self._need(True)
        return self._engine.execute(Delete(self.relation.pivot, tuple(self._pivot_where(self._pivot_values(child)))))

    def detach_all(self) -> WriteOutcome:
        self._need(True)
        return self._engine.execute(Delete(self.relation.pivot, tuple(self._pivot_where(self._own() | self._morph()))))

    def sync(self, children: Sequence[Any], detaching: bool = True) -> tuple[int, int]:
        """Makes the attached rows those given; gives how many came and went."""
        self._need(True)
        r = self.relation
        pivot = self._engine.table(r.pivot.name)
        for k, v in (self._own() | self._morph()).items():
            pivot = pivot.where(F.col(k) == F.lit(v))
        have = {tuple(row) for row in pivot.select(*r.pivot_far).collect()}
        want = {tuple(c[t] for t in r.target_key): c for c in children}
        with self._engine.transaction():
            for key, child in want.items():
                if key not in have:
                    self.attach(child)
            gone = have - set(want) if detaching else set()
            for key in gone:
                self._engine.execute(Delete(r.pivot, tuple(self._pivot_where(self._own() | self._morph() | dict(zip(r.pivot_far, key, strict=True))))))
        return len(set(want) - have), len(gone)


def entities(engine: Any, table: TableDef) -> EntityQuery:
    return EntityQuery(engine, table)


__all__ = ["CycleWrite", "Graph", "RelatedWrites", "Repository", "entities"]
