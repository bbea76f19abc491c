"""Writes as DataFrame transformations.

A statement says which rows it changes and what the table holds afterwards;
both are plans over the table as it is. Running one counts the rows, checks
what was expected, and only then publishes the new contents.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import AffectedRowsError, ArgumentError, QueryShapeError, ReadOnlyColumnError, UnsafeWriteError
from ..functions.expr import Condition, Expr, Lit, Scope
from .query import name_parts


class Default(Expr):
    """The column's default in place of a value; not the same as null."""

    def to_column(self, scope: Scope) -> Column:
        raise QueryShapeError("DEFAULT stands only for the value of a written column")


DEFAULT = Default()


class WriteScope(Enum):
    FILTERED, UNRESTRICTED = "filtered", "unrestricted"


@dataclass(frozen=True)
class Field:
    """A field of a patch: absent, or a value, which may be null."""

    value: Any = None
    present: bool = True


ABSENT = Field(None, False)


def patch_values(patch: dict[str, Any]) -> dict[str, Any]:
    """The present fields of a patch."""
    pairs = ((k, v if isinstance(v, Field) else Field(v)) for k, v in patch.items())
    return {k: f.value for k, f in pairs if f.present}


@dataclass(frozen=True)
class WriteOutcome:
    affected: int
    rows: tuple[Row, ...] = ()
    counted: str = "plan"


@dataclass(frozen=True)
class Output:
    """Columns of the rows before (``deleted``) and after (``inserted``), under names of the caller's."""

    columns: tuple[tuple[str, str, str], ...]  # side, column, name
    into: str | None = None

    @staticmethod
    def of(inserted: Sequence[str] = (), deleted: Sequence[str] = (), into: str | None = None) -> Output:
        both = set(inserted) & set(deleted)
        name = lambda side, c: f"{side}_{c}" if c in both else c
        cols = [("inserted", c, name("inserted", c)) for c in inserted] + [("deleted", c, name("deleted", c)) for c in deleted]
        if not cols:
            raise QueryShapeError("OUTPUT needs a column")
        return Output(tuple(cols), into)


def _name(table: Any) -> str:
    return ".".join(name_parts(table if isinstance(table, str) else table.name))


class Statement:
    """A write. ``changed`` gives ``deleted`` and ``inserted`` structs of the rows it meets, ``result`` the table afterwards."""

    table: Any
    output: Output | None
    expected: int | None

    def changed(self, engine: Any) -> DataFrame:
        raise NotImplementedError

    def result(self, engine: Any) -> DataFrame:
        raise NotImplementedError

    def check(self, engine: Any) -> None:
        pass

    def evaluated(self, engine: Any) -> tuple[DataFrame, DataFrame]:
        """``changed`` and ``result`` of one evaluation: clocks and identities are the same in both."""
        return engine.settled(self.changed(engine)), self.result(engine)

    def returning(self, output: Output) -> Any:
        return replace(self, output=output)  # type: ignore[type-var]

    def expect(self, rows: int) -> Any:
        return replace(self, expected=rows)  # type: ignore[type-var]

    def run(self, engine: Any) -> WriteOutcome:
        self.check(engine)
        rows: tuple[Row, ...] = ()
        result = None
        if self.output is None:
            changed = self.changed(engine)
        else:
            changed, result = self.evaluated(engine)
            picked = changed.select(*[F.col(f"{side}.{c}").alias(n) for side, c, n in self.output.columns])
            if self.output.into:
                picked.createOrReplaceTempView(self.output.into)
            rows = tuple(picked.collect())
        affected = len(rows) if self.output is not None else changed.count()
        if self.expected is not None and affected != self.expected:
            raise AffectedRowsError(type(self).__name__.lower(), self.expected, affected)
        if affected:
            engine.put({_name(self.table): self.result(engine) if result is None else result})
        return WriteOutcome(affected, rows)


def table_scope(engine: Any, table: Any, df: DataFrame) -> Scope:
    label = _name(table).rsplit(".", 1)[-1]
    return Scope({label: tuple(df.columns)}, None, engine, {} if isinstance(table, str) else {table: label})


def target_of(engine: Any, table: Any) -> tuple[DataFrame, Scope]:
    df = engine.table(_name(table))
    label = _name(table).rsplit(".", 1)[-1]
    return df.alias(label), table_scope(engine, table, df)


def _definition(table: Any) -> Any:
    return None if isinstance(table, str) else table


def value_column(table: Any, name: str, value: Any, scope: Scope) -> Column:
    """What is written to a column: a bound value, an expression, or the column's default."""
    definition = _definition(table)
    column = definition.column_def(name) if definition is not None else None
    if isinstance(value, Default):
        if column is None or column.default is None:
            return F.lit(None)
        return column.default.to_column(scope)
    if isinstance(value, Expr):
        return value.to_column(scope)
    if column is not None and column.members is not None and isinstance(value, column.members):
        value = value.value
    if column is not None and column.converter is not None:
        value = column.converter.to_store(value)
    return Lit(value).to_column(scope)


def check_writable(table: Any, columns: Sequence[str]) -> None:
    definition = _definition(table)
    if len({c.lower() for c in columns}) != len(columns):
        raise QueryShapeError("a column is written twice")
    for c in columns if definition is not None else ():
        if not definition.column_def(c).writable:
            raise ReadOnlyColumnError(f"{definition.name}.{c} is never written")


def fitted(df: DataFrame, rows: DataFrame, table: Any, engine: Any) -> DataFrame:
    """``rows`` with all columns of ``df`` in its order and types; what is missing takes its default, or the next identity."""
    definition = _definition(table)
    have = {c.lower(): c for c in rows.columns}
    out = []
    scope = Scope({}, None, engine)
    for f in df.schema:
        c = definition.column_def(f.name) if definition is not None else None
        if f.name.lower() in have:
            value = rows[have[f.name.lower()]]
        elif c is not None and c.identity:
            top = F.coalesce(df.agg(F.max(f.name).cast("long")).scalar(), F.lit(0).cast("long"))
            # One row per inserted row; ids follow each other within the insert.
            from pyspark.sql import Window

            value = top + F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))
        elif c is not None and c.row_version:
            value = F.lit(1)
        elif c is not None and c.default is not None:
            value = c.default.to_column(scope)
        else:
            value = F.lit(None)
        out.append(value.cast(f.dataType).alias(f.name))
    return rows.select(*out)


@dataclass(frozen=True)
class Insert(Statement):
    table: Any
    rows: tuple[tuple[tuple[str, Any], ...], ...] = ()
    default_row: bool = False
    output: Output | None = None
    expected: int | None = None

    def values(self, **values: Any) -> Insert:
        return self.values_of(values)

    def values_of(self, values: dict[str, Any]) -> Insert:
        if not values:
            raise QueryShapeError("an insert without values; ask for the defaults")
        check_writable(self.table, list(values))
        if self.rows and {k for k, _ in self.rows[0]} != set(values):
            raise QueryShapeError("rows of an insert have the same columns")
        return replace(self, rows=(*self.rows, tuple(values.items())))

    def default_values(self) -> Insert:
        return replace(self, default_row=True)

    def check(self, engine: Any) -> None:
        if bool(self.rows) == self.default_row:
            raise QueryShapeError("an insert has rows of values or asks for the defaults")

    def new_rows(self, engine: Any) -> DataFrame:
        df, _ = target_of(engine, self.table)
        one = engine.spark.range(1)
        scope = Scope({}, None, engine)
        if self.default_row:
            return fitted(df, one.select(), self.table, engine)
        names = [k for k, _ in self.rows[0]]
        kinds = {f.name.lower(): f.dataType for f in df.schema}
        made = []
        for row in self.rows:
            values = dict(row)
            made.append(F.struct(*[value_column(self.table, k, values[k], scope).cast(kinds[k.lower()]).alias(k) for k in names]))
        rows = one.select(F.explode(F.array(*made)).alias("r")).select("r.*")
        return fitted(df, rows, self.table, engine)

    def changed(self, engine: Any) -> DataFrame:
        rows = self.new_rows(engine)
        return rows.select(F.lit(None).cast(rows.schema).alias("deleted"), F.struct(*rows.columns).alias("inserted"))

    def result(self, engine: Any) -> DataFrame:
        return engine.table(_name(self.table)).unionByName(self.new_rows(engine))

    def evaluated(self, engine: Any) -> tuple[DataFrame, DataFrame]:
        changed = engine.settled(self.changed(engine))
        return changed, engine.table(_name(self.table)).unionByName(changed.select("inserted.*"))


@dataclass(frozen=True)
class InsertSelect(Statement):
    """Rows of a query into named columns."""

    table: Any
    columns: tuple[str, ...]
    query: Any
    output: Output | None = None
    expected: int | None = None

    def check(self, engine: Any) -> None:
        check_writable(self.table, self.columns)
        names = self.query.output_names()
        if not self.columns or names is not None and len(names) != len(self.columns):
            raise QueryShapeError("the query has another number of columns than the target list")

    def new_rows(self, engine: Any) -> DataFrame:
        df, _ = target_of(engine, self.table)
        return fitted(df, self.query.frame(engine).toDF(*self.columns), self.table, engine)

    changed = Insert.changed
    evaluated = Insert.evaluated

    def result(self, engine: Any) -> DataFrame:
        return engine.table(_name(self.table)).unionByName(self.new_rows(engine))


@dataclass(frozen=True)
class _Filtered(Statement):
    table: Any
    conditions: tuple[Condition, ...] = ()
    everything: bool = False
    implied: tuple[Condition, ...] = ()  # scopes; they restrict, but are no predicate of the caller's
    output: Output | None = None
    expected: int | None = None

    def where(self, condition: Condition) -> Any:
        return replace(self, conditions=(*self.conditions, condition))

    def all_rows(self) -> Any:
        return replace(self, everything=True)

    def within(self, conditions: Sequence[Condition]) -> Any:
        return replace(self, implied=(*self.implied, *conditions))

    def check(self, engine: Any) -> None:
        if self.everything and self.conditions:
            raise QueryShapeError("all rows and a predicate exclude each other")
        if not self.everything and not self.conditions:
            raise UnsafeWriteError(f"a write to {_name(self.table)} without a predicate; say all_rows if it is meant")

    def met(self, scope: Scope) -> Column:
        """True of the rows that are met; unknown is not met."""
        out = F.lit(True)
        for c in (*self.implied, *self.conditions):
            out = out & c.to_column(scope)
        return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class Update(_Filtered):
    assignments: tuple[tuple[str, Any], ...] = ()

    def set(self, **values: Any) -> Update:
        return self.set_of(values)

    def set_of(self, values: dict[str, Any]) -> Update:
        check_writable(self.table, [*(k for k, _ in self.assignments), *values])
        return replace(self, assignments=(*self.assignments, *values.items()))

    def check(self, engine: Any) -> None:
        super().check(engine)
        if not self.assignments:
            raise QueryShapeError("an update sets something")

    def _after(self, df: DataFrame, scope: Scope) -> dict[str, Column]:
        new = {k.lower(): value_column(self.table, k, v, scope) for k, v in self.assignments}
        missing = set(new) - {c.lower() for c in df.columns}
        if missing:
            raise QueryShapeError(f"{_name(self.table)} has no columns {sorted(missing)}")
        definition = _definition(self.table)
        for c in definition.columns if definition is not None else ():
            if c.row_version:
                new[c.name.lower()] = F.coalesce(F.col(c.name), F.lit(0)) + 1
        return {f.name: new[f.name.lower()].cast(f.dataType) if f.name.lower() in new else F.col(f"`{f.name}`") for f in df.schema}

    def changed(self, engine: Any) -> DataFrame:
        df, scope = target_of(engine, self.table)
        after = self._after(df, scope)
        hit = df.where(self.met(scope))
        return hit.select(F.struct(*df.columns).alias("deleted"), F.struct(*[v.alias(k) for k, v in after.items()]).alias("inserted"))

    def result(self, engine: Any) -> DataFrame:
        df, scope = target_of(engine, self.table)
        hit, after = self.met(scope), self._after(df, scope)
        return df.select(*[F.when(hit, v).otherwise(F.col(f"`{k}`")).alias(k) for k, v in after.items()])

    def evaluated(self, engine: Any) -> tuple[DataFrame, DataFrame]:
        df, scope = target_of(engine, self.table)
        after = F.struct(*[v.alias(k) for k, v in self._after(df, scope).items()])
        hit = self.met(scope)
        both = engine.settled(df.select(F.struct(*df.columns).alias("deleted"), F.when(hit, after).alias("inserted")))
        return both.where("inserted is not null"), both.select(F.coalesce("inserted", "deleted").alias("row")).select("row.*")


@dataclass(frozen=True)
class Delete(_Filtered):
    def changed(self, engine: Any) -> DataFrame:
        df, scope = target_of(engine, self.table)
        kind = df.schema.simpleString()
        return df.where(self.met(scope)).select(F.struct(*df.columns).alias("deleted"), F.lit(None).cast(kind).alias("inserted"))

    def result(self, engine: Any) -> DataFrame:
        df, scope = target_of(engine, self.table)
        return df.where(~self.met(scope))


@dataclass(frozen=True)
class Upsert(Statement):
    """One row by its matching values: updated if it is there, inserted if not. Null matches null."""

    table: Any
    matching: dict[str, Any] = field(default_factory=dict)
    insert_values: dict[str, Any] = field(default_factory=dict)
    update_values: dict[str, Any] = field(default_factory=dict)
    implied: tuple[Condition, ...] = ()
    output: Output | None = None
    expected: int | None = None

    def check(self, engine: Any) -> None:
        if not self.matching:
            raise UnsafeWriteError("an upsert without a match")
        for k, v in self.insert_values.items():
            if k in self.matching and self.matching[k] != v:
                raise QueryShapeError(f"{k} is inserted with another value than it is matched by")
        check_writable(self.table, list({**self.matching, **self.insert_values}))

    def _condition(self) -> list[Condition]:
        from ..functions.expr import Col

        return [Col(k).is_null() if v is None else Col(k).eq(v) for k, v in self.matching.items()]

    def _parts(self, engine: Any) -> tuple[Update | None, Insert | None]:
        there = Delete(self.table, tuple(self._condition()), implied=self.implied)
        if not there.changed(engine).isEmpty():
            return (Update(self.table, tuple(self._condition()), implied=self.implied).set_of(self.update_values) if self.update_values else None), None
        return None, Insert(self.table).values_of({**self.matching, **self.insert_values})

    def run(self, engine: Any) -> WriteOutcome:
        self.check(engine)
        update, insert = self._parts(engine)
        statement = update or insert
        if statement is None:
            return WriteOutcome(0)
        return replace(statement, output=self.output, expected=self.expected).run(engine)

    def result(self, engine: Any) -> DataFrame:
        self.check(engine)
        update, insert = self._parts(engine)
        statement = update or insert
        return statement.result(engine) if statement is not None else engine.table(_name(self.table))


def merged(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """A whole-frame upsert: rows of ``source`` replace those of equal keys, null equal to null, and the rest are added."""
    columns = list(update if update is not None else [c for c in source.columns if c not in keys])
    if not keys:
        raise ArgumentError("a merge needs keys")
    s = source.select(*[F.col(c).alias(f"__{c}") for c in source.columns], F.lit(True).alias("__there"))
    t = target.withColumn("__old", F.lit(True))
    on = None
    for k in keys:
        one = t[k].eqNullSafe(s[f"__{k}"])
        on = one if on is None else on & one
    both = t.join(s, on, "full")
    new, old = F.col("__old").isNull(), F.col("__there").isNull()
    out = []
    for f in target.schema:
        c = f.name
        if c in source.columns:
            fresh = F.col(f"__{c}").cast(f.dataType)
            take = new | (~old if c in columns else F.lit(False))
            out.append(F.when(take, fresh).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return both.select(*out)


def insert_into(table: Any) -> Insert:
    return Insert(table)


def update_table(table: Any) -> Update:
    return Update(table)


def delete_from(table: Any) -> Delete:
    return Delete(table)


__all__ = [
    "ABSENT", "DEFAULT", "Default", "Delete", "Field", "Insert", "InsertSelect", "Output", "Statement", "Update", "Upsert",
    "WriteOutcome", "WriteScope", "delete_from", "insert_into", "merged", "patch_values", "update_table",
]
