"""Immutable expressions and predicates, lowered to Spark columns within a scope.

An expression knows its parts and a canonical text, which serves grouping,
cursor signatures and tests. A scope knows which sources are in reach: a column
of an enclosing query becomes an outer reference, so correlated subqueries
need no special syntax.
"""

from __future__ import annotations

import datetime as dt
import decimal
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError, NullComparisonError, QueryShapeError, TypeRuleError


@dataclass(frozen=True)
class Scope:
    """Sources in reach: alias to column names, and the scope around."""

    sources: dict[str, tuple[str, ...]] = field(default_factory=dict)
    outer: Scope | None = None
    engine: Any = None
    bindings: dict[Any, str] = field(default_factory=dict)
    ctes: dict[str, DataFrame] = field(default_factory=dict)

    def column(self, name: str, qualifier: str | None = None) -> Column:
        if qualifier is None and "." in name:
            qualifier, name = name.rsplit(".", 1)
        here = self._has(name, qualifier)
        if here or not self._outside(name, qualifier):
            return F.col(f"`{qualifier}`.`{name}`" if qualifier else f"`{name}`")
        return F.col(f"`{qualifier}`.`{name}`" if qualifier else f"`{name}`").outer()

    def _has(self, name: str, qualifier: str | None) -> bool:
        if qualifier is not None:
            return qualifier.lower() in {s.lower() for s in self.sources}
        return any(name.lower() in {c.lower() for c in cols} for cols in self.sources.values())

    def _outside(self, name: str, qualifier: str | None) -> bool:
        scope = self.outer
        while scope is not None:
            if scope._has(name, qualifier):
                return True
            scope = scope.outer
        return False

    def inside(self) -> Scope:
        return Scope({}, self, self.engine, {}, self.ctes)


class Operator(Enum):
    EQ, NE, LT, LTE, GT, GTE = "=", "<>", "<", "<=", ">", ">="

    def apply(self, a: Column, b: Column) -> Column:
        return {"=": a.__eq__, "<>": a.__ne__, "<": a.__lt__, "<=": a.__le__, ">": a.__gt__, ">=": a.__ge__}[self.value](b)


class ArithmeticOperator(Enum):
    ADD, SUBTRACT, MULTIPLY, DIVIDE, MODULO, XOR = "+", "-", "*", "/", "%", "^"


class LikePosition(Enum):
    EXACT, ANYWHERE, STARTING, ENDING = "exact", "anywhere", "starting", "ending"


class EmptyIn(Enum):
    """What a list without members means: refused, nothing (or everything, negated), or no predicate."""

    ERROR, MATCH_NONE, OMIT = "error", "match_none", "omit"


class Nulls(Enum):
    FIRST, LAST = "first", "last"


def expression(value: Any) -> Expr:
    return value if isinstance(value, Expr) else Lit(value)


def operand(value: Any, kind: str | None = None) -> Expr:
    if value is None:
        raise NullComparisonError("a comparison with null is never true; use is_null or is_not_null")
    return value if isinstance(value, Expr) else Lit(value, kind)


class Expr:
    """A value. Subclasses give ``to_column`` and ``parts``."""

    kind: str | None = None  # Spark type, if it is known before lowering

    def to_column(self, scope: Scope) -> Column:
        raise NotImplementedError

    def parts(self) -> tuple[Expr, ...]:
        return ()

    def text(self) -> str:
        """Canonical text: equal for expressions that mean the same by construction."""
        own = ",".join(f"{k}={v!r}" for k, v in sorted(vars(self).items()) if not isinstance(v, Expr | tuple | list))
        return f"{type(self).__name__}({own};{','.join(p.text() for p in self.parts())})"

    @property
    def is_aggregate(self) -> bool:
        return any(p.is_aggregate for p in self.parts())

    @property
    def is_raw(self) -> bool:
        return any(p.is_raw for p in self.parts())

    def output_name(self) -> str | None:
        return None

    # Comparisons.
    def _compare(self, op: Operator, value: Any) -> Condition:
        return Comparison(self, op, operand(value, self.kind))

    def eq(self, value: Any) -> Condition:
        return self._compare(Operator.EQ, value)

    def ne(self, value: Any) -> Condition:
        return self._compare(Operator.NE, value)

    def lt(self, value: Any) -> Condition:
        return self._compare(Operator.LT, value)

    def lte(self, value: Any) -> Condition:
        return self._compare(Operator.LTE, value)

    def gt(self, value: Any) -> Condition:
        return self._compare(Operator.GT, value)

    def gte(self, value: Any) -> Condition:
        return self._compare(Operator.GTE, value)

    def eq_col(self, name: str) -> Condition:
        return self.eq(Col(name))

    def eq_expr(self, other: Expr) -> Condition:
        return self.eq(other)

    def is_null(self) -> Condition:
        return IsNull(self)

    def is_not_null(self) -> Condition:
        return IsNull(self, True)

    def in_list(self, values: Iterable[Any], on_empty: EmptyIn = EmptyIn.ERROR) -> Condition | None:
        return _in(self, values, on_empty, False)

    def not_in_list(self, values: Iterable[Any], on_empty: EmptyIn = EmptyIn.ERROR) -> Condition | None:
        return _in(self, values, on_empty, True)

    def between(self, low: Any, high: Any) -> Condition:
        return Between(self, operand(low, self.kind), operand(high, self.kind))

    def not_between(self, low: Any, high: Any) -> Condition:
        return Between(self, operand(low, self.kind), operand(high, self.kind), True)

    def between_columns(self, low: str, high: str) -> Condition:
        return Between(self, Col(low), Col(high))

    def not_between_columns(self, low: str, high: str) -> Condition:
        return Between(self, Col(low), Col(high), True)

    # Text.
    def like(self, term: str) -> Condition:
        return Like(self, term)

    def not_like(self, term: str) -> Condition:
        return Like(self, term, negated=True)

    def contains(self, term: str) -> Condition:
        return Like(self, term, LikePosition.ANYWHERE)

    def not_contains(self, term: str) -> Condition:
        return Like(self, term, LikePosition.ANYWHERE, True)

    def starts_with(self, term: str) -> Condition:
        return Like(self, term, LikePosition.STARTING)

    def ends_with(self, term: str) -> Condition:
        return Like(self, term, LikePosition.ENDING)

    def like_raw(self, pattern: str) -> Condition:
        return Like(self, pattern, None)

    def not_like_raw(self, pattern: str) -> Condition:
        return Like(self, pattern, None, True)

    # Subqueries.
    def in_query(self, query: Any) -> Condition:
        return InQuery(self, query)

    def not_in_query(self, query: Any) -> Condition:
        return InQuery(self, query, True)

    # Arithmetic, order, names.
    def _calc(self, op: ArithmeticOperator, other: Any) -> Expr:
        return Arithmetic(self, op, expression(other))

    def __add__(self, other: Any) -> Expr:
        return self._calc(ArithmeticOperator.ADD, other)

    def __sub__(self, other: Any) -> Expr:
        return self._calc(ArithmeticOperator.SUBTRACT, other)

    def __mul__(self, other: Any) -> Expr:
        return self._calc(ArithmeticOperator.MULTIPLY, other)

    def __truediv__(self, other: Any) -> Expr:
        return self._calc(ArithmeticOperator.DIVIDE, other)

    def __mod__(self, other: Any) -> Expr:
        return self._calc(ArithmeticOperator.MODULO, other)

    def __xor__(self, other: Any) -> Expr:
        return self._calc(ArithmeticOperator.XOR, other)

    def cast(self, kind: str) -> Expr:
        return Cast(self, kind)

    def as_(self, name: str) -> Expr:
        return Alias(self, name)

    def asc(self, nulls: Nulls | None = None) -> Order:
        return Order(self, False, nulls)

    def desc(self, nulls: Nulls | None = None) -> Order:
        return Order(self, True, nulls)


class Condition(Expr):
    """A truth value."""

    kind = "boolean"

    def __and__(self, other: Condition) -> Condition:
        return Junction(True, (self, other))

    def __or__(self, other: Condition) -> Condition:
        return Junction(False, (self, other))

    def __invert__(self) -> Condition:
        return Not(self)


@dataclass(frozen=True, eq=False)
class Col(Expr):
    """A column by name, with its source's alias before a dot if need be."""

    name: str
    source: Any = None

    def __post_init__(self) -> None:
        if not self.name or not self.name.strip():
            raise ArgumentError("a column needs a name")

    def to_column(self, scope: Scope) -> Column:
        if self.source is not None:
            at: Scope | None = scope
            while at is not None:
                if self.source in at.bindings:
                    return scope.column(self.name, at.bindings[self.source])
                at = at.outer
        return scope.column(self.name)

    def text(self) -> str:
        return f"Col({self.name.lower()})"

    def output_name(self) -> str:
        return self.name.rsplit(".", 1)[-1]


@dataclass(frozen=True, eq=False)
class Alias(Expr):
    expr: Expr
    name: str

    def __post_init__(self) -> None:
        if not self.name:
            raise ArgumentError("an alias needs a name")
        object.__setattr__(self, "kind", self.expr.kind)

    def to_column(self, scope: Scope) -> Column:
        return self.expr.to_column(scope).alias(self.name)

    def parts(self) -> tuple[Expr, ...]:
        return (self.expr,)

    def output_name(self) -> str:
        return self.name


@dataclass(frozen=True, eq=False)
class Lit(Expr):
    """A value; it never becomes text of a statement."""

    value: Any
    kind: str | None = None

    def to_column(self, scope: Scope) -> Column:
        value = self.value.value if isinstance(self.value, Enum) else self.value
        out = F.lit(value)
        if isinstance(value, dt.datetime) and value.tzinfo is None and not self.kind:
            return out.cast("timestamp_ntz")
        return out.cast(self.kind) if self.kind else out

    def text(self) -> str:
        return f"Lit({self.value!r}:{self.kind})"


@dataclass(frozen=True, eq=False)
class Raw(Expr):
    """A fragment of Spark SQL with ``:name`` parameters, bound as literals."""

    sql: str
    params: tuple[tuple[str, Any], ...] = ()

    @property
    def is_raw(self) -> bool:
        return True

    def to_column(self, scope: Scope) -> Column:
        values = dict(self.params)
        used = re.findall(r"(?<!:):([A-Za-z_]\w*)", self.sql)
        if set(used) != set(values):
            raise ArgumentError(f"parameters {sorted(set(used) ^ set(values))} are unused or missing")
        return F.expr(re.sub(r"(?<!:):([A-Za-z_]\w*)", lambda m: sql_literal(values[m[1]]), self.sql))


def sql_literal(value: Any) -> str:
    """A literal that cannot end before its value does."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, decimal.Decimal):
        return f"CAST('{value}' AS DECIMAL(38,{max(0, -value.as_tuple().exponent)}))"
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE'{value.isoformat()}'"
    return f"unhex('{str(value).encode().hex()}')::string"


class RawCondition(Raw, Condition):
    pass


def raw(sql: str, **params: Any) -> Raw:
    return Raw(sql, tuple(params.items()))


def raw_condition(sql: str, **params: Any) -> Condition:
    return RawCondition(sql, tuple(params.items()))


_IDENTIFIER = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*\Z")
#: Names of T-SQL functions and what computes the same in Spark.
_SAME: dict[str, Callable[..., Column]] = {
    "LEN": lambda c: F.length(F.rtrim(c)),
    "CHARINDEX": lambda needle, hay, *at: F.call_function("locate", needle, hay, *at),
    "ISNULL": lambda a, b: F.coalesce(a, b),
    "GETDATE": lambda: F.localtimestamp(),
    "GETUTCDATE": lambda: F.localtimestamp(),
    "SQUARE": lambda c: c * c,
    "DATALENGTH": lambda c: F.octet_length(c),
    "REPLICATE": lambda c, n: F.call_function("repeat", c, n),
    "NEWID": lambda: F.expr("uuid()"),
}


@dataclass(frozen=True, eq=False)
class Func(Expr):
    """A function by name: a built-in, one registered under this name, or a T-SQL name."""

    name: str
    args: tuple[Expr, ...] = ()

    def __post_init__(self) -> None:
        if not _IDENTIFIER.match(self.name):
            raise ArgumentError(f"{self.name!r} is not the name of a function")

    def parts(self) -> tuple[Expr, ...]:
        return self.args

    def to_column(self, scope: Scope) -> Column:
        args = [a.to_column(scope) for a in self.args]
        same = _SAME.get(self.name.upper())
        return same(*args) if same else F.call_function(self.name, *args)


def fn(name: str, *args: Any) -> Func:
    return Func(name, tuple(map(expression, args)))


#: Type names of casts and the Spark types behind them; lengths of text are not kept.
CAST_TYPES = {
    "bit": "boolean", "tinyint": "smallint", "smallint": "smallint", "int": "int", "bigint": "bigint", "real": "float",
    "float": "double", "money": "decimal(19,4)", "smallmoney": "decimal(10,4)", "char": "string", "varchar": "string",
    "nchar": "string", "nvarchar": "string", "text": "string", "ntext": "string", "binary": "binary", "varbinary": "binary",
    "image": "binary", "date": "date", "datetime": "timestamp_ntz", "datetime2": "timestamp_ntz",
    "smalldatetime": "timestamp_ntz", "datetimeoffset": "timestamp", "time": "interval day to second",
    "uniqueidentifier": "string", "xml": "string", "decimal": "decimal(18,0)", "numeric": "decimal(18,0)",
}
_CAST = re.compile(r"([a-z]\w*)\s*(?:\(\s*(\d+|max)\s*(?:,\s*(\d+)\s*)?\))?\Z", re.I)


def cast_type(name: str) -> str:
    m = _CAST.match(name.strip())
    base = m and m[1].lower()
    if base in ("string", "double", "boolean", "timestamp", "timestamp_ntz", "long"):
        return base
    if not m or base not in CAST_TYPES:
        raise ArgumentError(f"{name!r} is not a type to cast to")
    if base in ("decimal", "numeric") and m[2]:
        p, s = int(m[2]), int(m[3] or 0)
        if not 1 <= p <= 38 or s > p:
            raise ArgumentError(f"{name!r}: precision 1 to 38, scale up to it")
        return f"decimal({p},{s})"
    return CAST_TYPES[base]


@dataclass(frozen=True, eq=False)
class Cast(Expr):
    expr: Expr
    type_name: str

    def __post_init__(self) -> None:
        object.__setattr__(self, "kind", cast_type(self.type_name))

    def parts(self) -> tuple[Expr, ...]:
        return (self.expr,)

    def to_column(self, scope: Scope) -> Column:
        return self.expr.to_column(scope).cast(self.kind)


INTEGERS = ("smallint", "int", "bigint", "long", "tinyint")


def is_integer(kind: str | None) -> bool:
    return kind in INTEGERS


@dataclass(frozen=True, eq=False)
class Arithmetic(Expr):
    """Integers divide to integers, text adds to text; types that are not declared follow the data."""

    left: Expr
    op: ArithmeticOperator
    right: Expr

    def parts(self) -> tuple[Expr, ...]:
        return (self.left, self.right)

    def _kinds(self) -> list[str | None]:
        guess = {bool: "boolean", int: "bigint", str: "string", float: "double"}
        return [p.kind or (guess.get(type(p.value)) if isinstance(p, Lit) else None) for p in self.parts()]

    @property
    def kind(self) -> str | None:  # type: ignore[override]
        kinds = self._kinds()
        if "string" in kinds:
            return "string"
        if all(map(is_integer, kinds)):
            return "bigint" if "bigint" in kinds or "long" in kinds else kinds[0]
        return "double" if "double" in kinds else None

    def to_column(self, scope: Scope) -> Column:
        a, b = (p.to_column(scope) for p in self.parts())
        kinds = self._kinds()
        if self.op is ArithmeticOperator.ADD:
            return F.concat(a, b) if "string" in kinds else a + b
        if self.op is ArithmeticOperator.DIVIDE:
            return F.call_function("div", a, b) if all(map(is_integer, kinds)) else a / b
        if self.op is ArithmeticOperator.XOR:
            return a.bitwiseXOR(b)
        return {"-": a.__sub__, "*": a.__mul__, "%": a.__mod__}[self.op.value](b)


@dataclass(frozen=True, eq=False)
class Case(Expr):
    branches: tuple[tuple[Condition, Expr], ...]
    otherwise: Expr | None = None
    as_type: str | None = None

    def __post_init__(self) -> None:
        if not self.branches:
            raise QueryShapeError("CASE needs a branch")
        object.__setattr__(self, "kind", self.as_type or self.branches[0][1].kind)

    def parts(self) -> tuple[Expr, ...]:
        return (*(e for b in self.branches for e in b), *([self.otherwise] if self.otherwise else []))

    def to_column(self, scope: Scope) -> Column:
        (first, value), *rest = self.branches
        out = F.when(first.to_column(scope), value.to_column(scope))
        for condition, value in rest:
            out = out.when(condition.to_column(scope), value.to_column(scope))
        out = out.otherwise(self.otherwise.to_column(scope)) if self.otherwise else out
        return out.cast(self.as_type) if self.as_type else out


def case_when(*branches: tuple[Condition, Any], otherwise: Any = None, as_type: str | None = None) -> Case:
    rest = None if otherwise is None else expression(otherwise)
    return Case(tuple((c, expression(v)) for c, v in branches), rest, as_type)


@dataclass(frozen=True, eq=False)
class Coalesce(Expr):
    operands: tuple[Expr, ...]

    def __post_init__(self) -> None:
        if len(self.operands) < 2:
            raise QueryShapeError("COALESCE needs two operands")
        object.__setattr__(self, "kind", self.operands[0].kind)

    def parts(self) -> tuple[Expr, ...]:
        return self.operands

    def to_column(self, scope: Scope) -> Column:
        return F.coalesce(*[p.to_column(scope) for p in self.operands])


def coalesce(*operands: Any) -> Coalesce:
    return Coalesce(tuple(map(expression, operands)))


@dataclass(frozen=True, eq=False)
class Comparison(Condition):
    left: Expr
    op: Operator
    right: Expr

    def parts(self) -> tuple[Expr, ...]:
        return (self.left, self.right)

    def to_column(self, scope: Scope) -> Column:
        return self.op.apply(self.left.to_column(scope), self.right.to_column(scope))


def where_column(left: str, op: Operator, right: str) -> Condition:
    return Comparison(Col(left), op, Col(right))


@dataclass(frozen=True, eq=False)
class IsNull(Condition):
    expr: Expr
    negated: bool = False

    def parts(self) -> tuple[Expr, ...]:
        return (self.expr,)

    def to_column(self, scope: Scope) -> Column:
        c = self.expr.to_column(scope)
        return c.isNotNull() if self.negated else c.isNull()


@dataclass(frozen=True, eq=False)
class Truth(Condition):
    value: bool

    def to_column(self, scope: Scope) -> Column:
        return F.lit(self.value)


@dataclass(frozen=True, eq=False)
class InList(Condition):
    expr: Expr
    values: tuple[Expr, ...]
    negated: bool = False

    def parts(self) -> tuple[Expr, ...]:
        return (self.expr, *self.values)

    def to_column(self, scope: Scope) -> Column:
        c = self.expr.to_column(scope).isin(*[v.to_column(scope) for v in self.values])
        return ~c if self.negated else c


def _in(expr: Expr, values: Iterable[Any], on_empty: EmptyIn, negated: bool) -> Condition | None:
    items = tuple(operand(v, expr.kind) for v in values)
    if items:
        return InList(expr, items, negated)
    if on_empty is EmptyIn.ERROR:
        raise ArgumentError("IN needs a value; say what an empty list means")
    return None if on_empty is EmptyIn.OMIT else Truth(negated)


@dataclass(frozen=True, eq=False)
class Between(Condition):
    expr: Expr
    low: Expr
    high: Expr
    negated: bool = False

    def parts(self) -> tuple[Expr, ...]:
        return (self.expr, self.low, self.high)

    def to_column(self, scope: Scope) -> Column:
        c = self.expr.to_column(scope).between(self.low.to_column(scope), self.high.to_column(scope))
        return ~c if self.negated else c


@dataclass(frozen=True, eq=False)
class Like(Condition):
    """A literal term at a position, or a pattern of the caller's with ``% _ [class]``."""

    expr: Expr
    term: str
    position: LikePosition | None = LikePosition.EXACT
    negated: bool = False

    def __post_init__(self) -> None:
        if self.term is None:
            raise NullComparisonError("a pattern must not be null")
        if self.expr.kind not in (None, "string"):
            raise TypeRuleError(f"LIKE needs text, not {self.expr.kind}")

    def parts(self) -> tuple[Expr, ...]:
        return (self.expr,)

    def to_column(self, scope: Scope) -> Column:
        c, term = self.expr.to_column(scope), self.term
        match self.position:
            case LikePosition.EXACT:
                out = c == F.lit(term)
            case LikePosition.ANYWHERE:
                out = c.contains(F.lit(term))
            case LikePosition.STARTING:
                out = c.startswith(F.lit(term))
            case LikePosition.ENDING:
                out = c.endswith(F.lit(term))
            case _:
                # A backslash is a letter like others; Spark's LIKE takes it for an escape.
                out = c.rlike(like_regex(term)) if "[" in term else c.like(term.replace("\\", "\\\\"))
        return ~out if self.negated else out


def like_regex(pattern: str) -> str:
    """A T-SQL pattern with character classes as a regular expression of the whole text."""
    out, at = [], 0
    while at < len(pattern):
        ch = pattern[at]
        end = pattern.find("]", at + 1) if ch == "[" else -1
        if end > at + 1:
            inner = pattern[at + 1 : end]
            sign = "^" if inner.startswith("^") else ""
            body = re.sub(r"([\\\[\]&^])", r"\\\1", inner.removeprefix("^"))
            out.append(f"[{sign}{body}]")
            at = end
        else:
            out.append({"%": ".*", "_": "."}.get(ch, re.escape(ch)))
        at += 1
    return rf"(?s)\A{''.join(out)}\z"


@dataclass(frozen=True, eq=False)
class Junction(Condition):
    every: bool
    operands: tuple[Condition, ...]

    def __post_init__(self) -> None:
        if not self.operands:
            raise QueryShapeError("AND and OR need an operand")

    def parts(self) -> tuple[Expr, ...]:
        return self.operands

    def to_column(self, scope: Scope) -> Column:
        columns = [c.to_column(scope) for c in self.operands]
        return reduce((lambda a, b: a & b) if self.every else (lambda a, b: a | b), columns)


@dataclass(frozen=True, eq=False)
class Not(Condition):
    condition: Condition

    def parts(self) -> tuple[Expr, ...]:
        return (self.condition,)

    def to_column(self, scope: Scope) -> Column:
        return ~self.condition.to_column(scope)


def and_(conditions: Iterable[Condition | None]) -> Condition:
    return Junction(True, tuple(c for c in conditions if c is not None))


def or_(conditions: Iterable[Condition | None]) -> Condition:
    return Junction(False, tuple(c for c in conditions if c is not None))


def not_(condition: Condition) -> Condition:
    return Not(condition)


def _each(columns: Sequence[str | Expr], build: Callable[[Expr], Condition]) -> list[Condition]:
    return [build(c if isinstance(c, Expr) else Col(c)) for c in columns]


def where_any(columns: Sequence[str | Expr], build: Callable[[Expr], Condition]) -> Condition:
    return or_(_each(columns, build))


def where_all(columns: Sequence[str | Expr], build: Callable[[Expr], Condition]) -> Condition:
    return and_(_each(columns, build))


def where_none(columns: Sequence[str | Expr], build: Callable[[Expr], Condition]) -> Condition:
    return Not(or_(_each(columns, build)))


@dataclass(frozen=True, eq=False)
class Exists(Condition):
    query: Any
    negated: bool = False

    def to_column(self, scope: Scope) -> Column:
        c = self.query.lower(scope.inside()).exists()
        return ~c if self.negated else c

    def text(self) -> str:
        return f"Exists({self.negated};{self.query.text()})"


@dataclass(frozen=True, eq=False)
class ExistsValue(Exists):
    """EXISTS in a projection: never null. Over a semi join there is nothing to project, so a count decides."""

    def to_column(self, scope: Scope) -> Column:
        n = self.query.lower(scope.inside()).select(F.count(F.lit(1))).scalar()
        return (n == 0) if self.negated else (n > 0)


@dataclass(frozen=True, eq=False)
class InQuery(Condition):
    expr: Expr
    query: Any
    negated: bool = False

    def parts(self) -> tuple[Expr, ...]:
        return (self.expr,)

    def to_column(self, scope: Scope) -> Column:
        self.query.require_one_column("IN")
        c = self.expr.to_column(scope).isin(self.query.lower(scope.inside()))
        return ~c if self.negated else c

    def text(self) -> str:
        return f"In({self.negated};{self.expr.text()};{self.query.text()})"


@dataclass(frozen=True, eq=False)
class Scalar(Expr):
    query: Any

    def to_column(self, scope: Scope) -> Column:
        self.query.require_one_column("a scalar subquery")
        return self.query.lower(scope.inside()).scalar()

    def text(self) -> str:
        return f"Scalar({self.query.text()})"


def where_exists(query: Any) -> Condition:
    return Exists(query)


def where_not_exists(query: Any) -> Condition:
    return Exists(query, True)


def exists_value(query: Any, negated: bool = False) -> Expr:
    return ExistsValue(query, negated)


def scalar_subquery(query: Any) -> Expr:
    return Scalar(query)


@dataclass(frozen=True)
class Order:
    """A term of an order; nulls come lowest unless a policy says otherwise."""

    expr: Expr
    descending: bool = False
    nulls: Nulls | None = None

    def nulls_first(self) -> Order:
        return Order(self.expr, self.descending, Nulls.FIRST)

    def nulls_last(self) -> Order:
        return Order(self.expr, self.descending, Nulls.LAST)

    @property
    def nulls_lead(self) -> bool:
        return self.nulls is Nulls.FIRST if self.nulls else not self.descending

    def reversed(self) -> Order:
        return Order(self.expr, not self.descending, Nulls.LAST if self.nulls_lead else Nulls.FIRST)

    def apply(self, c: Column) -> Column:
        if self.descending:
            return c.desc_nulls_first() if self.nulls_lead else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_lead else c.asc_nulls_last()

    def text(self) -> str:
        return f"{self.expr.text()} {'desc' if self.descending else 'asc'} {'first' if self.nulls_lead else 'last'}"


def order_term(term: Order | Expr | str) -> Order:
    if isinstance(term, Order):
        return term
    return Order(term if isinstance(term, Expr) else Col(term))


__all__ = [
    n
    for n, v in list(globals().items())
    if getattr(v, "__module__", None) == __name__ and not n.startswith("_") and n not in ("operand",)
]
