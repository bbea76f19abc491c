"""Aggregates and what their types allow."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArgumentError, QueryShapeError, TypeRuleError
from .expr import Col, Expr, Scope, is_integer


class IntegerAverage(Enum):
    """How an average of integers is taken: it must be said."""

    EXACT_DECIMAL, TRUNCATING = "exact_decimal", "truncating"


def _operand(x: Any) -> Expr:
    return Col(x) if isinstance(x, str) else x


@dataclass(frozen=True, eq=False)
class Aggregate(Expr):
    name: str
    operand: Expr | None = None
    distinct: bool = False
    integers: IntegerAverage | None = None
    exact_scale: int = 6
    window: Any = None

    def __post_init__(self) -> None:
        kind = self.operand.kind if self.operand is not None else None
        if self.name in ("sum", "avg") and kind in ("string", "boolean", "binary", "date", "timestamp", "timestamp_ntz"):
            raise TypeRuleError(f"{self.name} of {kind}")
        if self.name in ("min", "max") and kind in ("boolean", "binary"):
            raise TypeRuleError(f"{self.name} of {kind}")
        if self.name == "avg" and is_integer(kind) and self.integers is None:
            raise TypeRuleError("an average of integers needs a policy: exact decimal or truncating")
        if not 0 <= self.exact_scale <= 38:
            raise ArgumentError("a scale is from 0 to 38")
        if self.distinct and self.window is not None:
            raise QueryShapeError("DISTINCT does not go with a window")

    @property
    def is_aggregate(self) -> bool:
        return self.window is None

    @property
    def kind(self) -> str | None:  # type: ignore[override]
        if self.name == "count":
            return "bigint"
        own = self.operand.kind if self.operand is not None else None
        if self.name == "avg":
            return f"decimal(38,{self.exact_scale})" if self.integers is IntegerAverage.EXACT_DECIMAL else own
        return own

    def parts(self) -> tuple[Expr, ...]:
        return (self.operand,) if self.operand is not None else ()

    def over(self, window: Any) -> Aggregate:
        return replace(self, window=window)

    def to_column(self, scope: Scope) -> Column:
        c = self.operand.to_column(scope) if self.operand is not None else F.lit(1)
        out = self._column(c)
        return out if self.window is None else self._windowed(c, scope)

    def _windowed(self, c: Column, scope: Scope) -> Column:
        spec = self.window.spec(scope)
        if self.name == "avg" and self.integers is IntegerAverage.TRUNCATING:
            return F.call_function("div", F.sum(c).over(spec), F.count(c).over(spec))
        if self.name == "avg" and self.integers is IntegerAverage.EXACT_DECIMAL:
            kind = f"decimal(38,{self.exact_scale})"
            return F.avg(c.cast(kind)).over(spec).cast(kind)
        return self._column(c).over(spec)

    def _column(self, c: Column) -> Column:
        match self.name:
            case "count":
                return F.count_distinct(c) if self.distinct else F.count(c)
            case "sum":
                return F.sum_distinct(c) if self.distinct else F.sum(c)
            case "min":
                return F.min(c)
            case "max":
                return F.max(c)
        if self.integers is IntegerAverage.TRUNCATING:
            total, n = (F.sum_distinct(c), F.count_distinct(c)) if self.distinct else (F.sum(c), F.count(c))
            return F.call_function("div", total, n)
        if self.integers is IntegerAverage.EXACT_DECIMAL:
            kind = f"decimal(38,{self.exact_scale})"
            exact = c.cast(kind)
            if self.distinct:
                return (F.sum_distinct(exact) / F.count_distinct(exact)).cast(kind)
            return F.avg(exact).cast(kind)
        return F.sum_distinct(c) / F.count_distinct(c) if self.distinct else F.avg(c)


def sum_(x: Any, distinct: bool = False) -> Aggregate:
    return Aggregate("sum", _operand(x), distinct)


def avg(x: Any, distinct: bool = False, integers: IntegerAverage | None = None, exact_scale: int = 6) -> Aggregate:
    return Aggregate("avg", _operand(x), distinct, integers, exact_scale)


def min_(x: Any) -> Aggregate:
    return Aggregate("min", _operand(x))


def max_(x: Any) -> Aggregate:
    return Aggregate("max", _operand(x))


def count(x: Any, distinct: bool = False) -> Aggregate:
    return Aggregate("count", _operand(x), distinct)


count_big = count


def count_all() -> Aggregate:
    return Aggregate("count")


__all__ = ["Aggregate", "IntegerAverage", "avg", "count", "count_all", "count_big", "max_", "min_", "sum_"]
