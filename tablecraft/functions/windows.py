"""Windows, frames and window functions."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from ..errors import ArgumentError, QueryShapeError
from .expr import Col, Expr, Order, Scope, expression, order_term


class FrameUnit(Enum):
    ROWS, RANGE = "rows", "range"


@dataclass(frozen=True)
class Bound:
    """A bound as an offset from the current row; the far ends are Spark's own."""

    offset: int

    @staticmethod
    def preceding(n: int) -> Bound:
        return Bound(-_steps(n))

    @staticmethod
    def following(n: int) -> Bound:
        return Bound(_steps(n))

    @property
    def is_offset(self) -> bool:
        return self.offset not in (UNBOUNDED_PRECEDING.offset, UNBOUNDED_FOLLOWING.offset, 0)


def _steps(n: int) -> int:
    if n < 1:
        raise ArgumentError("a frame's offset is at least 1")
    return n


UNBOUNDED_PRECEDING = Bound(SparkWindow.unboundedPreceding)
UNBOUNDED_FOLLOWING = Bound(SparkWindow.unboundedFollowing)
CURRENT_ROW = Bound(0)


@dataclass(frozen=True)
class Frame:
    unit: FrameUnit = FrameUnit.ROWS
    start: Bound = UNBOUNDED_PRECEDING
    end: Bound = CURRENT_ROW

    def __post_init__(self) -> None:
        if self.unit is FrameUnit.RANGE and (self.start.is_offset or self.end.is_offset):
            raise QueryShapeError("a RANGE frame has no offsets")
        if self.start == UNBOUNDED_FOLLOWING or self.end == UNBOUNDED_PRECEDING or self.start.offset > self.end.offset:
            raise QueryShapeError("a frame ends where it starts or later")


class Window:
    """PARTITION BY, ORDER BY and a frame, which needs the order."""

    def __init__(self, partition_by: Any = (), order_by: Any = (), frame: Frame | None = None):
        many = lambda x: tuple(x) if isinstance(x, list | tuple) else (x,)
        self.partition_by = tuple(Col(p) if isinstance(p, str) else p for p in many(partition_by))
        self.order_by: tuple[Order, ...] = tuple(map(order_term, many(order_by)))
        self.frame = frame
        if frame is not None and not self.order_by:
            raise QueryShapeError("a frame needs an order")

    def spec(self, scope: Scope) -> WindowSpec:
        out = SparkWindow.partitionBy(*[p.to_column(scope) for p in self.partition_by])
        if self.order_by:
            out = out.orderBy(*[o.apply(o.expr.to_column(scope)) for o in self.order_by])
        if self.frame is None:
            return out
        between = out.rowsBetween if self.frame.unit is FrameUnit.ROWS else out.rangeBetween
        return between(self.frame.start.offset, self.frame.end.offset)

    def __repr__(self) -> str:
        return f"Window({[p.text() for p in self.partition_by]},{[o.text() for o in self.order_by]},{self.frame})"


RANKING = ("row_number", "rank", "dense_rank", "ntile")


@dataclass(frozen=True, eq=False)
class WindowCall(Expr):
    name: str
    window: Window
    operand: Expr | None = None
    n: int = 1
    missing: Expr | None = None

    def __post_init__(self) -> None:
        if not self.window.order_by:
            raise QueryShapeError(f"{self.name} needs an order")
        if self.window.frame is not None:
            raise QueryShapeError(f"{self.name} takes no frame")
        if self.name == "ntile" and self.n < 1:
            raise ArgumentError("ntile needs a bucket")
        if self.name in ("lag", "lead") and self.n < 0:
            raise ArgumentError("an offset is not negative")
        object.__setattr__(self, "kind", "bigint" if self.name in RANKING else self.operand and self.operand.kind)

    @property
    def is_aggregate(self) -> bool:
        return False

    def parts(self) -> tuple[Expr, ...]:
        return tuple(p for p in (self.operand, self.missing) if p is not None)

    def to_column(self, scope: Scope) -> Column:
        spec = self.window.spec(scope)
        if self.name == "ntile":
            return F.ntile(self.n).over(spec).cast("bigint")
        if self.name in RANKING:
            return getattr(F, self.name)().over(spec).cast("bigint")
        c = self.operand.to_column(scope)
        out = getattr(F, self.name)(c, self.n).over(spec)
        if self.missing is None or self.n == 0:
            return out
        # The default may be an expression, which Spark's own default may not.
        there = getattr(F, self.name)(F.lit(1), self.n).over(spec)
        return F.when(there.isNull(), self.missing.to_column(scope)).otherwise(out)


def row_number(window: Window) -> Expr:
    return WindowCall("row_number", window)


def rank(window: Window) -> Expr:
    return WindowCall("rank", window)


def dense_rank(window: Window) -> Expr:
    return WindowCall("dense_rank", window)


def ntile(buckets: int, window: Window) -> Expr:
    return WindowCall("ntile", window, n=buckets)


def _shifted(name: str, x: Any, window: Window, offset: int, if_missing: Any) -> Expr:
    operand = Col(x) if isinstance(x, str) else x
    return WindowCall(name, window, operand, offset, None if if_missing is None else expression(if_missing))


def lag(x: Any, window: Window, offset: int = 1, if_missing: Any = None) -> Expr:
    return _shifted("lag", x, window, offset, if_missing)


def lead(x: Any, window: Window, offset: int = 1, if_missing: Any = None) -> Expr:
    return _shifted("lead", x, window, offset, if_missing)


__all__ = [
    "Bound", "CURRENT_ROW", "Frame", "FrameUnit", "RANKING", "UNBOUNDED_FOLLOWING", "UNBOUNDED_PRECEDING", "Window",
    "WindowCall", "dense_rank", "lag", "lead", "ntile", "rank", "row_number",
]
