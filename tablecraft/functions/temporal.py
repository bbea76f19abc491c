"""Dates: parts, calendar ranges that reach the scan, truncation, buckets, differences, clocks."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArgumentError, TypeRuleError
from .expr import Col, Comparison, Condition, Expr, Lit, Operator, Scope, operand


class DatePart(Enum):
    DATE, TIME, YEAR, MONTH, DAY = "date", "time", "year", "month", "day"


class Grain(Enum):
    YEAR, QUARTER, MONTH, DAY, HOUR, MINUTE = "year", "quarter", "month", "day", "hour", "minute"

    @property
    def whole_days(self) -> bool:
        return self in (Grain.YEAR, Grain.QUARTER, Grain.MONTH, Grain.DAY)


class Unit(Enum):
    YEAR, QUARTER, MONTH, WEEK, DAY, HOUR, MINUTE, SECOND = (
        "year", "quarter", "month", "week", "day", "hour", "minute", "second",
    )


class Clock(Enum):
    """Clocks of the session, and their types."""

    LOCAL, UTC, OFFSET, LOCAL_DATETIME, UTC_DATETIME = range(5)


MICROS = {Unit.WEEK: 604_800_000_000, Unit.DAY: 86_400_000_000, Unit.HOUR: 3_600_000_000, Unit.MINUTE: 60_000_000, Unit.SECOND: 1_000_000}
MONTHS = {Unit.MONTH: 1, Unit.QUARTER: 3, Unit.YEAR: 12}
EPOCH = dt.datetime(1970, 1, 1)


@dataclass(frozen=True, eq=False)
class Now(Expr):
    """The clock of the session; a fixed instant, if given, makes results repeatable."""

    clock: Clock = Clock.UTC
    fixed: dt.datetime | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "kind", "timestamp" if self.clock is Clock.OFFSET else "timestamp_ntz")

    def to_column(self, scope: Scope) -> Column:
        fixed = self.fixed or getattr(scope.engine, "fixed_now", None)
        if fixed is not None:
            return F.lit(fixed).cast(self.kind)
        if self.clock is Clock.OFFSET:
            return F.current_timestamp()
        if self.clock in (Clock.UTC, Clock.UTC_DATETIME):
            return F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())
        return F.localtimestamp()


def now(clock: Clock = Clock.UTC) -> Now:
    return Now(clock)


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), c.cast("timestamp_ntz"))


@dataclass(frozen=True, eq=False)
class PartComparison(Condition):
    expr: Expr
    part: DatePart
    op: Operator
    value: Expr

    def parts(self) -> tuple[Expr, ...]:
        return (self.expr, self.value)

    def to_column(self, scope: Scope) -> Column:
        c, v = self.expr.to_column(scope), self.value.to_column(scope)
        match self.part:
            case DatePart.DATE:
                c, v = F.to_date(c), v.cast("date")
            case DatePart.TIME:
                c = F.date_format(c, "HH:mm:ss.SSSSSS")
            case DatePart.YEAR:
                c = F.year(c)
            case DatePart.MONTH:
                c = F.month(c)
            case DatePart.DAY:
                c = F.dayofmonth(c)
        return self.op.apply(c, v)


def _part(x: Any, part: DatePart, op: Operator, value: Any) -> Condition:
    return PartComparison(_col(x), part, op, operand(value))


def _col(x: Any) -> Expr:
    return Col(x) if isinstance(x, str) else x


def where_date(x: Any, day: dt.date, op: Operator = Operator.EQ) -> Condition:
    return _part(x, DatePart.DATE, op, day)


def where_time(x: Any, time: dt.time, op: Operator = Operator.EQ) -> Condition:
    if time is None:
        operand(None)
    return _part(x, DatePart.TIME, op, time.strftime("%H:%M:%S.%f"))


def where_year(x: Any, year: int, op: Operator = Operator.EQ) -> Condition:
    return _part(x, DatePart.YEAR, op, year)


def where_month(x: Any, month: int, op: Operator = Operator.EQ) -> Condition:
    return _part(x, DatePart.MONTH, op, month)


def where_day(x: Any, day: int, op: Operator = Operator.EQ) -> Condition:
    return _part(x, DatePart.DAY, op, day)


def _today(op: Operator):
    return lambda x, clock=Clock.LOCAL: PartComparison(_col(x), DatePart.DATE, op, Now(clock))


def _instant(op: Operator):
    return lambda x, clock=Clock.LOCAL: Comparison(_col(x), op, Now(clock))


where_today, where_before_today, where_after_today = map(_today, (Operator.EQ, Operator.LT, Operator.GT))
where_today_or_before, where_today_or_after = map(_today, (Operator.LTE, Operator.GTE))
where_past, where_future, where_now_or_past, where_now_or_future = map(
    _instant, (Operator.LT, Operator.GT, Operator.LTE, Operator.GTE)
)


@dataclass(frozen=True, eq=False)
class CalendarRange(Condition):
    """A comparison with a half-open stretch of time, on the bare column, so that it reaches the scan."""

    expr: Expr
    start: dt.datetime
    end: dt.datetime
    op: Operator = Operator.EQ
    zone_offset: dt.timedelta | None = None

    def __post_init__(self) -> None:
        zoned = self.expr.kind == "timestamp"
        if zoned and self.zone_offset is None:
            raise ArgumentError("a column with a zone needs the offset the calendar is meant in")
        if self.zone_offset is not None and not zoned and self.expr.kind is not None:
            raise ArgumentError("an offset goes with a column that has a zone")
        if self.zone_offset is not None and abs(self.zone_offset) > dt.timedelta(hours=14):
            raise ArgumentError("an offset is at most 14 hours")

    def parts(self) -> tuple[Expr, ...]:
        return (self.expr,)

    def to_column(self, scope: Scope) -> Column:
        c = self.expr.to_column(scope)
        kind = self.expr.kind or "timestamp_ntz"

        def edge(at: dt.datetime) -> Column:
            if self.zone_offset is not None:
                return F.lit(at.replace(tzinfo=dt.timezone(self.zone_offset)))
            return F.lit(at).cast("timestamp_ntz").cast(kind)

        low, high = edge(self.start), edge(self.end)
        return {
            Operator.EQ: lambda: (c >= low) & (c < high),
            Operator.NE: lambda: (c < low) | (c >= high),
            Operator.LT: lambda: c < low,
            Operator.LTE: lambda: c < high,
            Operator.GT: lambda: c >= high,
            Operator.GTE: lambda: c >= low,
        }[self.op]()


def in_year(x: Any, year: int, op: Operator = Operator.EQ, zone_offset: dt.timedelta | None = None) -> Condition:
    if not 1 <= year <= 9998:
        raise ArgumentError("a year is from 1 to 9998")
    return CalendarRange(_col(x), dt.datetime(year, 1, 1), dt.datetime(year + 1, 1, 1), op, zone_offset)


def on_date(x: Any, day: dt.date, op: Operator = Operator.EQ, zone_offset: dt.timedelta | None = None) -> Condition:
    start = dt.datetime(day.year, day.month, day.day)
    return CalendarRange(_col(x), start, start + dt.timedelta(days=1), op, zone_offset)


@dataclass(frozen=True, eq=False)
class Truncated(Expr):
    expr: Expr
    grain: Grain

    def __post_init__(self) -> None:
        if self.expr.kind not in (None, "date", "timestamp", "timestamp_ntz"):
            raise TypeRuleError(f"{self.expr.kind} has no calendar")
        object.__setattr__(self, "kind", "date" if self.grain.whole_days else "timestamp_ntz")

    def parts(self) -> tuple[Expr, ...]:
        return (self.expr,)

    def to_column(self, scope: Scope) -> Column:
        c = self.expr.to_column(scope)
        if self.grain is Grain.DAY:
            return F.to_date(c)
        if self.grain.whole_days:
            return F.trunc(c, self.grain.value)
        return F.date_trunc(self.grain.value, c).cast("timestamp_ntz")


def truncated_to(x: Any, grain: Grain) -> Expr:
    return Truncated(_col(x), grain)


def month_start(x: Any) -> Expr:
    return truncated_to(x, Grain.MONTH)


def _months(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c) - 1


@dataclass(frozen=True, eq=False)
class DateBucket(Expr):
    """The start of the fixed-width stretch, counted from an origin, that a time lies in."""

    expr: Expr
    unit: Unit
    width: int = 1
    origin: dt.datetime = dt.datetime(1900, 1, 1)

    def __post_init__(self) -> None:
        if self.width < 1:
            raise ArgumentError("a bucket is at least one unit wide")
        object.__setattr__(self, "kind", self.expr.kind or "timestamp_ntz")

    def parts(self) -> tuple[Expr, ...]:
        return (self.expr,)

    def to_column(self, scope: Scope) -> Column:
        c, origin = self.expr.to_column(scope), F.lit(self.origin).cast("timestamp_ntz")
        c = c.cast("timestamp_ntz")
        if self.unit in MONTHS:
            width = MONTHS[self.unit] * self.width
            apart = _months(c) - (self.origin.year * 12 + self.origin.month - 1)
            # A month is complete only where its day and time are those of the origin or later.
            apart = apart - F.when(F.timestamp_add("MONTH", apart, origin) > c, 1).otherwise(0)
            out = F.timestamp_add("MONTH", (F.floor(apart / width) * width).cast("int"), origin)
        else:
            width = MICROS[self.unit] * self.width
            apart = F.timestamp_diff("MICROSECOND", origin, c)
            out = F.timestamp_add("MICROSECOND", apart - F.pmod(apart, F.lit(width)), origin)
        return out.cast(self.kind)


def date_bucket(x: Any, unit: Unit, width: int = 1, origin: dt.datetime = dt.datetime(1900, 1, 1)) -> Expr:
    return DateBucket(_col(x), unit, width, origin)


@dataclass(frozen=True, eq=False)
class DateDiff(Expr):
    """Boundaries of a unit crossed from start to end; a week begins on Sunday."""

    unit: Unit
    start: Expr
    end: Expr
    kind = "int"

    def parts(self) -> tuple[Expr, ...]:
        return (self.start, self.end)

    def to_column(self, scope: Scope) -> Column:
        a, b = (p.to_column(scope).cast("timestamp_ntz") for p in self.parts())
        if self.unit is Unit.YEAR:
            out = F.year(b) - F.year(a)
        elif self.unit is Unit.QUARTER:
            out = F.year(b) * 4 + F.quarter(b) - F.year(a) * 4 - F.quarter(a)
        elif self.unit is Unit.MONTH:
            out = _months(b) - _months(a)
        elif self.unit is Unit.DAY:
            out = F.datediff(b, a)
        elif self.unit is Unit.WEEK:
            # Day 3 of 1970 was a Sunday.
            week = lambda c: F.floor((F.unix_date(F.to_date(c)) - 3) / 7)
            out = week(b) - week(a)
        else:
            step = lambda c: F.floor(micros(c) / MICROS[self.unit])
            out = step(b) - step(a)
        return out.cast("int")


def date_diff(unit: Unit, start: Any, end: Any) -> Expr:
    as_expr = lambda x: Lit(x) if isinstance(x, dt.date) else _col(x)
    return DateDiff(unit, as_expr(start), as_expr(end))


__all__ = [n for n, v in list(globals().items()) if getattr(v, "__module__", None) == __name__ and not n.startswith("_")]
__all__ += ["where_today", "where_before_today", "where_after_today", "where_today_or_before", "where_today_or_after"]
__all__ += ["where_past", "where_future", "where_now_or_past", "where_now_or_future"]
