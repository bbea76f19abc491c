"""Keyset paging: cursors, and the predicate that is true of the rows behind one."""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from ..errors import CursorError, QueryShapeError
from ..functions.expr import Col, Condition, Expr, Junction, Lit, Order, Truth, and_, or_

CURSOR_VERSION = 1
_READ = {
    "datetime": dt.datetime.fromisoformat, "date": dt.date.fromisoformat, "Decimal": decimal.Decimal,
    "int": int, "float": float, "str": str, "bool": lambda s: s == "True", "NoneType": lambda s: None,
}


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def order_signature(orders: Sequence[Order]) -> str:
    return _digest("|".join(o.text() for o in orders))


def filter_signature(conditions: Sequence[Condition]) -> str:
    return _digest("|".join(c.text() for c in conditions))


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: the values of its order, for this order and this filter."""

    order: str
    filter: str
    keys: tuple[Any, ...]
    version: int = CURSOR_VERSION

    def token(self) -> str:
        keys = [(type(k).__name__, k.isoformat() if isinstance(k, dt.date) else str(k)) for k in self.keys]
        return base64.urlsafe_b64encode(json.dumps([self.version, self.order, self.filter, keys]).encode()).decode()

    @staticmethod
    def parse(token: str) -> Cursor:
        try:
            version, order, filters, keys = json.loads(base64.urlsafe_b64decode(token))
            return Cursor(order, filters, tuple(_READ[kind](text) for kind, text in keys), version)
        except Exception as e:
            raise CursorError("not a cursor") from e

    def check(self, orders: Sequence[Order], conditions: Sequence[Condition]) -> None:
        if self.version != CURSOR_VERSION:
            raise CursorError(f"a cursor of version {self.version}")
        if self.order != order_signature(orders):
            raise CursorError("the cursor belongs to another order")
        if self.filter != filter_signature(conditions):
            raise CursorError("the cursor belongs to another filter")
        if len(self.keys) != len(orders):
            raise CursorError("the cursor has another number of keys")


def require_named(orders: Sequence[Order], what: str) -> None:
    if not orders:
        raise QueryShapeError(f"{what} needs an order")
    for o in orders:
        if not isinstance(o.expr, Col):
            raise QueryShapeError(f"{what} is ordered by columns, not by {type(o.expr).__name__}")


def reverse_orders(orders: Sequence[Order]) -> tuple[Order, ...]:
    return tuple(o.reversed() for o in orders)


def _bound(expr: Expr, key: Any) -> Lit:
    return Lit(key, expr.kind)


def _beyond(order: Order, key: Any) -> Condition:
    """True of values that come later in this term alone."""
    if key is None:
        return order.expr.is_not_null() if order.nulls_lead else Truth(False)
    later = order.expr.lt(_bound(order.expr, key)) if order.descending else order.expr.gt(_bound(order.expr, key))
    return later if order.nulls_lead else or_([later, order.expr.is_null()])


def _same(order: Order, key: Any) -> Condition:
    return order.expr.is_null() if key is None else order.expr.eq(_bound(order.expr, key))


def after(orders: Sequence[Order], keys: Sequence[Any]) -> Condition:
    """True of the rows strictly behind ``keys``: later in a term and equal in all terms ahead of it."""
    if len(orders) != len(keys):
        raise CursorError("the cursor has another number of keys")
    ways = []
    for i, order in enumerate(orders):
        equal = [_same(o, k) for o, k in zip(orders[:i], keys[:i], strict=True)]
        ways.append(and_([*equal, _beyond(order, keys[i])]))
    return Junction(False, tuple(ways))


def with_tie_break(orders: Sequence[Order], keys: Sequence[Expr]) -> tuple[Order, ...]:
    """The order, ended by the key columns that are not in it."""
    have = {o.expr.output_name().lower() for o in orders if isinstance(o.expr, Col)}
    return (*orders, *(Order(k) for k in keys if k.output_name().lower() not in have))


__all__ = ["Cursor", "after", "filter_signature", "order_signature", "require_named", "reverse_orders", "with_tie_break"]
