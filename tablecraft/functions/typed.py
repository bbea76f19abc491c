"""Columns with declared types: values take the column's type, operators the type does not have are refused."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from enum import Enum
from typing import Any

from ..errors import ArgumentError, NullComparisonError, TypeRuleError
from .expr import Col, Condition, Lit, Operator, Comparison

#: Declared base types, the family they belong to and the Spark type they have.
TYPE_FAMILIES = {
    "bit": ("boolean", "boolean"),
    "tinyint": ("integer", "smallint"),
    "smallint": ("integer", "smallint"),
    "int": ("integer", "int"),
    "bigint": ("integer", "bigint"),
    "real": ("approximate", "float"),
    "float": ("approximate", "double"),
    "decimal": ("exact", "decimal(18,2)"),
    "numeric": ("exact", "decimal(18,2)"),
    "money": ("exact", "decimal(19,4)"),
    "smallmoney": ("exact", "decimal(10,4)"),
    "char": ("text", "string"),
    "varchar": ("text", "string"),
    "nchar": ("text", "string"),
    "nvarchar": ("text", "string"),
    "text": ("text", "string"),
    "ntext": ("text", "string"),
    "binary": ("binary", "binary"),
    "varbinary": ("binary", "binary"),
    "image": ("binary", "binary"),
    "rowversion": ("binary", "bigint"),
    "date": ("temporal", "date"),
    "smalldatetime": ("temporal", "timestamp_ntz"),
    "datetime": ("temporal", "timestamp_ntz"),
    "datetime2": ("temporal", "timestamp_ntz"),
    "datetimeoffset": ("temporal", "timestamp"),
    "time": ("temporal", "interval day to second"),
    "uniqueidentifier": ("guid", "string"),
    "xml": ("xml", "string"),
}
#: Types that can be read as text and not written.
READ_AS_TEXT = ("hierarchyid", "geometry", "geography", "sql_variant")


def family_of(spark_type: str | None) -> str | None:
    """The family of a Spark type."""
    if spark_type is None:
        return None
    if spark_type.startswith("decimal"):
        return "exact"
    return {
        "boolean": "boolean", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "approximate",
        "double": "approximate", "string": "text", "binary": "binary", "date": "temporal", "timestamp": "temporal",
        "timestamp_ntz": "temporal",
    }.get(spark_type)


@dataclass(frozen=True)
class Converter:
    """Two ways between stored values and values of the program; nulls pass both."""

    decode: Callable[[Any], Any]
    encode: Callable[[Any], Any]

    def to_program(self, value: Any) -> Any:
        return None if value is None else self.decode(value)

    def to_store(self, value: Any) -> Any:
        return None if value is None else self.encode(value)


@dataclass(frozen=True, eq=False)
class TypedCol(Col):
    """A column of a declared Spark type; bound values are cast, never the column."""

    type_name: str = "string"
    converter: Converter | None = None
    members: type[Enum] | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        object.__setattr__(self, "kind", self.type_name)

    @property
    def family(self) -> str | None:
        return family_of(self.type_name)

    def at(self, source: Any) -> TypedCol:
        """The same column of another source."""
        return replace(self, source=source)

    def value(self, v: Any) -> Lit:
        if v is None:
            raise NullComparisonError(f"{self.name} cannot be compared with null; use is_null")
        if self.members is not None:
            if not isinstance(v, self.members):
                raise TypeRuleError(f"{self.name} takes members of {self.members.__name__}")
            v = v.value
        if self.converter is not None:
            v = self.converter.to_store(v)
        good = {"boolean": bool, "integer": int, "text": str}.get(self.family or "")
        if good and (not isinstance(v, good) or (good is int and isinstance(v, bool))):
            raise TypeRuleError(f"{self.name} is {self.type_name}; {type(v).__name__} does not fit")
        return Lit(v, self.type_name)

    def _compare(self, op: Operator, value: Any) -> Condition:
        from .expr import Expr

        if self.family == "boolean" and op not in (Operator.EQ, Operator.NE):
            raise TypeRuleError(f"{self.name} is boolean and has no order")
        return Comparison(self, op, value if isinstance(value, Expr) else self.value(value))

    def in_list(self, values, on_empty=None):  # type: ignore[override]
        from .expr import EmptyIn

        return super().in_list([self.value(v) for v in values], on_empty or EmptyIn.ERROR)

    def not_in_list(self, values, on_empty=None):  # type: ignore[override]
        from .expr import EmptyIn

        return super().not_in_list([self.value(v) for v in values], on_empty or EmptyIn.ERROR)

    def between(self, low: Any, high: Any) -> Condition:
        return super().between(self.value(low), self.value(high))

    def is_true(self) -> Condition:
        return self._flag(True)

    def is_false(self) -> Condition:
        return self._flag(False)

    def _flag(self, value: bool) -> Condition:
        if self.family != "boolean":
            raise TypeRuleError(f"{self.name} is not boolean")
        return self.eq(value)


def typed(name: str, type_name: str, source: Any = None, **options: Any) -> TypedCol:
    if not type_name:
        raise ArgumentError("a typed column needs a type")
    return TypedCol(name, source, type_name, **options)


__all__ = ["TYPE_FAMILIES", "READ_AS_TEXT", "Converter", "TypedCol", "family_of", "typed"]
