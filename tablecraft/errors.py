"""What is refused, and why. Every error of the library derives from ``TablecraftError``."""

from __future__ import annotations


class TablecraftError(Exception):
    """Base of all errors raised on purpose."""


class QueryShapeError(TablecraftError, ValueError):
    """Clauses that do not go together or are incomplete."""


class ArgumentError(TablecraftError, ValueError):
    """A value that an operator does not take."""


class NullComparisonError(ArgumentError):
    """A comparison with a bare null; use ``is_null``."""


class TypeRuleError(TablecraftError, TypeError):
    """An operator that the declared type does not have."""


class CapabilityError(TablecraftError):
    """Something the target cannot do."""


class UnknownNameError(TablecraftError, KeyError):
    """A table, column, relation or field that is not declared."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


class RowNotFoundError(TablecraftError):
    """A row was required and none was there."""


class MultipleRowsError(TablecraftError):
    """One row was required and more were there."""


class ResultTypeError(TablecraftError):
    """A result that cannot be given without loss."""


class UnsafeWriteError(TablecraftError):
    """An update or delete without a predicate of its own."""


class AffectedRowsError(TablecraftError):
    """A write met another number of rows than it had to."""

    def __init__(self, operation: str, expected: int, actual: int):
        super().__init__(f"{operation}: {expected} rows expected, {actual} met")
        self.operation, self.expected, self.actual = operation, expected, actual


class ConcurrencyError(TablecraftError):
    """A row or table has another version than the writer had read."""


class UniqueKeyError(TablecraftError):
    """A row with this key is already there."""


class ReadOnlyColumnError(TablecraftError):
    """A column that is never written."""


class CursorError(TablecraftError):
    """A cursor that does not belong to this order, filter or version."""


class RelationError(TablecraftError):
    """A relation that cannot be loaded, filtered or written this way."""


class CardinalityError(RelationError):
    """More than one row behind a to-one relation."""


class UnknownMorphError(RelationError):
    """A discriminator without a declared target."""


class SchemaDriftError(TablecraftError):
    """A live schema that breaks what was declared."""


class RecursionLimitError(TablecraftError):
    """A walk that did not end within its limit."""


__all__ = [n for n, v in list(globals().items()) if isinstance(v, type) and issubclass(v, TablecraftError)]
