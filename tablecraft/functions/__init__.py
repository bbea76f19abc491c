"""Expressions: values, predicates, aggregates, windows, dates."""

from .aggregates import *  # noqa: F403
from .expr import *  # noqa: F403
from .temporal import *  # noqa: F403
from .typed import *  # noqa: F403
from .windows import *  # noqa: F403
