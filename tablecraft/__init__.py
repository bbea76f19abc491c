"""Typed, immutable queries, entities and guarded writes over Spark DataFrames."""

from .errors import *  # noqa: F403
from .functions import *  # noqa: F403
from .operators import *  # noqa: F403
from .sources import *  # noqa: F403
