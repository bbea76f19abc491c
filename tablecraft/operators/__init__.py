"""Queries, set queries, common tables, hierarchies, paging, entities, relations, writes."""

from .entity import *  # noqa: F403
from .hierarchy import *  # noqa: F403
from .keyset import *  # noqa: F403
from .query import *  # noqa: F403
from .relations import *  # noqa: F403
from .repository import *  # noqa: F403
from .writes import *  # noqa: F403
