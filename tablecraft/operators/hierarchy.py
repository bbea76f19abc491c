"""Walks of self-referencing tables, by Spark's recursive common tables."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.utils import AnalysisException

from ..errors import ArgumentError, RecursionLimitError
from ..functions.expr import sql_literal
from .query import LONGEST_RECURSION, Query, source


class Cycles(Enum):
    """What a node that is its own ancestor does: end in an error, or be visited once on a path."""

    ERROR, SKIP_VISITED = "error", "skip_visited"


@dataclass(frozen=True)
class Hierarchy:
    """A table whose rows name their parents."""

    table: Any
    key: str
    parent_key: str
    name: str = "tree"

    def descendants(
        self,
        engine: Any,
        root: Any = None,
        max_depth: int | None = None,
        include_root: bool = True,
        cycles: Cycles = Cycles.ERROR,
        max_recursion: int = 100,
    ) -> DataFrame:
        """``Key, ParentKey, Depth`` (and ``Path``, when visited nodes are skipped) below a root, or below all roots.

        Without a root the walk starts at rows without a parent. The walk is one
        plan, evaluated once, with any number of rows; ``max_recursion`` 0 means no limit.
        """
        if max_depth is not None and max_depth < 0:
            raise ArgumentError("a depth is not negative")
        if not 0 <= max_recursion <= LONGEST_RECURSION:
            raise ArgumentError(f"a recursion limit is from 0 to {LONGEST_RECURSION}")
        nodes = Query(source(self.table, "nodes")).select(self.key, self.parent_key).frame(engine).toDF("k", "p")
        spark = nodes.sparkSession
        start = "p IS NULL" if root is None else f"k = {sql_literal(root)}"
        skip = cycles is Cycles.SKIP_VISITED
        path, step = (", concat('/', CAST(k AS STRING), '/') AS path", ", concat(t.path, CAST(n.k AS STRING), '/')") if skip else ("", "")
        unseen = "AND locate(concat('/', CAST(n.k AS STRING), '/'), t.path) = 0" if skip else ""
        deeper = f"AND t.depth < {int(max_depth)}" if max_depth is not None else ""
        limit = f" MAX RECURSION LEVEL {max_recursion + 1}" if max_recursion else ""
        text = f"""
            WITH RECURSIVE t(k, p, depth{', path' if skip else ''}){limit} AS (
                SELECT k, p, 0 AS depth{path} FROM {{nodes}} WHERE {start}
                UNION ALL
                SELECT n.k, n.p, t.depth + 1{step} FROM {{nodes}} n JOIN t ON n.p = t.k {deeper} {unseen}
            )
            SELECT k AS Key, p AS ParentKey, depth AS Depth{', path AS Path' if skip else ''} FROM t
        """
        # Spark ends a walk at a level and, by default, at a million rows, whichever comes first; only the level is asked for here.
        # Both settings are read when the walk runs, so it runs here.
        lifted = ["spark.sql.cteRecursionRowLimit", *([] if max_recursion else ["spark.sql.cteRecursionLevelLimit"])]
        before = {name: spark.conf.get(name) for name in lifted}
        for name in lifted:
            spark.conf.set(name, "-1")
        try:
            walk = engine.settled(spark.sql(text, nodes=nodes))
        finally:
            for name, value in before.items():
                spark.conf.set(name, value)
        return walk if include_root else walk.where("Depth > 0")

    def checked(self, engine: Any, **options: Any) -> DataFrame:
        """The walk, with an error of this package for a cycle."""
        try:
            return self.descendants(engine, **options)
        except Exception as e:
            if "RECURSION_LEVEL_LIMIT_EXCEEDED" in str(e) or isinstance(e, AnalysisException) and "RECURSION" in str(e):
                raise RecursionLimitError(f"{self.name} did not end within its limit; is there a cycle?") from e
            raise


__all__ = ["Cycles", "Hierarchy"]
