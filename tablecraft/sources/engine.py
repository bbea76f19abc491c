"""The engine: a borrowed session, the tables it knows, where writes go."""

from __future__ import annotations

import datetime as dt
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConcurrencyError, UnknownNameError
from ..functions.expr import Scope
from ..streaming.hub import ChangeHub
from .store import VersionedStore


class Engine:
    """Finds tables, lowers queries, publishes writes. It never stops the session it was given."""

    def __init__(
        self,
        spark: SparkSession,
        root: str | None = None,
        store: VersionedStore | None = None,
        fixed_now: dt.datetime | None = None,
    ):
        self.spark, self.root, self.store, self.fixed_now = spark, root, store, fixed_now
        self.hub = ChangeHub()
        self.observers: list[Callable[[dict], None]] = []
        self._known: dict[tuple[str, ...], Any] = {}
        self._staged: list[dict[str, DataFrame]] = []
        self._base: int | None = None
        self._functions: dict[str, Callable[..., Any]] = {}

    # Tables.
    def register(self, name: str | Sequence[str], what: DataFrame | str) -> Engine:
        """Makes a frame, or the path of a Parquet table, known under a name."""
        from ..operators.query import name_parts

        self._known[tuple(p.lower() for p in name_parts(name))] = what
        return self

    def table(self, name: str | Sequence[str]) -> DataFrame:
        from ..operators.query import name_parts

        parts = tuple(p.lower() for p in name_parts(name))
        key = ".".join(parts)
        for stage in reversed(self._staged):
            if key in stage:
                return stage[key]
        if parts in self._known:
            known = self._known[parts]
            return self.spark.read.parquet(known) if isinstance(known, str) else known
        if self.store is not None and key in self.store.manifest(self._base):
            return self.store.read(key, self._base)
        if self.root is not None and len(parts) == 1:
            return self.spark.read.parquet(f"{self.root}/{parts[0]}.parquet")
        if self.spark.catalog.tableExists(key):
            return self.spark.table(key)
        raise UnknownNameError(f"no table {key}")

    def settled(self, df: DataFrame) -> DataFrame:
        """The frame evaluated once: a table in the session's checkpoint folder, read again.

        Columns of no type cannot be stored; they are checkpointed.
        """
        folder = self.spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if not self.spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="tablecraft-")
            self.spark.conf.set("spark.checkpoint.dir", folder)
        if "void" in df.schema.simpleString():
            if self.spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
                self.spark.sparkContext.setCheckpointDir(folder)
            return df.checkpoint()
        path = f"{folder.rstrip('/')}/tablecraft/settled-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # Running.
    def query(self, q: Any) -> DataFrame:
        began = time.perf_counter()
        try:
            df = q.lower(Scope(engine=self))
        except Exception as e:
            self._tell(kind="query", text=q.text(), seconds=time.perf_counter() - began, error=e)
            raise
        self._tell(kind="query", text=q.text(), seconds=time.perf_counter() - began, error=None)
        return df

    def execute(self, statement: Any) -> Any:
        began = time.perf_counter()
        try:
            out = statement.run(self)
        except Exception as e:
            self._tell(kind="write", text=type(statement).__name__, seconds=time.perf_counter() - began, error=e)
            raise
        self._tell(kind="write", text=type(statement).__name__, seconds=time.perf_counter() - began, error=None, rows=out.affected)
        return out

    def _tell(self, **event: Any) -> None:
        for observer in self.observers:
            observer(event)

    def procedure(self, name: str, function: Callable[..., Any]) -> None:
        self._functions[name.lower()] = function

    def call(self, name: str, *args: Any) -> Any:
        if name.lower() not in self._functions:
            raise UnknownNameError(f"no procedure {name}")
        return self._functions[name.lower()](self, *args)

    # Writes.
    def put(self, changes: dict[str, DataFrame]) -> None:
        """New contents of tables: staged within a transaction, published at once outside."""
        changes = {k.lower(): v for k, v in changes.items()}
        if self._staged:
            self._staged[-1].update({k: self.settled(v) for k, v in changes.items()})
            return
        self._publish(changes)

    def _publish(self, changes: dict[str, DataFrame]) -> None:
        if self.store is not None:
            self.store.commit(changes, self._base)
        else:
            for name, df in changes.items():
                self.register(name, self.settled(df))
        for name in changes:
            self.hub.note(name)
        self.hub.commit_pending()

    @contextmanager
    def transaction(self) -> Iterator[Engine]:
        """All or nothing; within another one, a savepoint."""
        outermost = not self._staged
        if outermost and self.store is not None:
            self._base = self.store.version()
        self._staged.append({})
        try:
            yield self
        except BaseException:
            self._staged.pop()
            if outermost:
                self._base = None
                self.hub.discard_pending()
            raise
        stage = self._staged.pop()
        if not outermost:
            self._staged[-1].update(stage)
            return
        try:
            if stage:
                self._publish(stage)
        except ConcurrencyError:
            self.hub.discard_pending()
            raise
        finally:
            self._base = None

    @contextmanager
    def snapshot(self) -> Iterator[Engine]:
        """Reads within see one version of the store."""
        before, self._base = self._base, self.store.version() if self.store is not None and self._base is None else self._base
        try:
            yield self
        finally:
            self._base = before


__all__ = ["Engine"]
