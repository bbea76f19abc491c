"""A result again and again, when it differs."""

from __future__ import annotations

import queue
import time
from collections.abc import Callable, Iterator
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import ArgumentError


class WatchStrategy(Enum):
    LOCAL_WRITES, POLLING = "local_writes", "polling"


def rows_equal(a: list[Row] | None, b: list[Row] | None) -> bool:
    """Equal columns with equal values, row by row."""
    if a is None or b is None or len(a) != len(b):
        return False
    return all(x.asDict(True) == y.asDict(True) for x, y in zip(a, b, strict=True))


class Watch:
    """An iterator over results: the first one, then each that differs from the one before.

    One read is under way at a time; changes that arrive meanwhile lead to one
    more read. ``close`` ends it.
    """

    def __init__(
        self,
        read: Callable[[], list[Row]],
        tables: list[str],
        hub: Any,
        strategy: WatchStrategy = WatchStrategy.LOCAL_WRITES,
        interval: float = 5.0,
    ):
        if strategy is WatchStrategy.LOCAL_WRITES and not tables:
            raise ArgumentError("watching writes needs the tables")
        if strategy is WatchStrategy.POLLING and interval <= 0:
            raise ArgumentError("an interval is positive")
        self._read, self._strategy, self._interval = read, strategy, interval
        self._heard: queue.Queue[str | None] = queue.Queue()
        self._leave = hub.listen(tables, self._heard.put) if strategy is WatchStrategy.LOCAL_WRITES else lambda: None
        self._last: list[Row] | None = None
        self._closed = False

    def __iter__(self) -> Iterator[list[Row]]:
        return self

    def __next__(self) -> list[Row]:
        while not self._closed:
            if self._last is not None and not self._wait():
                break
            rows = self._read()
            if not rows_equal(rows, self._last):
                self._last = rows
                return rows
        raise StopIteration

    def pending(self) -> bool:
        return not self._heard.empty()

    def _wait(self) -> bool:
        if self._strategy is WatchStrategy.POLLING:
            time.sleep(self._interval)
            return not self._closed
        name = self._heard.get()
        while name is not None and not self._heard.empty():
            name = self._heard.get()
        return name is not None and not self._closed

    def close(self) -> None:
        self._closed = True
        self._leave()
        self._heard.put(None)


def stream_windows(
    events: DataFrame, time_col: str, width: str, keys: list[str] | None = None, late: str = "10 minutes", slide: str | None = None
) -> DataFrame:
    """Counts per window of a stream, or of a batch; rows later than ``late`` are dropped. An extension."""
    rows = events.withWatermark(time_col, late) if events.isStreaming else events
    window = F.window(F.col(time_col), width, slide or width)
    return rows.groupBy(window, *(keys or [])).count().select("window.start", "window.end", *(keys or []), "count")


def stream_sessions(events: DataFrame, time_col: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts per session of a key. An extension."""
    rows = events.withWatermark(time_col, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(F.col(time_col), gap), *keys).count()
    return out.select("session_window.start", "session_window.end", *keys, "count")


def watch_folder(spark: Any, path: str, schema: Any, handle: Callable[[DataFrame, int], None], checkpoint: str) -> Any:
    """Calls ``handle`` with the new rows of a Parquet folder, batch by batch, each once."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["Watch", "WatchStrategy", "rows_equal", "stream_sessions", "stream_windows", "watch_folder"]
