"""Who is told of a committed write."""

from __future__ import annotations

from collections.abc import Callable


class ChangeHub:
    """Table names collect until a commit publishes or a rollback drops them."""

    def __init__(self) -> None:
        self._pending: list[str] = []
        self._listeners: list[tuple[frozenset[str], Callable[[str], None]]] = []

    def listen(self, tables: list[str], heard: Callable[[str], None]) -> Callable[[], None]:
        entry = (frozenset(t.lower() for t in tables), heard)
        self._listeners.append(entry)
        return lambda: self._listeners.remove(entry) if entry in self._listeners else None

    def note(self, table: str) -> None:
        self._pending.append(table.lower())

    def commit_pending(self) -> None:
        names, self._pending = list(dict.fromkeys(self._pending)), []
        for name in names:
            for tables, heard in list(self._listeners):
                if name in tables:
                    heard(name)

    def discard_pending(self) -> None:
        self._pending = []
