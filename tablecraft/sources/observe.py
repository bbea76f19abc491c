"""Events of statements, collected and described, values hidden."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


def redact(text: str) -> str:
    """A statement's text without the values bound in it."""
    import re

    return re.sub(r"Lit\((?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^:()]|\([^()]*\))*:", "Lit(?:", text)


@dataclass
class Recorder:
    """An observer that keeps what happened; ``show_values`` keeps bound values too."""

    show_values: bool = False
    events: list[dict[str, Any]] = field(default_factory=list)

    def __call__(self, event: dict[str, Any]) -> None:
        self.events.append(event if self.show_values else event | {"text": redact(event["text"])})

    @property
    def failures(self) -> list[dict[str, Any]]:
        return [e for e in self.events if e["error"] is not None]

    def describe(self) -> str:
        return "\n".join(
            f"{e['kind']} {e['seconds'] * 1000:.1f} ms {'failed: ' + type(e['error']).__name__ if e['error'] else 'done'}: {e['text']}"
            for e in self.events
        )


def observed(engine: Any, observer: Any) -> Any:
    engine.observers.append(observer)
    return engine


__all__ = ["Recorder", "observed", "redact"]
