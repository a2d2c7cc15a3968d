"""Scope timers and their log."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path


class Timings:
    """Seconds of named scopes, in the order in which they end."""

    def __init__(self) -> None:
        self.entries: list[tuple[str, float]] = []

    @contextmanager
    def scope(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.entries.append((name, time.perf_counter() - began))

    def report(self) -> str:
        total: dict[str, list[float]] = {}
        for name, s in self.entries:
            total.setdefault(name, []).append(s)
        return "".join(f"{name:<40} {len(v):>6} x {sum(v):>12.3f} s\n" for name, v in total.items())

    def append_to(self, path: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        with Path(path).open("a") as f:
            f.write(self.report())
