"""Where a command's time goes: named phases on the driver; what tasks do is in Spark's own metrics."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager


class Phases:
    """Seconds and calls of each phase since this was made."""

    clock = staticmethod(time.monotonic)

    def __init__(self) -> None:
        self.begun = self.clock()
        self.seconds: dict[str, float] = {}
        self.calls: dict[str, int] = {}

    @contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        t = self.clock()
        try:
            yield
        finally:
            self.add(name, self.clock() - t)

    def add(self, name: str, seconds: float) -> None:
        self.seconds[name] = self.seconds.get(name, 0.0) + seconds
        self.calls[name] = self.calls.get(name, 0) + 1

    def report(self) -> dict:
        """Phases by time, what no phase accounts for, and by how much phases overlap."""
        whole = self.clock() - self.begun
        known = sum(self.seconds.values())
        order = sorted(self.seconds, key=lambda k: (-self.seconds[k], k))
        return {"seconds": round(whole, 3), "phases": [{"phase": k, "seconds": round(self.seconds[k], 3), "calls": self.calls[k]} for k in order], "unaccounted": round(max(whole - known, 0.0), 3), "overlap": round(max(known - whole, 0.0), 3)}
