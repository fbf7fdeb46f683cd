"""Seconds by phase of work that ends in actions; a plan alone takes no time."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager


class Phases:
    """Counters that add up how long, and how often, named phases ran."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}
        self.times: dict[str, int] = {}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
            self.times[name] = self.times.get(name, 0) + 1

    def reset(self) -> None:
        self.seconds.clear()
        self.times.clear()

    def lines(self) -> list[str]:
        return [f"{name}: {self.seconds[name]:.3f} s in {self.times[name]} runs" for name in sorted(self.seconds)]
