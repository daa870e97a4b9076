"""What the driver keeps about its own work: counters, gauges, histograms and timers by name, and health checks.

Numbers about rows are not counted here but observed as they go by (search.observed), where tasks run.
"""

from __future__ import annotations

import threading
import time
from bisect import bisect_left
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

#: Upper bounds of a histogram's buckets; one more holds what is above.
BOUNDS = tuple(m * 10.0**e for e in range(-4, 5) for m in (1, 2, 5))


@dataclass
class Histogram:
    bounds: tuple[float, ...] = BOUNDS
    counts: list[int] = field(default_factory=list)
    total: float = 0.0
    low: float = float("inf")
    high: float = float("-inf")

    def __post_init__(self):
        self.counts = self.counts or [0] * (len(self.bounds) + 1)

    @property
    def count(self) -> int:
        return sum(self.counts)

    @property
    def mean(self) -> float:
        return self.total / self.count if self.count else 0.0

    def add(self, x: float) -> None:
        self.counts[bisect_left(self.bounds, x)] += 1
        self.total, self.low, self.high = self.total + x, min(self.low, x), max(self.high, x)

    def quantile(self, q: float) -> float:
        """The upper bound of the bucket that the share q of all values reaches, at most the largest value; 0 without values."""
        left = q * self.count
        for bound, n in zip((*self.bounds, self.high), self.counts, strict=True):
            left -= n
            if n and left <= 0:
                return min(bound, self.high)
        return self.high if self.count else 0.0


class Metrics:
    """Names are made when they are first used. Safe for several threads."""

    def __init__(self):
        self._lock, self.counters, self.gauges, self.histograms = threading.Lock(), {}, {}, {}

    def count(self, name: str, by: int = 1) -> None:
        if by < 0:
            raise ValueError("a counter never falls")
        with self._lock:
            self.counters[name] = self.counters.get(name, 0) + by

    def gauge(self, name: str, value: float) -> None:
        with self._lock:
            self.gauges[name] = value

    def record(self, name: str, value: float) -> None:
        with self._lock:
            self.histograms.setdefault(name, Histogram()).add(value)

    @contextmanager
    def timed(self, name: str):
        """Records the seconds that the block takes, also if it fails."""
        start = time.perf_counter()
        try:
            yield
        finally:
            self.record(name, time.perf_counter() - start)

    def snapshot(self) -> dict:
        with self._lock:
            return {"counters": dict(self.counters), "gauges": dict(self.gauges), "histograms": {k: {"count": h.count, "mean": h.mean, "p50": h.quantile(0.5), "p99": h.quantile(0.99)} for k, h in self.histograms.items()}}


def health(checks: dict[str, Callable[[], bool]]) -> dict[str, str]:
    """'healthy', 'unhealthy' or the error of each check, and 'all', which is healthy only if all are."""
    out = {}
    for name, check in checks.items():
        try:
            out[name] = "healthy" if check() else "unhealthy"
        except Exception as e:
            out[name] = f"failed: {e}"
    return out | {"all": "healthy" if all(v == "healthy" for v in out.values()) else "unhealthy"}
