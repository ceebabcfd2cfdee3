"""Time and memory of a scan's phases, on the driver."""

from __future__ import annotations

import functools
import threading
import time
import tracemalloc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Metric:
    """Calls of one name."""

    seconds: list[float] = field(default_factory=list)

    @property
    def total(self) -> float:
        return sum(self.seconds)


class Profile:
    """Seconds by name; safe for several threads."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._of: dict[str, Metric] = {}
        self.peak_bytes: dict[str, int] = {}

    def record(self, name: str, seconds: float) -> None:
        with self._lock:
            self._of.setdefault(name, Metric()).seconds.append(seconds)

    @contextmanager
    def measure(self, name: str) -> Iterator[None]:
        begun = time.perf_counter()
        try:
            yield
        finally:
            self.record(name, time.perf_counter() - begun)

    @contextmanager
    def memory(self, name: str) -> Iterator[None]:
        """The most Python memory that a block adds."""
        ours = not tracemalloc.is_tracing()
        if ours:
            tracemalloc.start()
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        try:
            yield
        finally:
            self.peak_bytes[name] = tracemalloc.get_traced_memory()[1] - before
            if ours:
                tracemalloc.stop()

    def timed(self, function: Callable) -> Callable:
        """A decorator that measures calls under the function's qualified name."""

        @functools.wraps(function)
        def run(*args, **kwargs):
            with self.measure(function.__qualname__):
                return function(*args, **kwargs)

        return run

    def summary(self) -> list[tuple[str, int, float]]:
        """(name, calls, seconds), the longest in total first."""
        with self._lock:
            return sorted(((n, len(m.seconds), m.total) for n, m in self._of.items()), key=lambda x: (-x[2], x[0]))

    def rate(self, name: str) -> float:
        """Calls a second; 0 for none."""
        m = self._of.get(name)
        return len(m.seconds) / m.total if m and m.total else 0.0

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, seconds), a row a call."""
        return spark.createDataFrame([(n, s) for n, m in self._of.items() for s in m.seconds], "name string, seconds double")

    def reset(self) -> None:
        with self._lock:
            self._of.clear()
            self.peak_bytes.clear()
