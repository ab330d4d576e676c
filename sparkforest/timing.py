"""Wall-clock seconds by phase. Spark is lazy: put actions or checkpoints inside the phase."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class PhaseTimer:
    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        t = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - t

    def total(self) -> float:
        return sum(self.seconds.values())

    def reset(self) -> None:
        self.seconds.clear()

    def table(self, spark: SparkSession) -> DataFrame:
        """(phase, ms), longest first."""
        rows = sorted(((k, 1000 * v) for k, v in self.seconds.items()), key=lambda r: -r[1])
        return spark.createDataFrame(rows, "phase string, ms double")
