"""Seconds by phase, and how often each ran."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Phases:
    """Phases within phases are counted in both, so totals may overlap."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}
        self.runs: dict[str, int] = {}

    @contextmanager
    def of(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
            self.runs[name] = self.runs.get(name, 0) + 1

    def reset(self) -> None:
        self.seconds.clear()
        self.runs.clear()

    def table(self, spark: SparkSession) -> DataFrame:
        """phase, runs, seconds."""
        return spark.createDataFrame([(k, self.runs[k], v) for k, v in self.seconds.items()], "phase string, runs long, seconds double")
