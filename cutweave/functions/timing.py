"""Phase clock and its report."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Phases:
    """Adds up wall-clock seconds by name: ``with phases.time("trim"): ...``"""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def time(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def report(self, spark: SparkSession) -> DataFrame:
        """(phase, seconds, share of all), a row per phase."""
        df = spark.createDataFrame(list(self.seconds.items()), "phase string, seconds double")
        total = sum(self.seconds.values())
        return df.withColumn("share", F.col("seconds") / F.lit(total) if total else F.lit(None).cast("double"))
