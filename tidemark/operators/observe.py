"""Measures of a plan taken while it runs, and row counts that a stage must keep."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Recorder:
    """Named timings, and observed counts of the frames that ran."""

    def __init__(self):
        self.timings: list[tuple[str, float]] = []
        self.observed: dict[str, Observation] = {}

    def timed(self, name: str, run: Callable):
        """What ``run`` returns; its seconds are kept."""
        began = time.perf_counter()
        try:
            return run()
        finally:
            self.timings.append((name, time.perf_counter() - began))

    def watched(self, name: str, df: DataFrame, value: str | None = None) -> DataFrame:
        """The same frame; rows, and the finite share of a column, are counted as it runs."""
        o = self.observed[name] = Observation(name)
        more = [F.count_if(~F.isnan(value) & (F.abs(value) < float("inf"))).alias("finite")] if value else []
        return df.observe(o, F.count(F.lit(1)).alias("rows"), *more)

    def counts(self, name: str) -> dict:
        return self.observed[name].get

    def slowest(self, n: int = 3) -> list[tuple[str, float]]:
        return sorted(self.timings, key=lambda x: -x[1])[:n]
