"""Live metering with Structured Streaming: windowed levels, sessions, and a stateful peak hold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.scalars import block_level, gain_to_db


def window_levels(rows: DataFrame, series: str, length: str = "3 seconds", step: str | None = "1 second", late: str = "10 seconds") -> DataFrame:
    """Level, peak and count of event-time windows of rows (series, ts, value); later rows than ``late`` are dropped.

    The same plan runs on batches, where the watermark has no effect.
    """
    own = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", length, step) if step else F.window("ts", length)
    v = F.col("value")
    out = own.groupBy(series, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), block_level(F.avg(v * v)).alias("level"), gain_to_db(F.max(F.abs(v))).alias("peak_db"))
    return out.select(series, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "level", "peak_db")


def stereo_windows(rows: DataFrame, series: str, length: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Correlation of windows of rows (series, ts, left, right): three sums, and 1 for silence."""
    own = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    x, y = F.col("left"), F.col("right")
    sums = own.groupBy(series, F.window("ts", length).alias("w")).agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    den = F.sqrt(F.col("xx") * F.col("yy"))
    return sums.select(series, F.col("w.start").alias("start"), F.when(den < 1e-20, F.lit(1.0)).otherwise(F.col("xy") / den).alias("correlation"))


def sessions(rows: DataFrame, series: str, gap: str, late: str = "10 seconds") -> DataFrame:
    """Bursts of rows that pauses of ``gap`` part."""
    own = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy(series, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(series, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key: stale results lose."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(version)).alias("r")).select(key, "r.*")


def trailing_levels(rows: DataFrame, series: str, lengths: dict[str, float]) -> DataFrame:
    """Rows (series, n, dt, value) with a level for each length: readings weighted by how long they stood.

    n numbers a series; dt are seconds. As many of the last readings count as it
    takes to reach the length, the one that reaches it whole.
    """
    so_far = rows.withColumn("at", F.round(F.sum("dt").over(Window.partitionBy(series).orderBy("n")) * 1e6).cast("bigint"))  # microseconds
    own = {}
    for name, seconds in lengths.items():
        w = Window.partitionBy(series).orderBy("at").rangeBetween(-round(seconds * 1e6), 0)
        power = F.sum(F.col("value") * F.col("value") * F.col("dt")).over(w) / F.sum("dt").over(w)
        own[name] = block_level(F.greatest(power, F.lit(1e-12)))
    return so_far.withColumns(own).drop("at")


def last_n(rows: DataFrame, series: str, order: str, n: int) -> DataFrame:
    """The last n rows of each series: a bounded history."""
    w = Window.partitionBy(series).orderBy(F.desc(order))
    return rows.withColumn("age", F.row_number().over(w) - 1).where(F.col("age") < n)


def peak_hold(rows: DataFrame, series: str, decay: float = 0.98) -> DataFrame:
    """series, n, peak: a peak that decays with every row, kept across micro-batches in event order of each batch."""

    def step(key: tuple, batches, state: GroupState):
        n, peak = state.get if state.exists else (0, 0.0)
        for b in batches:
            for v in b.sort_values("ts")["value"].abs().tolist():
                n, peak = n + 1, max(v, peak * decay)
        state.update((n, peak))
        yield pd.DataFrame({series: [key[0]], "n": [n], "peak": [peak]})

    kind = dict(rows.dtypes)[series]
    return rows.select(series, "ts", "value").groupBy(series).applyInPandasWithState(step, f"{series} {kind}, n long, peak double", "n long, peak double", "update", GroupStateTimeout.NoTimeout)
