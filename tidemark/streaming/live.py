"""Live true peak of chunks, with a processor that is set up, fed, flushed and closed.

State of a series: the frames that the interpolation still needs, the peak so far, the
chunk that is due, and chunks that came before their turn. A series ends with its final
chunk, or by a timer once the watermark is ``idle`` past its latest chunk; then the
frames that are left are interpolated into silence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import design as d
from tidemark.operators.kernels import oversampling

TAPS = 24
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "clip_id string, channel int, chunks long, frames long, peak double, ended boolean, missing long"


class TruePeakMeter(StatefulProcessor):
    """A row for each series and batch: chunks and frames so far, peak so far; at its end also how many chunks never came."""

    def __init__(self, rate: int, idle_ms: int):
        self.rate, self.idle_ms = rate, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bank = d.polyphase(oversampling(self.rate), TAPS)[1:]
        self.meter = handle.getValueState("meter", "due long, chunks long, frames long, peak double, tail array<double>, timer long")
        self.early = handle.getMapState("early", "chunk_idx long", "samples array<double>, final boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, chunks, frames, peak, tail, timer = self._now()
        latest, final = 0, False
        for pdf in rows:
            latest = max(latest, int(pdf["ts"].max().timestamp() * 1000))
            for i, samples, last in zip(pdf["chunk_idx"], pdf["samples"], pdf["final"], strict=True):
                if i >= due:  # what comes again has been metered
                    self.early.updateValue((int(i),), ([float(x) for x in ([] if samples is None else samples)], bool(last)))
        while not final and self.early.containsKey((due,)):
            samples, final = self.early.getValue((due,))
            peak, tail = self._heard(np.asarray(samples, float), tail, peak)
            self.early.removeKey((due,))
            due, chunks, frames = due + 1, chunks + 1, frames + len(samples)
        if final:
            yield self._end(key, due, chunks, frames, peak, tail, timer)
            return
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = max(timer, latest + self.idle_ms)
        self.handle.registerTimer(timer)
        self.meter.update((due, chunks, frames, peak, tail.tolist(), timer))
        yield self._row(key, chunks, frames, peak, False, 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.meter.exists():
            due, chunks, frames, peak, tail, _ = self._now()
            yield self._end(key, due, chunks, frames, peak, tail, -1)

    def close(self) -> None:
        self.bank = None

    def _now(self) -> tuple:
        """A new series starts in silence."""
        if not self.meter.exists():
            return 0, 0, 0, 0.0, np.zeros(TAPS // 2 - 1), -1
        due, chunks, frames, peak, tail, timer = self.meter.get()
        return due, chunks, frames, peak, np.asarray(tail, float), timer

    def _heard(self, x: np.ndarray, tail: np.ndarray, peak: float) -> tuple[float, np.ndarray]:
        """The peak with what can be interpolated by now, and the frames that the next chunk needs."""
        both = np.concatenate([tail, x])
        peak = max(peak, float(np.abs(x).max(initial=0.0)))
        if len(both) >= TAPS:
            peak = max([peak, *(float(np.abs(np.convolve(both, phase[::-1], "valid")).max()) for phase in self.bank)])
        return peak, both[-(TAPS - 1) :]

    def _end(self, key, due: int, chunks: int, frames: int, peak: float, tail: np.ndarray, timer: int) -> pd.DataFrame:
        """What came early follows silence for the chunks that are missing; then all state goes."""
        rest = np.zeros(TAPS // 2)
        missing = 0
        for (i,), (samples, _) in sorted(((tuple(k), tuple(v)) for k, v in self.early.iterator()), key=lambda kv: kv[0][0]):
            peak, tail = self._heard(rest, tail, peak)
            peak, tail = self._heard(np.asarray(samples, float), np.zeros(TAPS // 2 - 1), peak)
            missing, due = missing + i - due, i + 1
            chunks, frames = chunks + 1, frames + len(samples)
        peak, _ = self._heard(rest, tail, peak)
        if timer >= 0:
            self.handle.deleteTimer(timer)
        self.meter.clear()
        self.early.clear()
        return self._row(key, chunks, frames, peak, True, missing)

    def _row(self, key, chunks: int, frames: int, peak: float, ended: bool, missing: int) -> pd.DataFrame:
        return pd.DataFrame({"clip_id": [key[0]], "channel": [key[1]], "chunks": [chunks], "frames": [frames], "peak": [peak], "ended": [ended], "missing": [missing]})


def true_peaks(chunks: DataFrame, rate: int, idle: str = "10 seconds") -> DataFrame:
    """``OUT`` for chunks (clip_id, channel, chunk_idx from 0, ts, samples, final), streamed or not.

    Chunks of a series may come in any order and more than once. A null or empty
    chunk has no frames; a null ``final`` is none. After its end a series may begin anew.
    The session's state store has to be ``STORE``.
    """
    _ = chunks.sparkSession.streams.active  # starts what keeps track of state stores, which a batch needs too
    amount, unit = idle.split()
    scale = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]
    rows = chunks.select("clip_id", F.col("channel").cast("int").alias("channel"), F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("ts").cast("timestamp").alias("ts"), F.col("samples").cast("array<double>").alias("samples"), F.coalesce("final", F.lit(False)).alias("final"))
    kind = dict(rows.dtypes)["clip_id"]
    own = rows.withWatermark("ts", idle).groupBy("clip_id", "channel")
    return own.transformWithStateInPandas(TruePeakMeter(rate, int(amount) * scale), OUT.replace("clip_id string", f"clip_id {kind}"), "Update", "EventTime")
