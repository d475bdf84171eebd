"""Deterministic signals as chunk rows, made where they are read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.functions import design as d
from tidemark.operators.clips import CHUNKS, chunked

RATE = 48_000
ARROW = pa.schema([("clip_id", pa.string()), ("channel", pa.int32()), ("chunk_idx", pa.int64()), ("start_frame", pa.int64()), ("frame_count", pa.int32()), ("samples", pa.list_(pa.float32())), ("sample_rate", pa.int32())])


def sine(freq: float, seconds: float, amp: float = 0.5, rate: int = RATE) -> np.ndarray:
    return amp * np.sin(2 * np.pi * freq * np.arange(int(seconds * rate)) / rate)


def faded(x: np.ndarray, rate: int = RATE, ms: float = 10) -> np.ndarray:
    n = min(len(x) // 2, max(1, int(ms / 1000 * rate)))
    ramp = np.ones(len(x))
    ramp[:n] = 0.5 - 0.5 * np.cos(np.pi * np.arange(n) / n)
    ramp[-n:] = ramp[:n][::-1]
    return x * ramp


def white(seconds: float, amp: float = 0.3, seed: int = 1, rate: int = RATE) -> np.ndarray:
    return amp * (d.uniform(seed, 0, int(seconds * rate)) * 2 - 1)


def pink(seconds: float, amp: float = 0.15, seed: int = 3, rate: int = RATE, rows: int = 16) -> np.ndarray:
    """Rows of held random values, each changing half as often as the one before."""
    n = int(seconds * rate)
    total = np.zeros(n)
    for k in range(rows):
        v = d.uniform(d.derived_seed(seed, f"row:{k}"), 0, (n >> k) + 1) * 2 - 1
        total += np.repeat(v, 1 << k)[:n]
    return amp * total / np.sqrt(rows)


def sweep(seconds: float, low: float = 20, high: float = 20_000, amp: float = 0.5, rate: int = RATE) -> np.ndarray:
    t, k = np.arange(int(seconds * rate)) / rate, np.log(high / low)
    return amp * np.sin(2 * np.pi * low * seconds / k * (np.exp(t / seconds * k) - 1))


def bursts(seconds: float, amp: float = 1.6, rate: int = RATE) -> np.ndarray:
    """3.2 kHz bursts on an 80 Hz bed."""
    n = int(seconds * rate)
    t = np.arange(n) % (rate // 4)
    return 0.2 * np.sin(2 * np.pi * 80 * np.arange(n) / rate) + (amp - 0.2) * np.exp(-t / (0.004 * rate)) * np.sin(2 * np.pi * 3200 * t / rate)


def identification(channels: int, rate: int = RATE, amp: float = 0.25, beep_ms: float = 120, gap_ms: float = 120, pause_ms: float = 400, tone_ms: float = 800, tail_ms: float = 400, base: float = 220.0, beep_hz: float = 1000.0) -> np.ndarray:
    """n beeps and a tone of a semitone of its own for channel n, one channel after another."""
    n = lambda ms: max(1, int(ms / 1000 * rate + 0.5))
    total = sum((c + 1) * (n(beep_ms) + n(gap_ms)) + n(pause_ms) + n(tone_ms) + n(tail_ms) for c in range(channels))
    out, at = np.zeros((channels, total)), 0
    tone = lambda f, ms: faded(amp * np.sin(2 * np.pi * f * np.arange(n(ms)) / rate), rate, 3)
    for c in range(channels):
        for b in range(c + 1):
            a = at + b * (n(beep_ms) + n(gap_ms))
            out[c, a : a + n(beep_ms)] = tone(beep_hz, beep_ms)
        at += (c + 1) * (n(beep_ms) + n(gap_ms)) + n(pause_ms)
        out[c, at : at + n(tone_ms)] = tone(base * 2 ** (c / 12), tone_ms)
        at += n(tone_ms) + n(tail_ms)
    return out


def crackle(seconds: float, seed: int, rate: int = RATE, per_second: float = 6) -> np.ndarray:
    n = int(seconds * rate)
    u = d.uniform(seed, 0, 2 * n).reshape(n, 2)
    return np.where(u[:, 0] < per_second / rate, u[:, 1] * 2 - 1, 0.0)


def hiss(seconds: float, seed: int, rate: int = RATE) -> np.ndarray:
    return d.gaussian(seed, int(seconds * rate)) * 0.25


CATALOGUE = {
    "impulse": lambda: np.stack([np.eye(1, RATE // 2, 64)[0]] * 2),
    "sine-1k": lambda: np.stack([sine(1000, 4)] * 2),
    "sine-sweep": lambda: np.stack([sweep(2)] * 2),
    "multitone": lambda: np.stack([sum(sine(f, 4, 0.1) for f in (61, 149, 397, 1009, 2503, 5003, 9001))] * 2),
    **{f"bass-{f}": (lambda f=f: np.stack([faded(sine(f, 4))] * 2)) for f in (40, 50, 60, 80, 100)},
    "transient-train": lambda: np.stack([bursts(4)] * 2),
    "clipped-source": lambda: np.stack([np.clip(sine(220, 4, 1.4), -0.89, 0.89)] * 2),
    "pink-noise": lambda: np.stack([pink(4), pink(4, seed=4)]),
    "white-noise": lambda: np.stack([white(4), white(4, seed=2)]),
    "correlated": lambda: np.stack([pink(4)] * 2),
    "anti-correlated": lambda: np.stack([(x := pink(4)), -x]),
    "hard-left": lambda: np.stack([(x := sine(440, 4)), x * 0]),
    "hard-right": lambda: np.stack([(x := sine(440, 4)) * 0, x]),
    "bright-synthetic": lambda: np.stack([sum(sine(f, 4, 0.15) for f in (9000, 11000, 13000))] * 2),
    "silence": lambda: np.zeros((2, RATE * 4)),
    "extreme-dynamics": lambda: np.stack([np.concatenate([sine(500, 4, 0.0005), sine(500, 4, 0.5)])] * 2),
}


def chunks(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Chunk rows, with sample_rate, of clips of the catalogue; each clip is made in a task of its own."""
    names = names or list(CATALOGUE)
    clips = spark.createDataFrame([(n,) for n in names], "clip_id string").repartition(len(names), "clip_id")

    def run(batches):
        for b in batches:
            for n in b.column(0).to_pylist():
                rows = [r | {"sample_rate": RATE} for r in chunked(n, CATALOGUE[n]().astype(np.float32))]
                yield from pa.Table.from_pylist(rows, schema=ARROW).to_batches()

    return clips.mapInArrow(run, CHUNKS + ", sample_rate int")
