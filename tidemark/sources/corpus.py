"""A hostile-input corpus: container bytes made from rules, with what a reader should do with each."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import containers as c

RATES = (8_000, 11_025, 22_050, 44_100, 48_000, 96_000, 192_000)


@dataclass
class Case:
    id: str
    expect: str  # decode, either or reject
    file_name: str
    data: bytes
    channels: int = 0
    frames: int = 0
    notes: list[str] = field(default_factory=list)


def tone(channels: int, frames: int = 480) -> np.ndarray:
    return np.stack([0.5 * np.sin(np.arange(frames) * 0.05 * (k + 1)) for k in range(channels)]).astype(np.float32) if channels else np.zeros((0, frames), np.float32)


def cut(raw: bytes, n: int) -> bytes:
    """Without the last n bytes."""
    return raw[: max(0, len(raw) - n)]


def oversized(raw: bytes, size: int = 0x7FFFFFF0) -> bytes:
    """With a data chunk that claims more than is there."""
    at = raw.index(b"data") + 4
    return raw[:at] + struct.pack("<I", size) + raw[at + 4 :]


def broken_header(raw: bytes) -> bytes:
    return b"RIFX" + raw[4:]


def patched(raw: bytes, frame: int, value: float) -> bytes:
    """A float file with one sample of its first channel replaced."""
    f = c.inspect(raw)
    at = next(x for x in f["chunks"] if x["id"] == "data")["offset"] + 8 + 4 * frame * f["format"]["channels"]
    return raw[:at] + struct.pack("<f", value) + raw[at + 4 :]


def cases() -> list[Case]:
    out = [Case(f"rate-{r}", "decode", f"r{r}.wav", c.write_wav(tone(2), r, 16), 2, 480) for r in RATES]
    out += [Case(f"bits-{b}", "decode", f"b{b}.wav", c.write_wav(tone(2), 48_000, b), 2, 480) for b in (16, 24, 32)]
    out += [Case(f"channels-{n}", "decode", f"c{n}.wav", c.write_wav(tone(n), 48_000, 24), n, 480) for n in (1, 2, 6, 8, 24, 32)]
    out += [Case(f"aiff-{b}", "decode", f"a{b}.aif", c.write_aiff(tone(2), 44_100, b), 2, 480) for b in (16, 24)]
    good, floats = c.write_wav(tone(2), 48_000, 16), c.write_wav(tone(2), 48_000, 32)
    out += [
        Case("one-sample", "decode", "one.wav", c.write_wav(tone(1, 1), 48_000, 16), 1, 1), Case("no-samples", "decode", "none.wav", c.write_wav(tone(1, 0), 48_000, 16), 1, 0),
        Case("silence", "decode", "silence.wav", c.write_wav(np.zeros((2, 480), np.float32), 48_000, 24), 2, 480), Case("constant", "decode", "dc.wav", c.write_wav(np.full((1, 480), 0.25, np.float32), 48_000, 24), 1, 480),
        Case("nan", "decode", "nan.wav", patched(floats, 7, float("nan")), 2, 480, ["non-finite"]), Case("infinity", "decode", "inf.wav", patched(floats, 9, float("inf")), 2, 480, ["non-finite"]),
        Case("wide-sizes", "decode", "wide.wav", c.write_wav(tone(2), 48_000, 16, mode="rf64"), 2, 480), Case("unicode-info", "decode", "ünï.wav", c.write_wav(tone(1), 48_000, 16, extra=[("LIST", "INFOINAMé漢字".encode())]), 1, 480),
        Case("truncated", "either", "cut.wav", cut(good, 101), 2), Case("oversized", "either", "over.wav", oversized(good), 2), Case("header-only", "reject", "head.wav", good[:20]), Case("broken-header", "reject", "rifx.wav", broken_header(good)),
        Case("empty", "reject", "empty.wav", b""), Case("text", "reject", "text.wav", b"this is no audio " * 20),
    ]
    return out


def frame(spark: SparkSession) -> DataFrame:
    rows = [(x.id, x.expect, x.file_name, bytearray(x.data), x.channels, x.frames, x.notes) for x in cases()]
    return spark.createDataFrame(rows, "id string, expect string, file_name string, bytes binary, channels int, frames bigint, notes array<string>")
