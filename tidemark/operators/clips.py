"""Kernels on signal chunks: one task for each clip, all clips in parallel.

The recursions of a clip can't be split, so a clip's chunks are gathered in one
Arrow group, as large as the clip. Work that needs no neighbours (gain,
quantising) stays on the chunk rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.operators import kernels as k


def assembled(t: pa.Table) -> tuple[np.ndarray, int]:
    """(channels, frames) and the sample rate of a clip's chunk rows (with sample_rate).

    Channels of different lengths, and chunks that leave gaps or overlap, are a ValueError.
    """
    order = np.lexsort((t.column("chunk_idx").to_numpy(), t.column("channel").to_numpy()))
    t = t.take(pa.array(order)).combine_chunks()
    channel, start = t.column("channel").to_numpy(), t.column("start_frame").to_numpy()
    lists = t.column("samples").chunk(0)
    flat, size = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False), np.diff(lists.offsets.to_numpy())
    new = np.flatnonzero(np.r_[True, channel[1:] != channel[:-1]])
    due = np.cumsum(size) - size
    if (start != due - np.repeat(due[new], np.diff(np.r_[new, len(channel)]))).any():
        raise ValueError("chunks leave gaps or overlap")
    frames = np.add.reduceat(size, new)
    if (frames != frames[0]).any():
        raise ValueError(f"channels differ in length: {', '.join(map(str, frames.tolist()))} frames")
    return flat.reshape(len(new), -1), int(t.column("sample_rate")[0].as_py())


def each_clip(chunks: DataFrame, fn: Callable[[str, np.ndarray, int], list[dict]], schema: str) -> DataFrame:
    """Rows that ``fn(clip_id, samples, rate)`` gives for each clip.

    A clip whose chunks don't fit together (``assembled``) is one row with its
    ``error`` if the schema has such a column; otherwise the job fails.
    """
    target = StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def run(t: pa.Table) -> pa.Table:
        clip = t.column("clip_id")[0].as_py()
        try:
            x, rate = assembled(t)
        except ValueError as e:
            if "error" not in arrow.names:
                raise ValueError(f"{clip}: {e}") from e
            return pa.Table.from_pylist([{"clip_id": clip, "error": str(e)}], schema=arrow)
        return pa.Table.from_pylist(fn(clip, x, rate), schema=arrow)

    # a stated number of partitions: clips are small in bytes but long in work, and would be coalesced into few tasks
    parts = 4 * chunks.sparkSession.sparkContext.defaultParallelism
    return chunks.repartition(parts, "clip_id").groupBy("clip_id").applyInArrow(run, target)


MEASURES = "clip_id string, sample_rate int, channels int, n_frames bigint, integrated double, lra double, max_momentary double, max_short_term double, silent boolean, sample_peak_db double, true_peak_db double, rms_db double, crest_db double, correlation double, brightness_db double, worst_band_lo int, worst_mono_loss_db double"


def measure(clip: str, x: np.ndarray, rate: int) -> list[dict]:
    """The measurement document of a clip; levels of silence are null."""
    fin = lambda v: float(v) if np.isfinite(v) else None
    loud = k.loudness(x, rate)
    rms = float(np.sqrt(np.mean(x.astype(np.float64) ** 2)))
    top = float(np.abs(x).max())
    den = np.sqrt((x[0].astype(float) ** 2).sum() * (x[-1].astype(float) ** 2).sum())
    worst = min(k.mono_bands(x[0], x[1], rate), key=lambda b: b["mono_loss_db"], default=None) if len(x) > 1 else None
    return [{
        "clip_id": clip, "sample_rate": rate, "channels": len(x), "n_frames": x.shape[1], "integrated": fin(loud["integrated"]), "lra": loud["lra"], "max_momentary": fin(loud["max_momentary"]), "max_short_term": fin(loud["max_short_term"]), "silent": loud["silent"],
        "sample_peak_db": k.to_db(top), "true_peak_db": k.to_db(max(k.true_peak_verified(c, rate) for c in x)), "rms_db": k.to_db(rms * np.sqrt(2)), "crest_db": k.to_db(top) - k.to_db(rms) if top else 0.0,
        "correlation": float((x[0].astype(float) * x[-1]).sum() / den) if den >= 1e-20 else 1.0, "brightness_db": k.brightness(x, rate), "worst_band_lo": worst and worst["lo"], "worst_mono_loss_db": worst and worst["mono_loss_db"],
    }]


def chunked(clip: str, x: np.ndarray, size: int = 16384) -> list[dict]:
    """Chunk rows of a clip."""
    return [{"clip_id": clip, "channel": c, "chunk_idx": i, "start_frame": i * size, "frame_count": len(row[i * size : (i + 1) * size]), "samples": row[i * size : (i + 1) * size].tolist()} for c, row in enumerate(x) for i in range(-(-len(row) // size))]


CHUNKS = "clip_id string, channel int, chunk_idx bigint, start_frame bigint, frame_count int, samples array<float>"


def gain(chunks: DataFrame, g: float) -> DataFrame:
    """Scaled samples; a gain of one changes nothing."""
    return chunks if g == 1 else chunks.withColumn("samples", F.transform("samples", lambda v: (v * g).cast("float")))
