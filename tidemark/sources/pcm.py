"""Spark data source ``pcm``: folders of WAV and AIFF files as signal chunks, and back."""

from __future__ import annotations

import glob
import io
import os
import uuid
from dataclasses import dataclass
from itertools import chain, groupby
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidemark.operators import intake
from tidemark.operators.clips import CHUNKS
from tidemark.sources import containers as c

#: Frames of a block.
BLOCK = 16384
READ = CHUNKS + ", sample_rate int, errors array<string>"


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Done(WriterCommitMessage):
    paths: list[tuple[str, str]]


class PcmSource(DataSource):
    """Local or mounted paths; for other stores use ``from_binary`` on Spark's binaryFile source.

    Reading: one partition for a file, in blocks; a file that can't be read is one
    row with ``errors``. Options ``first_frame`` and ``frames`` read a part of each
    file and no more of its bytes. Writing: rows of a clip must be in one partition,
    in order of their frames (``save``); one block is held. Options ``bits`` 16, 24
    or 32, ``container`` wav or aiff. As streams: ``streams``.
    """

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return READ

    def reader(self, schema):
        frames = self.options.get("frames")
        return _Reader(self.options["path"], int(self.options.get("first_frame", "0")), int(frames) if frames else None)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], int(self.options.get("bits", "24")), self.options.get("container", "wav"))

    def streamReader(self, schema):
        from tidemark.sources import streams

        return streams.Arrivals(self.options["path"], self.reader(schema))

    def streamWriter(self, schema, overwrite):
        from tidemark.sources import streams

        return streams.ClipWriter(self.options["path"], int(self.options.get("bits", "24")))


class _Reader(DataSourceReader):
    def __init__(self, path: str, first: int, frames: int | None):
        self.path, self.first, self.frames = path, first, frames

    def partitions(self):
        found = sorted(glob.glob(f"{self.path}/*")) if os.path.isdir(self.path) else [self.path]
        return [File(p) for p in found if p.lower().endswith((".wav", ".wave", ".aif", ".aiff"))]

    def read(self, part: File):
        clip = unquote(os.path.splitext(os.path.basename(part.path))[0])
        if not os.path.getsize(part.path):
            yield _failed(clip, "empty")
            return
        with open(part.path, "rb") as f:
            if part.path.lower().endswith((".aif", ".aiff")):
                yield from decoded(clip, f.read(), self.first, self.frames)
                return
            yield from _blocks(clip, f, self.first, self.frames)


def _failed(clip: str, why: str) -> tuple:
    return clip, None, None, None, 0, None, None, [why]


def _blocks(clip: str, f, first: int, frames: int | None):
    try:
        for start, x, rate in c.frame_blocks(f, first, frames, BLOCK):
            for ch, row in enumerate(x):
                yield clip, ch, (start - first) // BLOCK, start, len(row), row.tolist(), rate, []
    except Exception as e:
        yield _failed(clip, str(e))


def decoded(clip: str, raw: bytes, first: int = 0, frames: int | None = None):
    """Chunk rows of a file's bytes, or one row that says why there are none."""
    if raw[:4] != b"FORM":
        yield from _blocks(clip, io.BytesIO(raw), first, frames)
        return
    try:
        x, rate = c.read_aiff(raw)
    except Exception as e:
        yield _failed(clip, str(e))
        return
    x = x[:, first : None if frames is None else first + frames]
    for ch, row in enumerate(x):
        for i in range(-(-len(row) // BLOCK)):
            part = row[i * BLOCK : (i + 1) * BLOCK]
            yield clip, ch, i, first + i * BLOCK, len(part), part.tolist(), rate, []


class _Writer(DataSourceWriter):
    def __init__(self, path: str, bits: int, container: str):
        self.path, self.bits, self.container = path, bits, container

    def write(self, rows):
        os.makedirs(self.path, exist_ok=True)
        done = []
        for clip, own in groupby(rows, key=lambda r: r["clip_id"]):
            first = next(own)
            tmp = f"{self.path}/.{uuid.uuid4().hex}.part"
            final = f"{self.path}/{quote(clip, safe=' ')}.{'aif' if self.container == 'aiff' else 'wav'}"
            done.append((tmp, final))
            blocks = _stacked(chain([first], own), first["n_channels"])
            with open(tmp, "wb") as f:
                if self.container == "aiff":
                    f.write(c.write_aiff(np.concatenate(list(blocks), 1), first["sample_rate"], self.bits))
                else:
                    c.stream_wav(f, blocks, first["n_channels"], first["n_frames"], first["sample_rate"], self.bits)
        return Done(done)

    def commit(self, messages):
        for m in messages:
            for tmp, final in m.paths if m else ():
                os.replace(tmp, final)

    def abort(self, messages):
        for m in messages:
            for tmp, _ in m.paths if m else ():
                if os.path.exists(tmp):
                    os.remove(tmp)


def _stacked(rows, channels: int):
    """Blocks of all channels from rows in order of their frames."""
    for start, own in groupby(rows, key=lambda r: r["start_frame"]):
        parts = [np.asarray(r["samples"], np.float32) for r in own]
        if len(parts) != channels or len({len(p) for p in parts}) > 1:
            raise ValueError(f"channels differ at frame {start}")
        yield np.stack(parts)


def save(chunks: DataFrame, path: str, bits: int = 24, container: str = "wav") -> None:
    """One file for each clip; files appear when all are written. Clips whose channels differ in length fail the job."""
    chunks.sparkSession.dataSource.register(PcmSource)
    sizes = chunks.groupBy("clip_id").agg((F.max("channel") + 1).alias("n_channels"), F.max(F.col("start_frame") + F.col("frame_count")).alias("n_frames"))
    rows = chunks.select("clip_id", "channel", "start_frame", "samples", "sample_rate").join(sizes, "clip_id").repartition("clip_id").sortWithinPartitions("clip_id", "start_frame", "channel")
    rows.write.format("pcm").option("path", path).option("bits", bits).option("container", container).mode("append").save()


def load(spark: SparkSession, path: str, first_frame: int = 0, frames: int | None = None) -> DataFrame:
    """Chunk rows of a folder's files, or of a stretch of their frames."""
    spark.dataSource.register(PcmSource)
    own = spark.read.format("pcm").option("path", path).option("first_frame", first_frame)
    return (own if frames is None else own.option("frames", frames)).load()


def from_binary(spark: SparkSession, path: str, most_bytes: int = intake.MOST_BYTES) -> DataFrame:
    """Chunk rows of any store Spark reads.

    Files of more than ``most_bytes`` are a row with the reason; their bytes aren't
    read. Spark's file sources don't list empty files; ``load`` does.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    none = F.lit(None)
    refused = files.select("path", "length").where(~F.col("length").between(1, most_bytes)).select(
        name.alias("clip_id"), none.cast("int").alias("channel"), none.cast("bigint").alias("chunk_idx"), none.cast("bigint").alias("start_frame"), F.lit(0).alias("frame_count"), none.cast("array<float>").alias("samples"), none.cast("int").alias("sample_rate"),
        F.array(intake.preflight(F.col("length"), most_bytes)).alias("errors"),
    )

    def run(batches):
        for b in batches:
            rows = [r for p, raw in zip(b["path"], b["content"], strict=True) for r in decoded(os.path.splitext(os.path.basename(p))[0], bytes(raw))]
            yield pd.DataFrame(rows, columns=["clip_id", "channel", "chunk_idx", "start_frame", "frame_count", "samples", "sample_rate", "errors"])

    return files.where(F.col("length").between(1, most_bytes)).select("path", "content").mapInPandas(run, READ).unionByName(refused)
