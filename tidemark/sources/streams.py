"""The ``pcm`` data source as a stream: files of a folder as they come, and clips written batch by batch."""

from __future__ import annotations

import os
import tempfile
import uuid
from itertools import chain, groupby
from urllib.parse import quote

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSourceStreamReader, DataSourceStreamWriter
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources import containers as c
from tidemark.sources.pcm import BLOCK, Done, File, PcmSource, _Reader, _stacked

#: Bytes of a clip that are held while its length isn't known; more go to a file of the task.
HELD = 4 << 20
ENDINGS = (".wav", ".wave", ".aif", ".aiff")


class Arrivals(DataSourceStreamReader):
    """Offsets are the time of the last change and the name of a file, so each file is read once, whatever comes or goes.

    A file must appear under its name when it is complete, as ``os.replace`` does and
    both writers do.
    """

    def __init__(self, path: str, files: _Reader):
        self.path, self.files = path, files

    def _listed(self) -> list[tuple[int, str]]:
        with os.scandir(self.path) as found:
            return sorted((e.stat().st_ctime_ns, e.name) for e in found if e.is_file() and e.name.lower().endswith(ENDINGS))

    def initialOffset(self) -> dict:
        return {"at": 0, "name": ""}

    def latestOffset(self) -> dict:
        listed = self._listed()
        return {"at": listed[-1][0], "name": listed[-1][1]} if listed else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[File]:
        low, high = (start["at"], start["name"]), (end["at"], end["name"])
        return [File(os.path.join(self.path, name)) for at, name in self._listed() if low < (at, name) <= high]

    def read(self, partition: File):
        yield from self.files.read(partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class ClipWriter(DataSourceStreamWriter):
    """A WAV file for each clip of a batch, all of them named as the batch commits; a batch that runs again replaces its files.

    Rows of a clip come in one task, in order of their frames. Rows with errors, or
    without samples, aren't written.
    """

    def __init__(self, path: str, bits: int):
        self.path, self.bits = path, bits

    def write(self, rows) -> Done:
        os.makedirs(self.path, exist_ok=True)
        done = []
        for clip, own in groupby((r for r in rows if r["samples"] is not None and not r["errors"]), key=lambda r: r["clip_id"]):
            first = next(own)
            tmp = f"{self.path}/.{uuid.uuid4().hex}.part"
            with tempfile.SpooledTemporaryFile(HELD) as spool:
                channels = frames = 0
                for at, block in groupby(chain([first], own), key=lambda r: r["start_frame"]):
                    block = list(block)
                    channels = channels or len(block)
                    if at != frames:
                        raise ValueError(f"{clip}: frame {frames} is due, not {at}")
                    (x,) = _stacked(block, channels)
                    spool.write(np.ascontiguousarray(x.T, "<f4").tobytes())
                    frames += x.shape[1]
                spool.seek(0)
                with open(tmp, "wb") as f:
                    c.stream_wav(f, self._blocks(spool, channels), channels, frames, first["sample_rate"], self.bits)
            done.append((tmp, f"{self.path}/{quote(clip, safe=' ')}.wav"))
        return Done(done)

    @staticmethod
    def _blocks(spool, channels: int):
        while raw := spool.read(BLOCK * channels * 4):
            yield np.frombuffer(raw, "<f4").reshape(-1, channels).T

    def commit(self, messages, batchId: int) -> None:
        for tmp, final in (p for m in messages if m for p in m.paths):
            os.replace(tmp, final)

    def abort(self, messages, batchId: int) -> None:
        for tmp, _ in (p for m in messages if m for p in m.paths):
            if os.path.exists(tmp):
                os.remove(tmp)


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of a folder's files, as a stream; a file that can't be read is a row with errors."""
    spark.dataSource.register(PcmSource)
    return spark.readStream.format("pcm").option("path", path).load()


def written(chunks: DataFrame, path: str, checkpoint: str, bits: int = 24) -> StreamingQuery:
    """Write what has come by now of a stream of chunk rows, one file for each clip, then stop."""
    chunks.sparkSession.dataSource.register(PcmSource)
    out = chunks.writeStream.format("pcm").option("path", path).option("bits", bits).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start()
