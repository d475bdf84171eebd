"""Recursions over chunks, without one task for one series.

A chunk's effect on the state that it is entered with is known before that state is:
for a filter it is a matrix and a vector, for a level follower the largest of some
straight lines. Effects of neighbouring chunks make one effect, so each stretch of
chunks is summed up by itself, stretches carry the state on, and then all chunks of all
series run at the same time from the states they are entered with. Only effects, a few
numbers for each chunk, meet by series.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tidemark.operators.kernels import follow, staged

#: Chunks of a stretch.
STRETCH = 1024


class Cascade:
    """Biquads in a row, in double precision throughout. Its state has two numbers for each."""

    def __init__(self, stages: list[tuple]):
        self.stages = tuple(stages)
        self.width = 2 * len(self.stages)
        self.start = np.zeros(self.width)
        self._carry = lru_cache(64)(lambda n: np.stack([self.run(np.zeros(n), unit)[1] for unit in np.eye(self.width)], 1))

    def __reduce__(self):
        return Cascade, (list(self.stages),)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and the state after it."""
        y, after = np.asarray(x, np.float64), []
        for k, stage in enumerate(self.stages):
            y, s = staged(y, stage, state[2 * k : 2 * k + 2])
            after.append(s)
        return y, np.concatenate(after)

    def effect(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._carry(len(x)).ravel(), self.run(x, self.start)[1]])

    def _parts(self, effect: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return effect[: self.width**2].reshape(self.width, self.width), effect[self.width**2 :]

    def both(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        (m, z), (n, y) = self._parts(first), self._parts(then)
        return np.concatenate([(n @ m).ravel(), n @ z + y])

    def after(self, effect: np.ndarray, state: np.ndarray) -> np.ndarray:
        m, z = self._parts(effect)
        return m @ state + z


class Follower:
    """A level that rises by ``attack`` and falls by ``release`` of its distance to magnitudes.

    A step is the larger of two rising straight lines of the level, so any number of
    steps is the largest of some. The attack must be the faster one.
    """

    def __init__(self, attack: float, release: float):
        if not 0 < release <= attack <= 1:
            raise ValueError("a follower rises at least as fast as it falls")
        self.attack, self.release = attack, release
        self.start = np.zeros(1)

    def run(self, v: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(v):
            return np.zeros(0), state
        out, _ = follow(v, self.attack, self.release, state[:1])
        return out[0], out[0, -1:]

    def _lines(self, v: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """Slope and offset of the straight line that a chunk's effect follows at each level."""
        out, rises = follow(v, self.attack, self.release, levels)
        slope = (1 - self.attack) ** rises * (1 - self.release) ** (len(v) - rises)
        return np.stack([slope, out[:, -1] - slope * levels], 1)

    def effect(self, v: np.ndarray) -> np.ndarray:
        """The lines of a chunk, found where those known so far cross: each is new until none lies above."""
        if not len(v):
            return np.array([1.0, 0.0])
        top = float(np.max(v))
        n = len(v)
        falling = [(1 - self.release) ** n, float(self.release * (1 - self.release) ** np.arange(n - 1, -1, -1.0) @ v)]  # from a level above all that come
        lines = np.concatenate([self._lines(v, np.zeros(1)), [falling]])
        gaps = [(lines[0], lines[1])]
        while gaps:
            gaps = [(p, q) for p, q in gaps if q[0] - p[0] > 1e-15]
            at = np.array([(p[1] - q[1]) / (q[0] - p[0]) for p, q in gaps])
            if not len(at):
                break
            new = self._lines(v, np.maximum(at, 0.0))
            above = [x[0] * a + x[1] > p[0] * a + p[1] + 1e-14 * max(top, a) for x, a, (p, _) in zip(new, at, gaps, strict=True)]
            gaps = [g for x, up, (p, q) in zip(new, above, gaps, strict=True) if up for g in ((p, x), (x, q))]
            lines = np.concatenate([lines, new[above]])
        return self._highest(lines)

    def _highest(self, lines: np.ndarray) -> np.ndarray:
        """Those of the lines that are the largest for some level of 0 or more."""
        lines = lines[np.lexsort((lines[:, 1], lines[:, 0]))]
        kept: list[np.ndarray] = []
        for x in lines:
            while kept and (x[1] >= kept[-1][1] or (len(kept) > 1 and (x[1] - kept[-2][1]) * (kept[-1][0] - kept[-2][0]) >= (kept[-1][1] - kept[-2][1]) * (x[0] - kept[-2][0]))):
                kept.pop()
            kept.append(x)
        return np.concatenate(kept)

    def both(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        p, q = first.reshape(-1, 2), then.reshape(-1, 2)
        slope = np.multiply.outer(q[:, 0], p[:, 0]).ravel()
        return self._highest(np.stack([slope, (np.multiply.outer(q[:, 0], p[:, 1]) + q[:, 1:]).ravel()], 1))

    def after(self, effect: np.ndarray, state: np.ndarray) -> np.ndarray:
        lines = effect.reshape(-1, 2)
        return np.array([(lines[:, 0] * state[0] + lines[:, 1]).max()])


def over_chunks(
    chunks: DataFrame, recursion: Cascade | Follower | dict[str, Cascade | Follower], series: tuple[str, ...] = ("clip_id", "channel"),
    order: str = "chunk_idx", samples: str = "samples", stretch: int = STRETCH,
) -> DataFrame:
    """``chunks`` with the recursion's output (doubles) for ``samples``, as if each series were one chunk.

    Chunks follow each other by ``order`` (unique in a series); a missing one isn't
    filled in. Empty chunks stay empty, null ones stay null and change no state. A
    dictionary of recursions is looked up by the last column of ``series``.
    """
    bank = recursion if isinstance(recursion, dict) else None
    which = F.col(series[-1]).cast("string")
    of = (lambda name: bank[name]) if bank else (lambda _: recursion)

    @F.pandas_udf("array<double>")
    def effect(xs: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([of(n).effect(np.asarray([] if x is None else x, np.float64)) for x, n in zip(xs, names, strict=True)])

    @F.pandas_udf("array<double>")
    def output(xs: pd.Series, names: pd.Series, states: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else of(n).run(np.asarray(x, np.float64), np.asarray(s))[0] for x, n, s in zip(xs, names, states, strict=True)])

    def entered(pdf: pd.DataFrame, by: str, start: np.ndarray | None) -> pd.DataFrame:
        """The state before each row, from the effects of the rows before it."""
        r = of(pdf[series[-1]].iloc[0])
        pdf = pdf.sort_values(by)
        states = [r.start if start is None else start]
        for e in pdf["__effect"].iloc[:-1]:
            states.append(r.after(np.asarray(e), states[-1]))
        return pdf.assign(__state=states)

    keys = [chunks.schema[k] for k in series]
    at = StructField("__stretch", LongType())
    numbers = ArrayType(DoubleType())
    summed = StructType([*keys, at, StructField("__effect", numbers)])
    carried = StructType([*keys, at, StructField("__state", numbers)])
    each = StructType([*keys, chunks.schema[order], StructField("__state", numbers)])
    own, cut = list(series), [*series, "__stretch"]
    parts = chunks.select(*own, order, F.floor(F.col(order) / stretch).cast("long").alias("__stretch"), effect(samples, which).alias("__effect"))

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.head(1)[cut].assign(__effect=[reduce(of(pdf[series[-1]].iloc[0]).both, map(np.asarray, pdf.sort_values(order)["__effect"]))])

    stretches = parts.groupBy(*cut).applyInPandas(total, summed)
    states = stretches.groupBy(*own).applyInPandas(lambda pdf: entered(pdf, "__stretch", None)[[*cut, "__state"]], carried)
    inside = parts.join(states.withColumnRenamed("__state", "__from"), cut)
    begun = inside.groupBy(*cut).applyInPandas(lambda pdf: entered(pdf, order, np.asarray(pdf["__from"].iloc[0]))[[*own, order, "__state"]], each)
    return chunks.join(begun, [*own, order]).withColumn(samples, output(samples, which, "__state")).select(*chunks.columns)


def linked_peak(chunks: DataFrame, clip: str = "clip_id", order: str = "chunk_idx", samples: str = "samples") -> DataFrame:
    """clip, order and the largest magnitude of all channels at each frame of a chunk."""
    larger = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, F.abs(y).cast("double")))
    magnitudes = F.transform(samples, lambda v: F.abs(v).cast("double"))
    each = chunks.groupBy(clip, order).agg(F.collect_list(magnitudes).alias("__all"))  # as many as a clip has channels
    rest = F.slice("__all", 2, F.greatest(F.size("__all") - 1, F.lit(0)))
    return each.select(clip, order, F.aggregate(rest, F.col("__all")[0], larger).alias(samples))
