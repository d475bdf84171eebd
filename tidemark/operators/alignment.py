"""Alignment of two takes: the integer lag, gain and residual at which one fits the other best.

Correlations of all lags are sums over frames, so chunks give partial sums (by Fourier
transforms of a chunk of one take and its surroundings in the other, overlap-save) that
are added by pair and lag; no pair needs one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import gain_to_db


def partial_sums(a: np.ndarray, b: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each lag from -reach to reach: products of ``b`` and the lagged ``a``, and squares of the lagged ``a``.

    ``a`` begins ``reach`` frames before ``b`` and ends ``reach`` frames after it.
    """
    n = 1 << max(1, int(len(a) - 1).bit_length())
    products = np.fft.irfft(np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n)), n)[: 2 * reach + 1]
    squares = np.concatenate([[0.0], np.cumsum(a * a)])
    return products, squares[len(b) :][: 2 * reach + 1] - squares[: 2 * reach + 1]


def common(a: DataFrame, b: DataFrame, pair: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Both takes' chunks (pair, chunk_idx, samples) as far as the shorter one goes, without null ones."""
    frames = lambda df, name: df.groupBy(pair).agg(F.max(F.col("chunk_idx") * size + F.size("samples")).alias(name))
    ends = frames(a.where("samples is not null"), "__a").join(frames(b.where("samples is not null"), "__b"), pair).select(pair, F.least("__a", "__b").alias("__n"))

    def within(df: DataFrame) -> DataFrame:
        left = F.col("__n") - F.col("chunk_idx") * size
        cut = F.slice(F.col("samples").cast("array<double>"), F.lit(1), F.greatest(F.lit(0), F.least(F.lit(size), left)).cast("int"))
        return df.join(ends, pair).where("samples is not null").select(pair, "chunk_idx", cut.alias("samples"))

    return within(a), within(b)


def lag_sums(a: DataFrame, b: DataFrame, pair: str, size: int, reach: int) -> DataFrame:
    """pair, lag, product, square, energy of takes ``a`` and ``b`` (pair, chunk_idx, samples), chunks of ``size`` frames.

    Both takes count as far as the shorter one goes; lagged frames outside it are
    silent. Missing or null chunks are silent too. A pair without both takes has no rows.
    """
    around = -(-reach // size)
    a, b = common(a, b, pair, size)
    spread = a.select(pair, F.explode(F.array(*(F.struct((F.col("chunk_idx") - d).alias("chunk_idx"), F.lit(d).alias("d")) for d in range(-around, around + 1)))).alias("to"), "samples")
    near = spread.select(pair, "to.chunk_idx", "to.d", "samples").groupBy(pair, "chunk_idx").agg(F.collect_list(F.struct("d", "samples")).alias("near"))  # 2 around + 1 of them

    @F.pandas_udf("array<struct<lag: int, product: double, square: double, energy: double>>")
    def sums(nears: pd.Series, bs: pd.Series) -> pd.Series:
        out = []
        for near, x in zip(nears, bs, strict=True):
            x = np.asarray(x, np.float64)
            line = np.zeros((2 * around + 1) * size)
            for part in near:
                at = (part["d"] + around) * size
                line[at : at + len(part["samples"])] = part["samples"]
            start = around * size - reach
            p, s = partial_sums(line[start : start + len(x) + 2 * reach], x, reach)
            e = float(x @ x)
            out.append([(k - reach, float(u), float(v), e) for k, (u, v) in enumerate(zip(p, s, strict=True))])
        return pd.Series(out)

    each = b.where(F.size("samples") > 0).join(near, [pair, "chunk_idx"]).select(pair, F.inline(sums("near", "samples")))
    silent = b.join(near.select(pair, "chunk_idx"), [pair, "chunk_idx"], "left_anti").select(pair, F.aggregate("samples", F.lit(0.0), lambda s, v: s + v * v).alias("more"))
    added = each.groupBy(pair, "lag").agg(*(F.sum(k).alias(k) for k in ("product", "square", "energy")))
    more = silent.groupBy(pair).agg(F.sum("more").alias("more"))  # frames of b with nothing of a near them
    return added.join(more, pair, "left").withColumn("energy", F.col("energy") + F.coalesce("more", F.lit(0.0))).drop("more")


def best_fit(sums: DataFrame, pair: str, earliest: int | None = None) -> DataFrame:
    """pair, lag, gain, gain_db, residual_db, inverted: the lag of the largest correlation, the smallest of equal ones.

    The gain is the one that leaves least of ``b``; without energy it is 0. Sums cancel in the residual of takes that
    fit: under some -140 dB it is their rounding, and ``residuals`` has it from the frames.
    """
    own = sums if earliest is None else sums.where(F.col("lag") >= earliest)
    best = own.groupBy(pair).agg(F.max_by(F.struct("lag", "product", "square", "energy"), F.struct(F.abs("product"), -F.col("lag"))).alias("b")).select(pair, "b.*")
    gain = F.col("product") / (F.col("square") + 1e-20)
    left = F.greatest(F.lit(0.0), F.col("energy") - 2 * gain * F.col("product") + gain * gain * F.col("square")) + 1e-20
    return best.select(pair, "lag", gain.alias("gain"), gain_to_db(F.abs(gain)).alias("gain_db"), (10 * F.log10(left / (F.col("energy") + 1e-20))).alias("residual_db"), (gain < 0).alias("inverted"))


def residuals(fit: DataFrame, a: DataFrame, b: DataFrame, pair: str, size: int) -> DataFrame:
    """``fit`` with residual_db from the frames that its lags and gains leave of ``b``, so that an exact fit leaves nothing."""
    a, b = common(a, b, pair, size)
    to, lag = F.col("to"), F.col("lag")
    part = lambda d: F.struct((F.col("chunk_idx") - F.floor(lag / size) - d).alias("chunk_idx"), F.lit(d).alias("d"))
    spread = a.join(fit.select(pair, "lag", "gain"), pair).select(pair, "gain", F.pmod(lag, F.lit(size)).cast("int").alias("at"), "samples", F.explode(F.array(part(0), part(1))).alias("to"))
    held = lambda d: F.coalesce(F.first(F.when(to["d"] == d, F.col("samples")), ignorenulls=True), F.array().cast("array<double>"))
    lagged = spread.groupBy(pair, to["chunk_idx"].alias("chunk_idx")).agg(F.first("gain").alias("gain"), F.first("at").alias("at"), held(0).alias("first"), held(1).alias("second"))
    line = F.concat("first", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("first")), "second")
    energy = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    rest = F.transform("samples", lambda v, i: v - F.col("gain") * F.coalesce(F.get("line", F.col("at") + i), F.lit(0.0)))
    each = b.join(lagged.select(pair, "chunk_idx", "gain", "at", line.alias("line")), [pair, "chunk_idx"], "left")
    left = F.when(F.col("line").isNull(), energy("samples")).otherwise(energy(rest))  # chunks with nothing of a near them stay whole
    sums = each.select(pair, left.alias("__left"), energy("samples").alias("__energy")).groupBy(pair).agg(F.sum("__left").alias("__left"), F.sum("__energy").alias("__energy"))
    return fit.join(sums, pair).withColumn("residual_db", 10 * F.log10((F.col("__left") + 1e-20) / (F.col("__energy") + 1e-20))).drop("__left", "__energy")
