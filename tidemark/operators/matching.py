"""Tonal match of one fingerprint to another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp, js_round
from tidemark.operators.rules import MATCH_HZ

#: Smoothing and largest gain (dB) of each mode.
MODES = {"broad": (0.55, 3.0), "balanced": (0.3, 5.0), "precise": (0.12, 8.0)}


def _taper(hz: float) -> float:
    low = min(1.0, max(0.0, (hz - 40) / 40)) if hz < 80 else 1.0
    high = min(1.0, max(0.0, (14_000 - hz) / 7000)) if hz > 7000 else 1.0
    return low * high


def best_lag(a: Column, b: Column, most: int) -> Column:
    """lag and dot of the shift within ``most`` at which two arrays of one length fit best; of equal fits the smallest."""
    n = F.size(a)

    def dot(k: int) -> Column:
        left, right = F.slice(a, max(0, -k) + 1, n - abs(k)), F.slice(b, max(0, k) + 1, n - abs(k))
        return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    # fits are compared in millionths, so that rounding doesn't choose
    tried = F.array(*(F.struct(F.floor(dot(k) * 1e6 + 0.5).alias("fit"), F.lit(-k).alias("back"), dot(k).alias("dot")) for k in range(-most, most + 1)))
    best = F.array_max(tried)
    return F.struct((-best["back"]).alias("lag"), best["dot"].alias("dot"))


def curve(source: Column, reference: Column, mode: str = "balanced", duration_ratio: Column | None = None, frames: Column | None = None) -> Column:
    """gains (dB, eight bands) and confidence of matching ``source`` to ``reference`` band levels."""
    smooth, most = MODES[mode]
    n = len(MATCH_HZ)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, v: x + v, lambda x: x / n)
    d = F.zip_with(reference, source, lambda a, b: a - b)
    u = F.transform(d, lambda v: v - mean(d))
    at = lambda i: F.element_at(u, i + 1)
    soft = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: at(i) * (1 - smooth) + (at(F.greatest(i - 1, F.lit(0))) + at(F.least(i + 1, F.lit(n - 1)))) * (smooth / 2))
    tapered = F.zip_with(soft, F.array(*(F.lit(_taper(float(h))) for h in MATCH_HZ)), lambda a, b: a * b)
    gains = F.transform(tapered, lambda v: js_round(clamp(v - mean(tapered), -most, most), 1))
    rms = F.sqrt(mean(F.transform(u, lambda v: v * v)))
    sure = clamp(1 - rms / 12, 0.0, 1.0)
    if duration_ratio is not None:
        sure = sure * F.when(duration_ratio < 0.35, 0.6).otherwise(1.0)
    if frames is not None:
        sure = sure * F.when(frames < 8, 0.7).otherwise(1.0)
    return F.struct(gains.alias("gains"), js_round(sure, 2).alias("confidence"))
