"""Level, correlation and mid/side aggregates. All are sums, so they combine before a shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import gain_to_db, power_db


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def rms_db(x: Column) -> Column:
    """Referred to a sine: full-scale sines read 0 dB."""
    return gain_to_db(rms(x) * F.lit(math.sqrt(2.0)))


def peak(x: Column) -> Column:
    return F.max(F.abs(x))


def crest_db(x: Column) -> Column:
    """Peak over plain RMS; 0 for silence."""
    return F.when(F.coalesce(peak(x), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(gain_to_db(peak(x)) - gain_to_db(rms(x)))


def correlation(left: Column, right: Column) -> Column:
    """Uncentred: a cosine similarity; 1 for silence."""
    den = F.sqrt(F.sum(left * left) * F.sum(right * right))
    return F.when(den < 1e-20, F.lit(1.0)).otherwise(F.sum(left * right) / den)


def mid(left: Column, right: Column) -> Column:
    return (left + right) / 2


def side(left: Column, right: Column) -> Column:
    return (left - right) / 2


def reduction(gain: Column) -> dict[str, Column]:
    """Aggregates of a gain curve: deepest and average reduction (dB, of samples under 0.9999), and their share."""
    on = gain < 0.9999
    average = F.coalesce(F.avg(F.when(on, gain)), F.lit(1.0))
    return {"peak_gr_db": gain_to_db(F.min(gain)), "avg_gr_db": gain_to_db(average), "active": F.count_if(on) / F.count(F.lit(1))}


def mono_loss_db(left: Column, right: Column) -> Column:
    """Level of the mono fold against the louder channel; 0 for silence."""
    m = mid(left, right)
    ref = F.greatest(F.sum(left * left), F.sum(right * right))
    return F.when(ref < 1e-20, F.lit(0.0)).otherwise(power_db(F.sum(m * m) / F.when(ref < 1e-20, F.lit(1.0)).otherwise(ref), 1e-20))
