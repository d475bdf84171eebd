"""Scalar functions as columns: decibels, rounding, easing, windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Loudness offset and gates in LUFS and LU (ITU-R BS.1770, EBU R 128).
OFFSET, ABSOLUTE_GATE, RELATIVE_GATE, RANGE_GATE = -0.691, -70.0, -10.0, -20.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def js_round(x: Column, digits: int = 0) -> Column:
    """Rounds ties toward plus infinity; a double. No minus zero."""
    f = float(10**digits)
    return F.floor(x * F.lit(f) + F.lit(0.5)).cast("double") / F.lit(f)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, _c(low)), _c(high))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def smoothstep(t: Column) -> Column:
    u = clamp(t, 0.0, 1.0)
    return u * u * (F.lit(3.0) - F.lit(2.0) * u)


def db_to_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / F.lit(20.0))


def gain_to_db(g: Column) -> Column:
    """Gains under 1e-9 read -180 dB."""
    return F.lit(20.0) * F.log10(F.greatest(g, F.lit(1e-9)))


def power_db(p: Column, floor: float = 1e-30) -> Column:
    return F.lit(10.0) * F.log10(F.greatest(p, F.lit(floor)))


def block_level(mean_square: Column) -> Column:
    return F.lit(OFFSET) + power_db(mean_square)


def power_of_level(level: Column) -> Column:
    return F.pow(F.lit(10.0), (level - F.lit(OFFSET)) / F.lit(10.0))


def level_of_power(power: Column) -> Column:
    return F.lit(OFFSET) + F.lit(10.0) * F.log10(power)


def quantise(x: Column, bits: int) -> Column:
    """PCM integer of a sample; full scale clips one step under plus one."""
    full = float(2 ** (bits - 1))
    return F.least(js_round(clamp(x, -1.0, 1.0) * F.lit(full)), F.lit(full - 1)).cast("int")


def quantisation_tolerance(bits: Column) -> Column:
    """Largest error of a decoded sample: half a step and a little, or float precision from 32 bits on."""
    return F.when(bits >= 32, F.lit(1e-7)).otherwise(F.lit(1.0) / F.pow(F.lit(2.0), bits - 1) + F.lit(1e-7))


def finite_or_null(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def hann(i: Column, n: Column | int) -> Column:
    """Periodic Hann window."""
    return F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2 * math.pi) * i / _c(n))


def normalisation_gain(measured: Column, target: Column, most: float = 40.0) -> Column:
    delta = target - measured
    return F.when(F.isnan(delta) | (F.abs(delta) == F.lit(float("inf"))), F.lit(0.0)).otherwise(clamp(delta, -most, most))


def refinement_score(delta: Column, average: Column, peak: Column) -> Column:
    """Damage of a pass, and four times that plus a share of its error if it missed by over 0.15."""
    damage = F.lit(1.5) * F.greatest(F.lit(0.0), -average - 1.5) + F.lit(1.25) * F.greatest(F.lit(0.0), -peak - 3.0)
    miss = F.abs(delta)
    return F.when(miss <= 0.15, damage).otherwise(damage * 4 + miss * 0.35)


def identification_hz(channel: Column, base: float = 220.0) -> Column:
    """The tone that names a channel (from 0): a semitone higher for each."""
    return F.lit(base) * F.pow(F.lit(2.0), channel / 12.0)


def oversampling(rate: Column) -> Column:
    return F.when(rate < 88200, 4).when(rate < 176400, 2).otherwise(1)


def wav_bytes(frames: Column, channels: Column, bits: Column) -> Column:
    return F.lit(68).cast("bigint") + frames * channels * (bits / 8).cast("bigint")


def register(spark: SparkSession) -> None:
    """The scalar functions as SQL functions."""
    for name, args, body in (
        ("js_round", "x double, d int", "floor(x * pow(10, d) + 0.5) / pow(10, d)"),
        ("db_to_gain", "db double", "pow(10, db / 20)"),
        ("gain_to_db", "g double", "20 * log10(greatest(g, 1e-9))"),
        ("clamp", "x double, low double, high double", "least(greatest(x, low), high)"),
        ("lerp", "a double, b double, t double", "a + (b - a) * t"),
        ("smoothstep", "t double", "pow(least(greatest(t, 0), 1), 2) * (3 - 2 * least(greatest(t, 0), 1))"),
        ("power_db", "p double", "10 * log10(greatest(p, 1e-30))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
