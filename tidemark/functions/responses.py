"""Frequency responses as column functions: complex numbers are pairs of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.design import BUTTERWORTH

Complex = tuple[Column, Column]


def times(a: Complex, b: Complex) -> Complex:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def over(a: Complex, b: Complex) -> Complex:
    size = b[0] * b[0] + b[1] * b[1]
    return (a[0] * b[0] + a[1] * b[1]) / size, (a[1] * b[0] - a[0] * b[1]) / size


def plus(*each: Complex) -> Complex:
    return sum((x for x, _ in each[1:]), each[0][0]), sum((y for _, y in each[1:]), each[0][1])


def scaled(a: Complex, g: Column) -> Complex:
    return a[0] * g, a[1] * g


def magnitude_db(a: Complex, floor: float = 1e-6) -> Column:
    return 20 * F.log10(F.greatest(F.lit(floor), F.sqrt(a[0] * a[0] + a[1] * a[1])))


def second_order(kind: str, freq: Column, corner: float, rate: Column, q: float = BUTTERWORTH) -> Complex:
    """Response at ``freq`` of a cookbook lowpass, highpass or allpass."""
    w, at = 2 * math.pi * corner / rate, 2 * math.pi * freq / rate
    cw, alpha = F.cos(w), F.sin(w) / (2 * q)
    b = {
        "lowpass": ((1 - cw) / 2, 1 - cw, (1 - cw) / 2),
        "highpass": ((1 + cw) / 2, -1 - cw, (1 + cw) / 2),
        "allpass": (1 - alpha, -2 * cw, 1 + alpha),
    }[kind]
    poly = lambda c: (c[0] + c[1] * F.cos(at) + c[2] * F.cos(2 * at), -c[1] * F.sin(at) - c[2] * F.sin(2 * at))
    return over(poly(b), poly((1 + alpha, -2 * cw, 1 - alpha)))


#: Second-order filters that the layouts below are made of, by name: kind and whether at the upper corner.
PARTS = {"low_lp": ("lowpass", False), "low_hp": ("highpass", False), "low_ap": ("allpass", False), "high_lp": ("lowpass", True), "high_hp": ("highpass", True), "high_ap": ("allpass", True)}


def with_parts(rows: DataFrame, freq: str, rate: str, low: float, high: float) -> DataFrame:
    """``rows`` with the responses of ``PARTS`` as columns (fourth-order Linkwitz-Riley for lowpass and highpass), each worked out once."""
    once = {name: second_order(kind, F.col(freq), high if upper else low, F.col(rate)) for name, (kind, upper) in PARTS.items()}
    own = rows.withColumns({f"{name}_{part}": x for name, pair in once.items() for part, x in zip(("re", "im"), pair, strict=True)})
    twice = {name: times(_part(name), _part(name)) for name, (kind, _) in PARTS.items() if kind != "allpass"}
    return own.withColumns({f"{name}_{part}": x for name, pair in twice.items() for part, x in zip(("re", "im"), pair, strict=True)})


def _part(name: str) -> Complex:
    return F.col(f"{name}_re"), F.col(f"{name}_im")


def tree(mix: Column) -> Complex:
    """Of rows ``with_parts``: three bands of a tree, each in the phase of the others, mixed with a dry path in that phase."""
    above, late = _part("low_hp"), _part("high_ap")
    bands = plus(times(_part("low_lp"), late), times(above, plus(_part("high_lp"), _part("high_hp"))))
    return plus(scaled(bands, mix), scaled(times(_part("low_ap"), late), 1 - mix))


def parallel(mix: Column) -> Complex:
    """Of rows ``with_parts``: the older layout, three bands side by side and a dry wire, whose phases differ, so that their sum combs."""
    bands = plus(_part("low_lp"), times(_part("low_hp"), _part("high_lp")), _part("high_hp"))
    return plus(scaled(bands, mix), (1 - mix, F.lit(0.0)))
