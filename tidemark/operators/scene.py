"""Spatial scenes: checks of a scene table, and gains that move its rings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp, lerp, smoothstep

BANDS = ("sub", "low", "lowmid", "mid", "presence", "air")
GAINS = ("frontM", "centreM", "frontS", "sideS", "rearS", "heightS", "lfeM")
RINGS = ("side", "rear", "height", "front")


def problems(rows: DataFrame) -> DataFrame:
    """scene, band, rule for every rule a scene row (scene, band and the seven gains) breaks.

    Fronts stay at 0.8 or more, bass stays in front, only the sub band feeds the
    low-frequency channel, surround energy is bounded, and gains stay within 1.4.
    """
    c = F.col
    bass = c("band").isin("sub", "low")
    around = c("sideS") ** 2 + c("rearS") ** 2 + c("heightS") ** 2
    odd = [F.abs(c(k)) > 1.4 for k in GAINS if k not in ("frontM", "lfeM")]
    missing = F.exists(F.array(*(c(k).isNull() | F.isnan(c(k)) for k in GAINS)), lambda x: x)
    rules = {
        "missing gain": missing, "front under 0.8": c("frontM") < 0.8, "bass not anchored": bass & ((c("sideS") != 0) | (c("rearS") != 0) | (c("heightS") != 0)),
        "low-frequency feed": (c("band") != "sub") & (c("lfeM") != 0), "surround budget": around > 3.2 + 1e-9, "gain out of range": F.exists(F.array(*odd), lambda x: x),
    }
    broken = F.filter(F.array(*(F.when(F.coalesce(w, F.lit(False)), F.lit(k)) for k, w in rules.items())), lambda x: x.isNotNull())
    return rows.select("scene", "band", F.explode(broken).alias("rule"))


# How knobs of 0 to 1, neutral at 0.5, move a scene: gain, way, knob, bands with weights, amount, low, high.
# ``add`` moves by amount x weight x (knob - 0.5), ``times`` by a factor that runs from 1 - amount to 1 + amount.
MOVES = """
frontS add envelopment mid:1,lowmid:0.7,presence:0.7,air:0.5 -0.2 0 1.2
sideS add envelopment mid:1,lowmid:0.7,presence:0.7,air:0.5 0.3 0 1.3
rearS add envelopment mid:1,lowmid:0.7,presence:0.7,air:0.5 0.15 0 1.3
sideS add front_focus mid:1,lowmid:1 -0.16 0 1.3
rearS add front_focus mid:1,lowmid:1 -0.07 0 1.3
frontS add front_focus mid:1,lowmid:1 0.22 0 1.4
rearS times rear_depth presence:1,air:1 0.3 0 1.4
frontS add room_size lowmid:1,mid:1,presence:1,air:1 -0.1 0 1.2
sideS add room_size lowmid:1,mid:1,presence:1,air:1 0.09 0 1.35
rearS add room_size lowmid:1,mid:1,presence:1,air:1 0.12 0 1.35
heightS add room_size lowmid:1,mid:1,presence:1,air:1 0.07 0 1.4
heightS times height_focus presence:1,air:1 0.4 0 1.4
heightS times height_focus mid:1 -0.4 0 1.4
decorr times room_size lowmid:1,mid:1,presence:1,air:1 0.4 0 1
decorr times height_spread lowmid:1,mid:1,presence:1,air:1 0.15 0 1
"""
KNOBS = ("envelopment", "front_focus", "rear_depth", "room_size", "height_focus", "height_spread")


def planned(rows: DataFrame) -> DataFrame:
    """Scene rows (scene, band, gains, decorr, and the ``KNOBS``) with gains as the knobs move them; null knobs are neutral."""
    made: dict[str, Column] = {}
    for gain, way, knob, bands, amount, low, high in (line.split() for line in MOVES.strip().splitlines()):
        now, turn = made.get(gain, F.col(gain)), clamp(F.coalesce(F.col(knob), F.lit(0.5)), 0.0, 1.0) - 0.5
        weights = {b: float(w) for b, w in (x.split(":") for x in bands.split(","))}
        weight = F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col("band"))
        moved = now + float(amount) * weight * turn if way == "add" else now * (1 + 2 * float(amount) * turn)
        made[gain] = F.when(F.col("band").isin(*weights), clamp(moved, float(low), float(high))).otherwise(now)
    return rows.withColumns(made)


def ring_levels(levels: DataFrame) -> DataFrame:
    """scene, side and rear levels as the knob ``rear_depth`` moves them."""
    turn = clamp(F.coalesce("rear_depth", F.lit(0.5)), 0.0, 1.0) - 0.5
    return levels.withColumns({"side": F.col("side") * (1 + 0.3 * turn), "rear": F.col("rear") * (1 + 0.5 * turn)})


def motion(mode: str, phase: Column, depth: float = 1.0) -> dict[str, Column]:
    """Gains of the left and right of each ring at a phase of 0 to 1; rings that a mode leaves alone are 1."""
    t = phase - F.floor(phase)
    one = F.lit(1.0)
    a = t * (2 * math.pi)
    out = {f"{r}{s}": one for r in RINGS for s in "LR"}
    half = lambda x: x * 0.5 + 0.5
    to = lambda x, share: lerp(one, x, F.lit(depth * share))
    if mode == "orbit":
        swing = lambda x: F.sqrt(lerp(F.lit(0.4), one, half(x)))
        out |= {"sideL": to(swing(F.cos(a)), 0.9), "sideR": to(swing(-F.cos(a)), 0.9), "rearL": to(swing(F.sin(a)), 0.9), "rearR": to(swing(-F.sin(a)), 0.9)}
    elif mode in ("clockwise", "anti-clockwise"):
        d = 1 if mode == "clockwise" else -1
        swing = lambda x: lerp(F.lit(0.5), one, F.sqrt(F.greatest(half(x), F.lit(0.0))))
        out |= {"sideL": to(swing(F.cos(a)), 0.8), "sideR": to(swing(-F.cos(a)), 0.8), "rearL": to(swing(d * F.sin(a)), 0.8), "rearR": to(swing(-d * F.sin(a)), 0.8)}
    elif mode == "front-rear-drift":
        drift = lerp(F.lit(0.55), F.lit(1.6), smoothstep(t))
        out |= {f"{r}{s}": to(g, w) for r, g, w in (("side", 1 / drift, 0.6), ("rear", drift, 1.0), ("front", F.sqrt(1 / drift), 0.3)) for s in "LR"}
    elif mode == "vertical":
        up = lerp(F.lit(0.65), F.lit(1.5), half(F.sin(a)))
        out |= {f"{r}{s}": to(g, w) for r, g, w in (("height", up, 1.0), ("side", F.sqrt(2 - up), 0.5)) for s in "LR"}
    elif mode == "breathing":
        b = F.sqrt(1 + F.sin(a) * 0.3)
        out |= {f"{r}{s}": to(g, w) for r, g, w in (("side", b, 1.0), ("rear", b, 1.0), ("height", F.sqrt(b), 0.7)) for s in "LR"}
    elif mode != "static":
        raise ValueError(f"unknown mode {mode!r}")
    return out
