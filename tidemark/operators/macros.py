"""Macro controls: one setting of 0 to 100 that moves several parameters at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp, js_round

# Macro, parameter, setting at rest and its scale (a position is (setting - rest) / scale), how far from
# rest nothing moves yet, resting value, then value = base + slope * position within low and high, and decimals (- none).
MACROS = """
body warm 50 50 0.05 0 0 3.2 -6 6 1
body body 50 50 0.05 0 0 2.2 -5 5 1
body sub 50 50 0.05 0 0 1.1 -3 3 1
clarity clarity 50 50 0.05 0 0 3.0 -4 4 -
clarity harsh 50 50 0.05 0 0 -1.2 -2 2 -
punch mbLow 0 100 0.12 0 0 32 0 100 0
punch mbMid 0 100 0.12 0 0 26 0 100 0
punch mbHigh 0 100 0.12 0 0 18 0 100 0
punch mbMix 0 100 0.12 100 92 -18 0 100 0
punch transAttack 0 100 0.12 0 0 18 0 100 0
punch transSustain 0 100 0.12 0 0 10 0 100 0
air air 50 50 0.05 0 0 3.5 -5 5 1
width width 50 50 0.08 1 1 0.45 0.6 1.75 2
width widthLow 50 50 0.08 1 1 0.18 0.7 1.3 2
width widthMid 50 50 0.08 1 1 0.32 0.8 1.45 2
width widthHigh 50 50 0.08 1 1 0.5 0.85 1.9 2
depth depth 0 100 0.06 0 0 55 0 100 0
depth spread 0 100 0.06 0 0 0.35 0 1 2
character tape 0 100 0.06 0 0 55 0 100 0
character sat 0 100 0.06 0 0 14 0 100 0
"""
# Names of a macro's stretches, each up to (not including) a setting.
STRETCHES = """
punch 20 open 45 glue 75 firm 101 dense
width 30 narrow 55 natural 78 wide 101 extra-wide
depth 8 dry 30 room 60 hall 101 deep
character 8 clean 30 warm 60 textured 101 worn
"""


def rows_of() -> list[tuple]:
    number = lambda x: None if x == "-" else float(x)
    return [(m, k, *map(number, rest)) for m, k, *rest in (line.split() for line in MACROS.strip().splitlines())]


def macros(spark: SparkSession) -> DataFrame:
    """macro, key and the rule of each parameter that it moves in a straight line."""
    return spark.createDataFrame(rows_of(), "macro string, key string, rest double, scale double, still double, resting double, base double, slope double, low double, high double, digits double")


def applied(settings: DataFrame) -> DataFrame:
    """set_id, macro, key, value: what settings (set_id, macro, v) make of numeric parameters.

    Beside the straight lines: mono bass from a width over 58, hiss that steepens
    over the middle of character, and crackle from 65 on.
    """
    j = settings.join(F.broadcast(macros(settings.sparkSession)), "macro")  # a fixed table
    c = F.col
    t = (c("v") - c("rest")) / c("scale")
    line = c("base") + t * c("slope")
    scale = F.pow(F.lit(10.0), c("digits"))
    rounded = F.when(c("digits").isNull(), line).otherwise(F.floor(line * scale + 0.5) / scale)
    moved = F.when(F.abs(t) < c("still"), c("resting")).otherwise(clamp(rounded, c("low"), c("high")))
    straight = j.select("set_id", "macro", "key", moved.alias("value"))
    u, width, character = c("v") / 100.0, settings.where("macro = 'width'"), settings.where("macro = 'character'")
    mono = width.select("set_id", "macro", F.lit("bassMono").alias("key"), F.when(c("v") > 58, 65.0).otherwise(0.0).alias("value"))
    hiss = js_round(u * F.when(u > 0.5, 18.0).otherwise(6.0))
    crackle = F.when(u > 0.65, js_round((u - 0.65) * 55)).otherwise(0.0)
    bent = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.when(u < 0.06, 0.0).otherwise(v).alias("value")) for k, v in (("hiss", hiss), ("vinyl", crackle))))).alias("e")
    return straight.unionByName(mono).unionByName(character.select("set_id", "macro", bent).select("set_id", "macro", "e.key", "e.value"))


def described(settings: DataFrame) -> DataFrame:
    """set_id, macro, shown: the name of a setting's stretch, or its signed distance from the middle."""
    v = F.col("v").cast("int")
    far = F.when(v > 50, F.concat(F.lit("+"), (v - 50).cast("string"))).otherwise((v - 50).cast("string"))
    shown = F.when(v == 50, F.when(F.col("macro") == "clarity", "neutral").otherwise("flat")).otherwise(far)
    for name, *steps in (line.split() for line in STRETCHES.strip().splitlines()):
        named = F.lit(steps[-1])
        for upto, word in reversed(list(zip(steps[:-2:2], steps[1::2]))):
            named = F.when(v < int(upto), word).otherwise(named)
        shown = F.when(F.col("macro") == name, named).otherwise(shown)
    return settings.select("set_id", "macro", shown.alias("shown"))
