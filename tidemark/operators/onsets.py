"""Onsets of a series and how well their attacks stand out, over frames that stretches share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import gain_to_db

#: Frames of a stretch; onsets of a series that are measured; share of rises that are none.
STRETCH, MOST, QUIET = 1 << 16, 60, 0.99
#: An attack is compared with what follows it, up to so many windows after its start.
AFTER = 10


def around(rows: DataFrame, series: str, before: int, after: int, made: dict, stretch: int = STRETCH) -> DataFrame:
    """``rows`` (series, frame, ...) with columns over neighbouring frames.

    made: name to a function of ``window(a, b)``, which spans frames from a to b of a
    row's, at least ``-before`` and at most ``after``. A stretch holds copies of the
    frames that its rows reach, so a long series is spread over tasks.
    """
    reach = F.sequence(F.floor((F.col("frame") - after) / stretch), F.floor((F.col("frame") + before) / stretch))
    spread = rows.withColumn("__stretch", F.explode(reach))
    order = Window.partitionBy(series, "__stretch").orderBy("frame")
    out = spread.withColumns({name: fn(lambda a, b: order.rangeBetween(a, b)) for name, fn in made.items()})
    return out.where(F.floor(F.col("frame") / stretch) == F.col("__stretch")).drop("__stretch")


def energy(frames: DataFrame, series: str, win: int, value: str = "value", stretch: int = STRETCH) -> DataFrame:
    """``energy``: the moving mean square of ``win`` frames around each, silence outside; ``rise``: to the next frame (null at the end)."""
    x = F.col(value).cast("double")
    low, high = win // 2, (win - 1) // 2
    power = lambda w, shift: F.sum(x * x).over(w(shift - low, shift + high)) / win
    made = {
        "energy": lambda w: power(w, 0),
        "rise": lambda w: F.when(F.count(F.lit(1)).over(w(1, 1)) > 0, F.coalesce(power(w, 1), F.lit(0.0)) - power(w, 0)),
    }
    return around(frames, series, low, high + 1, made, stretch)


def attacks(frames: DataFrame, series: str, win: int, value: str = "value", most: int = MOST, stretch: int = STRETCH) -> DataFrame:
    """series, frame, ratio_db, peak of the onsets of gap-free frames (series, frame from 0, value).

    Onsets rise more than ``QUIET`` of a series' steps do in size; evenly thinned, at
    most ``most`` are measured. One needs two windows after it. The ratio is of the
    mean energy of its window and of the nine after it, as far as the series goes.
    """
    own = energy(frames, series, win, value, stretch)
    bar = own.groupBy(series).agg(F.percentile(F.abs("rise"), F.lit(QUIET)).alias("bar"), F.count(F.lit(1)).alias("frames"))
    level = F.col("energy")
    loud: Column = F.abs(F.col(value).cast("double"))
    made = {
        "attack": lambda w: F.avg(level).over(w(0, win - 1)),
        "rest": lambda w: F.avg(level).over(w(win, AFTER * win - 1)),
        "peak": lambda w: F.max(loud).over(w(0, win - 1)),
    }
    each = around(own, series, 0, AFTER * win - 1, made, stretch).join(bar, series).where(F.col("rise") > F.col("bar"))
    w = Window.partitionBy(series)  # a hundredth of a series' frames
    numbered = each.withColumns({"__k": F.row_number().over(w.orderBy("frame")) - 1, "__n": F.count(F.lit(1)).over(w)})
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / most))
    kept = numbered.where((F.col("__k") % step == 0) & (F.col("__k") < step * most) & (F.col("frame") + 2 * win <= F.col("frames")))
    return kept.select(series, "frame", (10 * F.log10((F.col("attack") + 1e-18) / (F.col("rest") + 1e-18))).alias("ratio_db"), "peak")


def summary(found: DataFrame, series: str) -> DataFrame:
    """series, onsets, ratio_db (their mean), peak_db (of the loudest). Series without onsets have no row."""
    return found.groupBy(series).agg(F.count(F.lit(1)).alias("onsets"), F.avg("ratio_db").alias("ratio_db"), gain_to_db(F.max("peak")).alias("peak_db"))
