"""Frames, blocks and windows over ordered series, as plain DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ABSOLUTE_GATE, RANGE_GATE, RELATIVE_GATE, block_level, level_of_power, power_of_level


def framed(rows: DataFrame, series: str, order: list[str], stretch: Column, out: str = "frame") -> DataFrame:
    """Numbers each series from 0 in order, without one task for one series.

    ``stretch`` is a coarse, non-decreasing function of the first order column.
    Rows are numbered inside a stretch and moved by what earlier stretches hold;
    only the counts of stretches meet by series.
    """
    cut = rows.withColumn("__stretch", stretch)
    counts = cut.groupBy(series, "__stretch").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(series).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(series, "__stretch", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(series, "__stretch").orderBy(*order)
    numbered = cut.withColumn("__k", F.row_number().over(inside))
    return numbered.join(offsets, [series, "__stretch"]).withColumn(out, F.col("__before") + F.col("__k") - 1).drop("__stretch", "__k", "__before")


def hop_blocks(frames: DataFrame, series: str, block: int, hop: int, sums: dict[str, Column]) -> DataFrame:
    """Sums over hopping blocks of gap-free frames: series, block_idx and the sums.

    If the hop divides the block, sums of hops are added up; else each frame is
    given to all blocks that hold it. The incomplete tail has no block.
    """
    if block % hop == 0:
        k = block // hop
        hops = frames.groupBy(series, F.floor(F.col("frame") / hop).alias("block_idx")).agg(*(F.sum(v).alias(n) for n, v in sums.items()), F.count(F.lit(1)).alias("__n"))
        ahead = Window.partitionBy(series).orderBy("block_idx").rowsBetween(0, k - 1)
        return hops.select(series, "block_idx", *(F.sum(n).over(ahead).alias(n) for n in sums), F.sum("__n").over(ahead).alias("__n")).where(F.col("__n") == block).drop("__n")
    first = F.greatest(F.lit(0), F.ceil((F.col("frame") - (block - 1)) / hop))
    spread = frames.withColumn("block_idx", F.explode(F.sequence(first, F.floor(F.col("frame") / hop))))
    out = spread.groupBy(series, "block_idx").agg(*(F.sum(v).alias(n) for n, v in sums.items()), F.count(F.lit(1)).alias("__n"))
    return out.where(F.col("__n") == block).drop("__n")


def block_levels(frames: DataFrame, series: str, block: int, hop: int, value: Column | None = None) -> DataFrame:
    v = F.col("value") if value is None else value
    return hop_blocks(frames, series, block, hop, {"sq": v * v}).select(series, "block_idx", block_level(F.col("sq") / block).alias("level"))


def mean_level(level: Column) -> Column:
    """Mean of levels in the power domain, as an aggregate."""
    return level_of_power(F.avg(power_of_level(level)))


def gated(levels: DataFrame, series: str, relative: float = RELATIVE_GATE) -> DataFrame:
    """Levels above both gates; the threshold is one aggregated row for each series."""
    loud = levels.where(F.col("level") > ABSOLUTE_GATE)
    threshold = loud.groupBy(series).agg((mean_level(F.col("level")) + relative).alias("threshold"))
    return loud.join(threshold, series).where(F.col("level") > F.col("threshold"))


def integrated(levels: DataFrame, series: str) -> DataFrame:
    return gated(levels, series).groupBy(series).agg(mean_level(F.col("level")).alias("integrated"), F.count(F.lit(1)).alias("n_blocks"))


def loudness_range(levels: DataFrame, series: str) -> DataFrame:
    own = gated(levels, series, RANGE_GATE).groupBy(series).agg(F.percentile("level", F.lit(0.95)).alias("p95"), F.percentile("level", F.lit(0.10)).alias("p10"), F.count(F.lit(1)).alias("n_blocks"))
    return own.where("n_blocks >= 2").select(series, F.greatest(F.lit(0.0), F.col("p95") - F.col("p10")).alias("lra"), "n_blocks")


def sliding_minimum(frames: DataFrame, series: str, half: int, value: str = "value", stretch: int = 1 << 16) -> DataFrame:
    """``low``: the least of the values up to ``half`` frames away.

    Series are cut into stretches, so that a long one is spread over tasks; rows
    within ``half`` frames of a cut come to both sides of it.
    """
    reach = F.sequence(F.floor((F.col("frame") - half) / stretch), F.floor((F.col("frame") + half) / stretch))
    spread = frames.withColumn("__stretch", F.explode(reach))
    w = Window.partitionBy(series, "__stretch").orderBy("frame").rangeBetween(-half, half)
    low = spread.withColumn("low", F.min(value).over(w))
    return low.where(F.floor(F.col("frame") / stretch) == F.col("__stretch")).drop("__stretch")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, stretch: Column) -> DataFrame:
    """``left`` rows (key, at, ...) with the value of the latest ``right`` row (key, at, value) at or before them, or null.

    Of right rows at one time the largest value counts. ``stretch`` is a coarse,
    non-decreasing function of ``at``: rows meet inside a stretch of a key, and only
    each stretch's last value travels on, so that no key needs one task.
    """
    kind = dict(right.dtypes)[value]
    both = left.withColumns({value: F.lit(None).cast(kind), "__kind": F.lit(1)}).unionByName(right.select(key, at, value).withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    cut = both.withColumn("__stretch", stretch)
    last = cut.where("__kind = 0").groupBy(key, "__stretch").agg(F.max(F.struct(at, value))[value].alias("__last"))
    spots = cut.select(key, "__stretch").distinct().join(last, [key, "__stretch"], "left")
    before = Window.partitionBy(key).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.select(key, "__stretch", F.last("__last", ignorenulls=True).over(before).alias("__carry"))
    inside = Window.partitionBy(key, "__stretch").orderBy(at, "__kind", value).rowsBetween(Window.unboundedPreceding, 0)
    here = cut.withColumn("__here", F.last(value, ignorenulls=True).over(inside)).where("__kind = 1")
    out = here.join(carried, [key, "__stretch"], "left").withColumn(value, F.coalesce("__here", "__carry"))
    return out.select(*left.columns, value)


def smooth_3pt(frames: DataFrame, series: str, share: float, value: str = "value") -> DataFrame:
    """``smooth``: a row's value and, by ``share``, its two neighbours'; at an end the row stands for the missing one."""
    w = Window.partitionBy(series).orderBy("frame")
    v = F.col(value)
    around = F.coalesce(F.lag(v).over(w), v) + F.coalesce(F.lead(v).over(w), v)
    return frames.withColumn("smooth", v * (1 - share) + around * (share / 2))


def pyramid_level(values: DataFrame, series: str, size: int) -> DataFrame:
    """One level up: min and max of ``size`` buckets (series, bucket, vmin, vmax)."""
    return values.groupBy(series, F.floor(F.col("bucket") / size).alias("bucket")).agg(F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))


def pyramid(frames: DataFrame, series: str, size: int, levels: int) -> DataFrame:
    """series, level, bucket, vmin, vmax.

    On the first level a bucket's maximum is taken over the samples one later:
    it misses the bucket's first and takes in the next bucket's first.
    """
    ahead = Window.partitionBy(series).orderBy("frame")
    own = frames.select(series, F.col("frame").alias("bucket"), F.col("value").alias("vmin"), F.coalesce(F.lead("value").over(ahead), F.col("value")).alias("vmax"))
    out = None
    for level in range(levels):
        own = pyramid_level(own, series, size)
        here = own.withColumn("level", F.lit(level))
        out = here if out is None else out.unionByName(here)
    return out


def peak_buckets(frames: DataFrame, series: str, buckets: int) -> DataFrame:
    """Largest magnitude in each of ``buckets`` equal stretches; a longer tail is left out."""
    n = frames.groupBy(series).agg((F.max("frame") + 1).alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / buckets))
    return frames.join(n, series).withColumn("bucket", F.floor(F.col("frame") / step)).where(F.col("bucket") < buckets).groupBy(series, "bucket").agg(F.max(F.abs("value")).alias("peak"))


def runs(frames: DataFrame, series: str, flag: Column) -> DataFrame:
    """Gaps and islands: start and length of each run of consecutive flagged frames."""
    own = frames.where(flag)
    w = Window.partitionBy(series).orderBy("frame")
    return own.withColumn("__run", F.col("frame") - F.row_number().over(w)).groupBy(series, "__run").agg(F.min("frame").alias("start"), F.count(F.lit(1)).alias("length")).drop("__run")


def bursts(frames: DataFrame, series: str, loud: Column, gap: int) -> DataFrame:
    """Sessions of loud frames that a quiet stretch of ``gap`` frames or more ends."""
    w = Window.partitionBy(series).orderBy("frame")
    own = frames.where(loud).withColumn("__new", (F.col("frame") - F.lag("frame").over(w) > gap).cast("int"))
    own = own.withColumn("__burst", F.sum(F.coalesce("__new", F.lit(0))).over(w))
    return own.groupBy(series, "__burst").agg(F.min("frame").alias("start"), (F.max("frame") - F.min("frame") + 1).alias("length")).drop("__burst")
