"""Baseline against candidate: thresholded flags of joined measurement rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a measure may move on a reference path, and on a creative one.
LIMITS = {
    "loudness": (1.0, 3.0), "crest": (3.0, 8.0), "rms": (1.0, 4.0), "correlation": (0.15, 0.5), "mono": (1.5, 6.0), "centroid": (250.0, 1500.0), "band": (1.5, 6.0),
}
DC, DC_GROWTH, OVERSHOOT = 0.05, 0.02, 0.15


def limit(name: str, cls: Column) -> Column:
    reference, creative = LIMITS[name]
    return F.when(cls == "creative", F.lit(creative)).otherwise(F.lit(reference))


def flags(baseline: DataFrame, candidate: DataFrame, ceiling: float | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """severity, kind, id, class, value: one row for each rule a candidate row breaks, and for each row it lacks.

    Both: id, class, nan, inf, dc, true_peak_db, integrated, crest_db, rms_db,
    correlation, mono_loss_db, centroid_hz, and bands_db (an array of band levels)
    where there is one. Rules of movement need a baseline row. Rows meet by id and
    the columns ``within``, which come with each flag.
    """
    on = ["id", *within]
    measures = [c for c in candidate.columns if c not in (*on, "class")]
    base = baseline.select(*on, *(F.col(c).alias(f"b_{c}") for c in measures))
    j = candidate.join(base, on, "left")
    c = F.col
    moved = lambda m: c(m) - c(f"b_{m}")
    soft = F.when(c("class") == "reference", "defect").otherwise("info")
    rules = [
        ("defect", F.when(c("nan") > 0, "nan").otherwise("infinity"), c("nan") + c("inf") > 0, c("nan") + c("inf")),
        ("defect", F.lit("dc"), (c("dc") > DC) | ((moved("dc") > DC_GROWTH) & (c("class") == "reference")), c("dc")),
        (soft, F.lit("loudness-change"), F.abs(moved("integrated")) > limit("loudness", c("class")), moved("integrated")),
        (soft, F.lit("crest-collapse"), -moved("crest_db") > limit("crest", c("class")), moved("crest_db")),
        (soft, F.lit("rms-change"), F.abs(moved("rms_db")) > limit("rms", c("class")), moved("rms_db")),
        (soft, F.lit("correlation-collapse"), -moved("correlation") > limit("correlation", c("class")), moved("correlation")),
        (soft, F.lit("mono-sum-degradation"), -moved("mono_loss_db") > limit("mono", c("class")), moved("mono_loss_db")),
        (soft, F.lit("spectral-shift"), F.abs(moved("centroid_hz")) > limit("centroid", c("class")), moved("centroid_hz")),
    ]
    if "bands_db" in measures:
        worst = F.array_max(F.zip_with("bands_db", "b_bands_db", lambda a, b: F.struct(F.abs(a - b).alias("far"), (a - b).alias("moved"))))
        rules.append((soft, F.lit("band-shift"), worst["far"] > limit("band", c("class")), worst["moved"]))
    if ceiling is not None:
        rules.append(("defect", F.lit("true-peak-violation"), c("true_peak_db") > ceiling + OVERSHOOT, c("true_peak_db")))
    made = F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct((s if isinstance(s, Column) else F.lit(s)).alias("severity"), kind.alias("kind"), value.cast("double").alias("value"))) for s, kind, when, value in rules))
    found = j.select(*on, "class", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("f")).select("f.severity", "f.kind", *on, "class", "f.value")
    gone = baseline.join(candidate.select(*on), on, "left_anti").select(F.lit("defect").alias("severity"), F.lit("missing-measurement").alias("kind"), *on, "class", F.lit(None).cast("double").alias("value"))
    return found.unionByName(gone)


def across(measured: DataFrame, group: str, reference: str, ceiling: float | None = None) -> DataFrame:
    """Flags of every other group against the reference group; what is a defect there is a divergence here.

    The reference rows come once for each other group, of which there are few.
    """
    ref = measured.where(F.col(group) == reference).drop(group).withColumn("class", F.lit("reference"))
    own = measured.where(F.col(group) != reference).withColumn("class", F.lit("reference"))
    names = own.agg(F.collect_set(group).alias("names"))  # one row
    base = ref.join(F.broadcast(names)).withColumn(group, F.explode("names")).drop("names")
    found = flags(base, own, ceiling, (group,))
    return found.withColumns({
        "severity": F.when((F.col("severity") == "defect") & ~F.col("kind").isin("nan", "infinity"), "browser").otherwise(F.col("severity")),
        "kind": F.when(F.col("kind") == "loudness-change", "browser-divergence").otherwise(F.col("kind")),
    })


def pcm_differences(original: DataFrame, decoded: DataFrame, tolerance: Column) -> DataFrame:
    """Sample-wise join on (channel, frame): largest error, polarity, silence swaps, and whether within tolerance.

    Both: clip, channel, frame, value. Samples of one side only count as errors of the rest.
    """
    a = original.select("clip", "channel", "frame", F.col("value").alias("x"))
    b = decoded.select("clip", "channel", "frame", F.col("value").alias("y"))
    j = a.join(b, ["clip", "channel", "frame"], "full")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    return j.groupBy("clip", "channel").agg(
        F.max(F.abs(x - y)).alias("max_error"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("missing"),
        ((F.sum(x * y) < 0) & (F.sum(x * x) > 1e-9)).alias("polarity_flipped"), ((F.max(F.abs(x)) == 0) != (F.max(F.abs(y)) == 0)).alias("silence_swapped"), F.max(F.abs(x)).alias("peak"), F.max(F.abs(y)).alias("decoded_peak"),
    ).withColumn("ok", (F.col("max_error") <= tolerance) & (F.col("missing") == 0) & ~F.col("polarity_flipped") & ~F.col("silence_swapped") & (F.abs(F.col("peak") - F.col("decoded_peak")) <= tolerance + F.col("peak") * 1e-4))
