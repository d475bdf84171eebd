"""Dimension tables: parameters, speakers, layouts, delivery profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The parameters as key, kind, default, low, high, choices.
PARAMETERS = """
normalize boolean true - - true,false
targetLUFS number -14 -30 -5 -
ceiling number -1 -3 -0.1 -
drive number 0 -6 9 -
sub number 0 -12 12 -
warm number 0 -12 12 -
body number 0 -12 12 -
harsh number 0 -12 12 -
clarity number 0 -12 12 -
air number 0 -12 12 -
tilt number 0 -6 6 -
sat number 0 0 100 -
mbLow number 0 0 100 -
mbMid number 0 0 100 -
mbHigh number 0 0 100 -
mbMix number 100 0 100 -
mbSpeed enum med - - fast,med,slow
mbAutoMakeup boolean false - - true,false
mbSolo enum none - - none,low,mid,high
mbBypassLow boolean false - - true,false
mbBypassMid boolean false - - true,false
mbBypassHigh boolean false - - true,false
transAttack number 0 -100 100 -
transSustain number 0 -100 100 -
width number 1 0 2.5 -
ms number 0 -1 1 -
bassMono number 0 0 400 -
haas number 0 0 35 -
haasSide enum 1 - - 1,-1
crossfeed number 0 0 1 -
phaseRot number 0 0 1 -
widthLow number 1 0 2 -
widthMid number 1 0 2 -
widthHigh number 1 0 2.5 -
depth number 0 0 100 -
depthSize enum med - - small,med,large
depthMode enum classic - - classic,clean
binaural boolean false - - true,false
spread number 0 0 1 -
tape number 0 0 100 -
hiss number 0 0 100 -
vinyl number 0 0 100 -
textureSeed number 85348887 0 4294967295 -
matchStrength number 0 0 100 -
matchMode enum balanced - - broad,balanced,precise
matchGains array 0,0,0,0,0,0,0,0 -12 12 -
dither enum tpdf - - none,tpdf,shaped
"""

# Speakers as id, azimuth (positive left), elevation, label, WAVE mask bit, whether low-frequency.
SPEAKERS = """
L 30 0 M+030 0x1 0
R -30 0 M-030 0x2 0
C 0 0 M+000 0x4 0
LFE 0 -15 LFE1 0x8 1
Ls 110 0 M+110 0x10 0
Rs -110 0 M-110 0x20 0
Lss 90 0 M+090 0x200 0
Rss -90 0 M-090 0x400 0
Lrs 135 0 M+135 0x10 0
Rrs -135 0 M-135 0x20 0
Lw 60 0 M+060 0x40 0
Rw -60 0 M-060 0x80 0
Ltf 45 45 U+045 0x1000 0
Rtf -45 45 U-045 0x4000 0
Ltm 90 60 U+090 0x0 0
Rtm -90 60 U-090 0x0 0
Ltr 135 45 U+135 0x8000 0
Rtr -135 45 U-135 0x20000 0
"""

# Standard layouts and their channels.
LAYOUTS = {
    "5.1": "L R C LFE Ls Rs",
    "7.1": "L R C LFE Lss Rss Lrs Rrs",
    "7.1.2": "L R C LFE Lss Rss Lrs Rrs Ltf Rtf",
    "7.1.4": "L R C LFE Lss Rss Lrs Rrs Ltf Rtf Ltr Rtr",
    "9.1.6": "L R C LFE Lss Rss Lrs Rrs Lw Rw Ltf Rtf Ltm Rtm Ltr Rtr",
}
NO_MASK = ("9.1.6", "venue")

# The 24-channel venue's azimuths and elevations in channel order; the last four are subwoofers.
VENUE = "30:0 -27:0 67:0 -61:0 112.5:0 -115:0 153:0 -155:0 43.5:-8 -40:-8 134:-8 -136:-8 43.5:13 -40:13 134:13 -136:13 44:33 -41.5:35 131:34 -130:35 90:-8 -90:-8 0:-8 180:-8"

# Delivery profiles as id, bit depth, rates, layout, ceiling, loudness, container.
PROFILES = """
stereo-distribution 24 44100,48000 stereo -1 -14 wav
film-video 24 48000 stereo -2 -23 wav
high-res-archive 32 48000,88200,96000,176400,192000 stereo - - wav
bed-714 24 48000,96000 7.1.4 -1 - wav
venue-204 24 48000,96000 venue -1 - wav
adm-ingest 24 48000,96000 7.1.4 -1 - adm-bwf
"""
# Files that go with a profile.
SIDECARS = {
    "stereo-distribution": "{base}_render-report.json {base}_delivery-manifest.json",
    "film-video": "{base}_render-report.json {base}_delivery-manifest.json",
    "high-res-archive": "{base}_render-report.json {base}_delivery-manifest.json SHA256SUMS.txt",
    "bed-714": "{base}_channel-map.txt {base}_channel-map.json {base}_channel-identification.wav {base}_render-report.json {base}_delivery-manifest.json",
    "venue-204": "{base}_channel-map.txt {base}_channel-map.json {base}_channel-identification.wav {base}_render-report.json {base}_delivery-manifest.json README-delivery.txt SHA256SUMS.txt",
    "adm-ingest": "{base}_channel-map.txt {base}_channel-map.json {base}_adm.xml {base}_render-report.json {base}_delivery-manifest.json README-delivery.txt",
}


def _lines(text: str) -> list[list[str]]:
    return [line.split() for line in text.strip().splitlines()]


def param_spec(spark: SparkSession) -> DataFrame:
    none = lambda x, f: None if x == "-" else f(x)
    rows = [(k, kind, d, none(a, float), none(b, float), none(ch, lambda x: x.split(","))) for k, kind, d, a, b, ch in _lines(PARAMETERS)]
    return spark.createDataFrame(rows, "key string, kind string, fallback string, low double, high double, choices array<string>")


#: Parameters that a preview leaves out.
EXPORT_ONLY = ("ceiling", "transAttack", "transSustain", "dither")


def preview_divergences(spark: SparkSession) -> DataFrame:
    """key, kind, fallback of the parameters that sound in an export only."""
    return param_spec(spark).where(F.col("key").isin(*EXPORT_ONLY)).select("key", "kind", "fallback")


def audition_groups(spark: SparkSession) -> DataFrame:
    """speaker_id, group: the ring that soloing a speaker belongs to."""
    ear = F.col("ring").isin("ear", "sub")
    az = F.abs("azimuth_adm")
    group = F.when(F.col("lfe"), "sub").when(F.col("ring") == "ground", "side").when(~ear, "height").when((F.col("speaker_id") == "C") | (az <= 70), "front").when(az > 130, "rear").otherwise("side")
    return speakers(spark).select("speaker_id", group.alias("group"))


def placements(spark: SparkSession) -> DataFrame:
    """speaker_id and its unit vector from the listener: x right, y up, z back."""
    a, e = F.radians("azimuth_hrtf"), F.radians("elevation")
    return speakers(spark).select("speaker_id", (F.sin(a) * F.cos(e)).alias("x"), F.sin(e).alias("y"), (-F.cos(a) * F.cos(e)).alias("z"))


def defaults() -> dict[str, str]:
    return {r[0]: r[2] for r in _lines(PARAMETERS)}


def speakers(spark: SparkSession) -> DataFrame:
    rows = [(i, float(a), float(e), label, int(m, 16), lfe == "1") for i, a, e, label, m, lfe in _lines(SPEAKERS)]
    for k, place in enumerate(VENUE.split()):
        a, e = map(float, place.split(":"))
        rows.append((f"V{k + 1}", a, e, f"V_{k + 1:02d}", 0, k >= 20))
    df = spark.createDataFrame(rows, "speaker_id string, azimuth_adm double, elevation double, adm_label string, wav_mask_bit int, lfe boolean")
    ring = F.when(F.col("speaker_id").startswith("V") & F.col("lfe"), "sub").when(F.col("elevation") > 20, "roof").when(F.col("elevation") > 0, "height").when(F.col("speaker_id").startswith("V") & (F.col("elevation") < 0), "ground").otherwise("ear")
    return df.withColumns({"azimuth_hrtf": -F.col("azimuth_adm") + 0.0, "ring": ring})


def layout_channels(spark: SparkSession) -> DataFrame:
    """layout_id, pos, speaker_id, standard: a row for each channel of each layout."""
    every = LAYOUTS | {"venue": " ".join(f"V{k + 1}" for k in range(24))}
    rows = [(layout, pos, s, layout not in NO_MASK) for layout, own in every.items() for pos, s in enumerate(own.split())]
    return spark.createDataFrame(rows, "layout_id string, pos int, speaker_id string, standard boolean")


def weighted(rows: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """``rows`` (with ``lfe``) with the weight of their key; without one, 0 for low-frequency channels and 1 for others."""
    j = rows.join(F.broadcast(weights), key, "left")  # a row for each kind of channel
    return j.withColumn("weight", F.coalesce("weight", F.when(F.col("lfe"), 0.0).otherwise(1.0)))


def profiles(spark: SparkSession) -> DataFrame:
    none = lambda x: None if x == "-" else float(x)
    rows = [(i, int(b), [int(r) for r in rates.split(",")], layout, none(c), none(lo), box, SIDECARS[i].split()) for i, b, rates, layout, c, lo, box in _lines(PROFILES)]
    return spark.createDataFrame(rows, "profile_id string, bit_depth int, sample_rates array<int>, layout string, ceiling double, loudness double, container string, sidecars array<string>")


def wav_channel_order(spark: SparkSession) -> DataFrame:
    """layout_id, channel (from 1), speaker_id, mask, standard: by mask bit where all bits are set and distinct, else as listed."""
    j = layout_channels(spark).join(speakers(spark), "speaker_id")
    whole = j.groupBy("layout_id").agg((F.bool_and("standard") & (F.min("wav_mask_bit") > 0) & (F.count_distinct("wav_mask_bit") == F.count(F.lit(1)))).alias("usable"), F.bit_or("wav_mask_bit").alias("bits"))
    from pyspark.sql import Window

    key = F.when(F.col("usable"), F.col("wav_mask_bit")).otherwise(F.col("pos"))
    return j.join(whole, "layout_id").select("layout_id", F.row_number().over(Window.partitionBy("layout_id").orderBy(key)).alias("channel"), "speaker_id", F.when(F.col("usable"), F.col("bits")).otherwise(0).alias("mask"), F.col("usable").alias("standard"))


def conformance(renders: DataFrame, spark: SparkSession) -> DataFrame:
    """Renders (render_id, profile_id, sample_rate, bit_depth, layout, true_peak, integrated) against their profiles."""
    j = renders.join(F.broadcast(profiles(spark).withColumnsRenamed({"bit_depth": "p_depth", "layout": "p_layout"})), "profile_id")  # six fixed rows
    kept = lambda *x: F.filter(F.array(*x), lambda v: v.isNotNull())
    deviations = kept(F.when(~F.array_contains("sample_rates", F.col("sample_rate")), "sample rate"), F.when(F.col("bit_depth") != F.col("p_depth"), "bit depth"), F.when(F.col("layout") != F.col("p_layout"), "layout"))
    advisories = kept(F.when(F.col("true_peak") > F.col("ceiling") + 0.05, "true peak"), F.when(F.abs(F.col("integrated") - F.col("loudness")) > 1, "loudness"))
    return j.select("render_id", "profile_id", (F.size(deviations) == 0).alias("conforms"), F.concat_ws(",", deviations).alias("deviations"), F.concat_ws(",", advisories).alias("advisories"))
