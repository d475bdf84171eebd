"""Speaker feeds of planned scenes: a sparse table of gains, joined to the chunks that it mixes.

A scene sends bands of the mid and side of a programme to group buses, and every
speaker taps one bus. A ``path`` is a filtered signal that routes start from: a band of
the mid or side, a band's side through one ear's decorrelator, or the low-frequency
feed. Filters run over chunks as ``scans`` does; delays move chunks, gains are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import design as d
from tidemark.operators.scans import Cascade, over_chunks
from tidemark.operators.scene import BANDS

#: Frequencies (Hz) between the bands.
EDGES = (100, 300, 900, 3000, 8000)
#: Decorrelation of a band: delay before (ms), all-pass (Hz), delay of an ear (ms).
DECORRELATION = {"lowmid": (7.0, 950, 1.4), "mid": (6.2, 1500, 1.7), "presence": (5.4, 2400, 2.1), "air": (4.6, 3600, 2.6)}
#: Further delay of a ring (ms), left and right; bands that may feed it.
RING_DELAY = {"side": (0.0, 0.0), "rear": (4.6, 5.3), "height": (9.4, 10.6), "ground": (2.8, 3.4)}
RING_BANDS = {"side": ("lowmid", "mid", "presence", "air"), "rear": ("mid", "presence", "air"), "height": ("mid", "presence", "air"), "ground": ("lowmid", "mid", "presence")}
#: An ear's all-pass frequency and delay as multiples of the band's, and the Q of its all-pass.
EARS = {"L": (1.4, 1.0, 0.45), "R": (0.65, 1.7, 0.6)}
#: Gain of speakers that don't take their bus as it is.
TAP_GAIN = {"Lw": 0.75, "Rw": 0.75, "V3": 0.72, "V4": 0.72, "V13": 0.9, "V14": 0.9, "V15": 0.8, "V16": 0.8, "V17": 1.05, "V18": 1.05, "V19": 0.95, "V20": 0.95, "V21": 0.85, "V22": 0.85, "V24": 0.7}
LONGEST_MS = 240.0
#: Buses that are soloed together.
GROUPS = {"front": ("frontL", "frontR", "centre"), "side": ("sideL", "sideR", "groundL", "groundR"), "rear": ("rearL", "rearR"), "height": ("heightL", "heightR"), "sub": ("lfe",)}
VENUE = "venue"


def bus_of(speaker: Column, azimuth: Column, ring: Column, lfe: Column) -> Column:
    """The bus that a speaker taps."""
    hand = F.when(azimuth > 0, "L").otherwise("R")
    away = F.abs(azimuth)
    ear = F.when((speaker == "C") | (away <= 8), "centre").otherwise(F.concat(F.when(away <= 70, "front").when(away <= 130, "side").otherwise("rear"), hand))
    return F.when(lfe, "lfe").when(ring == "ground", F.concat(F.lit("ground"), hand)).when(ring == "ear", ear).otherwise(F.concat(F.lit("height"), hand))


def taps(speakers: DataFrame, channels: DataFrame) -> DataFrame:
    """layout_id, speaker_id, bus, tap: what each channel of a layout takes."""
    tap = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TAP_GAIN.items() for x in kv)), F.col("speaker_id")), F.lit(1.0))
    bus = bus_of(*(F.col(k) for k in ("speaker_id", "azimuth_adm", "ring", "lfe")))
    return channels.join(speakers, "speaker_id").select("layout_id", "speaker_id", bus.alias("bus"), tap.alias("tap"))


def bus_levels(scenes: DataFrame) -> DataFrame:
    """scene, bus, level of scenes (scene, layout_id, front_rear, lfe_db, surround_db, height_db, and the levels side, rear, height, ground).

    Null knobs are neutral. Only the venue has ground buses that a scene's level moves.
    """
    knob = lambda name, neutral: F.coalesce(F.col(name), F.lit(neutral))
    gain = lambda db: F.pow(F.lit(10.0), db / 20)
    turn = knob("front_rear", 0.5) - 0.5
    front, back = 1 - F.greatest(F.lit(0.0), turn) * 0.6, 1 - F.greatest(F.lit(0.0), -turn) * 0.6
    around, above = gain(knob("surround_db", -3.0)) * back, gain(knob("height_db", -6.0)) * back
    ground = F.when(F.col("layout_id") == VENUE, around * F.col("ground")).otherwise(1.0)
    pairs = {"front": front, "side": around * F.col("side"), "rear": around * F.col("rear"), "height": above * F.col("height"), "ground": ground}
    level = {f"{k}{s}": v for k, v in pairs.items() for s in "LR"} | {"centre": F.lit(1.0), "lfe": gain(knob("lfe_db", -3.0))}
    return scenes.select("scene", F.explode(F.create_map(*(x for k, v in level.items() for x in (F.lit(k), v)))).alias("bus", "level"))


def routes(rows: DataFrame) -> DataFrame:
    """scene, path, bus, gain, delay_ms of planned scene rows (scene, layout_id, has_centre, has_lfe, centre_extract, band, the gains, decorr).

    Routes without a gain aren't listed. Null gains are none.
    """
    v = lambda k: F.coalesce(F.col(k).cast("double"), F.lit(0.0))
    band = F.col("band")
    to = lambda path, bus, gain, ms=0.0: F.struct(path.alias("path"), F.lit(bus).alias("bus"), gain.alias("gain"), (ms if isinstance(ms, Column) else F.lit(ms)).alias("delay_ms"))
    extract = F.coalesce("centre_extract", F.lit(0.5))
    centre = F.when(F.col("has_centre") & (extract > 0) & (v("centreM") > 0), v("centreM") * extract).otherwise(0.0)
    front = F.greatest(F.lit(0.0), v("frontM") - 0.3 * centre)
    mid, side = F.concat(F.lit("mid:"), band), F.concat(F.lit("side:"), band)
    wide = F.greatest(v("frontS"), F.lit(0.0))
    out = [to(mid, "centre", centre), to(mid, "frontL", front), to(mid, "frontR", front), to(side, "frontL", wide), to(side, "frontR", -wide)]
    out.append(to(F.lit("lfe"), "lfe", F.when((band == "sub") & F.col("has_lfe") & (v("lfeM") > 0), v("lfeM")).otherwise(0.0)))
    depth = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("decorr", F.lit(0.5))))
    of_band = lambda k: F.element_at(F.create_map(*(F.lit(x) for b, w in DECORRELATION.items() for x in (b, w[k]))), band)
    for ring, extra in RING_DELAY.items():
        fed = band.isin(*RING_BANDS[ring]) & ((F.col("layout_id") == VENUE) if ring == "ground" else F.lit(True))
        gain = F.when(fed, F.greatest(v("sideS" if ring == "ground" else f"{ring}S"), F.lit(0.0))).otherwise(0.0)
        for (ear, (_, late, _)), more in zip(EARS.items(), extra, strict=True):
            ms = F.least(F.lit(LONGEST_MS), of_band(0) * (0.4 + 0.6 * depth)) + F.least(F.lit(LONGEST_MS), of_band(2) * late * depth) + more
            path = F.concat(F.lit(f"{ear}-dark:" if ring == "ground" else f"{ear}:"), band)
            out.append(to(path, f"{ring}{ear}", gain, F.coalesce(ms, F.lit(0.0))))
    each = rows.select("scene", F.explode(F.filter(F.array(*out), lambda x: x["gain"] != 0)).alias("to"))
    return each.select("scene", "to.path", "to.bus", "to.gain", "to.delay_ms")


def feed_gains(rows: DataFrame, scenes: DataFrame, tapped: DataFrame) -> DataFrame:
    """scene, speaker_id, path, gain, delay_ms: what of each path reaches a speaker of the scene's layout."""
    levels = bus_levels(scenes).join(scenes.select("scene", "layout_id"), "scene")
    heard = levels.join(F.broadcast(tapped), ["layout_id", "bus"])  # a row for each channel of each layout
    return routes(rows).join(heard, ["scene", "bus"]).select("scene", "speaker_id", "path", (F.col("gain") * F.col("level") * F.col("tap")).alias("gain"), "delay_ms")


def filters(rate: int, lfe_hz: float = 120.0) -> dict[str, Cascade]:
    """The filters of every path."""
    bands, above = {}, []
    for band, edge in zip(BANDS, (*EDGES, None), strict=True):
        bands[band] = [*above, *(d.lr4("lowpass", edge, rate) if edge else [])]
        above += d.lr4("highpass", edge, rate) if edge else []
    out = {f"{s}:{b}": Cascade(c) for s in ("mid", "side") for b, c in bands.items()} | {"lfe": Cascade(d.lr4("lowpass", lfe_hz, rate))}
    dark = [d.biquad("lowpass", 3000, 10 ** (0.7 / 20), 0, rate)]
    for band, (_, hz, _) in DECORRELATION.items():
        for ear, (times, _, q) in EARS.items():
            own = [*bands[band], d.biquad("allpass", hz, 0.55, 0, rate), d.biquad("allpass", hz * times, q, 0, rate)]
            out |= {f"{ear}:{band}": Cascade(own), f"{ear}-dark:{band}": Cascade(own + dark)}
    return out


def sources(chunks: DataFrame) -> DataFrame:
    """clip_id, chunk_idx, mid, side of stereo chunks."""
    one = lambda c: F.first(F.when(F.col("channel") == c, F.transform("samples", lambda v: v.cast("double"))), ignorenulls=True)
    both = chunks.groupBy("clip_id", "chunk_idx").agg(one(0).alias("l"), one(1).alias("r"))
    return both.select("clip_id", "chunk_idx", F.zip_with("l", "r", lambda a, b: (a + b) / 2).alias("mid"), F.zip_with("l", "r", lambda a, b: (a - b) / 2).alias("side"))


def mixed(paths: DataFrame, gains: DataFrame, size: int, rate: int) -> DataFrame:
    """clip_id, speaker_id, chunk_idx, samples: delayed and weighted sums of paths (clip_id, path, chunk_idx, samples), chunks of ``size`` frames.

    gains: clip_id, speaker_id, path, gain, delay_ms. A delayed chunk lies in two
    neighbours; what is delayed beyond a clip's last chunk, or frame, goes.
    """
    n = F.size("samples")
    late = F.floor(F.col("delay_ms") / 1000 * rate + 0.5).cast("int")
    zeros = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
    j = paths.join(gains, ["clip_id", "path"]).withColumn("late", late).withColumns({"skip": F.floor(F.col("late") / size).cast("int"), "by": (F.col("late") % size).cast("int")})
    scaled = F.transform("samples", lambda v: v * F.col("gain"))
    j = j.withColumn("samples", scaled)
    first = F.struct((F.col("chunk_idx") + F.col("skip")).alias("chunk_idx"), F.concat(zeros(F.col("by")), F.slice("samples", 1, F.least(n, size - F.col("by")))).alias("part"))
    rest = F.struct((F.col("chunk_idx") + F.col("skip") + 1).alias("chunk_idx"), F.slice("samples", size - F.col("by") + 1, F.greatest(F.lit(0), n - (size - F.col("by")))).alias("part"))
    parts = j.select("clip_id", "speaker_id", F.explode(F.array(first, rest)).alias("p")).select("clip_id", "speaker_id", "p.*")
    lengths = paths.groupBy("clip_id", "chunk_idx").agg(F.max(n).alias("frames"))
    there = parts.join(lengths, ["clip_id", "chunk_idx"]).where(F.size("part") > 0)
    padded = F.slice(F.concat("part", zeros(F.greatest(F.lit(0), F.col("frames") - F.size("part")))), F.lit(1), F.col("frames"))
    # as many parts as a speaker has routes, twice
    every = there.select("clip_id", "speaker_id", "chunk_idx", padded.alias("part")).groupBy("clip_id", "speaker_id", "chunk_idx").agg(F.collect_list("part").alias("parts"))
    rest_of = F.slice("parts", 2, F.size("parts"))
    return every.select("clip_id", "speaker_id", "chunk_idx", F.aggregate(rest_of, F.col("parts")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("samples"))


def feeds(chunks: DataFrame, gains: DataFrame, size: int, rate: int, lfe_hz: float = 120.0) -> DataFrame:
    """clip_id, speaker_id, chunk_idx, samples: the feeds of stereo clips (chunks of ``size`` frames) by their gains (clip_id, ...)."""
    own = filters(rate, lfe_hz)
    from_mid = [p for p in own if p == "lfe" or p.startswith("mid")]
    wanted = gains.select("clip_id", "path").distinct()
    signal = F.when(F.col("path").isin(*from_mid), F.col("mid")).otherwise(F.col("side")).alias("samples")
    paths = sources(chunks).join(wanted, "clip_id").select("clip_id", "path", "chunk_idx", signal)
    return mixed(over_chunks(paths, own, ("clip_id", "path")), gains, size, rate)
