"""Decision rules as column expressions: source classes, parameter adaptation, budgets, spatial laws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp, js_round, smoothstep
from tidemark.functions.text import format_bytes

#: Thresholds of source classes (LUFS, LU, dB, correlation).
LOUD, QUIET, NEAR_TARGET = -11.0, -20.0, 2.0
DENSE_CREST, CRUSHED_CREST, CRUSHED_LRA, DYNAMIC_CREST, DYNAMIC_LRA = 10.0, 7.0, 3.0, 14.0, 9.0
HOT_PEAK, VERY_HOT_PEAK = -1.5, -0.3
BRIGHT_TREBLE, HOT_PRESENCE, HEAVY_BASS = 3.0, 4.0, 4.0
WIDE, PHASEY = 0.35, 0.15

BANDS = ("mbLow", "mbMid", "mbHigh")
STATS = ("integrated", "lra", "crest_db", "true_peak_db", "bass_db", "presence_db", "treble_db", "correlation", "channels")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def stats_flags() -> dict[str, Column]:
    """Named conditions on measured statistics; a null statistic makes none of its own true."""
    c = F.col
    dense = _true(c("crest_db") < CRUSHED_CREST) | _true((c("lra") < CRUSHED_LRA) & (c("crest_db") < DENSE_CREST))
    return {
        "loud": _true(c("integrated") >= LOUD), "quiet": _true(c("integrated") <= QUIET), "dense": dense,
        "dynamic": ~dense & (_true(c("crest_db") > DYNAMIC_CREST) | _true(c("lra") > DYNAMIC_LRA)),
        "hot": _true(c("true_peak_db") > HOT_PEAK), "very_hot": _true(c("true_peak_db") > VERY_HOT_PEAK),
        "phasey": _true(c("correlation") < PHASEY), "wide": _true(c("correlation") < WIDE),
        "bright": _true(c("treble_db") > BRIGHT_TREBLE), "forward": _true(c("presence_db") > HOT_PRESENCE), "bassy": _true(c("bass_db") > HEAVY_BASS),
    }


def source_class() -> Column:
    """Tags of a source in a fixed order, joined by plus."""
    f = stats_flags()
    measured = reduce(lambda a, b: a | b, (F.col(k).isNotNull() for k in STATS[:3] + STATS[4:8]))
    tags = F.concat_ws(
        "+",
        F.when(f["loud"], "loud").when(f["quiet"], "quiet"), F.when(f["dense"], "dense").when(f["dynamic"], "dynamic"), F.when(f["hot"], "hot"),
        F.when(f["phasey"], "phasey").when(f["wide"], "wide"), F.when(f["bright"], "bright"), F.when(f["bassy"], "bass-heavy"), F.when(f["forward"] & ~f["bright"], "forward"),
    )
    return F.when(~measured, "unmeasured").when(tags == "", "balanced").otherwise(tags)


def percent(value: Column, factor, low: float = 0.0) -> Column:
    return js_round(clamp(value, low, 100.0) * (factor if isinstance(factor, Column) else F.lit(factor)))


class Edits:
    """Edits of parameter columns in sections: those of one section see what earlier sections made.

    A section is one projection, so plans stay flat. Edits of one key in a
    section exclude each other.
    """

    def __init__(self, rows: DataFrame):
        self.rows = rows.withColumn("edits", F.array().cast("array<string>"))
        self.section: list[tuple[str, Column, Column, str]] = []

    def put(self, key: str, when: Column, value: Column, why: str) -> None:
        self.section.append((key, _true(when), value, why))

    def done(self) -> None:
        values: dict[str, Column] = {}
        for key, when, value, _ in self.section:
            values[key] = values[key].when(when, value) if key in values else F.when(when, value)
        notes = F.filter(F.array(*(F.when(when, F.lit(f"{key}: {why}")) for key, when, _, why in self.section)), lambda x: x.isNotNull())
        self.rows = self.rows.withColumns({k: v.otherwise(F.col(k)) for k, v in values.items()} | {"edits": F.concat("edits", notes)})
        self.section = []


# What eases a parameter: section, condition, parameters, guard, action, reason. Sections follow one another;
# actions are set (a value), percent (a share of 0 to 100, or -100 to 100 for signed ones), toward1 (a share of the way
# from 1) and times.
EASINGS = """
1 first drive >0 set:0 loud or dense
1 first sat >0 percent:0.25 loud or dense
1 dense mbLow,mbMid,mbHigh >0 percent:0.3 loud or dense
1 loud_only mbLow,mbMid,mbHigh >0 percent:0.45 loud or dense
1 first transAttack,transSustain !=0 signed:0.4 loud or dense
1 loud air,clarity >0.5 set:0.5 loud
1 loud tilt >0 set:0 loud
1 loud width >1 toward1:0.25 loud
1 second mbLow,mbMid,mbHigh,sat >0 percent:0.6 moderately dense
1 second transAttack !=0 signed:0.6 moderately dense
1 second drive >0.5 set:0.5 moderately dense
1 third mbLow,mbMid,mbHigh >0 percent:0.7 dynamic
1 near mbLow,mbMid,mbHigh >0 percent:0.7 near target
1 near sat >0 percent:0.6 near target
1 near drive >0.5 set:0.5 near target
2 third_compressed mbMix >70 set:70 dynamic
2 hot drive >0 set:0 hot peaks
2 very_hot sat >0 percent:0.5 very hot peaks
2 bright clarity >0 set:0 bright
2 bright air >0.5 set:0.5 bright
2 bright tilt >0 set:0 bright
2 bright harsh >0 set:0 bright
2 forward_only clarity >0.5 set:0.5 hot presence
2 bassy sub >0.8 set:0.8 bass-heavy
2 bassy warm >1 set:1 bass-heavy
2 bassy_dense mbLow >0 held:0.6 held for bass
2 bassy_stereo bassMono <90 set:90 bass-heavy
3 phasey width !=1 toward1:0 wide
3 wide_only width !=1 toward1:0.35 wide
3 phasey haas,spread,phaseRot >0 times:0 wide
3 wide_only haas,spread,phaseRot >0 times:0.35 wide
3 phasey widthLow,widthMid,widthHigh !=1 toward1:0 wide
3 wide_only widthLow,widthMid,widthHigh !=1 toward1:0.4 wide
"""


def easing_conditions() -> dict[str, Column]:
    """The conditions that easings name, on statistics and on parameters as they are when their section begins."""
    f, c = stats_flags(), F.col
    first = f["loud"] | f["dense"]
    second = ~first & _true(c("crest_db") < DENSE_CREST)
    third = ~first & ~second & f["dynamic"]
    near = ~first & ~second & ~third & c("normalize") & _true(c("integrated") >= c("targetLUFS") - NEAR_TARGET)
    wide = f["wide"] | f["phasey"]
    return f | {
        "first": first, "loud_only": f["loud"] & ~f["dense"], "second": second, "third": third, "near": near, "third_compressed": third & (F.greatest(*BANDS) > 0),
        "forward_only": ~f["bright"] & f["forward"], "bassy_dense": f["bassy"] & f["dense"], "bassy_stereo": f["bassy"] & ~_true(c("channels") == 1), "wide_only": wide & ~f["phasey"],
    }


def eased(key: str, action: str, share: float) -> Column:
    """What an action makes of a parameter. ``held`` never falls under its share of the value that came in."""
    v = F.col(key)
    if action == "held":
        return F.greatest(v, percent(F.col(f"__{key}"), share))
    if action in ("percent", "signed"):
        return percent(v, share, -100.0 if action == "signed" else 0.0)
    return F.lit(share) if action == "set" else v * share if action == "times" else 1 + (v - 1) * share


def adapt(rows: DataFrame) -> DataFrame:
    """Parameters eased by measured statistics (columns ``STATS``), the edits made, and the source class.

    ``EASINGS`` are run section by section. They only go down, but for the floor
    of 90 Hz under which the bass of a bass-heavy source is made mono. Rows
    without any statistic stay as they are.
    """
    e = Edits(rows.withColumn("__mbLow", F.col("mbLow")))
    held = ["__mbLow"]
    lines = [line.split(" ", 5) for line in EASINGS.strip().splitlines()]
    for section in sorted({line[0] for line in lines}):
        own = [line[1:] for line in lines if line[0] == section]
        conditions = easing_conditions()
        flags = {f"__{section}_{name}": conditions[name] for name in dict.fromkeys(line[0] for line in own)}  # worked out once, as columns
        e.rows = e.rows.withColumns(flags)
        held += flags
        for name, keys, guard, action, why in own:
            kind, share = action.split(":")
            for key in keys.split(","):
                v, bound = F.col(key), float(guard.lstrip("<>!="))
                stands = v > bound if guard[0] == ">" else v < bound if guard[0] == "<" else v != bound
                value = eased(key, kind, float(share))
                moves = F.col(f"__{section}_{name}") & stands
                e.put(key, moves & (value != v) if kind == "held" else moves, value, why)
        e.done()
    return e.rows.withColumn("source_class", source_class()).drop(*held)


def reach(frequency: Column) -> Column:
    """How far a boost at a frequency reaches into the treble."""
    return F.when(frequency >= 11000, 1.0).when(frequency >= 7000, 0.85).when(frequency >= 4000, 0.45).when(frequency >= 2500, 0.2).otherwise(0.0)


def brightness_factor(ratio_db: Column) -> Column:
    return F.coalesce(clamp((ratio_db + 20) / 8, 0.0, 1.0), F.lit(0.0))


#: Centres of the eight match bands in Hz.
MATCH_HZ = (60, 150, 400, 1000, 2500, 5000, 8000, 12000)


def hf_budget(air: Column, spread: Column, binaural: Column, clarity: Column, tilt: Column, match: Column, brightness: Column) -> Column:
    """Plan for stacked treble boosts: struct of engaged, estimate_db, allowed_db, surplus_db, cut_db, sat_scale, air_total, clarity, tilt."""
    up = lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))
    tenth = lambda x: js_round(x, 1)
    spread_air = F.when(binaural, up(spread) * 1.5).otherwise(0.0)
    weights = F.array(*(reach(F.lit(float(f))) for f in MATCH_HZ))
    matched = F.aggregate(F.zip_with(match, weights, lambda g, w: up(g) * w), F.lit(0.0), lambda a, x: a + x)
    total = up(air) + spread_air + up(clarity) * 0.45 + up(tilt) * 0.85 + matched
    allowed = F.lit(4.0) - F.lit(1.25) * clamp(brightness, 0.0, 1.0)
    surplus = total - allowed
    on = (surplus > 0) & (total > 0)
    cut = F.least(F.lit(7.0), tenth(surplus * 0.65 * (F.lit(0.5) + F.least(F.lit(1.0), surplus / 1.5) * 0.5)))
    left = lambda v, w: F.greatest(F.lit(0.0), v - cut * v * w / F.when(total > 0, total).otherwise(1.0))
    scale = F.greatest(F.lit(0.65), F.lit(1.0) - clamp(surplus / 8, 0.0, 1.0) * 0.4)
    return F.struct(
        on.alias("engaged"), tenth(total).alias("estimate_db"), tenth(allowed).alias("allowed_db"), tenth(surplus).alias("surplus_db"), F.when(on, cut).otherwise(0.0).alias("cut_db"), F.when(on, tenth(scale)).otherwise(1.0).alias("sat_scale"),
        F.when(on, tenth(left(up(air), 1.0) + left(spread_air, 1.0))).alias("air_total"), F.when(on & (up(clarity) > 0), tenth(left(up(clarity), 0.45))).alias("clarity"), F.when(on & (up(tilt) > 0), tenth(left(up(tilt), 0.85))).alias("tilt"),
    )


def width_side_gain(width: Column) -> Column:
    w = clamp(width, 0.0, 3.0)
    return F.when(w <= 1, w).otherwise(1 + F.lit(1.2) * (1 - F.exp(F.lit(-0.8) * (w - 1))))


def cap_side_gain(gain: Column, band: str) -> Column:
    return F.when(gain <= 1, gain).otherwise(F.least(gain, F.lit(1.5 if band == "low" else 2.2)))


def mid_balance_gain(b: Column) -> Column:
    return F.when(b <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(10.0), F.lit(-3.0) * F.pow(clamp(b, 0.0, 1.0), F.lit(1.35)) / 20))


def haas_width_scale(ms: Column) -> Column:
    return F.when(ms > 0, 1 / (1 + clamp(ms, 0.0, 40.0) / 300)).otherwise(1.0)


def crossfeed_tap_gain(x: Column) -> Column:
    v = clamp(x, 0.0, 1.0)
    low = 0.45 * 0.55
    return F.when(v <= 0.55, v * 0.45).otherwise(F.lit(low) + F.lit(0.33 - low) * smoothstep((v - 0.55) / 0.45))


def side_width_gain(width: Column, spread: Column, binaural: Column, ms: Column, haas: Column) -> Column:
    raw = width * F.when(binaural, 1 + spread * 0.6).otherwise(1.0) * F.when(ms < 0, 1 + F.abs(ms) * 0.6).otherwise(1.0)
    return clamp(width_side_gain(raw) * haas_width_scale(haas), 0.0, 2.2)


def phase_risk() -> Column:
    """Level and number of the warnings that parameters of phase and width raise."""
    c = F.col
    warn = {
        "width": F.when(c("width") > 2.2, 2).when(c("width") > 1.8, 1), "wide bass": F.when((c("width") > 1.3) & (c("bassMono") <= 0), 1), "haas": F.when(c("haas") > 20, 2).when(c("haas") > 8, 1),
        "all-pass": F.when(c("phaseRot") > 0.5, 1), "hollow centre": F.when(c("ms") > 0.5, 1), "low width": F.when(c("widthLow") > 1.4, 2),
    }
    names = F.filter(F.array(*(F.when(w.isNotNull(), F.lit(k)) for k, w in warn.items())), lambda x: x.isNotNull())
    worst = F.greatest(*(F.coalesce(w, F.lit(0)) for w in warn.values()))
    return F.struct(F.element_at(F.array(F.lit("ok"), F.lit("caution"), F.lit("danger")), worst + 1).alias("level"), names.alias("messages"))


def memory_class(bytes_: Column, budget: Column) -> Column:
    return F.when(bytes_ > budget * 1.25, "LIKELY UNSAFE").when(bytes_ > budget * 0.75, "VERY HEAVY").when(bytes_ > budget * 0.35, "HEAVY").otherwise("SAFE")


def audio_memory(channels: Column, frames: Column, sample_bytes: int = 4) -> Column:
    return channels.cast("bigint") * frames.cast("bigint") * sample_bytes


#: Shares of a clip's bytes that each part of a job holds, unless told otherwise.
HELD = {"source": 1.0, "dsp": 1.0, "analysis": 0.0, "encoding": 0.0, "output": 0.0}


def memory_plan(channels: Column, frames: Column, budget: Column, immersive_channels: Column | int = 0, sample_bytes: int = 4, **held: float) -> Column:
    """Bytes that each part of a job holds, their sum, its class and a label."""
    one = F.greatest(channels, F.lit(0)).cast("bigint") * F.greatest(frames, F.lit(0)).cast("bigint") * sample_bytes
    around = immersive_channels if isinstance(immersive_channels, Column) else F.lit(immersive_channels)
    parts = {f"{k}_bytes": one * float(v) for k, v in (HELD | held).items()} | {"immersive_bytes": (around.cast("bigint") * F.greatest(frames, F.lit(0)).cast("bigint") * sample_bytes).cast("double")}
    peak = reduce(lambda a, b: a + b, parts.values())
    label = F.concat(F.lit("Expected peak: approximately "), format_bytes(peak))
    return F.struct(*(v.alias(k) for k, v in parts.items()), peak.alias("peak_bytes"), memory_class(peak, budget).alias("memory_class"), label.alias("label"))


def tonal_regions(bands: Column) -> Column:
    """Means of the two lowest, the middle and the two highest of eight band levels; null for fewer bands."""
    mean = lambda i, k: (F.element_at(bands, i) + F.element_at(bands, k)) / 2
    return F.when(F.size(bands) >= 8, F.struct(mean(1, 2).alias("bass_db"), mean(4, 5).alias("presence_db"), mean(7, 8).alias("treble_db")))


def requires_stereo() -> Column:
    c = F.col
    return (c("width") != 1) | (c("ms") != 0) | (c("bassMono") > 0) | (c("haas") > 0) | (c("crossfeed") > 0) | (c("phaseRot") > 0) | (c("widthLow") != 1) | (c("widthMid") != 1) | (c("widthHigh") != 1) | c("binaural") | (c("spread") > 0) | (c("depth") > 0) | (c("tape") > 0)


def band_settings(amount: Column) -> Column:
    """Compressor threshold, ratio and knee of a band's amount."""
    a = clamp(amount, 0.0, 100.0)
    return F.struct((a * -0.24).alias("threshold"), (a * 0.02 + 1).alias("ratio"), F.lit(12.0).alias("knee"))


def makeup_db(threshold: Column, knee: Column, ratio: Column) -> Column:
    """Static make-up gain of a soft-knee compressor: 0.6 of what full scale loses."""
    gain = lambda d: F.pow(F.lit(10.0), d / 20)
    db = lambda x: F.lit(20.0) * F.log10(F.greatest(x, F.lit(1e-12)))
    low, end = gain(threshold), gain(threshold + knee)
    curve = lambda x, k: F.when(x < low, x).otherwise(low + (1 - F.exp(-k * (x - low))) / k)

    def halve(acc: Column, _: Column) -> Column:
        k = acc["k"]
        slope = (db(curve(end * 1.001, k)) - db(curve(end, k))) / (db(end * 1.001) - db(end))
        high = F.when(slope < 1 / ratio, k).otherwise(acc["high"])
        lo = F.when(slope < 1 / ratio, acc["lo"]).otherwise(k)
        return F.struct(lo.alias("lo"), high.alias("high"), F.sqrt(lo * high).alias("k"))

    start = F.struct(F.lit(0.1).alias("lo"), F.lit(10000.0).alias("high"), F.lit(5.0).alias("k"))
    k = F.aggregate(F.sequence(F.lit(1), F.lit(15)), start, halve, lambda a: a["k"])
    whole = F.when(end > 1, db(curve(F.lit(1.0), k))).otherwise(db(curve(end, k)) - (threshold + knee) / ratio)
    return F.when(ratio <= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), whole * -0.6))


def coerce(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """Values of keyed text against a parameter table: unknown keys dropped, ranges clamped, bad values defaulted.

    rows: set_id, key, value (string). Missing keys come with their default.
    """
    keys = rows.select("set_id").distinct().crossJoin(F.broadcast(spec))  # the spec is a fixed table of under 50 rows
    own = rows.groupBy("set_id", "key").agg(F.max("value").alias("value"))
    j = keys.join(own, ["set_id", "key"], "left")
    n = F.try_to_number(F.col("value"), F.lit("S999999999.999999")).cast("double")
    number = F.when(n.isNull(), F.col("fallback")).otherwise(clamp(n, F.col("low"), F.col("high")).cast("string"))
    text = F.when(F.array_contains("choices", F.col("value")), F.col("value")).otherwise(F.col("fallback"))
    return j.select("set_id", "key", F.when(F.col("kind") == "number", number).otherwise(text).alias("value"), (F.col("value").isNull() | (F.col("kind") != "number") & ~F.coalesce(F.array_contains("choices", F.col("value")), F.lit(False))).alias("defaulted"))
