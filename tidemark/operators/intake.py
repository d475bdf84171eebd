"""Rules at the door: which files are looked at, what decoded clips may be, how presets are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import short_duration
from tidemark.operators import dims

#: Extensions that look like audio, usual rates, limits.
EXTENSIONS = "wav wave aif aiff flac mp3 m4a aac ogg oga opus webm".split()
RATES = (8000, 11025, 16000, 22050, 32000, 44100, 48000, 88200, 96000, 176400, 192000)
MOST_BYTES, MOST_CHANNELS, MOST_SECONDS, WARN_SECONDS, PRESET_BYTES = 512 << 20, 24, 3600, 900, 256 << 10
#: Settings that a mastering preset may not use.
DEGRADING = ("tape", "hiss", "vinyl", "phaseRot", "haas")


def looks_like_audio(path: Column, mime: Column | None = None) -> Column:
    by_name = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1)).isin(EXTENSIONS)
    return by_name if mime is None else by_name | F.coalesce(mime.startswith("audio/"), F.lit(False))


def preflight(size: Column, most: int = MOST_BYTES) -> Column:
    """Why a file isn't read: empty or too_large; null if it is."""
    return F.when(size == 0, "empty").when(size > most, "too_large")


def _some(*rules: Column) -> Column:
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def validated(clips: DataFrame) -> DataFrame:
    """errors, warnings and notes of decoded clips: channels, frames, rate, first_bad_frame (null: all finite)."""
    c = F.col
    seconds = c("frames") / F.nullif(c("rate"), F.lit(0))
    shapeless = c("frames").isNull() | (c("frames") < 0) | c("rate").isNull() | (c("rate") <= 0)
    errors = F.when(shapeless, F.array(F.lit("unusable shape"))).when(c("frames") == 0, F.array(F.lit("no samples"))).otherwise(
        _some(
            F.when(c("channels") > MOST_CHANNELS, F.lit("too many channels")),
            F.when((c("channels") <= MOST_CHANNELS) & c("first_bad_frame").isNotNull(), F.concat(F.lit("non-finite sample at frame "), c("first_bad_frame").cast("string"))),
            F.when(seconds > MOST_SECONDS, F.concat(F.lit("too long: "), short_duration(seconds))),
        )
    )
    warnings = _some(F.when((seconds > WARN_SECONDS) & (seconds <= MOST_SECONDS), F.lit("long clip")))
    notes = _some(F.when(c("channels") == 1, "mono").when(c("channels") > 2, "folded to two channels"), F.when(~c("rate").isin(*RATES), F.lit("unusual rate")))
    sound = ~shapeless & (c("frames") > 0)
    none = F.array().cast("array<string>")
    return clips.withColumns({"errors": errors, "warnings": F.when(sound, warnings).otherwise(none), "notes": F.when(sound, notes).otherwise(none)})


def presets(texts: DataFrame) -> DataFrame:
    """Preset files (preset_id, text) parsed: name, version, settings as keyed text, and the error if there is one.

    Files from schema 3 on have ``parameters``; older ones a block ``P``. Over
    256 KiB, other JSON than an object, and neither block are errors. Settings
    of a mastering family that degrade are left out.
    """
    c = F.col
    own = texts.select("preset_id", "text", *(F.get_json_object("text", f"$.{k}").alias(k) for k in ("schemaVersion", "format", "name", "preset", "family", "parameters", "P")))
    block = F.coalesce("parameters", "P")
    error = F.when(F.length("text") > PRESET_BYTES, "too large").when(~F.coalesce(c("text").rlike(r"^\s*\{"), F.lit(False)) | F.try_parse_json("text").isNull(), "not a JSON object").when(block.isNull(), "no parameters")
    fields = F.filter(F.map_entries(F.from_json(block, "map<string,string>")), lambda e: ~((F.coalesce(c("family"), F.lit("")) == "mastering") & e["key"].isin(*DEGRADING)))
    return own.select(
        "preset_id", F.substring(F.coalesce("name", "preset", F.lit("Imported")), 1, 120).alias("name"), F.coalesce(c("schemaVersion").try_cast("int"), F.lit(0)).alias("version"), error.alias("error"),
        F.when(error.isNull(), F.map_from_entries(fields)).alias("settings"),
    )


#: Fixed value: the rate at which clips are decoded whose own rate is unknown or refused.
FALLBACK_RATE = 48_000


def decode_rate(sniffed: Column, live: Column, supported: Column) -> Column:
    """The first of a file's own rate, the fallback and the device's rate that is supported; else the device's."""
    tried = F.filter(F.array(sniffed, F.lit(FALLBACK_RATE), live), lambda x: x.isNotNull() & (x > 0) & F.array_contains(supported, x))
    return F.coalesce(F.try_element_at(tried, F.lit(1)), live)


def dual_mono(chunks: DataFrame) -> DataFrame:
    """Chunks (clip_id, channel, ...) in which clips of one channel have it twice, as 0 and 1; others stay."""
    mono = chunks.groupBy("clip_id").agg(F.max("channel").alias("last")).where("last = 0").select("clip_id")
    return chunks.unionByName(chunks.join(mono, "clip_id", "left_semi").withColumn("channel", F.lit(1).cast(chunks.schema["channel"].dataType)))


def family(settings: Column) -> Column:
    """creative if a degrading setting is on, else mastering."""
    on = [F.coalesce(F.element_at(settings, k).try_cast("double"), F.lit(0.0)) != 0 for k in DEGRADING]
    return F.when(on[0] | on[1] | on[2] | on[3] | on[4], "creative").otherwise("mastering")


def parameter_class(settings: Column) -> Column:
    """reference where every numeric setting is at its default, else creative."""
    numbers = {k: float(v) for k, v in dims.defaults().items() if v.lstrip("-").replace(".", "", 1).isdigit() and k not in ("targetLUFS", "ceiling", "textureSeed", "haasSide")}
    moved = [F.abs(F.coalesce(F.element_at(settings, k).try_cast("double"), F.lit(v)) - v) > 1e-9 for k, v in numbers.items()]
    return F.when(F.exists(F.array(*moved), lambda x: x), "creative").otherwise("reference")
