"""Registered queries on records: intake, presets, delivery, scenes, estimates, live meters. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.functions import text as tx
from tidemark.operators import compare, delivery, dims, intake, levels, macros, rules, scene
from tidemark.plans.base import Registry, eighths, r, rs, table, values
from tidemark.streaming import meters

query = Registry()
c = F.col
EXT = ["wav", "AIFF", "txt", "flac", "mp3", "doc", "ogg", "webm", ""]


def _pick(choices: list, k):
    return F.element_at(F.array(*map(F.lit, choices)), (k % len(choices) + 1).cast("int"))


def _sql_pick(choices: list, k: str) -> str:
    return f"(CASE {' '.join(f'WHEN {k} % {len(choices)} = {i} THEN ' + (repr(x) if isinstance(x, str) else str(x)) for i, x in enumerate(choices))} END)"


# ---- intake -------------------------------------------------------------------


@query(f"""
WITH f AS (SELECT p_partkey AS k, 'take ' || p_partkey || CASE WHEN p_partkey % 9 = 8 THEN '' ELSE '.' || {_sql_pick(EXT, "p_partkey")} END AS name,
  CASE WHEN p_partkey % 4 = 0 THEN 'audio/x' WHEN p_partkey % 4 = 1 THEN 'text/plain' END AS mime FROM part)
SELECT k AS p_partkey, coalesce(lower(regexp_extract(name, '[.]([^.]+)$', 1)) IN ('wav', 'wave', 'aif', 'aiff', 'flac', 'mp3', 'm4a', 'aac', 'ogg', 'oga', 'opus', 'webm'), false) AS by_name,
  (coalesce(lower(regexp_extract(name, '[.]([^.]+)$', 1)) IN ('wav', 'wave', 'aif', 'aiff', 'flac', 'mp3', 'm4a', 'aac', 'ogg', 'oga', 'opus', 'webm'), false) OR coalesce(mime LIKE 'audio/%', false)) AS by_either
FROM f""")
def looks_like_audio(spark, sf):
    k = c("p_partkey")
    name = F.concat(F.lit("take "), k.cast("string"), F.when(k % 9 == 8, "").otherwise(F.concat(F.lit("."), _pick(EXT, k))))
    mime = F.when(k % 4 == 0, "audio/x").when(k % 4 == 1, "text/plain")
    return table(spark, sf, "part").select("p_partkey", intake.looks_like_audio(name).alias("by_name"), intake.looks_like_audio(name, mime).alias("by_either"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'empty' WHEN CAST(floor(o_totalprice * 2000) AS BIGINT) > 536870912 THEN 'too_large' END AS refused FROM orders""")
def preflight_files(spark, sf):
    size = F.when(c("o_orderkey") % 7 == 0, 0).otherwise(F.floor(c("o_totalprice") * 2000))
    return table(spark, sf, "orders").select("o_orderkey", intake.preflight(size).alias("refused"))


@query("""
WITH f AS (SELECT o_orderkey AS k, o_orderkey % 27 AS channels, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderkey % 50 * 4000000 END AS frames,
    (CASE o_orderkey % 5 WHEN 0 THEN 44100 WHEN 1 THEN 48000 WHEN 2 THEN 12345 WHEN 3 THEN 96000 ELSE 0 END) AS rate, CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey END AS bad FROM orders),
t AS (SELECT *, frames / nullif(rate, 0) AS sec, frames IS NULL OR rate <= 0 AS odd FROM f)
SELECT k AS o_orderkey,
  CASE WHEN odd THEN 'unusable shape' WHEN frames = 0 THEN 'no samples' ELSE concat_ws(',',
    CASE WHEN channels > 24 THEN 'too many channels' END, CASE WHEN channels <= 24 AND bad IS NOT NULL THEN 'non-finite sample at frame ' || bad END,
    CASE WHEN sec > 3600 THEN 'too long: ' || CAST(floor(floor(sec + 0.5) / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(sec + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0') END) END AS errors,
  CASE WHEN NOT odd AND frames > 0 AND sec > 900 AND sec <= 3600 THEN 'long clip' ELSE '' END AS warnings,
  CASE WHEN NOT odd AND frames > 0 THEN concat_ws(',', CASE WHEN channels = 1 THEN 'mono' WHEN channels > 2 THEN 'folded to two channels' END, CASE WHEN rate NOT IN (44100, 48000, 96000) THEN 'unusual rate' END) ELSE '' END AS notes
FROM t""")
def validated_clips(spark, sf):
    k = c("o_orderkey")
    clips = table(spark, sf, "orders").select("o_orderkey", (k % 27).alias("channels"), F.when(k % 31 != 0, k % 50 * 4_000_000).alias("frames"), _pick([44100, 48000, 12345, 96000, 0], k).alias("rate"), F.when(k % 13 == 0, k).alias("first_bad_frame"))
    return intake.validated(clips).select("o_orderkey", *(F.array_join(x, ",").alias(x) for x in ("errors", "warnings", "notes")))


@query("""
SELECT o_orderkey, CASE WHEN sniffed > 0 AND sniffed IN (44100, 48000, 96000) THEN sniffed WHEN o_orderkey % 2 = 0 THEN 48000 WHEN live IN (44100, 96000) THEN live ELSE live END AS rate
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 44100 WHEN 1 THEN 12345 WHEN 2 THEN NULL ELSE 96000 END AS sniffed, CASE WHEN o_orderkey % 3 = 0 THEN 22050 ELSE 44100 END AS live FROM orders)
WHERE sniffed IS DISTINCT FROM 48000""")
def decode_rates(spark, sf):
    """The rate at which a file is decoded, where every second device refuses the fallback."""
    k = c("o_orderkey")
    sniffed = F.when(k % 4 == 0, 44100).when(k % 4 == 1, 12345).when(k % 4 == 3, 96000)
    supported = F.when(k % 2 == 0, F.array(*map(F.lit, (44100, 48000, 96000)))).otherwise(F.array(F.lit(44100), F.lit(96000)))
    return table(spark, sf, "orders").select("o_orderkey", intake.decode_rate(sniffed, F.when(k % 3 == 0, 22050).otherwise(44100), supported).alias("rate"))


@query("""
WITH e AS (SELECT vec_id, vec_id % 3 AS kind, len(embedding) AS n FROM embeddings)
SELECT vec_id AS clip_id, channel, n FROM (SELECT vec_id, unnest(CASE WHEN kind = 0 THEN [0, 1] WHEN kind = 1 THEN [0, 1] ELSE [0, 1, 2] END) AS channel, n FROM e)""")
def dual_mono_clips(spark, sf):
    e = table(spark, sf, "embeddings")
    given = e.select(c("vec_id").alias("clip_id"), F.explode(F.sequence(F.lit(0), (c("vec_id") % 3).cast("int"))).alias("channel"), F.size("embedding").cast("bigint").alias("n"))
    return intake.dual_mono(given)


# ---- presets ------------------------------------------------------------------

PRESET = """(CASE p_partkey % 6
  WHEN 0 THEN '{"schemaVersion":3,"name":"P' || p_partkey || '","family":"mastering","parameters":{"air":"' || p_size || '","tape":"4","hiss":"1"}}'
  WHEN 1 THEN '{"preset":"Old ' || p_partkey || '","P":{"air":1.5,"width":1.2,"tape":' || p_size || '}}'
  WHEN 2 THEN '[1, 2]' WHEN 3 THEN '{"name": "cut' WHEN 4 THEN '{"schemaVersion":3,"name":"none"}' ELSE '{"schemaVersion":4,"parameters":{"sub":"2"}}' END)"""


def _presets(spark, sf):
    k, size = c("p_partkey"), c("p_size").cast("string")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit('{"schemaVersion":3,"name":"P'), k.cast("string"), F.lit('","family":"mastering","parameters":{"air":"'), size, F.lit('","tape":"4","hiss":"1"}}')))
        .when(k % 6 == 1, F.concat(F.lit('{"preset":"Old '), k.cast("string"), F.lit('","P":{"air":1.5,"width":1.2,"tape":'), size, F.lit("}}")))
        .when(k % 6 == 2, "[1, 2]").when(k % 6 == 3, '{"name": "cut').when(k % 6 == 4, '{"schemaVersion":3,"name":"none"}').otherwise('{"schemaVersion":4,"parameters":{"sub":"2"}}')
    )
    return table(spark, sf, "part").select(k.alias("preset_id"), text.alias("text"))


@query(f"""
WITH t AS (SELECT p_partkey AS k, p_size, {PRESET} AS j FROM part),
g AS (SELECT *, CASE WHEN json_valid(j) THEN j END AS ok FROM t)
SELECT k AS preset_id, CASE k % 6 WHEN 3 THEN 'Imported' ELSE coalesce(json_extract_string(ok, '$.name'), json_extract_string(ok, '$.preset'), 'Imported') END AS name,
  coalesce(CAST(json_extract_string(ok, '$.schemaVersion') AS INT), 0) AS version,
  CASE WHEN ok IS NULL OR json_type(ok) <> 'OBJECT' THEN 'not a JSON object' WHEN json_extract(ok, '$.parameters') IS NULL AND json_extract(ok, '$.P') IS NULL THEN 'no parameters' END AS error,
  CASE k % 6 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 5 THEN 1 END AS n_settings, CASE k % 6 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '1.5' END AS air
FROM g""")
def preset_files(spark, sf):
    own = intake.presets(_presets(spark, sf))
    return own.select("preset_id", "name", "version", "error", F.when(c("settings").isNotNull(), F.size("settings")).alias("n_settings"), c("settings")["air"].alias("air"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR p_partkey % 3 = 0 THEN 'creative' ELSE 'mastering' END AS family,
  CASE WHEN p_size % 5 = 0 OR p_partkey % 3 = 0 OR p_partkey % 4 = 1 THEN 'creative' ELSE 'reference' END AS parameter_class FROM part""")
def preset_classes(spark, sf):
    k = c("p_partkey")
    one = lambda name, on: F.when(on, F.struct(F.lit(name).alias("key"), F.lit("7").alias("value")))
    given = F.map_from_entries(F.filter(F.array(one("tape", c("p_size") % 5 == 0), one("haas", k % 3 == 0), one("air", k % 4 == 1), F.struct(F.lit("width").alias("key"), F.lit("1").alias("value"))), lambda x: x.isNotNull()))
    return table(spark, sf, "part").select("p_partkey", intake.family(given).alias("family"), intake.parameter_class(given).alias("parameter_class"))


@query("""
SELECT p_partkey AS preset_id, 'preset' AS format, 3 AS version, substr(repeat(p_name || ' ', 12), 1, 120) AS name, CAST(p_size AS VARCHAR) AS air, CAST(p_size * 2 AS VARCHAR) AS sub FROM part""")
def preset_round_trip(spark, sf):
    """Presets written as JSON and read again."""
    p = table(spark, sf, "part").select(c("p_partkey").alias("preset_id"), F.repeat(F.concat("p_name", F.lit(" ")), F.lit(12)).alias("name"), F.lit("made").alias("description"), F.create_map(F.lit("air"), c("p_size").cast("string"), F.lit("sub"), (c("p_size") * 2).cast("string")).alias("settings"))
    text = delivery.serialised_presets(p)
    back = intake.presets(text).select("preset_id", "version", "name", c("settings")["air"].alias("air"), c("settings")["sub"].alias("sub"))
    return text.select("preset_id", F.get_json_object("text", "$.format").alias("format")).join(back, "preset_id")


_MACRO_SQL = values(macros.rows_of(), "macro, key, rest, scale, still, resting, base, slope, low, high, digits")


@query(f"""
WITH m AS (SELECT o_orderkey AS set_id, {_sql_pick(["body", "clarity", "punch", "air", "width", "depth", "character"], "o_orderkey")} AS macro, CAST(o_custkey % 101 AS DOUBLE) AS v FROM orders),
j AS (SELECT set_id, m.macro, key, (v - rest) / scale AS p, t.* EXCLUDE (macro, key) FROM m JOIN {_MACRO_SQL} ON t.macro = m.macro)
SELECT set_id, macro, key, {rs("CASE WHEN abs(p) < still THEN resting ELSE least(high, greatest(low, CASE WHEN digits IS NULL THEN base + p * slope ELSE floor((base + p * slope) * pow(10, digits) + 0.5) / pow(10, digits) END)) END", 6)} AS value FROM j
UNION ALL SELECT set_id, macro, 'bassMono', CASE WHEN v > 58 THEN 65.0 ELSE 0.0 END FROM m WHERE macro = 'width'
UNION ALL SELECT set_id, macro, 'hiss', CASE WHEN v < 6 THEN 0.0 ELSE floor(v / 100 * CASE WHEN v > 50 THEN 18 ELSE 6 END + 0.5) END FROM m WHERE macro = 'character'
UNION ALL SELECT set_id, macro, 'vinyl', CASE WHEN v > 65 THEN floor((v / 100 - 0.65) * 55 + 0.5) ELSE 0.0 END FROM m WHERE macro = 'character'""")
def macro_settings(spark, sf):
    own = macros.applied(_macros(spark, sf))
    return own.select("set_id", "macro", "key", r(c("value"), 6).alias("value"))


def _macros(spark, sf):
    k = c("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("set_id"), _pick(["body", "clarity", "punch", "air", "width", "depth", "character"], k).alias("macro"), (c("o_custkey") % 101).cast("double").alias("v"))


@query(f"""
WITH m AS (SELECT o_orderkey AS set_id, {_sql_pick(["body", "clarity", "punch", "air", "width", "depth", "character"], "o_orderkey")} AS macro, o_custkey % 101 AS v FROM orders)
SELECT set_id, macro, CASE macro
  WHEN 'punch' THEN CASE WHEN v < 20 THEN 'open' WHEN v < 45 THEN 'glue' WHEN v < 75 THEN 'firm' ELSE 'dense' END
  WHEN 'width' THEN CASE WHEN v < 30 THEN 'narrow' WHEN v < 55 THEN 'natural' WHEN v < 78 THEN 'wide' ELSE 'extra-wide' END
  WHEN 'depth' THEN CASE WHEN v < 8 THEN 'dry' WHEN v < 30 THEN 'room' WHEN v < 60 THEN 'hall' ELSE 'deep' END
  WHEN 'character' THEN CASE WHEN v < 8 THEN 'clean' WHEN v < 30 THEN 'warm' WHEN v < 60 THEN 'textured' ELSE 'worn' END
  ELSE CASE WHEN v = 50 THEN CASE macro WHEN 'clarity' THEN 'neutral' ELSE 'flat' END WHEN v > 50 THEN '+' || (v - 50) ELSE CAST(v - 50 AS VARCHAR) END END AS shown FROM m""")
def macro_names(spark, sf):
    return macros.described(_macros(spark, sf))


# ---- delivery -----------------------------------------------------------------


def _files(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(c("source").alias("package"), F.concat(F.lit("doc_"), c("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


@query("""
SELECT source AS package, md5(string_agg(sha256(coalesce(text, '')) || '  doc_' || doc_id || '.txt', chr(10) ORDER BY 'doc_' || doc_id || '.txt')) AS digest, count(*) AS n FROM documents GROUP BY source""")
def checksum_files(spark, sf):
    own = delivery.checksum_lines(_files(spark, sf))
    return own.select("package", F.md5(F.encode("text", "UTF-8")).alias("digest"), F.size(F.split("text", "\n")).cast("bigint").alias("n"))


@query("""
WITH g AS (SELECT source AS package, max(doc_id % 7) / 2.0 AS peak, count(*) AS n FROM documents GROUP BY source)
SELECT package, n AS renders, CASE WHEN n % 2 = 0 THEN round(peak, 3) END AS peak, m.n_files, m.total, m.first_name, m.first_sha FROM g JOIN (
  SELECT source AS package, count(*) AS n_files, sum(octet_length(encode(coalesce(text, '')))) AS total, min('doc_' || doc_id || '.txt') AS first_name, arg_min(sha256(coalesce(text, '')), 'doc_' || doc_id || '.txt') AS first_sha FROM documents GROUP BY source) m USING (package)""")
def delivery_manifests(spark, sf):
    """Manifests as JSON, read again; a measure that isn't finite is left out."""
    n, peak = F.count(F.lit(1)), F.max(c("doc_id") % 7) / 2.0
    renders = table(spark, sf, "documents").groupBy(c("source").alias("package")).agg(n.alias("renders"), F.when(n % 2 == 0, peak).otherwise(F.lit(float("inf"))).alias("peak"))
    own = delivery.manifests(renders, _files(spark, sf))
    m = own.select("package", F.from_json("manifest", "renders bigint, peak double, files array<struct<name: string, bytes: bigint, sha256: string>>").alias("m"))
    total = F.aggregate("m.files", F.lit(0).cast("bigint"), lambda a, f: a + f["bytes"])
    return m.select("package", "m.renders", "m.peak", F.size("m.files").cast("bigint").alias("n_files"), total.alias("total"), c("m.files")[0]["name"].alias("first_name"), c("m.files")[0]["sha256"].alias("first_sha"))


@query("""
SELECT source AS package, md5('Delivery ' || source || chr(10) || string_agg('- doc_' || doc_id || '.txt (' || octet_length(encode(coalesce(text, ''))) || ' bytes)', chr(10) ORDER BY 'doc_' || doc_id || '.txt')) AS digest FROM documents GROUP BY source""")
def delivery_readmes(spark, sf):
    files = _files(spark, sf)
    own = delivery.readme_lines(delivery.manifests(files.select("package").distinct(), files))
    return own.select("package", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'silent' ELSE printf('%.1f', c_custkey % 23 - 26.0) END || ' to ' || printf('%.1f', -14.5) || ' LUFS, gain ' || printf('%.1f', c_custkey % 5 - 0.5) || ' dB, peak ' || printf('%.2f', -1.25) || ' dBTP, ' || c_custkey % 3 || ' passes' AS summary FROM customer""")
def render_summaries(spark, sf):
    k = c("c_custkey")
    reports = table(spark, sf, "customer").select(k.cast("string").alias("clip_id"), F.when(k % 9 != 0, k % 23 - 26.0).alias("loudness_before"), F.lit(-14.5).alias("loudness_after"), (k % 5 - 0.5).alias("gain_db"), F.lit(-1.25).alias("true_peak_db"), (k % 3).alias("passes"))
    return delivery.summaries(reports).select(c("clip_id").cast("bigint").alias("c_custkey"), "summary")


@query("""
SELECT severity, kind, count(*) AS n, '| ' || severity || ' | ' || kind || ' | ' || count(*) || ' | ' || min(id) || ' |' AS line
FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'defect' ELSE 'info' END AS severity, 'rule-' || c_custkey % 4 AS kind, c_custkey AS id FROM customer) GROUP BY severity, kind""")
def regression_lines(spark, sf):
    k = c("c_custkey")
    flags = table(spark, sf, "customer").select(F.when(k % 3 == 0, "defect").otherwise("info").alias("severity"), F.concat(F.lit("rule-"), (k % 4).cast("string")).alias("kind"), k.alias("id"))
    return delivery.regression_report(flags).select("severity", "kind", "n", "line")


@query("""
WITH n AS (SELECT p_partkey, 'take ' || p_size || CASE WHEN p_size % 3 = 0 THEN '' ELSE '.wav' END AS name, p_size FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS k FROM n)
SELECT p_partkey, name, CASE WHEN k = 1 THEN name WHEN p_size % 3 = 0 THEN name || '_' || k ELSE 'take ' || p_size || '_' || k || '.wav' END AS unique_name FROM k""")
def export_names(spark, sf):
    name = F.concat(F.lit("take "), c("p_size").cast("string"), F.when(c("p_size") % 3 == 0, "").otherwise(".wav"))
    return delivery.unique_names(table(spark, sf, "part").select("p_partkey", name.alias("name")), "p_partkey", "name")


def _speakers_sql() -> str:
    rows = [(i, float(a), float(e), label, int(m, 16), int(lfe)) for i, a, e, label, m, lfe in dims._lines(dims.SPEAKERS)]
    rows += [(f"V{k + 1}", *map(float, p.split(":")), f"V_{k + 1:02d}", 0, int(k >= 20)) for k, p in enumerate(dims.VENUE.split())]
    return "SELECT * FROM " + values(rows, "speaker_id, azimuth, elevation, label, bit, lfe")


def _channels_sql() -> str:
    every = dims.LAYOUTS | {"venue": " ".join(f"V{k + 1}" for k in range(24))}
    return "SELECT * FROM " + values([(lay, p, sp, int(lay not in dims.NO_MASK)) for lay, own in every.items() for p, sp in enumerate(own.split())], "layout_id, pos, speaker_id, standard")


_ORDER_SQL = f"""
WITH s AS ({_speakers_sql()}), l AS ({_channels_sql()}),
w AS (SELECT layout_id, (min(standard) = 1 AND min(bit) > 0 AND count(DISTINCT bit) = count(*)) AS usable, bit_or(bit) AS bits FROM l JOIN s USING (speaker_id) GROUP BY layout_id),
o AS (SELECT l.layout_id, CASE WHEN usable THEN bits ELSE 0 END AS mask, usable, row_number() OVER (PARTITION BY l.layout_id ORDER BY CASE WHEN usable THEN s.bit ELSE pos END) AS channel, s.* FROM l JOIN s USING (speaker_id) JOIN w ON w.layout_id = l.layout_id)
"""


@query(_ORDER_SQL + """
SELECT layout_id, mask, md5(string_agg(lpad(CAST(channel AS VARCHAR), 2) || '  ' || rpad(speaker_id, CAST(greatest(5, length(speaker_id)) AS INT), ' ') || '  ' || lpad(printf('%.1f', azimuth), 7, ' ') || '  ' || lpad(printf('%.1f', -azimuth + 0.0), 8, ' ') || '  ' || lpad(printf('%.0f', elevation), 4, ' ') || '  ' || rpad(label, CAST(greatest(12, length(label)) AS INT), ' '), chr(10) ORDER BY channel)) AS digest
FROM o GROUP BY layout_id, mask""".replace("lpad(CAST(channel AS VARCHAR), 2)", "lpad(CAST(channel AS VARCHAR), 2, ' ')"))
def channel_map_texts(spark, sf):
    return delivery.channel_map(spark).select("layout_id", c("mask").cast("int").alias("mask"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query(_ORDER_SQL + """
SELECT layout_id, count(*) AS n, CAST(max(mask) AS INT) AS mask, bool_and(usable) AS standard, arg_max(speaker_id, channel) AS last_speaker, sum(lfe) AS n_lfe, sum(elevation) AS up FROM o GROUP BY layout_id""")
def channel_map_records(spark, sf):
    """Channel maps as JSON, read again."""
    m = delivery.channel_map_json(spark).select("layout_id", F.from_json("json", "channel_count bigint, mask int, standard boolean, channels array<struct<channel: int, speaker_id: string, elevation: double, lfe: boolean>>").alias("m"))
    ch = "m.channels"
    return m.select("layout_id", c("m.channel_count").alias("n"), "m.mask", "m.standard", F.element_at(ch, -1)["speaker_id"].alias("last_speaker"), F.aggregate(ch, F.lit(0).cast("bigint"), lambda a, x: a + x["lfe"].cast("bigint")).alias("n_lfe"), F.aggregate(ch, F.lit(0.0), lambda a, x: a + x["elevation"]).alias("up"))


@query(f"""
WITH s AS ({_speakers_sql()})
SELECT speaker_id, CASE WHEN lfe = 1 THEN 'sub' WHEN speaker_id LIKE 'V%' AND elevation < 0 THEN 'side' WHEN elevation > 0 THEN 'height' WHEN speaker_id = 'C' OR abs(azimuth) <= 70 THEN 'front' WHEN abs(azimuth) > 130 THEN 'rear' ELSE 'side' END AS audition_group FROM s""")
def audition_groups(spark, sf):
    return dims.audition_groups(spark).withColumnRenamed("group", "audition_group")


@query(f"""
WITH s AS ({_speakers_sql()})
SELECT speaker_id, {rs("sin(radians(-azimuth)) * cos(radians(elevation))", 6)} AS x, {rs("sin(radians(elevation))", 6)} AS y, {rs("-cos(radians(azimuth)) * cos(radians(elevation))", 6)} AS z FROM s""")
def speaker_placements(spark, sf):
    return dims.placements(spark).select("speaker_id", *(r(c(k), 6).alias(k) for k in "xyz"))


@query("""SELECT * FROM (VALUES ('ceiling', 'number', '-1'), ('transAttack', 'number', '0'), ('transSustain', 'number', '0'), ('dither', 'enum', 'tpdf')) AS t(key, kind, fallback)""")
def preview_divergences(spark, sf):
    return dims.preview_divergences(spark)


# ---- scenes, estimates, rules -------------------------------------------------

BANDS = list(scene.BANDS)


def _scene(spark, sf):
    k = c("p_partkey")
    gain = lambda n, low: (k * n % 24) / 10.0 + low
    return table(spark, sf, "part").select(k.alias("scene"), _pick(BANDS, k).alias("band"), gain(7, 0.5).alias("frontM"), gain(5, -0.5).alias("centreM"), gain(3, -0.9).alias("frontS"), F.when(k % 3 == 0, 0.0).otherwise(gain(11, -0.4)).alias("sideS"), F.when(k % 3 == 0, 0.0).otherwise(gain(13, -0.6)).alias("rearS"), F.when(k % 17 == 0, F.lit(None)).otherwise(F.lit(0.0)).alias("heightS"), F.when(k % 4 == 0, 0.5).otherwise(0.0).alias("lfeM"))


@query(f"""
WITH g AS (SELECT p_partkey AS scene, {_sql_pick(BANDS, "p_partkey")} AS band, p_partkey * 7 % 24 / 10.0 + 0.5 AS fm, p_partkey * 5 % 24 / 10.0 - 0.5 AS cm, p_partkey * 3 % 24 / 10.0 - 0.9 AS fs,
  CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE p_partkey * 11 % 24 / 10.0 - 0.4 END AS ss, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE p_partkey * 13 % 24 / 10.0 - 0.6 END AS rs, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 0.0 END AS hs, CASE WHEN p_partkey % 4 = 0 THEN 0.5 ELSE 0.0 END AS lf FROM part)
SELECT scene, band, rule FROM (
  SELECT scene, band, 'missing gain' AS rule FROM g WHERE hs IS NULL
  UNION ALL SELECT scene, band, 'front under 0.8' FROM g WHERE fm < 0.8
  UNION ALL SELECT scene, band, 'bass not anchored' FROM g WHERE band IN ('sub', 'low') AND (ss <> 0 OR rs <> 0)
  UNION ALL SELECT scene, band, 'low-frequency feed' FROM g WHERE band <> 'sub' AND lf <> 0
  UNION ALL SELECT scene, band, 'surround budget' FROM g WHERE ss * ss + rs * rs + hs * hs > 3.2 + 1e-9
  UNION ALL SELECT scene, band, 'gain out of range' FROM g WHERE abs(cm) > 1.4 OR abs(fs) > 1.4 OR abs(ss) > 1.4 OR abs(rs) > 1.4)""")
def scene_problems(spark, sf):
    return scene.problems(_scene(spark, sf))


_T = "(k % 40) / 40.0"
_A = f"({_T} * 2 * pi())"
_SMOOTH = f"({_T} * {_T} * (3 - 2 * {_T}))"


@query(f"""
WITH p AS (SELECT p_partkey AS k FROM part)
SELECT k AS p_partkey,
  {rs(f"1 + (sqrt(0.4 + 0.6 * (cos{_A} * 0.5 + 0.5)) - 1) * 0.9", 6)} AS orbit_side, {rs(f"1 + (sqrt(0.4 + 0.6 * (-sin{_A} * 0.5 + 0.5)) - 1) * 0.9", 6)} AS orbit_rear,
  {rs(f"1 + (0.5 + 0.5 * sqrt(greatest(sin{_A} * 0.5 + 0.5, 0)) - 1) * 0.8", 6)} AS clock_rear, {rs(f"1 + (0.55 + 1.05 * {_SMOOTH} - 1)", 6)} AS drift_rear,
  {rs(f"1 + (sqrt(1 / (0.55 + 1.05 * {_SMOOTH})) - 1) * 0.3", 6)} AS drift_front, {rs(f"0.65 + 0.85 * (sin{_A} * 0.5 + 0.5)", 6)} AS up, {rs(f"sqrt(1 + sin{_A} * 0.3)", 6)} AS breath FROM p""")
def scene_motion(spark, sf):
    """Gains of rings at forty phases of the motion modes."""
    t = (c("p_partkey") % 40) / 40.0
    at = lambda mode, ring: r(scene.motion(mode, t)[ring], 6)
    return table(spark, sf, "part").select("p_partkey", at("orbit", "sideL").alias("orbit_side"), at("orbit", "rearR").alias("orbit_rear"), at("clockwise", "rearL").alias("clock_rear"), at("front-rear-drift", "rearL").alias("drift_rear"), at("front-rear-drift", "frontR").alias("drift_front"), at("vertical", "heightL").alias("up"), at("breathing", "sideR").alias("breath"))


@query("""
WITH b AS (SELECT o_orderkey AS k, (1 + o_orderkey % 24) * CAST(floor(o_totalprice * 10) AS BIGINT) * 4 AS one, 12 * CAST(floor(o_totalprice * 10) AS BIGINT) * 4 AS around FROM orders),
s AS (SELECT *, one * 1.0 + one * 1.0 + one * 0.5 + one * 2.0 + around AS peak FROM b)
SELECT k AS o_orderkey, one * 0.5 AS analysis_bytes, peak AS peak_bytes,
  CASE WHEN peak > 1.25 * 536870912 THEN 'LIKELY UNSAFE' WHEN peak > 0.75 * 536870912 THEN 'VERY HEAVY' WHEN peak > 0.35 * 536870912 THEN 'HEAVY' ELSE 'SAFE' END AS memory_class,
  'Expected peak: approximately ' || CASE WHEN peak < 1048576 THEN CAST(floor(peak / 1024 + 0.5) AS BIGINT) || ' KB' WHEN peak >= 10485760 THEN CAST(floor(peak / 1048576 + 0.5) AS BIGINT) || ' MB' ELSE printf('%.1f', peak / 1048576) || ' MB' END AS label FROM s""")
def memory_plan(spark, sf):
    plan = rules.memory_plan(1 + c("o_orderkey") % 24, F.floor(c("o_totalprice") * 10), F.lit(float(512 << 20)), 12, analysis=0.5, output=2.0)
    return table(spark, sf, "orders").select("o_orderkey", plan.alias("p")).select("o_orderkey", "p.analysis_bytes", "p.peak_bytes", "p.memory_class", "p.label")


@query(f"""
WITH e AS (SELECT vec_id, unnest(range(len(embedding))) // 8 AS band, unnest(embedding)::DOUBLE * 10 AS v FROM embeddings)
SELECT vec_id, {rs("avg(v) FILTER (band <= 1)", 6)} AS bass_db, {rs("avg(v) FILTER (band IN (3, 4))", 6)} AS presence_db, {rs("avg(v) FILTER (band >= 6)", 6)} AS treble_db FROM e GROUP BY vec_id""")
def tonal_regions(spark, sf):
    """Means of a vector's eighths as the levels of the eight bands that the operator takes."""
    own = rules.tonal_regions(eighths(c("embedding")))
    return table(spark, sf, "embeddings").select("vec_id", own.alias("t")).select("vec_id", *(r(c(f"t.{k}"), 6).alias(k) for k in ("bass_db", "presence_db", "treble_db")))


@query("""
WITH o AS (SELECT * FROM orders WHERE o_totalprice > 300000) SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM o""")
def in_both_runs(spark, sf):
    """Ids that both of two runs measured."""
    return table(spark, sf, "customer").select("c_custkey").intersect(table(spark, sf, "orders").where("o_totalprice > 300000").select(c("o_custkey").alias("c_custkey")))


# ---- names and numbers ---------------------------------------------------------


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'master' ELSE p_name END AS base FROM part""")
def base_names(spark, sf):
    name = F.when(c("p_size") % 4 == 0, F.lit("..")).otherwise(F.concat(F.lit("C:\\takes\\"), c("p_name"), F.lit(".wav")))
    return table(spark, sf, "part").select("p_partkey", tx.base_name(name).alias("base"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '44.1k-16bit' WHEN 1 THEN '48k-24bit' WHEN 2 THEN '96k-32float' ELSE '88.2k-24bit' END AS tag FROM orders""")
def quality_tags(spark, sf):
    k = c("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", tx.quality_tag(_pick([44100, 48000, 96000, 88200], k), _pick([16, 24, 32, 24], k)).alias("tag"))


@query("""
SELECT doc_id, CASE WHEN length(t) <= 64 THEN t ELSE substr(t, 1, 63) || '…' END AS name FROM (SELECT doc_id, replace(substr(coalesce(text, ''), 1, 40 + doc_id % 60), chr(10), ' ') AS t FROM documents)""")
def clamped_names(spark, sf):
    given = F.replace(F.substring(F.coalesce("text", F.lit("")), F.lit(1), (40 + c("doc_id") % 60).cast("int")), F.lit("\n"), F.lit(" "))
    return table(spark, sf, "documents").select("doc_id", tx.clamp_name(given).alias("name"))


@query("""
SELECT o_orderkey, 68 + CAST(floor(o_totalprice) AS BIGINT) * (1 + o_orderkey % 6) * (CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END) AS bytes,
  CASE o_orderkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END AS oversampling FROM orders""")
def file_estimates(spark, sf):
    k = c("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", s.wav_bytes(F.floor("o_totalprice"), 1 + k % 6, _pick([16, 24, 32], k)).alias("bytes"), s.oversampling(_pick([44100, 48000, 96000, 192000], k)).alias("oversampling"))


@query(f"""
WITH v AS (SELECT o_orderkey AS k, o_totalprice / 250000.0 - 0.5 AS x FROM orders)
SELECT k AS o_orderkey, {rs("least(1, greatest(0, x))", 6)} AS clamped, {rs("3 + (7 - 3) * x", 6)} AS mixed, {rs("pow(least(1, greatest(0, x)), 2) * (3 - 2 * least(1, greatest(0, x)))", 6)} AS eased,
  {rs("10 * log10(greatest(x * x, 1e-30))")} AS power, {rs("-0.691 + 10 * log10(greatest(x * x, 1e-30))")} AS level, {rs("0.5 - 0.5 * cos(2 * pi() * (k % 512) / 512)", 6)} AS hann, CASE WHEN k % 5 = 0 THEN NULL ELSE {rs("x", 6)} END AS finite FROM v""")
def scalar_functions(spark, sf):
    """The scalar functions in SQL text, registered by name, beside their column forms."""
    s.register(spark)
    o = table(spark, sf, "orders").select("o_orderkey", (c("o_totalprice") / 250000.0 - 0.5).alias("x"))
    x = c("x")
    finite = s.finite_or_null(F.when(c("o_orderkey") % 10 == 0, F.lit(float("nan"))).when(c("o_orderkey") % 5 == 0, F.lit(float("-inf"))).otherwise(x))
    return o.select(
        "o_orderkey", r(F.expr("clamp(x, 0, 1)"), 6).alias("clamped"), r(F.expr("lerp(3, 7, x)"), 6).alias("mixed"), r(F.expr("smoothstep(x)"), 6).alias("eased"), r(F.expr("power_db(x * x)")).alias("power"),
        r(s.block_level(x * x)).alias("level"), r(s.hann(c("o_orderkey") % 512, 512), 6).alias("hann"), r(finite, 6).alias("finite"),
    )


# ---- live meters on batches ----------------------------------------------------


@query(f"""
WITH e AS (SELECT event_type, ts, value / 500.0 AS v FROM events),
w AS (SELECT event_type, v, unnest([date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 2 AS INTEGER)), date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 2 + 2 AS INTEGER)), date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 2 + 4 AS INTEGER))]) AS start FROM e)
SELECT event_type, start, count(*) AS n, {rs("-0.691 + 10 * log10(greatest(1e-30, avg(v * v)))")} AS level, {rs("20 * log10(greatest(max(abs(v)), 1e-9))")} AS peak_db FROM w GROUP BY event_type, start""")
def sliding_levels(spark, sf):
    """Levels of six hours, a new one every two."""
    e = table(spark, sf, "events").select("event_type", "ts", (c("value") / 500.0).alias("value"))
    own = meters.window_levels(e, "event_type", "6 hours", "2 hours")
    return own.select("event_type", c("start").cast("timestamp_ntz").alias("start"), "n", r(c("level")).alias("level"), r(c("peak_db")).alias("peak_db"))


@query(f"""
WITH e AS (SELECT event_type, date_trunc('day', ts) AS start, value / 500.0 - 0.5 AS x, (event_id % 11) / 10.0 - 0.5 AS y FROM events)
SELECT event_type, start, {rs("CASE WHEN sqrt(sum(x * x) * sum(y * y)) < 1e-20 THEN 1 ELSE sum(x * y) / sqrt(sum(x * x) * sum(y * y)) END", 6)} AS correlation FROM e GROUP BY event_type, start""")
def windowed_correlation(spark, sf):
    e = table(spark, sf, "events").select("event_type", "ts", (c("value") / 500.0 - 0.5).alias("left"), ((c("event_id") % 11) / 10.0 - 0.5).alias("right"))
    return meters.stereo_windows(e, "event_type", "1 day").select("event_type", c("start").cast("timestamp_ntz").alias("start"), r(c("correlation"), 6).alias("correlation"))


@query("""
WITH o AS (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS before FROM events),
g AS (SELECT event_type, ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 20 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts) AS g FROM o)
SELECT event_type, min(ts) AS session_start, max(ts) + INTERVAL 20 MINUTE AS session_end, count(*) AS n FROM g GROUP BY event_type, g""")
def burst_sessions(spark, sf):
    own = meters.sessions(table(spark, sf, "events").select("event_type", "ts"), "event_type", "20 minutes")
    return own.select("event_type", *(c(k).cast("timestamp_ntz").alias(f"session_{k}") for k in ("start", "end")), "n")


@query("""
SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def latest_result(spark, sf):
    """Of each key's results the newest wins, whatever the order in which they come."""
    return meters.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


_LIVE = """
WITH e AS (SELECT user_id, event_id AS n, (event_id % 4 + 1) * 0.25 AS dt, value / 500.0 AS v FROM events),
a AS (SELECT *, sum(dt) OVER (PARTITION BY user_id ORDER BY n) AS at FROM e)
"""


@query(_LIVE + f"""
SELECT a.user_id, a.n AS event_id, {rs("-0.691 + 10 * log10(greatest(1e-12, sum(CASE WHEN b.at >= a.at - 1 THEN b.v * b.v * b.dt END) / sum(CASE WHEN b.at >= a.at - 1 THEN b.dt END)))")} AS momentary,
  {rs("-0.691 + 10 * log10(greatest(1e-12, sum(b.v * b.v * b.dt) / sum(b.dt)))")} AS short_term
FROM a JOIN a b ON a.user_id = b.user_id AND b.at <= a.at AND b.at >= a.at - 3 GROUP BY a.user_id, a.n""")
def live_levels(spark, sf):
    """Levels of the last second and the last three, of readings that stood for different times."""
    e = table(spark, sf, "events").select("user_id", c("event_id").alias("n"), ((c("event_id") % 4 + 1) * 0.25).alias("dt"), (c("value") / 500.0).alias("value"))
    own = meters.trailing_levels(e, "user_id", {"momentary": 1.0, "short_term": 3.0})
    return own.select("user_id", c("n").alias("event_id"), r(c("momentary")).alias("momentary"), r(c("short_term")).alias("short_term"))


@query("""
SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS age FROM events QUALIFY age < 240""")
def correlation_history(spark, sf):
    """The last 240 readings of each series."""
    return meters.last_n(table(spark, sf, "events").select("event_type", "event_id"), "event_type", "event_id", 240).select("event_type", "event_id", c("age").cast("bigint").alias("age"))


# ---- comparison ----------------------------------------------------------------


@query("""
WITH m AS (SELECT c_custkey AS id, 'b' || c_custkey % 4 AS browser, c_custkey % 5 - 14.0 + (c_custkey % 4) * 0.6 AS integrated FROM customer), k AS (SELECT id // 4 AS id, browser, integrated FROM m)
SELECT x.browser, x.id, 'browser-divergence' AS kind, 'browser' AS severity FROM k x JOIN k y ON x.id = y.id AND y.browser = 'b0' WHERE x.browser <> 'b0' AND abs(x.integrated - y.integrated) > 1
UNION ALL SELECT g.browser, y.id, 'missing-measurement', 'browser' FROM k y, (SELECT DISTINCT browser FROM k WHERE browser <> 'b0') g WHERE y.browser = 'b0' AND NOT EXISTS (SELECT 1 FROM k x WHERE x.browser = g.browser AND x.id = y.id)""")
def compare_browsers(spark, sf):
    """Every engine's measurements against those of one."""
    k = c("c_custkey")
    none = F.lit(None).cast("double")
    own = table(spark, sf, "customer").select(F.floor(k / 4).cast("bigint").alias("id"), F.lit("reference").alias("class"), F.concat(F.lit("b"), (k % 4).cast("string")).alias("browser"), F.lit(0).alias("nan"), F.lit(0).alias("inf"), F.lit(0.0).alias("dc"), (k % 5 - 14.0 + (k % 4) * 0.6).alias("integrated"), *(none.alias(x) for x in ("true_peak_db", "crest_db", "rms_db", "correlation", "mono_loss_db", "centroid_hz")))
    return compare.across(own, "browser", "b0").select("browser", "id", "kind", "severity")


@query(f"""
WITH l AS (SELECT l_suppkey, l_extendedprice / 100000.0 AS x, l_quantity / 50.0 AS y FROM lineitem)
SELECT l_suppkey, {rs("20 * log10(greatest(sqrt(avg(x * x)) * sqrt(2), 1e-9))")} AS left_db, {rs("20 * log10(greatest(sqrt(avg(y * y)) * sqrt(2), 1e-9))")} AS right_db,
  {rs("20 * log10(greatest(sqrt(avg(x * x)) * sqrt(2), 1e-9)) - 20 * log10(greatest(sqrt(avg(y * y)) * sqrt(2), 1e-9))")} AS balance_db FROM l GROUP BY l_suppkey""")
def stereo_balance(spark, sf):
    lines = table(spark, sf, "lineitem")
    left, right = levels.rms_db(c("l_extendedprice") / 100000.0), levels.rms_db(c("l_quantity") / 50.0)
    return lines.groupBy("l_suppkey").agg(r(left).alias("left_db"), r(right).alias("right_db"), r(left - right).alias("balance_db"))


# ---- planned scenes ------------------------------------------------------------

_KNOB = {"envelopment": 3, "front_focus": 5, "rear_depth": 7, "room_size": 11, "height_focus": 13, "height_spread": 17}
_MID = "CASE band WHEN 'mid' THEN 1.0 WHEN 'lowmid' THEN 0.7 WHEN 'presence' THEN 0.7 WHEN 'air' THEN 0.5 END"


def _within(x: str, high: str, bands: str, otherwise: str) -> str:
    return f"(CASE WHEN band IN ({bands}) THEN least({high}, greatest(0, {x})) ELSE {otherwise} END)"


_UP, _FOCUS, _TOP = "'lowmid', 'mid', 'presence', 'air'", "'mid', 'lowmid'", "'presence', 'air'"


def _chain(start: str, *moves: tuple[str, str, str]) -> str:
    """Nested moves of (expression with {{}} for the value so far, largest value, bands)."""
    out = start
    for text, high, bands in moves:
        out = _within(text.format(f"({out})"), high, bands, out)
    return out


@query(f"""
WITH g AS (SELECT p_partkey AS scene, {_sql_pick(BANDS, "p_partkey")} AS band, p_partkey * 5 % 12 / 10e0 AS f, p_partkey * 7 % 13 / 10e0 AS s, p_partkey * 11 % 13 / 10e0 AS r, p_partkey * 13 % 14 / 10e0 AS h, p_partkey % 10 / 10e0 AS d,
  {', '.join(f"CASE WHEN p_partkey % 19 = 0 THEN 0 ELSE p_partkey * {w} % 11 / 10e0 - 5e-1 END AS {k}" for k, w in _KNOB.items())} FROM part)
SELECT scene, band,
  {rs(_chain("f", (f"{{}} - 0.2 * ({_MID}) * envelopment", "1.2", _UP), ("{} + 0.22 * front_focus", "1.4", _FOCUS), ("{} - 0.1 * room_size", "1.2", _UP)), 6)} AS "frontS",
  {rs(_chain("s", (f"{{}} + 0.3 * ({_MID}) * envelopment", "1.3", _UP), ("{} - 0.16 * front_focus", "1.3", _FOCUS), ("{} + 0.09 * room_size", "1.35", _UP)), 6)} AS "sideS",
  {rs(_chain("r", (f"{{}} + 0.15 * ({_MID}) * envelopment", "1.3", _UP), ("{} - 0.07 * front_focus", "1.3", _FOCUS), ("{} * (1 + 0.6 * rear_depth)", "1.4", _TOP), ("{} + 0.12 * room_size", "1.35", _UP)), 6)} AS "rearS",
  {rs(_chain("h", ("{} + 0.07 * room_size", "1.4", _UP), ("{} * (1 + 0.8 * height_focus)", "1.4", _TOP), ("{} * (1 - 0.8 * height_focus)", "1.4", "'mid'")), 6)} AS "heightS",
  {rs(_chain("d", ("{} * (1 + 0.8 * room_size)", "1", _UP), ("{} * (1 + 0.3 * height_spread)", "1", _UP)), 6)} AS decorr FROM g""")
def planned_scenes(spark, sf):
    """Scene rows as six knobs move them."""
    k = c("p_partkey")
    knobs = {name: F.when(k % 19 != 0, k * w % 11 / 10.0) for name, w in _KNOB.items()}
    rows = table(spark, sf, "part").select(k.alias("scene"), _pick(BANDS, k).alias("band"), (k * 5 % 12 / 10.0).alias("frontS"), (k * 7 % 13 / 10.0).alias("sideS"), (k * 11 % 13 / 10.0).alias("rearS"), (k * 13 % 14 / 10.0).alias("heightS"), (k % 10 / 10.0).alias("decorr"), *(v.alias(n) for n, v in knobs.items()))
    return scene.planned(rows).select("scene", "band", *(r(c(x), 6).alias(x) for x in ("frontS", "sideS", "rearS", "heightS", "decorr")))
