"""Registered queries on recursions over chunks and on speaker feeds, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import design, responses, tables
from tidemark.operators import alignment, dims, feeds, frames, onsets
from tidemark.operators.scans import Cascade, Follower, over_chunks
from tidemark.operators.scene import BANDS
from tidemark.plans import designs
from tidemark.plans.base import Registry, r, rs, table
from tidemark.streaming import live

query = Registry()
c = F.col
CHUNK = 200

#: Events as one signal for each type, frame by frame.
_SIGNAL = "e AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, value / 500 AS x FROM events)"


def _signal(spark, sf):
    """event_type, chunk_idx, samples: every type's values in order of their ids."""
    e = table(spark, sf, "events").select("event_type", "event_id", (c("value") / 500).alias("value"))
    each = frames.framed(e, "event_type", ["event_id"], F.floor(c("event_id") / 4096))
    held = each.groupBy("event_type", F.floor(c("frame") / CHUNK).alias("chunk_idx")).agg(F.sort_array(F.collect_list(F.struct("frame", "value"))).alias("s"))
    return held.select("event_type", "chunk_idx", c("s.value").alias("samples"))


@query(f"""
WITH RECURSIVE f AS (SELECT tan(pi() * 1681.974450955533 / 48000) AS s, tan(pi() * 38.13547087602444 / 48000) AS h, pow(10, 3.999843853973347 / 20) AS vh),
d AS (SELECT *, pow(vh, 0.4996667741545416) AS vb, 1 + s / 0.7071752369554196 + s * s AS d1, 1 + h / 0.5003270373238773 + h * h AS d2 FROM f),
k AS (
  SELECT (vh + vb * s / 0.7071752369554196 + s * s) / d1 AS b0, 2 * (s * s - vh) / d1 AS b1, (vh - vb * s / 0.7071752369554196 + s * s) / d1 AS b2,
    2 * (s * s - 1) / d1 AS a1, (1 - s / 0.7071752369554196 + s * s) / d1 AS a2, 2 * (h * h - 1) / d2 AS c1, (1 - h / 0.5003270373238773 + h * h) / d2 AS c2 FROM d),
{_SIGNAL},
y AS (
  SELECT event_type, 0::BIGINT AS i, x, 0.0::DOUBLE AS x1, b0 * x AS p, 0.0::DOUBLE AS p1, b0 * x AS q, 0.0::DOUBLE AS q1 FROM e, k WHERE i = 0
  UNION ALL
  SELECT e.event_type, e.i, e.x, y.x, b0 * e.x + b1 * y.x + b2 * y.x1 - a1 * y.p - a2 * y.p1, y.p,
    (b0 * e.x + b1 * y.x + b2 * y.x1 - a1 * y.p - a2 * y.p1) - 2 * y.p + y.p1 - c1 * y.q - c2 * y.q1, y.q
  FROM y JOIN e ON e.event_type = y.event_type AND e.i = y.i + 1, k)
SELECT event_type, i // {CHUNK} AS chunk_idx, {rs("-0.691 + 10 * log10(greatest(avg(q * q), 1e-30))", 3)} AS level FROM y GROUP BY ALL""")
def k_weighted_series(spark, sf):
    """K-weighted level of each chunk of each type's signal: the filter's state goes from chunk to chunk."""
    out = over_chunks(_signal(spark, sf), Cascade(design.k_weighting(48_000)), ("event_type",), stretch=4)
    power = F.aggregate("samples", F.lit(0.0), lambda s, v: s + v * v) / F.size("samples")
    return out.select("event_type", "chunk_idx", r(-0.691 + 10 * F.log10(F.greatest(power, F.lit(1e-30))), 3).alias("level"))


@query(f"""
WITH RECURSIVE k AS (SELECT 1 - exp(-1 / (0.006 * 8000)) AS a, 1 - exp(-1 / (0.12 * 8000)) AS r), {_SIGNAL},
y AS (
  SELECT event_type, 0::BIGINT AS i, x * a AS y FROM e, k WHERE i = 0
  UNION ALL SELECT e.event_type, e.i, y.y + (e.x - y.y) * CASE WHEN e.x > y.y THEN a ELSE r END FROM y JOIN e ON e.event_type = y.event_type AND e.i = y.i + 1, k)
SELECT event_type, i // {CHUNK} AS chunk_idx, {rs("max(y)", 6)} AS highest, {rs("arg_max(y, i)", 6)} AS last FROM y GROUP BY ALL""")
def followed_series(spark, sf):
    """Highest and last level of a follower (6 ms up, 120 ms down at 8 kHz) in each chunk."""
    rise, fall = (1 - float(np.exp(-1 / (s * 8000))) for s in (0.006, 0.12))
    out = over_chunks(_signal(spark, sf), Follower(rise, fall), ("event_type",), stretch=4)
    return out.select("event_type", "chunk_idx", r(F.array_max("samples"), 6).alias("highest"), r(F.element_at("samples", -1), 6).alias("last"))


_GAINS = {"frontM": (7, 9, 5), "centreM": (5, 11, -2), "frontS": (3, 13, -1), "sideS": (11, 12, -3), "rearS": (13, 10, -2), "heightS": (17, 8, -1)}


def _scene_rows(spark, sf):
    k, s = c("p_partkey"), F.floor(c("p_partkey") / 6)
    layout = F.element_at(F.array(*map(F.lit, ("5.1", "7.1.4", "venue"))), (s % 3 + 1).cast("int"))
    band = F.element_at(F.array(*map(F.lit, BANDS)), (k % 6 + 1).cast("int"))
    gains = [((k * a % b + low) / 10.0).alias(name) for name, (a, b, low) in _GAINS.items()]
    lfe = F.when(k % 4 == 0, (k % 5) / 5.0).otherwise(0.0).alias("lfeM")
    extract = F.when(s % 7 != 0, s % 5 / 4.0).alias("centre_extract")
    has_centre = (layout != "venue").alias("has_centre")
    return table(spark, sf, "part").select(s.alias("scene"), layout.alias("layout_id"), band.alias("band"), *gains, lfe, extract, (k % 11 / 10.0).alias("decorr"), has_centre, F.lit(True).alias("has_lfe"))


def _scenes(rows):
    s = c("scene")
    knob = lambda name, when, value: F.when(when, value.cast("double")).alias(name)
    return rows.select("scene", "layout_id").distinct().select(
        "scene", "layout_id", knob("front_rear", s % 5 != 0, s % 11 / 10.0), knob("lfe_db", s % 3 != 0, -(s % 7)), knob("surround_db", s % 4 != 0, -(s % 6)), knob("height_db", s % 2 != 0, -(s % 9)),
        (0.5 + s % 3 / 4.0).alias("side"), (0.6 + s % 4 / 5.0).alias("rear"), (0.7 + s % 5 / 10.0).alias("height"), (0.8 - s % 2 / 5.0).alias("ground"),
    )


def _speakers_sql() -> str:
    """speaker, azimuth, ring and low-frequency flag, and the layouts' channels, as SQL tables."""
    rows = []
    for line in dims.SPEAKERS.strip().splitlines():
        i, a, e, _, _, lfe = line.split()
        rows.append(f"('{i}', {a}, {e}, {lfe})")
    rows += [f"('V{k + 1}', {p.split(':')[0]}, {p.split(':')[1]}, {int(k >= 20)})" for k, p in enumerate(dims.VENUE.split())]
    every = dims.LAYOUTS | {"venue": " ".join(f"V{k + 1}" for k in range(24))}
    own = [f"('{k}', '{s}')" for k, v in every.items() for s in v.split()]
    return f"sp(speaker_id, az, el, lfe) AS (VALUES {', '.join(rows)}), ch(layout_id, speaker_id) AS (VALUES {', '.join(own)})"


_TAP = "CASE " + " ".join(f"WHEN speaker_id IN ({', '.join(repr(k) for k, v in feeds.TAP_GAIN.items() if v == g)}) THEN {g}" for g in sorted(set(feeds.TAP_GAIN.values()))) + " ELSE 1 END"


@query(f"""
WITH {_speakers_sql()},
taps AS (
  SELECT layout_id, speaker_id, {_TAP} AS tap,
    CASE WHEN lfe = 1 THEN 'lfe'
         WHEN speaker_id[1] = 'V' AND el < 0 THEN 'ground' || CASE WHEN az > 0 THEN 'L' ELSE 'R' END
         WHEN el > 0 THEN 'height' || CASE WHEN az > 0 THEN 'L' ELSE 'R' END
         WHEN abs(az) <= 8 THEN 'centre'
         ELSE CASE WHEN abs(az) <= 70 THEN 'front' WHEN abs(az) <= 130 THEN 'side' ELSE 'rear' END || CASE WHEN az > 0 THEN 'L' ELSE 'R' END END AS bus
  FROM ch JOIN sp USING (speaker_id)),
g AS (
  SELECT p_partkey // 6 AS scene, ['5.1', '7.1.4', 'venue'][p_partkey // 6 % 3 + 1] AS layout_id, ['sub', 'low', 'lowmid', 'mid', 'presence', 'air'][p_partkey % 6 + 1] AS band,
    (p_partkey * 7 % 9 + 5) / 10e0 AS fm, (p_partkey * 5 % 11 - 2) / 10e0 AS cm, (p_partkey * 3 % 13 - 1) / 10e0 AS fs, (p_partkey * 11 % 12 - 3) / 10e0 AS ss,
    (p_partkey * 13 % 10 - 2) / 10e0 AS rs, (p_partkey * 17 % 8 - 1) / 10e0 AS hs, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 5 / 5e0 ELSE 0 END AS lm,
    CASE WHEN p_partkey // 6 % 7 <> 0 THEN p_partkey // 6 % 5 / 4e0 ELSE 5e-1 END AS extract, p_partkey % 11 / 10e0 AS depth FROM part),
own AS (SELECT *, CASE WHEN layout_id <> 'venue' AND extract > 0 AND cm > 0 THEN cm * extract ELSE 0 END AS centre FROM g),
dec(band, pre, late) AS (VALUES ('lowmid', 7.0, 1.4), ('mid', 6.2, 1.7), ('presence', 5.4, 2.1), ('air', 4.6, 2.6)),
ears(ear, times) AS (VALUES ('L', 1.0), ('R', 1.7)),
rings(ring, ear, more, bands) AS (
  VALUES ('side', 'L', 0.0, 'lowmid mid presence air'), ('side', 'R', 0.0, 'lowmid mid presence air'), ('rear', 'L', 4.6, 'mid presence air'), ('rear', 'R', 5.3, 'mid presence air'),
         ('height', 'L', 9.4, 'mid presence air'), ('height', 'R', 10.6, 'mid presence air'), ('ground', 'L', 2.8, 'lowmid mid presence'), ('ground', 'R', 3.4, 'lowmid mid presence')),
routes AS (
  SELECT scene, 'mid:' || band AS path, 'centre' AS bus, centre AS gain, 0e0 AS ms FROM own
  UNION ALL SELECT scene, 'mid:' || band, 'front' || ear, greatest(0, fm - 0.3 * centre), 0e0 FROM own, ears
  UNION ALL SELECT scene, 'side:' || band, 'front' || ear, greatest(fs, 0) * CASE ear WHEN 'L' THEN 1 ELSE -1 END, 0e0 FROM own, ears
  UNION ALL SELECT scene, 'lfe', 'lfe', lm, 0e0 FROM own WHERE band = 'sub'
  UNION ALL
  SELECT scene, ear || CASE ring WHEN 'ground' THEN '-dark:' ELSE ':' END || band, ring || ear, greatest(0, CASE ring WHEN 'rear' THEN rs WHEN 'height' THEN hs ELSE ss END),
    pre::DOUBLE * (0.4e0 + 0.6e0 * depth) + late::DOUBLE * times::DOUBLE * depth + more::DOUBLE
  FROM own JOIN dec USING (band) JOIN rings ON list_contains(string_split(bands, ' '), own.band) JOIN ears USING (ear) WHERE ring <> 'ground' OR layout_id = 'venue'),
scenes AS (
  SELECT scene, layout_id, coalesce(CASE WHEN scene % 5 <> 0 THEN scene % 11 / 10e0 END, 5e-1) - 5e-1 AS turn, CASE WHEN scene % 3 <> 0 THEN -(scene % 7) ELSE -3 END AS lfe,
    CASE WHEN scene % 4 <> 0 THEN -(scene % 6) ELSE -3 END AS around, CASE WHEN scene % 2 <> 0 THEN -(scene % 9) ELSE -6 END AS above,
    0.5e0 + scene % 3 / 4e0 AS side, 0.6e0 + scene % 4 / 5e0 AS rear, 0.7e0 + scene % 5 / 10e0 AS height, 0.8e0 - scene % 2 / 5e0 AS ground FROM (SELECT DISTINCT scene, layout_id FROM g)),
power AS (SELECT *, 1 - greatest(0, turn) * 0.6e0 AS front, 1 - greatest(0, -turn) * 0.6e0 AS back FROM scenes),
levels AS (
  SELECT scene, layout_id, bus, CASE WHEN bus = 'centre' THEN 1 WHEN bus = 'lfe' THEN pow(10e0, lfe / 20e0) WHEN bus LIKE 'front%' THEN front
    WHEN bus LIKE 'height%' THEN pow(10e0, above / 20e0) * back * height WHEN bus LIKE 'ground%' AND layout_id <> 'venue' THEN 1
    ELSE pow(10e0, around / 20e0) * back * CASE WHEN bus LIKE 'side%' THEN side WHEN bus LIKE 'rear%' THEN rear ELSE ground END END AS level
  FROM power, (SELECT DISTINCT bus FROM taps))
SELECT scene, speaker_id, path, {rs("gain * level * tap", 6)} AS gain, {rs("ms", 6)} AS delay_ms
FROM routes JOIN levels USING (scene, bus) JOIN taps USING (layout_id, bus) WHERE gain <> 0""")
def scene_feed_gains(spark, sf):
    """What of each path reaches each speaker of each planned scene, and when."""
    rows = _scene_rows(spark, sf)
    tapped = feeds.taps(dims.speakers(spark), dims.layout_channels(spark))
    out = feeds.feed_gains(rows, _scenes(rows), tapped)
    return out.select("scene", "speaker_id", "path", r(c("gain"), 6).alias("gain"), r(c("delay_ms"), 6).alias("delay_ms"))


_MIX = "(('L', 'a', 5, 0), ('L', 'b', 3, 7), ('R', 'a', -4, 19), ('R', 'b', 2, 3))"


@query(f"""
WITH e AS (SELECT vec_id, CASE WHEN i < 32 THEN 'a' ELSE 'b' END AS path, i % 32 AS i, x FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)),
m AS (SELECT vec_id, speaker_id, path, factor * (vec_id % 5 + 1) / 10e0 AS gain, late * (vec_id % 3 + 1) AS late
      FROM (SELECT DISTINCT vec_id FROM e), (VALUES {_MIX[1:-1]}) v(speaker_id, path, factor, late))
SELECT vec_id, speaker_id, i + late AS frame, {rs("sum(x * gain)", 6)} AS y FROM e JOIN m USING (vec_id, path) WHERE i + late < 32 GROUP BY ALL""")
def mixed_feeds(spark, sf):
    """Halves of each vector as two paths in chunks of eight frames, mixed to two speakers with delays that cross chunks."""
    e = table(spark, sf, "embeddings").select(c("vec_id").alias("clip_id"), c("embedding").cast("array<double>").alias("e"))
    cut = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    paths = e.select("clip_id", "e", cut).select("clip_id", F.when(c("k") < 4, "a").otherwise("b").alias("path"), (c("k") % 4).cast("long").alias("chunk_idx"), F.slice("e", c("k") * 8 + 1, F.lit(8)).alias("samples"))
    fixed = F.array(*(F.struct(F.lit(s).alias("speaker_id"), F.lit(p).alias("path"), F.lit(g).alias("by"), F.lit(t).alias("late")) for s, p, g, t in (("L", "a", 5, 0), ("L", "b", 3, 7), ("R", "a", -4, 19), ("R", "b", 2, 3))))
    v = c("clip_id")
    gains = e.select("clip_id", F.inline(fixed)).select("clip_id", "speaker_id", "path", (c("by") * (v % 5 + 1) / 10).alias("gain"), (c("late") * (v % 3 + 1)).cast("double").alias("delay_ms"))
    out = feeds.mixed(paths, gains, 8, 1000).select(c("clip_id").alias("vec_id"), "speaker_id", "chunk_idx", F.posexplode("samples").alias("i", "y"))
    first = F.when(c("speaker_id") == "L", 0).otherwise(F.least(F.lit(19), F.lit(3)) * (c("vec_id") % 3 + 1))  # frames before a speaker's first path are silent
    return out.select("vec_id", "speaker_id", (c("chunk_idx") * 8 + c("i")).alias("frame"), r(c("y"), 6).alias("y")).where(c("frame") >= first)


@query(designs.query.oracles["true_peaks"])
def live_true_peaks(spark, sf):
    """The peaks of ``true_peaks`` from chunks of sixteen components that reach a stateful meter one by one."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STORE)
    k = c("k")
    cut = table(spark, sf, "embeddings").select(c("vec_id").alias("clip_id"), "embedding", F.explode(F.sequence(F.lit(0), F.ceil(F.size("embedding") / 16).cast("int") - 1)).alias("k"))
    chunks = cut.select("clip_id", F.lit(0).alias("channel"), k.alias("chunk_idx"), F.timestamp_seconds(k).alias("ts"), F.slice("embedding", k * 16 + 1, F.lit(16)).alias("samples"), ((k + 1) * 16 >= F.size("embedding")).alias("final"))
    return live.true_peaks(chunks, 48_000).where("ended").select(c("clip_id").alias("vec_id"), r(c("peak"), 5).alias("peak"))


@query(f"""
WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
b AS (
  SELECT e.vec_id, e.i, (CASE WHEN e.vec_id % 3 = 0 THEN -8e-1 ELSE 8e-1 END) * coalesce(s.x, 0) + 5e-2 * coalesce(o.x, 0) AS y
  FROM e LEFT JOIN e s ON s.vec_id = e.vec_id AND s.i = e.i + e.vec_id % 13 - 6 LEFT JOIN e o ON o.vec_id = e.vec_id + 1 AND o.i = e.i),
d AS (SELECT b.vec_id, lag, sum(y * x) AS product, sum(x * x) AS square FROM b, (SELECT unnest(range(-20, 21)) AS lag), e WHERE e.vec_id = b.vec_id AND e.i = b.i + lag GROUP BY ALL),
best AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(product) DESC, lag) = 1),
g AS (SELECT *, product / (square + 1e-20) AS gain, (SELECT sum(y * y) FROM b WHERE b.vec_id = best.vec_id) AS energy FROM best)
SELECT vec_id, lag, {rs("gain", 5)} AS gain, {rs("10 * log10((greatest(0, energy - 2 * gain * product + gain * gain * square) + 1e-20) / (energy + 1e-20))", 3)} AS residual_db, gain < 0 AS inverted FROM g""")
def aligned_takes(spark, sf):
    """Lag, gain and residual of a vector and a shifted, scaled take of it with some of the next vector in it."""
    e = table(spark, sf, "embeddings").select(c("vec_id").alias("pair"), c("embedding").cast("array<double>").alias("e"))
    both = e.join(e.select((c("pair") - 1).alias("pair"), c("e").alias("o")), "pair", "left")
    at = lambda i: F.get("e", (i + c("pair") % 13 - 6).cast("int"))
    gain = F.when(c("pair") % 3 == 0, -0.8).otherwise(0.8)
    take = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: gain * F.coalesce(at(i), F.lit(0.0)) + 0.05 * F.coalesce(F.get("o", i), F.lit(0.0)))
    cut = lambda df, v: df.select("pair", v.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("pair", c("k").cast("long").alias("chunk_idx"), F.slice("v", c("k") * 16 + 1, F.lit(16)).alias("samples"))
    a, b = cut(e, c("e")), cut(both, take)
    fit = alignment.residuals(alignment.best_fit(alignment.lag_sums(a, b, "pair", 16, 20), "pair"), a, b, "pair", 16)
    return fit.select(c("pair").alias("vec_id"), c("lag").cast("long").alias("lag"), r(c("gain"), 5).alias("gain"), r(c("residual_db"), 3).alias("residual_db"), "inverted")


@query(f"""
WITH {_SIGNAL},
p AS (SELECT event_type, i, x, sum(x * x) OVER (PARTITION BY event_type ORDER BY i RANGE BETWEEN 4 PRECEDING AND 3 FOLLOWING) / 8 AS energy FROM e),
d AS (
  SELECT *, lead(energy) OVER w - energy AS rise, count(*) OVER (PARTITION BY event_type) AS n, avg(energy) OVER (w RANGE BETWEEN CURRENT ROW AND 7 FOLLOWING) AS attack,
    avg(energy) OVER (w RANGE BETWEEN 8 FOLLOWING AND 79 FOLLOWING) AS rest, max(abs(x)) OVER (w RANGE BETWEEN CURRENT ROW AND 7 FOLLOWING) AS peak
  FROM p WINDOW w AS (PARTITION BY event_type ORDER BY i)),
bar AS (SELECT event_type, quantile_cont(abs(rise), 0.99) AS bar FROM d GROUP BY event_type),
o AS (
  SELECT d.*, row_number() OVER (PARTITION BY event_type ORDER BY i) - 1 AS k, greatest(1, count(*) OVER (PARTITION BY event_type) // 60) AS step
  FROM d JOIN bar USING (event_type) WHERE rise > bar)
SELECT event_type, i AS frame, {rs("10 * log10((attack + 1e-18) / (rest + 1e-18))", 4)} AS ratio_db, {rs("peak", 6)} AS peak
FROM o WHERE k % step = 0 AND k < step * 60 AND i + 16 <= n""")
def series_onsets(spark, sf):
    """Onsets of each type's signal (windows of eight frames), with their attacks."""
    frames_ = _signal(spark, sf).select("event_type", "chunk_idx", F.posexplode("samples").alias("i", "value")).select("event_type", (c("chunk_idx") * CHUNK + c("i")).alias("frame"), "value")
    found = onsets.attacks(frames_, "event_type", 8, stretch=512)
    return found.select("event_type", "frame", r(c("ratio_db"), 4).alias("ratio_db"), r(c("peak"), 6).alias("peak"))


@query(f"""
WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
b AS (SELECT vec_id, k, -0.691 + 10 * log10(greatest(sum(x * x) / 16, 1e-30)) AS level FROM e, (SELECT unnest(range(7)) AS k) WHERE i BETWEEN k * 8 AND k * 8 + 15 GROUP BY ALL),
h AS (SELECT vec_id % 25 AS series, CAST(floor((level + 70) * 10) AS BIGINT) AS bin, count(*) AS n FROM b WHERE level > -70 GROUP BY ALL),
c AS (SELECT *, (bin + 5e-1) / 10 - 70 AS centre FROM h),
g AS (SELECT series, -0.691 + 10 * log10(sum(n * pow(10, (centre + 0.691) / 10)) / sum(n)) - 10 AS bar FROM c GROUP BY series)
SELECT series, {rs("-0.691 + 10 * log10(sum(n * pow(10, (centre + 0.691) / 10)) / sum(n))", 5)} AS level FROM c JOIN g USING (series) WHERE centre > bar GROUP BY series""")
def gated_by_histogram(spark, sf):
    """Gated level of groups of vectors, in SQL text: a table function makes the levels, histograms of them merge."""
    tables.register(spark)
    return spark.sql("""
      WITH b AS (SELECT e.vec_id % 25 AS series, l.level FROM {e} e, LATERAL hop_levels(e.embedding, 16, 8) l),
      h AS (SELECT series, level_bin(level) AS bin, count(*) AS n FROM b GROUP BY ALL)
      SELECT series, floor(gated_level(level_bins(collect_list(struct(bin, n)))) * 100000 + 0.5D) / 100000 AS level FROM h GROUP BY series""", e=table(spark, sf, "embeddings"))


def _analogue(t: str, name: str) -> str:
    """Real and imaginary parts of second-order Butterworth responses at t = tan(pi f / rate) / tan(pi corner / rate)."""
    d = f"((1 - {t} * {t}) * (1 - {t} * {t}) + 2 * {t} * {t})"
    return f"""(1 - {t} * {t}) / {d} AS {name}r, -sqrt(2) * {t} / {d} AS {name}i, {t} AS {name}x"""


@query(f"""
WITH p AS (SELECT p_partkey AS k, [44100, 48000, 96000, 192000][1 + p_partkey % 4] AS rate, p_partkey % 199 * 100.0 + 30 AS spot, p_partkey % 5 / 4e0 AS mix FROM part),
t AS (SELECT *, tan(pi() * spot / rate) / tan(pi() * 140 / rate) AS a, tan(pi() * spot / rate) / tan(pi() * 3200 / rate) AS b FROM p),
o AS (SELECT k, mix, {_analogue("a", "a")}, {_analogue("b", "b")} FROM t),
q AS (
  SELECT *, ar * ar - ai * ai AS alr, 2 * ar * ai AS ali, br * br - bi * bi AS blr, 2 * br * bi AS bli, pow(ax, 4) AS ag, pow(bx, 4) AS bg,
    (1 - ax * ax) * ar + sqrt(2) * ax * ai AS apr, (1 - ax * ax) * ai - sqrt(2) * ax * ar AS api, (1 - bx * bx) * br + sqrt(2) * bx * bi AS bpr, (1 - bx * bx) * bi - sqrt(2) * bx * br AS bpi FROM o),
s AS (
  SELECT k, mix, alr + ag * (alr * blr - ali * bli) + bg * blr AS pr, ali + ag * (alr * bli + ali * blr) + bg * bli AS pi_,
    alr * bpr - ali * bpi + ag * (1 + bg) * (alr * blr - ali * bli) AS tr, alr * bpi + ali * bpr + ag * (1 + bg) * (alr * bli + ali * blr) AS ti,
    apr * bpr - api * bpi AS dr, apr * bpi + api * bpr AS di FROM q)
SELECT k AS p_partkey, {rs("20 * log10(greatest(1e-6, sqrt(pow(pr * mix + 1 - mix, 2) + pow(pi_ * mix, 2))))", 4)} AS parallel_db,
  {rs("20 * log10(greatest(1e-6, sqrt(pow(tr * mix + dr * (1 - mix), 2) + pow(ti * mix + di * (1 - mix), 2))))", 4)} AS tree_db FROM s""")
def multiband_sums(spark, sf):
    """What the older parallel bands and the tree add up to, with dry shares from none to all; in SQL from the analogue filters."""
    k = c("p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, (44100, 48000, 96000, 192000))), (k % 4 + 1).cast("int")).alias("rate"), (k % 199 * 100.0 + 30).alias("at"), (k % 5 / 4.0).alias("mix"))
    own = responses.with_parts(rows, "at", "rate", 140.0, 3200.0)
    db = lambda layout: r(responses.magnitude_db(layout(c("mix"))))
    return own.select("p_partkey", db(responses.parallel).alias("parallel_db"), db(responses.tree).alias("tree_db"))
