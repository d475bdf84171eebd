"""Registered queries on generated signals, files and clip kernels, with SQL that makes the same signals by formula."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import immersive, kernels, levels
from tidemark.plans.base import Registry, r, rs, table, values
from tidemark.plans.designs import _BANK, _E, _LE16, _LE32
from tidemark.sources import containers, signals

query = Registry()
c = F.col

_SINES = [("sine-1k", 1000, 0.5), *(("multitone", f, 0.1) for f in (61, 149, 397, 1009, 2503, 5003, 9001)), ("hard-left", 440, 0.5), *(("bright-synthetic", f, 0.15) for f in (9000, 11000, 13000)), ("clipped-source", 220, 1.4), *((f"bass-{f}", f, 0.5) for f in (40, 50, 60, 80, 100)), ("silence", 1, 0.0)]
_CLIPS = sorted({n for n, _, _ in _SINES} | {"impulse", "sine-sweep", "extreme-dynamics"})


@query(f"""
WITH t AS (SELECT unnest(range(192000)) AS n),
s AS (SELECT clip_id, n, sum(amp * sin(2 * pi() * hz * n / 48000)) AS x FROM {values(_SINES, "clip_id, hz, amp")}, t GROUP BY clip_id, n),
x AS (
  SELECT clip_id, n, CASE WHEN clip_id = 'clipped-source' THEN least(0.89, greatest(-0.89, x))
    WHEN clip_id LIKE 'bass-%' THEN x * CASE WHEN n < 480 THEN 0.5 - 0.5 * cos(pi() * n / 480) WHEN n >= 191520 THEN 0.5 - 0.5 * cos(pi() * (191999 - n) / 480) ELSE 1 END ELSE x END AS x FROM s
  UNION ALL SELECT 'impulse', n, CASE WHEN n = 64 THEN 1.0 ELSE 0.0 END FROM t WHERE n < 24000
  UNION ALL SELECT 'sine-sweep', n, 0.5 * sin(2 * pi() * 20 * 2 / ln(1000) * (exp(n / 48000.0 / 2 * ln(1000)) - 1)) FROM t WHERE n < 96000
  UNION ALL SELECT 'extreme-dynamics', n, 0.0005 * sin(2 * pi() * 500 * n / 48000) FROM t UNION ALL SELECT 'extreme-dynamics', n + 192000, 0.5 * sin(2 * pi() * 500 * n / 48000) FROM t),
y AS (SELECT clip_id, ch AS channel, n, (CASE WHEN clip_id = 'hard-left' AND ch = 1 THEN 0 ELSE x END)::FLOAT::DOUBLE AS x FROM x, (VALUES (0), (1)) AS v(ch))
SELECT clip_id, channel, count(*) AS n_frames, {rs("max(abs(x))", 5)} AS peak, {rs("sqrt(avg(x * x))", 5)} AS rms, {rs("CASE WHEN max(abs(x)) = 0 THEN 0 ELSE 20 * log10(greatest(max(abs(x)), 1e-9)) - 20 * log10(greatest(sqrt(avg(x * x)), 1e-9)) END", 3)} AS crest_db FROM y GROUP BY clip_id, channel""")
def generated_signals(spark, sf):
    """Length and levels of every generated clip that has a formula."""
    own = signals.chunks(spark, _CLIPS).select("clip_id", "channel", F.explode("samples").alias("v"))
    x = c("v").cast("double")
    return own.groupBy("clip_id", "channel").agg(F.count(F.lit(1)).alias("n_frames"), r(levels.peak(x), 5).alias("peak"), r(levels.rms(x), 5).alias("rms"), r(levels.crest_db(x), 3).alias("crest_db"))


@query("""
SELECT n, channel, channel AS detected, channel AS beeps FROM (SELECT n, unnest(range(1, n + 1)) AS channel FROM (SELECT DISTINCT 2 + p_size % 7 AS n FROM part))""")
def channel_identification(spark, sf):
    """Tone and beeps found in each channel of the identification signals of the sizes that a table asks for."""
    asked = table(spark, sf, "part").select((2 + c("p_size") % 7).cast("int").alias("n")).distinct()

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(n, ch, tone, beeps) for n in b["n"].tolist() for ch, tone, _, beeps in immersive.identify(signals.identification(n), signals.RATE)], columns=["n", "channel", "detected", "beeps"])

    return asked.repartition(7).mapInPandas(run, "n int, channel long, detected long, beeps long")


@query("""
WITH f AS (SELECT o_orderkey, CAST(floor(o_totalprice * 20000) AS BIGINT) AS data, 16 + 24 * (o_orderkey % 2) AS fmt FROM orders),
b AS (SELECT *, 4 + 8 + fmt + 8 + data + data % 2 AS body FROM f)
SELECT o_orderkey, CASE WHEN body > 4294967295 THEN 'BW64' ELSE 'RIFF' END AS container, CASE WHEN body > 4294967295 THEN body + 44 ELSE body + 8 END AS total_bytes, CASE WHEN body > 4294967295 THEN 56 ELSE 20 END + fmt AS data_at FROM b""")
def riff_plans(spark, sf):
    """Container, size and place of the samples of files up to ten gigabytes."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.floor(c("o_totalprice") * 20000).alias("data"), (16 + 24 * (c("o_orderkey") % 2)).alias("fmt"))

    def run(batches):
        for b in batches:
            out = []
            for k, data, fmt in zip(b["o_orderkey"].tolist(), b["data"].tolist(), b["fmt"].tolist(), strict=True):
                plan = containers.plan_riff([("fmt ", fmt), ("data", data)], most=None)
                out.append((k, plan["container"], plan["total_bytes"], plan["chunks"][-1]["offset"]))
            yield pd.DataFrame(out, columns=["o_orderkey", "container", "total_bytes", "data_at"])

    return rows.mapInPandas(run, "o_orderkey long, container string, total_bytes long, data_at long")


@query("""
WITH v AS (SELECT o_orderkey, 1 + o_custkey * 977 % 400000 AS v FROM orders), e AS (SELECT *, CAST(floor(log2(v)) AS BIGINT) AS e FROM v)
SELECT o_orderkey, printf('%04X', 16383 + e) || printf('%08X', v << (31 - e)) || '00000000' AS bytes, v::DOUBLE AS back FROM e""")
def extended_floats(spark, sf):
    """80-bit floats of whole numbers, and what is read from them."""
    rows = table(spark, sf, "orders").select("o_orderkey", (1 + c("o_custkey") * 977 % 400_000).alias("v"))

    def run(batches):
        for b in batches:
            raws = [containers.float80(v) for v in b["v"].tolist()]
            yield pd.DataFrame({"o_orderkey": b["o_orderkey"], "bytes": [x.hex().upper() for x in raws], "back": [containers.read_float80(x) for x in raws]})

    return rows.mapInPandas(run, "o_orderkey long, bytes string, back double")


_PCM16 = f"{_E}, q AS (SELECT vec_id, i, n, CAST(least(32767, floor(greatest(-1, least(1, x)) * 32768 + 0.5)) AS BIGINT) AS q FROM e)"


@query(f"""
WITH {_PCM16}, d AS (SELECT vec_id, any_value(n) AS n, string_agg({_LE16("q & 65535")}, '' ORDER BY i) AS body FROM q GROUP BY vec_id)
SELECT vec_id, 44 + 2 * n AS bytes, sha256(unhex('52494646' || {_LE32("36 + 2 * n")} || '57415645' || '666d7420' || '10000000' || '01000200' || {_LE32("44100")} || {_LE32("176400")} || '04001000' || '64617461' || {_LE32("2 * n")} || body)) AS sha256 FROM d""")
def streamed_files(spark, sf):
    """Each vector as a stereo file, written five frames at a time."""

    @F.pandas_udf("binary")
    def write(e: pd.Series) -> pd.Series:
        out = []
        for v in e:
            x, sink = np.asarray(v, np.float32).reshape(-1, 2).T, io.BytesIO()
            containers.stream_wav(sink, (x[:, a : a + 5] for a in range(0, x.shape[1], 5)), 2, x.shape[1], 44_100, 16)
            out.append(sink.getvalue())
        return pd.Series(out)

    return table(spark, sf, "embeddings").select("vec_id", write("embedding").alias("raw")).select("vec_id", F.length("raw").cast("bigint").alias("bytes"), F.sha2("raw", 256).alias("sha256"))


_BE16 = lambda v: f"printf('%02x%02x', (({v}) >> 8) & 255, ({v}) & 255)"
_BE32 = lambda v: f"printf('%02x%02x%02x%02x', (({v}) >> 24) & 255, (({v}) >> 16) & 255, (({v}) >> 8) & 255, ({v}) & 255)"


@query(f"""
WITH {_PCM16}, d AS (SELECT vec_id, any_value(n) AS n, string_agg({_BE16("q & 65535")}, '' ORDER BY i) AS body FROM q GROUP BY vec_id)
SELECT vec_id, sha256(unhex('464f524d' || {_BE32("4 + 8 + 18 + 8 + 8 + 2 * n")} || '41494646' || '434f4d4d' || '00000012' || '0001' || {_BE32("n")} || '0010' || '400ebb80000000000000' || '53534e44' || {_BE32("8 + 2 * n")} || '0000000000000000' || body)) AS sha256 FROM d""")
def aiff_files(spark, sf):
    @F.pandas_udf("binary")
    def write(e: pd.Series) -> pd.Series:
        return pd.Series([containers.write_aiff(np.asarray(x, np.float32)[None], 48_000, 16) for x in e])

    return table(spark, sf, "embeddings").select("vec_id", F.sha2(write("embedding"), 256).alias("sha256"))


@query(f"""
WITH {_PCM16} SELECT vec_id, i, {rs("q / 32768.0", 7)} AS x FROM q WHERE i >= 10 AND i < 40""")
def frames_of_files(spark, sf):
    """Thirty frames from the tenth on, read from each vector's file."""

    @F.pandas_udf("array<double>")
    def read(e: pd.Series) -> pd.Series:
        files = (io.BytesIO(containers.write_wav(np.asarray(x, np.float32)[None], 48_000, 16)) for x in e)
        return pd.Series([np.concatenate([b[0] for _, b, _ in containers.frame_blocks(f, 10, 30, 7)]).astype(np.float64) for f in files])

    out = table(spark, sf, "embeddings").select("vec_id", F.posexplode(read("embedding")).alias("i", "v"))
    return out.select("vec_id", (c("i") + 10).cast("bigint").alias("i"), r(c("v"), 7).alias("x"))


def _pole(ms: float) -> str:
    return f"(1 - exp(-1 / ({ms} / 1000 * 8000)))"


@query(f"""
WITH RECURSIVE {_E},
d AS (SELECT vec_id, 0::BIGINT AS i, abs(x) * {_pole(1)} AS d FROM e WHERE i = 0 UNION ALL SELECT e.vec_id, e.i, d.d + (abs(e.x) - d.d) * {_pole(1)} FROM d JOIN e ON e.vec_id = d.vec_id AND e.i = d.i + 1),
f AS (
  SELECT vec_id, i, d * {_pole(2)} AS fast, d * {_pole(50)} AS slow FROM d WHERE i = 0
  UNION ALL SELECT d.vec_id, d.i, f.fast + (d.d - f.fast) * CASE WHEN d.d > f.fast THEN {_pole(2)} ELSE {_pole(20)} END, f.slow + (d.d - f.slow) * CASE WHEN d.d > f.slow THEN {_pole(50)} ELSE {_pole(180)} END
  FROM f JOIN d ON d.vec_id = f.vec_id AND d.i = f.i + 1),
g AS (SELECT f.vec_id, f.i, x, least(12, greatest(-12, 0.6 * greatest(0, fast - slow) / (fast + 1e-9) * 6 - 0.2 * least(1, greatest(0, slow / (fast + 1e-9))) * 6)) AS db FROM f JOIN e USING (vec_id, i))
SELECT vec_id, i, {rs("(x * pow(10, db / 20))::FLOAT::DOUBLE", 5)} AS y FROM g""")
def shaped_transients(spark, sf):
    """Vectors at 8 kHz with more attack and less sustain: the kernel against the recursion."""

    @F.pandas_udf("array<double>")
    def run(e: pd.Series) -> pd.Series:
        return pd.Series([kernels.shape_transients(np.asarray(x, np.float64)[None], 8000, 60, -20)[0].astype(np.float64) for x in e])

    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(run("embedding")).alias("i", "v")).select("vec_id", c("i").cast("bigint").alias("i"), r(c("v"), 5).alias("y"))


@query(f"""
WITH {_E}, b AS (SELECT h, 256 * h + d AS bin FROM (SELECT unnest(range(1, 9)) AS h), (SELECT unnest(range(-2, 3)) AS d)),
m AS (SELECT vec_id, h, sqrt(pow(sum(w * cos(2 * pi() * bin * i / 8192)), 2) + pow(sum(w * sin(2 * pi() * bin * i / 8192)), 2)) AS m FROM (SELECT vec_id, i, x * (0.5 - 0.5 * cos(2 * pi() * i / 8192)) AS w FROM e), b GROUP BY vec_id, h, bin),
p AS (SELECT vec_id, h, max(m) AS m FROM m GROUP BY vec_id, h)
SELECT vec_id, h, {rs("20 * log10(greatest(m / max(m) OVER (PARTITION BY vec_id), 1e-6))", 3)} AS db FROM p""")
def harmonic_levels(spark, sf):
    """Levels of eight harmonics of 1.5 kHz, against the loudest."""

    @F.pandas_udf("array<double>")
    def run(e: pd.Series) -> pd.Series:
        return pd.Series([kernels.harmonics(np.asarray(x, np.float32), 48_000, 1500.0) for x in e])

    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(run("embedding")).alias("i", "v")).select("vec_id", (c("i") + 1).cast("bigint").alias("h"), r(c("v"), 3).alias("db"))


@query(f"""
WITH g AS (SELECT 4 AS factor, 8 AS taps), {_BANK}, w AS (SELECT phase, tap, v / sum(v) OVER (PARTITION BY phase) AS weight FROM bank), {_E},
y AS (SELECT e.vec_id, phase, i - tap AS spot, sum(weight * x) AS v FROM e JOIN w ON phase > 0 AND i - tap BETWEEN 0 AND n - 9 AND (i - tap) % 2 = 0 GROUP BY ALL)
SELECT vec_id, {rs("greatest(max(abs(v)), (SELECT max(abs(x)) FROM e e2 WHERE e2.vec_id = y.vec_id))", 5)} AS peak FROM y GROUP BY vec_id""")
def quick_peaks(spark, sf):
    """The quick peak estimate, around every second component."""

    @F.pandas_udf("double")
    def peak(e: pd.Series) -> pd.Series:
        return pd.Series([kernels.true_peak_estimate(np.asarray(x, np.float32), 48_000, 2) for x in e])

    return table(spark, sf, "embeddings").select("vec_id", r(peak("embedding"), 5).alias("peak"))


_RINGS = ["L", "R", "C", "LFE", "Ls", "Rrs", "Ltf", "Rtr", "Lw"]


@query(f"""
WITH v AS (SELECT p_partkey, sp, p_partkey * w % 17 / 16.0 AS v FROM part, {values([(sp, i + 3) for i, sp in enumerate(_RINGS)], "sp, w")}),
s AS (SELECT p_partkey, sum(CASE WHEN sp = 'LFE' THEN v * v ELSE 0 END) AS lfe, sum(CASE WHEN sp IN ('Ltf', 'Rtr') THEN v * v ELSE 0 END) AS height, sum(CASE WHEN sp IN ('L', 'R', 'C', 'Lw') THEN v * v ELSE 0 END) AS front, sum(CASE WHEN sp IN ('Ls', 'Rrs') THEN v * v ELSE 0 END) AS surround, sum(v * v) AS total FROM v GROUP BY p_partkey)
SELECT p_partkey, {', '.join(rs(f"CASE WHEN total > 0 THEN 100 * {k} / total ELSE 0 END", 5) + f" AS {k}" for k in ("front", "surround", "height", "lfe"))} FROM s""")
def spatial_energy(spark, sf):
    """Shares of energy by ring, from levels by speaker."""

    def run(batches):
        for b in batches:
            own = [kernels.spatial_energy({sp: k * (i + 3) % 17 / 16 for i, sp in enumerate(_RINGS)}) for k in b["p_partkey"].tolist()]
            yield pd.DataFrame(own).assign(p_partkey=b["p_partkey"].to_numpy())[["p_partkey", "front", "surround", "height", "lfe"]]

    out = table(spark, sf, "part").select("p_partkey").mapInPandas(run, "p_partkey long, front double, surround double, height double, lfe double")
    return out.select("p_partkey", *(r(c(k), 5).alias(k) for k in ("front", "surround", "height", "lfe")))
