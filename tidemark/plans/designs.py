"""Registered queries on filters, windows, random numbers and kernels that have a closed form or a short recursion in SQL."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import design
from tidemark.operators import adm, dims, immersive, kernels
from tidemark.plans.base import Registry, asked, r, rs, table, values
from tidemark.sources import containers

query = Registry()
c = F.col
KINDS = ["lowpass", "highpass", "bandpass", "notch", "allpass", "peaking", "lowshelf", "highshelf"]
RATES = [44100, 48000, 96000, 192000]


def _over(rows, keys: list[str], schema: str, fn):
    """Rows (keys and further columns) through ``fn(pdf) -> pdf`` in Arrow batches."""

    def run(batches):
        for pdf in batches:
            yield fn(pdf)

    return rows.mapInPandas(run, schema)


def _pick(choices: list, k):
    return F.element_at(F.array(*map(F.lit, choices)), (k % len(choices) + 1).cast("int"))


def _filters(spark, sf):
    k = c("p_partkey")
    return table(spark, sf, "part").select("p_partkey", _pick(KINDS, k).alias("kind"), (k % 97 * 150.0 + 40).alias("freq"), (k % 13 * 0.25 + 0.3).alias("q"), (k % 25 - 12.0).alias("gain"), _pick(RATES, k).alias("rate"), (k % 41 * 333.0 + 25).alias("at"))


_COEF = f"""
WITH p AS (SELECT p_partkey AS k, p_partkey % 8 AS kind, p_partkey % 97 * 150.0 + 40 AS freq, p_partkey % 13 * 0.25 + 0.3 AS q, p_partkey % 25 - 12.0 AS gain, {[44100, 48000, 96000, 192000]}[1 + p_partkey % 4] AS rate, p_partkey % 41 * 333.0 + 25 AS spot FROM part),
w AS (SELECT *, cos(2 * pi() * least(freq, rate / 2 * 0.999) / rate) AS cw, sin(2 * pi() * least(freq, rate / 2 * 0.999) / rate) / (2 * q) AS al, pow(10, gain / 40) AS a FROM p),
v AS (SELECT *, 2 * sqrt(a) * al AS ro FROM w),
n AS (SELECT k, rate, spot,
  CASE kind WHEN 0 THEN [(1 - cw) / 2, 1 - cw, (1 - cw) / 2] WHEN 1 THEN [(1 + cw) / 2, -1 - cw, (1 + cw) / 2] WHEN 2 THEN [al, 0, -al] WHEN 3 THEN [1, -2 * cw, 1] WHEN 4 THEN [1 - al, -2 * cw, 1 + al]
    WHEN 5 THEN [1 + al * a, -2 * cw, 1 - al * a] WHEN 6 THEN [a * (a + 1 - (a - 1) * cw + ro), 2 * a * (a - 1 - (a + 1) * cw), a * (a + 1 - (a - 1) * cw - ro)] ELSE [a * (a + 1 + (a - 1) * cw + ro), -2 * a * (a - 1 + (a + 1) * cw), a * (a + 1 + (a - 1) * cw - ro)] END AS b,
  CASE WHEN kind <= 4 THEN [1 + al, -2 * cw, 1 - al] WHEN kind = 5 THEN [1 + al / a, -2 * cw, 1 - al / a]
    WHEN kind = 6 THEN [a + 1 + (a - 1) * cw + ro, -2 * (a - 1 + (a + 1) * cw), a + 1 + (a - 1) * cw - ro] ELSE [a + 1 - (a - 1) * cw + ro, 2 * (a - 1 - (a + 1) * cw), a + 1 - (a - 1) * cw - ro] END AS d FROM v),
f AS (SELECT k, rate, spot, b[1] / d[1] AS b0, b[2] / d[1] AS b1, b[3] / d[1] AS b2, d[2] / d[1] AS a1, d[3] / d[1] AS a2 FROM n)
"""


@query(_COEF + f"SELECT k AS p_partkey, {', '.join(rs(x, 8) + ' AS ' + x for x in ('b0', 'b1', 'b2', 'a1', 'a2'))} FROM f")
def biquad_coefficients(spark, sf):
    """Coefficients of eight kinds of filter at various frequencies, widths, gains and rates."""
    names = ["b0", "b1", "b2", "a1", "a2"]

    def fn(pdf):
        own = [design.biquad(*x) for x in zip(pdf["kind"], pdf["freq"], pdf["q"], pdf["gain"], pdf["rate"], strict=True)]
        return pd.DataFrame(own, columns=names).assign(p_partkey=pdf["p_partkey"].to_numpy())[["p_partkey", *names]]

    out = _over(_filters(spark, sf), ["p_partkey"], "p_partkey long, b0 double, b1 double, b2 double, a1 double, a2 double", fn)
    return out.select("p_partkey", *(r(c(x), 8).alias(x) for x in names))


@query(_COEF + f"""
, w2 AS (SELECT *, 2 * pi() * spot / rate AS w FROM f),
m AS (SELECT k, (b0 + b1 * cos(w) + b2 * cos(2 * w)) AS nr, (b1 * sin(w) + b2 * sin(2 * w)) AS ni, (1 + a1 * cos(w) + a2 * cos(2 * w)) AS dr, (a1 * sin(w) + a2 * sin(2 * w)) AS di FROM w2)
SELECT k AS p_partkey, {rs("10 * log10(greatest((nr * nr + ni * ni) / (dr * dr + di * di), 1e-12))")} AS db FROM m""")
def biquad_responses(spark, sf):
    """Magnitude of a filter at one frequency."""

    def fn(pdf):
        own = []
        for kind, freq, q, gain, rate, at in zip(*(pdf[x] for x in ("kind", "freq", "q", "gain", "rate", "at")), strict=True):
            own.append(10 * np.log10(max(abs(design.response([design.biquad(kind, freq, q, gain, rate)], [at], rate)[0]) ** 2, 1e-12)))
        return pd.DataFrame({"p_partkey": pdf["p_partkey"], "db": own})

    return _over(_filters(spark, sf), ["p_partkey"], "p_partkey long, db double", fn).select("p_partkey", r(c("db")).alias("db"))


_K = """
WITH p AS (SELECT o_orderkey AS k, 8000.0 + o_orderkey % 185 * 1000 AS rate FROM orders),
t AS (SELECT *, tan(pi() * 1681.974450955533 / rate) AS s, tan(pi() * 38.13547087602444 / rate) AS h, pow(10, 3.999843853973347 / 20) AS vh FROM p),
u AS (SELECT *, pow(vh, 0.4996667741545416) AS vb, 1 + s / 0.7071752369554196 + s * s AS d1, 1 + h / 0.5003270373238773 + h * h AS d2 FROM t)
"""


@query(_K + f"""
SELECT k AS o_orderkey, {rs("(vh + vb * s / 0.7071752369554196 + s * s) / d1", 9)} AS shelf_b0, {rs("2 * (s * s - vh) / d1", 9)} AS shelf_b1, {rs("(1 - s / 0.7071752369554196 + s * s) / d1", 9)} AS shelf_a2,
  {rs("2 * (h * h - 1) / d2", 9)} AS high_a1, {rs("(1 - h / 0.5003270373238773 + h * h) / d2", 9)} AS high_a2 FROM u""")
def k_weighting_filters(spark, sf):
    """The two stages of K-weighting at 185 sample rates."""
    rows = table(spark, sf, "orders").select("o_orderkey", (8000.0 + c("o_orderkey") % 185 * 1000).alias("rate"))

    def fn(pdf):
        own = {x: design.k_weighting(x) for x in pdf["rate"].unique()}
        got = [(k, own[x][0][0], own[x][0][1], own[x][0][4], own[x][1][3], own[x][1][4]) for k, x in zip(pdf["o_orderkey"], pdf["rate"], strict=True)]
        return pd.DataFrame(got, columns=["o_orderkey", "shelf_b0", "shelf_b1", "shelf_a2", "high_a1", "high_a2"])

    out = _over(rows, ["o_orderkey"], "o_orderkey long, shelf_b0 double, shelf_b1 double, shelf_a2 double, high_a1 double, high_a2 double", fn)
    return out.select("o_orderkey", *(r(c(x), 9).alias(x) for x in out.columns[1:]))


_LR = """
WITH p AS (SELECT p_partkey AS k, [44100, 48000, 96000, 192000][1 + p_partkey % 4] AS rate, p_partkey % 199 * 100.0 + 30 AS spot FROM part),
t AS (SELECT *, pow(tan(pi() * spot / rate) / tan(pi() * 140 / rate), 4) AS lo, pow(tan(pi() * spot / rate) / tan(pi() * 3200 / rate), 4) AS hi FROM p)
"""


@query(_LR + f"""
SELECT k AS p_partkey, {rs("20 * log10(greatest(1 / (1 + lo), 1e-9))")} AS low_db, {rs("20 * log10(greatest(lo / (1 + lo) / (1 + hi), 1e-9))")} AS mid_db, {rs("20 * log10(greatest(lo / (1 + lo) * hi / (1 + hi), 1e-9))")} AS high_db FROM t""")
def crossover_bands(spark, sf):
    """Magnitudes of the three bands of the crossover tree; in closed form fourth-order Linkwitz-Riley."""
    k = c("p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", _pick(RATES, k).alias("rate"), (k % 199 * 100.0 + 30).alias("at"))

    def fn(pdf):
        trees = {x: design.crossover(140, 3200, x) for x in pdf["rate"].unique()}
        db = [[20 * np.log10(max(abs(design.response(trees[x][b], [f], x)[0]), 1e-9)) for b in ("low", "mid", "high")] for x, f in zip(pdf["rate"], pdf["at"], strict=True)]
        return pd.DataFrame(db, columns=["low_db", "mid_db", "high_db"]).assign(p_partkey=pdf["p_partkey"].to_numpy())[["p_partkey", "low_db", "mid_db", "high_db"]]

    out = _over(rows, ["p_partkey"], "p_partkey long, low_db double, mid_db double, high_db double", fn)
    return out.select("p_partkey", *(r(c(x)).alias(x) for x in out.columns[1:]))


def _bessel(x: str) -> str:
    """The modified Bessel function of order zero as a sum of terms (x/2)^2k / k!^2."""
    return f"list_sum(list_transform(range(0, 40), lambda k: CASE WHEN k = 0 THEN 1.0 ELSE exp(2 * k * ln(greatest(({x}) / 2, 1e-150)) - 2 * lgamma(k + 1.0)) END))"


_BANK = f"""
bank AS (SELECT factor, taps, i % factor AS phase, i // factor AS tap, CASE WHEN t = 0 THEN 1 ELSE sin(pi() * t) / (pi() * t) END * {_bessel("8.6 * sqrt(greatest(0, 1 - pow((2.0 * i) / (factor * taps - 1) - 1, 2)))")} AS v
  FROM (SELECT factor, taps, i, (i - (factor * taps - 1) / 2.0) / factor AS t FROM (SELECT factor, taps, unnest(range(factor * taps)) AS i FROM g)))
"""


@query(f"""
WITH g AS (SELECT DISTINCT 1 + p_size % 8 AS factor, 8 + p_size % 3 * 8 AS taps FROM part), {_BANK}
SELECT factor, taps, phase, tap, {rs("v / sum(v) OVER (PARTITION BY factor, taps, phase)", 7)} AS weight FROM bank""")
def polyphase_banks(spark, sf):
    """Every weight of the interpolation banks of the factors and lengths that a table asks for."""
    asked = table(spark, sf, "part").select((1 + c("p_size") % 8).cast("int").alias("factor"), (8 + c("p_size") % 3 * 8).cast("int").alias("taps")).distinct()

    def fn(pdf):
        out = []
        for f, t in zip(pdf["factor"].tolist(), pdf["taps"].tolist(), strict=True):
            bank = design.polyphase(f, t)
            out += [(f, t, p, k, float(bank[p, k])) for p in range(f) for k in range(t)]
        return pd.DataFrame(out, columns=["factor", "taps", "phase", "tap", "weight"])

    out = _over(asked, ["factor"], "factor int, taps int, phase long, tap long, weight double", fn)
    return out.select("factor", "taps", "phase", "tap", r(c("weight"), 7).alias("weight"))


@query(f"""
WITH g AS (SELECT 4 AS factor, 24 AS taps), {_BANK},
w AS (SELECT phase, tap, v / sum(v) OVER (PARTITION BY phase) AS weight FROM bank),
e AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x, len(embedding) AS n FROM embeddings),
y AS (SELECT e.vec_id, phase, i - tap + 11 AS spot, sum(weight * x) AS v FROM e JOIN w ON phase > 0 AND i - tap + 11 BETWEEN 0 AND n - 1 GROUP BY ALL)
SELECT vec_id, {rs("greatest(max(abs(v)), (SELECT max(abs(x)) FROM e e2 WHERE e2.vec_id = y.vec_id))", 5)} AS peak FROM y GROUP BY vec_id""")
def true_peaks(spark, sf):
    """The largest magnitude between a vector's components, by four-fold interpolation."""

    @F.pandas_udf("double")
    def peak(e: pd.Series) -> pd.Series:
        return pd.Series([kernels.true_peak(np.asarray(x, np.float32), 48_000) for x in e])

    return table(spark, sf, "embeddings").select("vec_id", r(peak("embedding"), 5).alias("peak"))


@query(f"""
WITH a AS (SELECT DISTINCT p_size % 21 / 20.0 AS amount FROM part WHERE p_size % 21 > 0),
u AS (SELECT amount, i, (-1 + 2.0 * i / 256) * 2 AS u FROM (SELECT amount, unnest(range(257)) AS i FROM a)),
y AS (SELECT amount, i, 1 + amount * 0.8 AS drive, 1 - pow(1 - amount, 2) AS blend, u, CASE WHEN abs(u) > 1 THEN u ELSE u + amount * 0.04 * (u * u - pow(u, 4)) END AS bent FROM u),
z AS (SELECT *, (1 - blend) * u + blend * (1 - 2 / (exp(2 * drive * bent) + 1)) AS y FROM y)
SELECT {rs("amount", 2)} AS amount, i, {rs("((y - avg(y) OVER (PARTITION BY amount)) / (1 - blend + blend * drive))::FLOAT::DOUBLE", 5)} AS y FROM z""")
def saturation_curves(spark, sf):
    """The shaper's curve at 257 points for each amount that a table asks for."""
    asked = table(spark, sf, "part").where("p_size % 21 > 0").select((c("p_size") % 21 / 20.0).alias("amount")).distinct()

    def fn(pdf):
        return pd.DataFrame([(a, i, float(v)) for a in pdf["amount"] for i, v in enumerate(design.saturation_curve(a, 257))], columns=["amount", "i", "y"])

    return _over(asked, ["amount"], "amount double, i long, y double", fn).select(r(c("amount"), 2).alias("amount"), "i", r(c("y"), 5).alias("y"))


M = "4294967295::HUGEINT"


def _uniform_sql(seed: str, i: str) -> str:
    """SQL steps of the generator, as nested expressions over 128-bit integers."""
    a = f"(({seed}::HUGEINT + ({i}::HUGEINT + 1) * 1831565813) & {M})"
    return a


_RANDOM = f"""
a AS (SELECT *, {_uniform_sql("seed", "i")} AS a FROM g),
t AS (SELECT *, (xor(a, a >> 15) * (a | 1)) & {M} AS t FROM a),
u AS (SELECT *, xor(t, (t + ((xor(t, t >> 7) * (t | 61)) & {M})) & {M}) AS u FROM t),
random AS (SELECT * EXCLUDE (a, t, u), xor(u, u >> 14)::DOUBLE / 4294967296.0 AS value FROM u)
"""


@query(f"""
WITH g AS (SELECT p_partkey, p_partkey * 2654435 % 4294967296 AS seed, unnest(range(p_partkey % 5, p_partkey % 5 + 3)) AS i FROM part), {_RANDOM}
SELECT p_partkey, i, {rs("value", 8)} AS value FROM random""")
def random_numbers(spark, sf):
    """Three numbers from a place of each seed's sequence, by random access."""
    rows = table(spark, sf, "part").select("p_partkey")

    def fn(pdf):
        out = [(k, k % 5 + j, float(v)) for k in pdf["p_partkey"].tolist() for j, v in enumerate(design.uniform(k * 2654435 % 2**32, k % 5, 3))]
        return pd.DataFrame(out, columns=["p_partkey", "i", "value"])

    return _over(rows, ["p_partkey"], "p_partkey long, i long, value double", fn).select("p_partkey", "i", r(c("value"), 8).alias("value"))


def _fnv_sql(seed: str, text: str) -> str:
    """FNV-1a over a text's ASCII codes, started from a seed."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::HUGEINT)"
    return f"list_reduce(list_prepend(xor(2166136261::HUGEINT, {seed}::HUGEINT), {codes}), lambda h, x: (xor(h, x) * 16777619) & {M})"


@query(f"""SELECT p_partkey, {_fnv_sql("p_partkey", "'dither:' || p_size")}::BIGINT AS seed FROM part""")
def derived_seeds(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("dither:"), c("p_size").cast("string")).alias("tag"))

    def fn(pdf):
        return pd.DataFrame({"p_partkey": pdf["p_partkey"], "seed": [design.derived_seed(k, t) for k, t in zip(pdf["p_partkey"].tolist(), pdf["tag"], strict=True)]})

    return _over(rows, ["p_partkey"], "p_partkey long, seed long", fn)


_E = "e AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x, len(embedding) AS n FROM embeddings)"


@query(f"""
WITH s AS (SELECT {_fnv_sql("7", "'dither:0'")} AS seed), {_E},
g AS (SELECT seed, unnest(range(2 * (SELECT max(n) FROM e))) AS i FROM s), {_RANDOM},
d AS (SELECT i // 2 AS i, (sum(value) - 1) / 32768.0 AS noise FROM random GROUP BY i // 2)
SELECT vec_id, e.i, {rs("x + noise", 6)} AS y FROM e JOIN d ON d.i = e.i""")
def dithered(spark, sf):
    """Vectors with triangular noise of one 16-bit step, the same for the same seed."""

    @F.pandas_udf("array<double>")
    def run(e: pd.Series) -> pd.Series:
        return pd.Series([kernels.dither(np.asarray(x, np.float64)[None], "tpdf", 16, 7)[0] for x in e])

    out = table(spark, sf, "embeddings").select("vec_id", F.posexplode(run("embedding")).alias("i", "y"))
    return out.select("vec_id", c("i").cast("bigint").alias("i"), r(c("y"), 6).alias("y"))


@query(f"""
WITH {_E}
SELECT vec_id, i, {rs("min(x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)", 6)} AS low FROM e""")
def centred_minimum(spark, sf):
    """The limiter's look-ahead minimum by doubling spans."""

    @F.pandas_udf("array<double>")
    def run(e: pd.Series) -> pd.Series:
        return pd.Series([kernels.centred_minimum(np.asarray(x, np.float64), 5) for x in e])

    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(run("embedding")).alias("i", "v")).select("vec_id", c("i").cast("bigint").alias("i"), r(c("v"), 6).alias("low"))


@query(f"""
WITH {_E}, b AS (SELECT unnest(range(33)) AS bin),
f AS (SELECT vec_id, bin, sum(x * cos(2 * pi() * bin * i / n)) AS re, sum(x * sin(2 * pi() * bin * i / n)) AS im FROM e, b GROUP BY vec_id, bin)
SELECT vec_id, bin, {rs("sqrt(re * re + im * im) / 32", 5)} AS amplitude FROM f""")
def tone_amplitudes(spark, sf):
    """A vector's amplitude at each of its 33 frequencies, by a product with one tone at a time."""

    @F.pandas_udf("array<double>")
    def run(e: pd.Series) -> pd.Series:
        return pd.Series([[immersive.goertzel(np.asarray(x, np.float64), b, len(x)) for b in range(33)] for x in e])

    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(run("embedding")).alias("bin", "v")).select("vec_id", c("bin").cast("bigint").alias("bin"), r(c("v"), 5).alias("amplitude"))


@query(f"""
WITH RECURSIVE k AS (SELECT 1 - exp(-1 / (0.05 * 1000)) AS k), {_E},
y AS (SELECT vec_id, 0::BIGINT AS i, x * k AS y FROM e, k WHERE i = 0 UNION ALL SELECT e.vec_id, e.i, y.y + (e.x - y.y) * k FROM y JOIN e ON e.vec_id = y.vec_id AND e.i = y.i + 1, k)
SELECT vec_id, i, {rs("y", 6)} AS y FROM y""")
def smoothed_levels(spark, sf):
    """A one-pole average of 50 ms at 1 kHz: the blocked filter against the recursion."""
    k = 1 - float(np.exp(-1 / (0.05 * 1000)))

    @F.pandas_udf("array<double>")
    def run(e: pd.Series) -> pd.Series:
        return pd.Series([kernels._stage(np.asarray(x, np.float64), (k, 0.0, 0.0, k - 1, 0.0)) for x in e])

    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(run("embedding")).alias("i", "v")).select("vec_id", c("i").cast("bigint").alias("i"), r(c("v"), 6).alias("y"))


@query(f"""
WITH RECURSIVE f AS (SELECT tan(pi() * 1681.974450955533 / 48000) AS s, tan(pi() * 38.13547087602444 / 48000) AS h, pow(10, 3.999843853973347 / 20) AS vh),
d AS (SELECT *, pow(vh, 0.4996667741545416) AS vb, 1 + s / 0.7071752369554196 + s * s AS d1, 1 + h / 0.5003270373238773 + h * h AS d2 FROM f),
k AS (SELECT (vh + vb * s / 0.7071752369554196 + s * s) / d1 AS b0, 2 * (s * s - vh) / d1 AS b1, (vh - vb * s / 0.7071752369554196 + s * s) / d1 AS b2, 2 * (s * s - 1) / d1 AS a1, (1 - s / 0.7071752369554196 + s * s) / d1 AS a2, 2 * (h * h - 1) / d2 AS c1, (1 - h / 0.5003270373238773 + h * h) / d2 AS c2 FROM d),
{_E},
y AS (
  SELECT vec_id, 0::BIGINT AS i, x, 0.0::DOUBLE AS x1, b0 * x AS p, 0.0::DOUBLE AS p1, 0.0::DOUBLE AS p2, b0 * x AS q, 0.0::DOUBLE AS q1 FROM e, k WHERE i = 0
  UNION ALL
  SELECT e.vec_id, e.i, e.x, y.x, b0 * e.x + b1 * y.x + b2 * y.x1 - a1 * y.p - a2 * y.p1, y.p, y.p1,
    (b0 * e.x + b1 * y.x + b2 * y.x1 - a1 * y.p - a2 * y.p1) - 2 * y.p + y.p1 - c1 * y.q - c2 * y.q1, y.q
  FROM y JOIN e ON e.vec_id = y.vec_id AND e.i = y.i + 1, k)
SELECT vec_id, {rs("-0.691 + 10 * log10(greatest(avg(q * q), 1e-30))", 3)} AS level FROM y GROUP BY vec_id""")
def k_weighted_levels(spark, sf):
    """Level of each vector's K-weighted components, through both stages of the filter."""
    stages = design.k_weighting(48_000)

    @F.pandas_udf("double")
    def run(e: pd.Series) -> pd.Series:
        return pd.Series([float((kernels.filtered(np.asarray(x, np.float32), stages).astype(np.float64) ** 2).mean()) for x in e])

    return table(spark, sf, "embeddings").select("vec_id", r(-0.691 + 10 * F.log10(F.greatest(run("embedding"), F.lit(1e-30))), 3).alias("level"))


_WINDOW = _bessel("8.6 * sqrt(greatest(0, 1 - pow(2 * t / taps, 2)))")


@query(f"""
WITH {_E}, o AS (SELECT 44100 / 48000.0 AS scale, ceil(96 / (44100 / 48000.0) / 2) * 2 AS taps, floor(64 * 44100 / 48000.0 + 0.5) AS n),
j AS (SELECT unnest(range(n::BIGINT)) AS j, scale, taps FROM o),
k AS (SELECT j, scale, taps, floor(j * 48000 / 44100.0) AS base, unnest(range(taps::BIGINT)) - taps / 2 + 1 AS k FROM j),
t AS (SELECT *, k - (j * 48000 / 44100.0 - base) AS t FROM k),
w AS (SELECT j, base + k AS spot, CASE WHEN t = 0 THEN 1 ELSE sin(pi() * t * scale * 0.98) / (pi() * t * scale * 0.98) END * {_WINDOW} AS w FROM t),
v AS (SELECT j, spot, w / sum(w) OVER (PARTITION BY j) AS w FROM w)
SELECT vec_id, j AS i, {rs("sum(x * w)", 4)} AS y FROM v JOIN e ON e.i = spot GROUP BY vec_id, j""")
def resampled(spark, sf):
    """Vectors taken from 48 kHz to 44.1 kHz."""

    @F.pandas_udf("array<double>")
    def run(e: pd.Series) -> pd.Series:
        return pd.Series([kernels.resample(np.asarray(x, np.float32)[None], 48_000, 44_100)[0].astype(np.float64) for x in e])

    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(run("embedding")).alias("i", "v")).select("vec_id", c("i").cast("bigint").alias("i"), r(c("v"), 4).alias("y"))


# ---- containers ------------------------------------------------------------------


@query("""
WITH f AS (SELECT p_partkey AS k, (CASE p_partkey % 5 WHEN 0 THEN 44100 WHEN 1 THEN 48000 WHEN 2 THEN 96000 WHEN 3 THEN 4000 ELSE 192000 END) AS rate, p_partkey // 5 % 4 AS kind FROM part)
SELECT k AS p_partkey, CASE WHEN kind = 3 THEN NULL WHEN rate < 8000 THEN NULL ELSE rate END AS rate FROM f""")
def sniffed_rates(spark, sf):
    """Sample rates by the first bytes of WAV, FLAC and AIFF files; a fourth kind is none of them."""
    k = c("p_partkey")
    rate = _pick([44100, 48000, 96000, 4000, 192000], k)
    hexa = lambda n, digits: F.lpad(F.hex(n), digits, "0")
    little = lambda n: F.concat(*(hexa(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255)), 2) for i in range(4)))
    wav = F.concat(F.lit("52494646" + "24000000" + "57415645" + "666d742010000000" + "01000100"), little(rate), F.lit("0" * 8 + "02001000" + "64617461" + "0" * 8))
    flac = F.concat(F.lit("664c6143" + "80000022" + "0" * 20), hexa(rate * 16, 6), F.lit("0" * 50))
    power = F.floor(F.log2(rate.cast("double"))).cast("int")
    mantissa = (rate * F.pow(F.lit(2.0), 31 - power)).cast("bigint")  # the first set bit in front
    aiff = F.concat(F.lit("464f524d00000026" + "41494646" + "434f4d4d00000012" + "0001" + "00000040" + "0010"), hexa(power + 16383, 4), hexa(mantissa, 8), F.lit("0" * 8))
    raw = F.unhex(F.element_at(F.array(wav, flac, aiff, F.concat(F.lit("4f676753"), hexa(mantissa, 8), F.lit("0" * 80))), (F.floor(k / 5) % 4 + 1).cast("int")))

    @F.pandas_udf("int")
    def sniff(raws: pd.Series) -> pd.Series:
        return pd.Series([containers.sniff_rate(bytes(x)) for x in raws], dtype="Int32")

    return table(spark, sf, "part").select("p_partkey", sniff(raw).alias("rate"))


_LE16 = lambda v: f"printf('%02x%02x', ({v}) & 255, (({v}) >> 8) & 255)"
_LE32 = lambda v: f"printf('%02x%02x%02x%02x', ({v}) & 255, (({v}) >> 8) & 255, (({v}) >> 16) & 255, (({v}) >> 24) & 255)"


@query(f"""
WITH {_E}, q AS (SELECT vec_id, i, n, CAST(least(32767, floor(greatest(-1, least(1, x)) * 32768 + 0.5)) AS BIGINT) & 65535 AS q FROM e),
d AS (SELECT vec_id, any_value(n) AS n, string_agg({_LE16("q")}, '' ORDER BY i) AS body FROM q GROUP BY vec_id)
SELECT vec_id, 44 + 2 * n AS bytes, sha256(unhex('52494646' || {_LE32("36 + 2 * n")} || '57415645' || '666d7420' || '10000000' || '01000100' || {_LE32("48000")} || {_LE32("96000")} || '02001000' || '64617461' || {_LE32("2 * n")} || body)) AS sha256 FROM d""")
def wav_files(spark, sf):
    """Each vector as a 16-bit WAV file: its length and its digest."""

    @F.pandas_udf("binary")
    def write(e: pd.Series) -> pd.Series:
        return pd.Series([containers.write_wav(np.asarray(x, np.float32)[None], 48_000, 16) for x in e])

    return table(spark, sf, "embeddings").select("vec_id", write("embedding").alias("raw")).select("vec_id", F.length("raw").cast("bigint").alias("bytes"), F.sha2("raw", 256).alias("sha256"))


@query("""
WITH v AS (SELECT vec_id, len(embedding) AS n, 1 + vec_id % 3 AS ch, [16, 24, 32][1 + vec_id % 3] AS bits FROM embeddings), s AS (SELECT *, (n // ch) * ch * bits // 8 AS data, CASE WHEN ch > 2 THEN 40 ELSE 16 END AS fmt FROM v)
SELECT vec_id, 0 AS idx, 'fmt ' AS id, 12 AS place, fmt AS size, bits, ch AS channels FROM s UNION ALL SELECT vec_id, 1, 'data', 20 + fmt, data, bits, ch FROM s""")
def inspected_files(spark, sf):
    """Chunks of files that hold each vector in one to three channels."""

    def fn(pdf):
        out = []
        for k, e in zip(pdf["vec_id"].tolist(), pdf["embedding"], strict=True):
            ch = 1 + k % 3
            x = np.asarray(e, np.float32)[: len(e) // ch * ch].reshape(-1, ch).T
            found = containers.inspect(containers.write_wav(x, 48_000, [16, 24, 32][k % 3]))
            assert not found["errors"] and not found["warnings"]
            out += [(k, i, b["id"], b["offset"], b["size"], found["format"]["bits"], found["format"]["channels"]) for i, b in enumerate(found["chunks"])]
        return pd.DataFrame(out, columns=["vec_id", "idx", "id", "place", "size", "bits", "channels"])

    return _over(table(spark, sf, "embeddings").select("vec_id", "embedding"), ["vec_id"], "vec_id long, idx int, id string, place long, size long, bits int, channels long", fn)


@query("""
SELECT p_partkey, string_agg(name, ' ' ORDER BY i) AS names FROM (
  SELECT p_partkey, i, ['FL', 'FR', 'FC', 'LFE', 'BL', 'BR', 'FLC', 'FRC', 'BC', 'SL', 'SR', 'TC', 'TFL', 'TFC', 'TFR', 'TBL', 'TBC', 'TBR'][i + 1] AS name
  FROM (SELECT p_partkey, unnest(range(18)) AS i, p_partkey * 131 % 262144 AS mask FROM part) WHERE (mask >> i) & 1 = 1) GROUP BY p_partkey""")
def mask_names(spark, sf):
    @F.udf("string", useArrow=True)
    def names(mask):
        return " ".join(containers.mask_names(mask))

    own = table(spark, sf, "part").select("p_partkey", names(c("p_partkey") * 131 % 262144).alias("names"))
    return own.where("names <> ''")


# ---- definition models --------------------------------------------------------


@query("""
WITH c AS (SELECT p_partkey, 1 + p_partkey % 64 AS i FROM part)
SELECT p_partkey, printf('AC_0001%04x', 4096 + i) AS channel, printf('AB_0001%04x_00000001', 4096 + i) AS block, printf('AT_0001%04x_01', 4096 + i) AS track, printf('ATU_%08x', i) AS uid FROM c""")
def adm_ids(spark, sf):
    def fn(pdf):
        own = [adm.ids(1 + k % 64) for k in pdf["p_partkey"].tolist()]
        return pd.DataFrame({"p_partkey": pdf["p_partkey"], **{x: [o[x] for o in own] for x in ("channel", "block", "track", "uid")}})

    return _over(table(spark, sf, "part").select("p_partkey"), ["p_partkey"], "p_partkey long, channel string, block string, track string, uid string", fn)


@query("""
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 9 = 0 THEN 32767 ELSE floor(greatest(-327.68, least(327.66, x)) * 100 + 0.5) END AS INT) AS loudness FROM (SELECT o_orderkey, o_totalprice / 500.0 - 400 AS x FROM orders)""")
def bext_levels(spark, sf):
    """The loudness field of a broadcast extension, read from its bytes; unmeasured levels have a value of their own."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(c("o_orderkey") % 9 != 0, c("o_totalprice") / 500.0 - 400).alias("level"))

    def fn(pdf):
        raws = [adm.bext("x", None if np.isnan(v) else v, None) for v in pdf["level"].astype(float)]
        return pd.DataFrame({"o_orderkey": pdf["o_orderkey"], "loudness": [int.from_bytes(raw[412:414], "little", signed=True) for raw in raws]})

    return _over(rows, ["o_orderkey"], "o_orderkey long, loudness int", fn)


_XML = {
    "fine": '<audioObject audioObjectID="AO_1001"/><audioObjectIDRef>AO_1001</audioObjectIDRef>',
    "lost": '<audioPackFormat audioPackFormatID="AP_0001{k}"/><audioPackFormatIDRef>AP_0002{k}</audioPackFormatIDRef>',
    "twice": '<audioContent audioContentID="ACO_1001"/><audioContent audioContentID="ACO_1001"/><audioContentIDRef>ACO_1001</audioContentIDRef>',
    "odd": '<audioObject audioObjectID="AO_{k}x"/><audioTrackUIDRef>ATU_0000{k}</audioTrackUIDRef>',
    "kind": '<audioTrackUID UID="ATU_0000{k}"/><audioObjectIDRef>ATU_0000{k}</audioObjectIDRef>',
    "cut": "<audioObject",
}


@query("""
WITH p AS (SELECT p_partkey AS doc_id, p_partkey % 6 AS kind, lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS k FROM part)
SELECT doc_id, 'unresolved' AS rule, 'AP_0002' || k AS ident FROM p WHERE kind = 1 UNION ALL SELECT doc_id, 'unreferenced', 'AP_0001' || k FROM p WHERE kind = 1
UNION ALL SELECT doc_id, 'duplicate-id', 'ACO_1001' FROM p WHERE kind = 2
UNION ALL SELECT doc_id, 'id-pattern', 'AO_' || k || 'x' FROM p WHERE kind = 3 UNION ALL SELECT doc_id, 'unresolved', 'ATU_0000' || k FROM p WHERE kind = 3
UNION ALL SELECT doc_id, 'wrong-kind', 'ATU_0000' || k FROM p WHERE kind = 4 UNION ALL SELECT doc_id, 'xml', '' FROM p WHERE kind = 5""")
def adm_id_problems(spark, sf):
    """Ids of many XML texts checked by joins; five of six kinds of text break one rule or two."""
    k = F.lpad((c("p_partkey") % 10_000).cast("string"), 4, "0")
    body = F.replace(_pick(list(_XML.values()), c("p_partkey")), F.lit("{k}"), k)
    xml = F.concat(F.lit('<a xmlns="urn:ebu:metadata-schema:ebuCore_2016">'), body, F.lit("</a>"))
    return adm.id_problems(table(spark, sf, "part").select(c("p_partkey").alias("doc_id"), xml.alias("xml")))


@query(f"""
WITH l AS (SELECT * FROM {values([(k, len(v.split()), sum(x == "LFE" for x in v.split())) for k, v in dims.LAYOUTS.items()], "layout_id, n, n_lfe")})
SELECT p_partkey, layout_id, n, n_lfe AS n_limits, 0 AS n_errors, 4 + 5 * n AS n_ids
FROM l JOIN (SELECT p_partkey, {list(dims.LAYOUTS)}[1 + p_partkey % {len(dims.LAYOUTS)}] AS layout_id FROM part) USING (layout_id)""")
def adm_documents(spark, sf):
    """The XML that each part asks for, of its layout, name and length: its channels, low-pass limits, what breaks a rule (nothing), and ids."""
    beds = dims.layout_channels(spark).where("standard or layout_id = '9.1.6'").join(dims.speakers(spark), "speaker_id").where("layout_id <> 'venue'")
    own = beds.groupBy("layout_id").agg(F.sort_array(F.collect_list(F.struct("pos", "speaker_id", "adm_label", "azimuth_adm", "elevation", "lfe"))).alias("speakers"))
    programmes = table(spark, sf, "part").select("p_partkey", "p_name", (c("p_size") + 0.5).alias("seconds"))
    own = programmes.join(asked(spark, sf, "layout_id", list(dims.LAYOUTS)), "p_partkey").join(own, "layout_id")
    own = own.repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")  # small rows, long work

    def fn(pdf):
        rows = []
        for key, name, title, seconds, speakers in zip(*(pdf[x] for x in ("p_partkey", "layout_id", "p_name", "seconds", "speakers")), strict=True):
            xml = adm.build([dict(x) for x in speakers], 48_000, 24, seconds, title)
            wrong = [x for x in adm.validate(xml, 48_000, 24, [adm.ids(i + 1)["uid"] for i in range(len(speakers))]) if x[0] == "error"]
            rows.append((key, name, len(speakers), xml.count("<frequency"), len(wrong), len(re.findall(r' audio\w+ID="| UID="', xml))))
        return pd.DataFrame(rows, columns=["p_partkey", "layout_id", "n", "n_limits", "n_errors", "n_ids"])

    return _over(own, ["p_partkey"], "p_partkey long, layout_id string, n long, n_limits long, n_errors int, n_ids long", fn)
