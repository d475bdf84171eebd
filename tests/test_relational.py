"""Frames, rules and comparison on small cases with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.functions import text as tx
from tidemark.operators import compare, dims, frames, matching, rules


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_rounding_gains_and_floors(spark):
    assert one(spark, s.js_round(F.lit(-2.5)), s.js_round(F.lit(2.5)), s.js_round(F.lit(1.005), 1), s.gain_to_db(F.lit(0.0)), s.power_db(F.lit(0.0)))[:3] == (-2.0, 3.0, 1.0)
    assert one(spark, s.gain_to_db(F.lit(0.0)), s.power_db(F.lit(0.0)), s.quantise(F.lit(1.0), 16), s.quantise(F.lit(-2.0), 24)) == (pytest.approx(-180), pytest.approx(-300), 32767, -(2**23))
    s.register(spark)
    assert spark.sql("SELECT js_round(-2.5, 0), gain_to_db(1), smoothstep(0.5), clamp(5, 0, 1)").first() == (-2.0, 0.0, 0.5, 1.0)


def test_text(spark):
    f = lambda v: one(spark, tx.sanitise_filename(F.lit(v)))[0]
    assert [f(v) for v in ("a/b\\c:d?.wav", "..hid  den. ", "CON.txt", "", "x" * 200 + ".flac")] == ["cd.wav", "hid den", "master", "master", "x" * 115 + ".flac"]
    odd = {".. a": " a", "Lpt9.tar.gz": "master", "con1": "con1", "a\u00a0\u3000 b": "a b", "x/": "master", "d\\ .x. . ": "x", "a\tb\x00c": "abc", "." * 9: "master", "y" * 130 + ".longest-one": "y" * 120}
    assert {v: f(v) for v in odd} == odd and f(None) == "master"
    assert one(spark, tx.base_name(F.lit("song.mix.wav")), tx.wrap(F.lit("aa bb ccccccc d"), 5), tx.timecode(F.lit(3661.25)), tx.format_bytes(F.lit(1536.0)), tx.quality_tag(F.lit(44100), F.lit(32))) == ("song.mix", "aa bb\nccccccc\nd", "01:01:01.250000000", "2 KB", "44.1k-32float")


def test_one_decimal_of_exact_values(spark):
    rng = np.random.default_rng(5)
    ties = [k + q for k in range(1, 10) for q in (0.25, 0.75)]
    near = [float(np.nextafter(k / 20, to)) for k in range(20, 200) for to in (0, 99)] + [k / 20 for k in range(20, 200)]
    values = [v for v in ties + near + list(rng.uniform(1, 10, 2000)) if 1 <= v < 10]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", tx.format_bytes(F.col("v") * 1048576).alias("size")).collect()
    assert len(rows) > 2500 and [r.size for r in rows] == ["%.1f MB" % r.v for r in rows]


def test_framed_numbers_across_stretches(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    out = frames.framed(rows, "k", ["t"], F.floor(F.col("t") / 70)).collect()
    assert all(r.frame == r.t // 3 for r in out) and len(out) == 1000


@pytest.mark.parametrize(("block", "hop"), [(8, 2), (10, 3), (5, 5)])
def test_blocks(spark, block, hop):
    f = spark.range(53).select(F.lit("a").alias("k"), F.col("id").alias("frame"), F.col("id").cast("double").alias("value"))
    got = sorted((r.block_idx, r.s) for r in frames.hop_blocks(f, "k", block, hop, {"s": F.col("value")}).collect())
    assert got == [(i, float(sum(range(i * hop, i * hop + block)))) for i in range((53 - block) // hop + 1)]
    assert frames.hop_blocks(f.where("frame < 3"), "k", block, hop, {"s": F.col("value")}).collect() == []


def test_pyramid_skips_each_first_sample(spark):
    f = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([9, 1, 2, 3, 8, 0])], "k string, frame bigint, value double")
    got = {(r.level, r.bucket): (r.vmin, r.vmax) for r in frames.pyramid(f, "k", 4, 2).collect()}
    assert got == {(0, 0): (1.0, 8.0), (0, 1): (0.0, 0.0), (1, 0): (0.0, 8.0)}


def test_rules(spark):
    base = {"integrated": -9.0, "lra": 2.0, "crest_db": 6.0, "true_peak_db": 0.0, "bass_db": 5.0, "presence_db": 5.0, "treble_db": 0.0, "correlation": 0.1, "channels": 1}
    cols = [F.lit(v).alias(k) for k, v in base.items()]
    assert spark.range(1).select(*cols).select(rules.source_class()).first()[0] == "loud+dense+hot+phasey+bass-heavy+forward"
    none = [F.lit(None).cast("double").alias(k) for k in base]
    assert spark.range(1).select(*none).select(rules.source_class()).first()[0] == "unmeasured"
    assert one(spark, rules.makeup_db(F.lit(-24.0), F.lit(12.0), F.lit(1.0)))[0] == 0.0
    up = [one(spark, rules.makeup_db(F.lit(-0.24 * a), F.lit(12.0), F.lit(1 + 0.02 * a)))[0] for a in (20.0, 60.0, 100.0)]
    assert 0 < up[0] < up[1] < up[2] < 20


def test_match_curve_is_centred_and_bounded(spark):
    a, b = F.array(*(F.lit(float(v)) for v in (0, 0, 0, 0, 0, 0, 0, 0))), F.array(*(F.lit(float(v)) for v in (30, -20, 10, 0, 0, 5, -10, 4)))
    m = one(spark, matching.curve(a, b))[0]
    assert all(abs(g) <= 5 for g in m.gains) and 0 <= m.confidence <= 1
    same = one(spark, matching.curve(b, b))[0]
    assert set(same.gains) == {0.0} and same.confidence == 1.0


def test_groups_against_a_reference(spark):
    cols = "id string, class string, browser string, nan int, inf int, dc double, true_peak_db double, integrated double, crest_db double, rms_db double, correlation double, mono_loss_db double, centroid_hz double"
    rows = [("a", "reference", "one", 0, 0, 0.0, -2.0, -14.0, 10.0, -18.0, 0.9, 0.0, 900.0), ("a", "reference", "two", 1, 0, 0.0, -0.2, -12.0, 10.0, -18.0, 0.9, 0.0, 900.0)]
    got = {(r.severity, r.kind) for r in compare.across(spark.createDataFrame(rows, cols), "browser", "one", ceiling=-1.0).collect()}
    assert got == {("defect", "nan"), ("browser", "browser-divergence"), ("browser", "true-peak-violation")}


def test_coercion(spark):
    rows = spark.createDataFrame([("s", "drive", "99"), ("s", "mbSpeed", "fast"), ("s", "width", "junk"), ("s", "unknown", "1"), ("s", "binaural", "maybe")], "set_id string, key string, value string")
    out = {r.key: (r.value, r.defaulted) for r in rules.coerce(rows, dims.param_spec(spark).where("kind <> 'array'")).collect()}
    assert out["drive"][0] == "9.0" and out["mbSpeed"] == ("fast", False) and out["width"][0] == "1" and "unknown" not in out and out["binaural"] == ("false", True) and out["dither"] == ("tpdf", True)


def test_series_cut_into_stretches_give_the_same(spark):
    rng = np.random.default_rng(4)
    rows = [(k % 2, i, float(v)) for k in range(2) for i, v in enumerate(rng.integers(0, 1000, 300))]
    df = spark.createDataFrame(rows, "series int, frame long, value double")
    got = {(r.series, r.frame): r.low for r in frames.sliding_minimum(df, "series", 7, stretch=16).collect()}
    value = {(s, i): v for s, i, v in rows}
    assert got == {(s, i): min(value[s, j] for j in range(max(0, i - 7), min(300, i + 8))) for s, i, _ in rows}


def test_as_of_over_stretches(spark):
    left = [(k, t, f"e{t}") for k in range(3) for t in range(0, 100, 3)]
    right = [(0, 5, 50), (0, 5, 51), (0, 60, 7), (1, 0, 9), (1, 99, 1)]
    a = spark.createDataFrame(left, "k int, t int, name string")
    b = spark.createDataFrame(right, "k int, t int, v int")
    for size in (1, 10, 1000):
        got = {(r.k, r.t): r.v for r in frames.as_of(a, b, "k", "t", "v", F.floor(F.col("t") / size)).collect()}
        want = {(k, t): max(((u, v) for q, u, v in right if q == k and u <= t), default=(None, None))[1] for k, t, _ in left}
        assert got == want
