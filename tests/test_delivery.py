"""Metadata, delivery records, intake rules and scenes."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import adm, compare, delivery, dims, intake, scene
from tidemark.sources import containers as c


def bed(spark, layout="5.1"):
    rows = dims.layout_channels(spark).where(F.col("layout_id") == layout).join(dims.speakers(spark), "speaker_id").orderBy("pos").collect()
    return [r.asDict() for r in rows]


def test_bed_is_valid_and_breaks_are_found(spark):
    sp = bed(spark)
    x = np.zeros((6, 4800), np.float32)
    raw = adm.write(x, 48_000, 24, sp, 'A "bed" <&>', -23.0, -1.0)
    found = c.inspect(raw)
    assert found["errors"] == [] and [ch["id"] for ch in found["chunks"]] == ["fmt ", "data", "chna", "axml", "bext"]
    at = next(ch for ch in found["chunks"] if ch["id"] == "axml")
    xml = raw[at["offset"] + 8 : at["offset"] + 8 + at["size"]].decode()
    uids = [adm.ids(i)["uid"] for i in range(1, 7)]
    assert adm.validate(xml, 48_000, 24, uids) == []
    rules = lambda s, **k: {r for _, r, _, _ in adm.validate(s, **k)}
    assert "unresolved" in rules(xml.replace("<audioContentIDRef>ACO_1001", "<audioContentIDRef>ACO_9999"))
    assert {"rate", "depth"} <= rules(xml, rate=96_000, bits=16)
    assert "chna" in rules(xml, uids=uids[:-1]) and "duplicate-id" in rules(xml.replace("AC_00011002", "AC_00011001"))
    assert "label-azimuth" in rules(xml.replace(">30.0<", ">-90.0<")) and "timecode" in rules(xml.replace("00:00:00.100000000", "0.1s"))
    assert "xml" in rules("<a>") and "id-pattern" in rules(xml.replace("APR_1001", "PROG"))
    with pytest.raises(ValueError):
        adm.build(sp, 48_000, 24, 1, "x", lfe_hz=9000)
    assert adm.timecode(3661.5) == "01:01:01.500000000" and len(adm.bext("x", None, None)) == 602 + 0


def test_records(spark):
    files = spark.createDataFrame([("p", "b.wav", bytearray(b"22")), ("p", "a.txt", bytearray(b"1"))], "package string, name string, content binary")
    text = delivery.checksum_lines(files).collect()[0].text
    assert text == f"{hashlib.sha256(b'1').hexdigest()}  a.txt\n{hashlib.sha256(b'22').hexdigest()}  b.wav"
    renders = spark.createDataFrame([("p", -14.00001, float("-inf")), ("q", 1.0, 2.0)], "package string, loudness double, peak double")
    got = {r.package: json.loads(r.manifest) for r in delivery.manifests(renders, files).collect()}
    assert got["p"]["loudness"] == -14.0 and "peak" not in got["p"] and [f["bytes"] for f in got["p"]["files"]] == [1, 2]
    maps = {r.layout_id: r for r in delivery.channel_map(spark).collect()}
    assert maps["5.1"].mask == 0x3F and maps["9.1.6"].mask == 0 and len(maps["venue"].text.splitlines()) == 24
    assert json.loads({r.layout_id: r.json for r in delivery.channel_map_json(spark).collect()}["7.1.4"])["channel_count"] == 12


def test_channel_order(spark):
    own = {}
    for r in dims.wav_channel_order(spark).orderBy("channel").collect():
        own.setdefault(r.layout_id, []).append(r.speaker_id)
    assert own["7.1"] == ["L", "R", "C", "LFE", "Lrs", "Rrs", "Lss", "Rss"]
    assert own["9.1.6"] == dims.LAYOUTS["9.1.6"].split()


def test_intake(spark):
    rows = [(1, 2, 48_000, 48_000, None), (2, 1, 0, 48_000, None), (3, 32, 10, 48_000, None), (4, 2, 10, 48_000, 7), (5, 6, 48_000 * 4000, 48_000, None), (6, 1, 10, 12_345, None), (7, 2, 10, 0, None)]
    out = {r.clip: r for r in intake.validated(spark.createDataFrame(rows, "clip int, channels int, frames bigint, rate int, first_bad_frame bigint")).collect()}
    assert out[1].errors == [] == out[1].warnings and out[2].errors == ["no samples"] and out[3].errors == ["too many channels"]
    assert out[4].errors == ["non-finite sample at frame 7"] and out[5].errors == ["too long: 66:40"] and out[6].notes == ["mono", "unusual rate"] and out[7].errors == ["unusable shape"]
    files = spark.createDataFrame([("a/B.WAV", 0), ("x.txt", 5), ("y.flac", 600 << 20)], "path string, size bigint")
    assert [tuple(r) for r in files.select(intake.looks_like_audio(F.col("path")), intake.preflight(F.col("size"))).collect()] == [(True, "empty"), (False, None), (True, "too_large")]


def test_presets(spark):
    texts = {"new": '{"schemaVersion": 3, "name": "N", "family": "mastering", "parameters": {"drive": 2, "tape": 40}}', "old": '{"preset": "O", "P": {"haas": 5}}', "bad": "{oops", "list": "[1]", "none": '{"a": 1}', "big": '{"P": {"a": "' + "x" * 300_000 + '"}}'}
    out = {r.preset_id: r for r in intake.presets(spark.createDataFrame(list(texts.items()), "preset_id string, text string")).withColumns({"family": intake.family(F.col("settings")), "class": intake.parameter_class(F.col("settings"))}).collect()}
    assert out["new"].settings == {"drive": "2"} and out["new"].version == 3 and out["new"]["class"] == "creative"
    assert out["old"].name == "O" and out["old"].family == "creative"
    assert [out[k].error for k in ("bad", "list", "none", "big")] == ["not a JSON object", "not a JSON object", "no parameters", "too large"]


def test_scenes_and_motion(spark):
    rows = [("s", "mid", 1.0, 0.2, 0.3, 0.5, 0.5, 0.5, 0.0), ("s", "low", 0.7, 0.2, 0.3, 0.5, 0.0, 0.0, 0.1), ("s", "air", 1.0, 0.2, 0.3, 1.4, 1.4, 1.3, 0.0)]
    got = {(r.band, r.rule) for r in scene.problems(spark.createDataFrame(rows, "scene string, band string, " + ", ".join(f"{g} double" for g in scene.GAINS))).collect()}
    assert got == {("low", "front under 0.8"), ("low", "bass not anchored"), ("low", "low-frequency feed"), ("air", "surround budget")}
    p = spark.range(9).select((F.col("id") / 8.0).alias("p"))
    for mode in ("static", "orbit", "clockwise", "anti-clockwise", "front-rear-drift", "vertical", "breathing"):
        for r in p.select(*(v.alias(k) for k, v in scene.motion(mode, F.col("p")).items())).collect():
            assert all(0.3 < v < 1.7 for v in r)
    with pytest.raises(ValueError):
        scene.motion("spin", F.col("p"))


def test_packages_presets_and_observation(spark, tmp_path):
    from tidemark.operators.observe import Recorder

    files = spark.createDataFrame([("p", "a.txt", bytearray(b"1"))], "package string, name string, content binary")
    own = delivery.package(spark.createDataFrame([("p", 1.0)], "package string, level double"), files, f"{tmp_path}/pkg")
    assert "a.txt (1 bytes)" in delivery.readme_lines(own).first().text and spark.read.parquet(f"{tmp_path}/pkg/SHA256SUMS").first().text.endswith("  a.txt")
    text = delivery.serialised_presets(spark.createDataFrame([("x", "N", "d", {"drive": "2"})], "preset_id string, name string, description string, settings map<string,string>"))
    back = intake.presets(text).first()
    assert back.name == "N" and back.settings == {"drive": "2"} and back.error is None
    rec = Recorder()
    df = rec.watched("rows", spark.range(10).select(F.col("id").cast("double").alias("v")), "v")
    rec.timed("count", lambda: df.write.format("noop").mode("overwrite").save())
    assert rec.counts("rows") == {"rows": 10, "finite": 10} and rec.slowest()[0][0] == "count"


def test_unique_names_skip_those_that_are_there(spark):
    rows = [(1, "a.wav"), (2, "a_2.wav"), (3, "a.wav"), (4, "a.wav"), (5, "b"), (6, "b"), (7, ".hidden"), (8, ".hidden"), (9, "a_2.wav")]
    out = {r.k: r.unique_name for r in delivery.unique_names(spark.createDataFrame(rows, "k int, name string"), "k", "name").collect()}
    assert out == {1: "a.wav", 2: "a_2.wav", 3: "a_3.wav", 4: "a_4.wav", 5: "b", 6: "b_2", 7: ".hidden", 8: ".hidden_2", 9: "a_2_2.wav"}


def test_band_shifts_are_flagged(spark):
    none = ", ".join(f"CAST(NULL AS DOUBLE) AS {k}" for k in ("true_peak_db", "integrated", "crest_db", "rms_db", "correlation", "mono_loss_db", "centroid_hz"))
    row = lambda i, cls, bands: f"SELECT {i} AS id, '{cls}' AS class, 0 AS nan, 0 AS inf, 0.0D AS dc, {none}, {bands} AS bands_db"
    base = spark.sql(" UNION ALL ".join(row(i, "reference" if i < 3 else "creative", "array(1.0D, 2.0D)") for i in range(4)))
    cand = spark.sql(" UNION ALL ".join(row(i, "reference" if i < 3 else "creative", f"array(1.0D, {2.0 + i * 1.6}D)") for i in range(4)))
    out = {(r.id, r.severity, round(r.value, 6)) for r in compare.flags(base, cand).collect() if r.kind == "band-shift"}
    assert out == {(1, "defect", 1.6), (2, "defect", 3.2)}


def test_streamed_bed_equals_whole_file(spark):
    import io

    own = [r.asDict() for r in dims.layout_channels(spark).where("layout_id = '5.1'").join(dims.speakers(spark), "speaker_id").orderBy("pos").collect()]
    x = np.random.default_rng(2).uniform(-1, 1, (6, 777)).astype(np.float32)
    sink = io.BytesIO()
    n = adm.stream(sink, (x[:, a : a + 100] for a in range(0, 777, 100)), 777, 48_000, 24, own, "bed", -14.0, -1.0)
    assert sink.getvalue() == adm.write(x, 48_000, 24, own, "bed", -14.0, -1.0) and n == len(sink.getvalue())
