"""Containers: byte round trips, hostile input, and the Spark source and sink."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clips
from tidemark.sources import containers as c
from tidemark.sources import pcm, signals

X = np.stack([np.linspace(-1, 1, 1001), np.sin(np.arange(1001))]).astype(np.float32)


@pytest.mark.parametrize("bits", [16, 24, 32])
def test_wav_round_trip(bits):
    raw = c.write_wav(X, 48_000, bits)
    y, rate = c.read_wav(raw)
    assert rate == 48_000 and np.abs(X - y).max() <= 2.0 ** (1 - min(bits, 24)) and c.inspect(raw)["errors"] == [] == c.inspect(raw)["warnings"]


@pytest.mark.parametrize("bits", [16, 24])
def test_aiff_round_trip(bits):
    y, rate = c.read_aiff(c.write_aiff(X, 44_100, bits))
    assert rate == 44_100 and np.abs(X - y).max() <= 2.0 ** (1 - bits)


def test_wide_containers_and_planning():
    raw = c.write_wav(X, 96_000, 24, mode="bw64", extra=[("axml", b"<x/>")])
    found = c.inspect(raw)
    assert raw[:4] == b"BW64" and found["errors"] == [] and [x["id"] for x in found["chunks"]] == ["ds64", "fmt ", "data", "axml"]
    assert np.abs(c.read_wav(raw)[0] - X).max() < 1e-6
    plan = c.plan_riff([("fmt ", 16), ("data", 5 * 2**30)], most=None)
    assert plan["container"] == "BW64" and plan["size_field"] == c.U32 and plan["total_bytes"] == 5 * 2**30 + 16 + 8 + 8 + 12 + 36
    for bad in ([("data", 5)] * 2, [("fmt", 1), ("data", 1)], []):
        with pytest.raises(ValueError):
            c.plan_riff(bad)
    with pytest.raises(ValueError):
        c.plan_riff([("data", 5 * 2**30)], mode="riff", most=None)
    with pytest.raises(ValueError):
        c.plan_riff([("data", 3 * 2**30)])


def test_float80():
    for v in (0.0, 44_100.0, 48_000.0, 192_000.0, -1.5, 0.1):
        assert c.read_float80(c.float80(v)) == v
    assert c.float80(44_100) == bytes.fromhex("400eac44000000000000")


def test_sniffing():
    assert c.sniff_rate(c.write_wav(X, 88_200, 24)) == 88_200
    assert c.sniff_rate(c.write_wav(X, 88_200, 32, extensible=False)) is None  # float format tags aren't taken
    assert c.sniff_rate(c.write_aiff(X, 44_100)) == 44_100
    flac = b"fLaC" + bytes([0, 0, 0, 34]) + bytes(10) + (96_000 << 4).to_bytes(3, "big") + bytes(40)
    assert c.sniff_rate(flac) == 96_000
    frame = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)
    assert c.sniff_rate(frame * 3) == 44_100 and c.sniff_rate(b"ID3\x04\x00\x00\x00\x00\x00\x05hello" + frame * 3) == 44_100
    assert c.sniff_rate(frame + b"junk" * 50) is None and c.sniff_rate(b"") is None and c.sniff_rate(c.write_wav(X, 4000, 16)) is None


def test_hostile_input():
    raw = c.write_wav(X, 48_000, 16)
    assert "cut off" in c.inspect(raw[:-100])["errors"][0]
    assert c.inspect(b"")["errors"] and c.inspect(b"plain text, no audio")["errors"]
    huge = raw.replace(struct.pack("<I", X.shape[1] * 4), struct.pack("<I", 2**31), 1)
    assert c.inspect(huge)["errors"]
    for junk in (b"", raw[:20], b"RIFF" + bytes(60)):
        assert list(pcm.decoded("x", junk))[0][-1]
    assert c.mask_names(0x3F) == ["FL", "FR", "FC", "LFE", "BL", "BR"]


def test_spark_round_trip(spark, tmp_path):
    pcm.save(signals.chunks(spark, ["sine-1k", "impulse"]), f"{tmp_path}/out", bits=24)
    (tmp_path / "out" / "bad.wav").write_bytes(b"no audio at all")
    for df in (pcm.load(spark, f"{tmp_path}/out"), pcm.from_binary(spark, f"{tmp_path}/out")):
        got = {(r.clip_id, r.channel, r.chunk_idx): r for r in df.collect()}
        assert got["bad", None, None].errors
        want = signals.CATALOGUE["sine-1k"]()[0][:16384]
        assert np.abs(np.array(got["sine-1k", 0, 0].samples) - want).max() < 1e-6
        assert sum(r.frame_count for r in got.values() if r.clip_id == "impulse") == 48_000


def test_streamed_meters_equal_batch(spark, tmp_path):
    from tidemark.streaming import meters

    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_type", "cast(ts as timestamp) ts", "value / 500 as value")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, plan in (("levels", lambda d: meters.window_levels(d, "event_type", "1 day", None, "400 days")), ("bursts", lambda d: meters.sessions(d, "event_type", "2 hours", "400 days"))):
        q = plan(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "levels" else "append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        if name == "levels":
            key = lambda r: (r.event_type, str(r.start))
            a, b = (sorted(map(tuple, x.select("event_type", "start", "n").collect()), key=str) for x in (spark.table(name), plan(rows)))
            assert a == b and len(a) > 5
    q = meters.peak_hold(stream, "event_type").writeStream.format("memory").queryName("held").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("held").count() >= 5


def test_corpus():
    from tidemark.sources import corpus

    seen = set()
    for case in corpus.cases():
        rows = list(pcm.decoded(case.id, case.data))
        failed = bool(rows and rows[0][-1])
        assert case.expect == "either" or failed == (case.expect == "reject"), case.id
        if case.expect == "decode":
            x, _ = c.read_aiff(case.data) if case.file_name.endswith("aif") else c.read_wav(case.data)
            assert x.shape == (case.channels, case.frames), case.id
            assert np.isfinite(x).all() != ("non-finite" in case.notes)
        seen.add(case.id)
    assert len(seen) == len(corpus.cases()) > 25


@pytest.mark.parametrize("bits", [16, 24, 32])
@pytest.mark.parametrize("channels", [1, 2, 6])
def test_streamed_file_equals_whole_file(bits, channels):
    x = np.random.default_rng(bits).uniform(-1, 1, (channels, 1001)).astype(np.float32)
    extra = [("bext", b"abc"), ("axml", b"<x/>")]
    out = io.BytesIO()
    blocks = (x[:, a : a + 300] for a in range(0, 1001, 300))
    n = c.stream_wav(out, blocks, channels, 1001, 48_000, bits, extra=extra)
    assert out.getvalue() == c.write_wav(x, 48_000, bits, extra=extra) and n == len(out.getvalue())
    assert out.getvalue().startswith(c.wav_head(channels, 1001, 48_000, bits, extra=[(i, len(b)) for i, b in extra]))
    with pytest.raises(ValueError):
        c.stream_wav(io.BytesIO(), iter([x[:, :5]]), channels, 1001, 48_000, bits)
    for first, frames in ((0, None), (17, 400), (900, 999), (2000, 5)):
        out.seek(0)
        got = [b for _, b, _ in c.frame_blocks(out, first, frames, 128)]
        whole, _ = c.read_wav(out.getvalue())
        want = whole[:, first : None if frames is None else first + frames]
        assert (np.concatenate(got, 1) if got else np.zeros((channels, 0))).tolist() == want.tolist()


def test_stretch_of_frames_and_odd_names(spark, tmp_path):
    chunks = signals.chunks(spark, ["sine-1k", "impulse"]).withColumn("clip_id", F.concat(F.lit("a/b|"), "clip_id"))
    pcm.save(chunks, f"{tmp_path}/out", bits=32)
    part = pcm.load(spark, f"{tmp_path}/out", first_frame=20_000, frames=3000).where("clip_id = 'a/b|sine-1k'")
    got = {(r.channel, r.start_frame + i): v for r in part.collect() for i, v in enumerate(r.samples)}
    want = {(r.channel, r.start_frame + i): v for r in chunks.where("clip_id = 'a/b|sine-1k'").collect() for i, v in enumerate(r.samples)}
    assert len(got) == 3000 * len({c for c, _ in want}) and all(want[k] == v for k, v in got.items())


def test_empty_and_large_files_are_rows(spark, tmp_path):
    for name, raw in (("none.wav", b""), ("large.wav", b"x" * 5000), ("text.wav", b"no audio at all, but text")):
        (tmp_path / name).write_bytes(raw)
    out = {r.clip_id: r.errors for r in pcm.from_binary(spark, str(tmp_path), most_bytes=1000).collect()}
    assert out["large"] == ["too_large"] and len(out["text"]) == 1
    assert {r.clip_id: r.errors for r in pcm.load(spark, str(tmp_path)).collect()}["none"] == ["empty"]


def test_uneven_clips_are_errors(spark, tmp_path):
    rows = [("whole", 0, 0, 0, 2, [0.5, 0.25], 48_000), ("whole", 1, 0, 0, 2, [0.5, 0.5], 48_000), ("uneven", 0, 0, 0, 4, [0.1] * 4, 48_000), ("uneven", 1, 0, 0, 2, [0.1] * 2, 48_000), ("gap", 0, 0, 0, 2, [0.1] * 2, 48_000), ("gap", 0, 1, 5, 2, [0.1] * 2, 48_000)]
    df = spark.createDataFrame(rows, "clip_id string, channel int, chunk_idx long, start_frame long, frame_count int, samples array<float>, sample_rate int")
    out = {r.clip_id: r for r in clips.each_clip(df, lambda clip, x, rate: [{"clip_id": clip, "n": x.size}], "clip_id string, n int, error string").collect()}
    assert out["whole"].n == 4 and out["whole"].error is None
    assert "differ in length" in out["uneven"].error and "gaps" in out["gap"].error
    with pytest.raises(Exception, match="differ in length"):
        clips.each_clip(df.where("clip_id = 'uneven'"), lambda clip, x, rate: [{"clip_id": clip}], "clip_id string").collect()
    with pytest.raises(Exception, match="channels differ"):
        pcm.save(df.where("clip_id = 'uneven'"), f"{tmp_path}/out")
