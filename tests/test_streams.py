import os

import numpy as np
import pytest
from tidemark.sources import containers as c
from tidemark.sources import pcm, streams

RATE = 48_000


def put(folder, name, x, bits=32):
    """A whole file under its name at once."""
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.tmp", "wb") as f:
        c.stream_wav(f, iter([x]), len(x), x.shape[1], RATE, bits)
    os.replace(f"{folder}/.tmp", f"{folder}/{name}.wav")


@pytest.mark.parametrize("held", [streams.HELD, 1000])
def test_files_arrive_and_are_written_once(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(streams, "HELD", held)
    rng = np.random.default_rng(1)
    x = {k: (rng.standard_normal((n, m)) * 0.1).astype(np.float32) for k, n, m in (("one", 2, 40_000), ("two words", 1, 10), ("late", 3, 16_384))}
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    put(source, "one", x["one"])
    put(source, "two words", x["two words"])
    open(f"{source}/broken.wav", "wb").write(b"RIFF....")
    assert streams.written(streams.arriving(spark, source), out, state, 32).awaitTermination(120)
    assert sorted(os.listdir(out)) == ["one.wav", "two words.wav"]
    before = {n: os.stat(f"{out}/{n}").st_mtime_ns for n in os.listdir(out)}
    put(source, "late", x["late"])  # found after a restart, alone
    os.remove(f"{source}/two words.wav")
    assert streams.written(streams.arriving(spark, source), out, state, 32).awaitTermination(120)
    assert sorted(os.listdir(out)) == ["late.wav", "one.wav", "two words.wav"]
    assert all(os.stat(f"{out}/{n}").st_mtime_ns == t for n, t in before.items())
    got = {}
    for r in sorted(pcm.load(spark, out).collect(), key=lambda r: (r.channel, r.start_frame)):
        got.setdefault(r.clip_id, {}).setdefault(r.channel, []).extend(r.samples)
    for k, v in x.items():
        assert np.array_equal(np.array([got[k][i] for i in range(len(v))], np.float32), v)


def test_stream_equals_batch(spark, tmp_path):
    source = f"{tmp_path}/in"
    put(source, "a", np.linspace(-1, 1, 50_000, dtype=np.float32).reshape(2, -1))
    open(f"{source}/none.wav", "wb").close()
    q = streams.arriving(spark, source).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(str, spark.table("arrived").collect())) == sorted(map(str, pcm.load(spark, source).collect()))


def test_uncommitted_parts_go(tmp_path):
    w = streams.ClipWriter(str(tmp_path), 16)
    row = lambda at, ch, n: {"clip_id": "c", "channel": ch, "start_frame": at, "samples": [0.5] * n, "sample_rate": RATE, "errors": []}
    done = w.write(iter([row(0, 0, 4), row(0, 1, 4), row(4, 0, 2), row(4, 1, 2)]))
    assert len(os.listdir(tmp_path)) == 1
    w.abort([done, None], 0)
    assert os.listdir(tmp_path) == []
    w.commit([w.write(iter([row(0, 0, 4)]))], 1)
    assert os.listdir(tmp_path) == ["c.wav"]
    with pytest.raises(ValueError):
        w.write(iter([row(0, 0, 4), row(5, 0, 2)]))
