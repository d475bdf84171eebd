import numpy as np
import pytest
from tidemark.operators import kernels as k
from tidemark.streaming import live

SCHEMA = "clip_id string, channel int, chunk_idx long, ts timestamp, samples array<double>, final boolean"
RATE = 48_000


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def chunked(clip, x, sizes, final=True, minute=0):
    out, at = [], 0
    for i, n in enumerate(sizes):
        out.append((clip, 0, i, f"2024-01-01 00:{minute:02d}:{i:02d}", [float(v) for v in x[at : at + n]], final and i == len(sizes) - 1))
        at += n
    return out


def ended(rows):
    return {r.clip_id: r for r in rows if r.ended}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).selectExpr("clip_id", "channel", "chunk_idx", "cast(ts as timestamp) ts", "samples", "final")


def test_stream_with_restart_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = {c: rng.standard_normal(700) for c in "abc"}
    rows = {c: chunked(c, v, s) for (c, v), s in zip(x.items(), ([100, 1, 0, 5, 594], [700], [11, 12, 300, 377]), strict=True)}
    first = rows["a"][:2] + [rows["c"][3], rows["c"][1]] + rows["b"]
    second = rows["a"][2:] + [rows["c"][0], rows["c"][2], rows["c"][1]]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    for part in (first, second):  # the query ends and is started again from its checkpoint
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = live.true_peaks(stream, RATE, "10 minutes").writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out"))
        q = q.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    for c, v in x.items():
        r = ended(got)[c]
        assert abs(r.peak - k.true_peak(v, RATE)) < 1e-12 and r.frames == 700 and r.missing == 0
    assert any(r.clip_id == "a" and not r.ended and r.frames == 101 for r in got)
    batch = ended(live.true_peaks(frame(spark, first + second), RATE).collect())
    assert all(abs(batch[c].peak - ended(got)[c].peak) < 1e-12 for c in x)


def test_timer_flushes_what_is_left(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(300)
    rows = chunked("open", x, [100, 100, 100], final=False)
    del rows[1]  # never comes
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    frame(spark, chunked("later", x, [30], minute=30)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(SCHEMA).parquet(f"{tmp_path}/in")
    q = live.true_peaks(stream, RATE, "1 minutes").writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out"))
    q = q.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    r = ended(spark.read.parquet(f"{tmp_path}/out").collect())["open"]
    assert r.missing == 1 and r.frames == 200 and r.chunks == 2
    assert abs(r.peak - max(k.true_peak(x[:100], RATE), k.true_peak(x[200:], RATE))) < 1e-12
