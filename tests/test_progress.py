import time

from tidemark.streaming import progress


def until(done):
    end = time.time() + 30
    while not done() and time.time() < end:
        time.sleep(0.2)
    assert done()


def test_rows_for_each_batch(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(i, float("nan") if i == 0 else float(i - k)) for i in range(10 * (k + 1))], "i long, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    watch = progress.Progress(most=50)
    spark.streams.addListener(watch)
    try:
        stream = spark.readStream.option("maxFilesPerTrigger", 1).schema("i long, v double").parquet(f"{tmp_path}/in")
        plan = progress.marked(progress.marked(stream, "read", "v").where("i % 2 = 0"), "even").groupBy("i").count()
        q = plan.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        until(lambda: watch.batches(spark).where("input_rows > 0").count() >= 3)
    finally:
        spark.streams.removeListener(watch)
    rows = sorted(watch.batches(spark).where("input_rows > 0").collect(), key=lambda r: r.batch_id)
    assert [r.batch_id for r in rows] == [0, 1, 2] and sorted(r.input_rows for r in rows) == [10, 20, 30]
    assert rows[-1].state_rows == 15 and all(r.name == "counted" and r.took_ms > 0 for r in rows)
    stages = {(r.batch_id, r.stage, r.metric): r.value for r in watch.stages(spark).collect()}
    for r in rows:
        assert stages[r.batch_id, "read", "rows"] == r.input_rows and stages[r.batch_id, "even", "rows"] == r.input_rows / 2
        assert stages[r.batch_id, "read", "finite"] == r.input_rows - 1
    assert {"addBatch", "triggerExecution"} <= {r.phase for r in watch.phases(spark).collect()} and watch.failed == {}


def test_bounded_and_failed(spark, tmp_path):
    watch = progress.Progress(most=1)
    spark.streams.addListener(watch)
    try:
        for k in range(2):
            spark.range(5).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.option("maxFilesPerTrigger", 1).schema("id long").parquet(f"{tmp_path}/in")
        q = stream.selectExpr("id").writeStream.format("memory").queryName("few").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        bad = stream.selectExpr("raise_error('no')").writeStream.format("noop").trigger(availableNow=True).start()
        try:
            bad.awaitTermination(120)
        except Exception:  # the stream's own error
            pass
        until(lambda: watch.failed)
    finally:
        spark.streams.removeListener(watch)
    assert watch.batches(spark).count() <= 1 and str(bad.id) in watch.failed
