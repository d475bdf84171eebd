"""What each batch of the running streams did, as Spark reports it: no timing of the driver's own.

    watch = Progress()
    spark.streams.addListener(watch)
    marked(rows, "read").groupBy(...)...            # counts rows where they pass
    watch.batches(spark), watch.phases(spark), watch.stages(spark)
"""

from __future__ import annotations

from collections import deque
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Batches that are kept; older ones go.
MOST = 10_000
BATCHES = "query string, name string, batch_id long, at string, input_rows long, state_rows long, state_bytes long, late_rows long, took_ms long"
PHASES = "query string, batch_id long, phase string, ms long"
STAGES = "query string, batch_id long, stage string, metric string, value double"


class Progress(StreamingQueryListener):
    """Keeps the last ``most`` batches, and the errors of streams that ended with one."""

    def __init__(self, most: int = MOST):
        self._kept: deque = deque(maxlen=most)
        self._lock = Lock()
        self.failed: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        """A stream without a batch has no rows."""

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = p.stateOperators
        sums = [sum(x) for x in ([s.numRowsTotal for s in state], [s.memoryUsedBytes for s in state], [s.numRowsDroppedByWatermark for s in state])]
        batch = (str(p.id), p.name, p.batchId, p.timestamp, p.numInputRows, *sums, p.durationMs.get("triggerExecution", 0))
        stages = [(stage, k, float(v)) for stage, row in p.observedMetrics.items() for k, v in row.asDict().items() if v is not None]
        with self._lock:
            self._kept.append((batch, sorted(p.durationMs.items()), sorted(stages)))

    def onQueryIdle(self, event) -> None:
        """Nothing was done."""

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            with self._lock:
                self.failed[str(event.id)] = event.exception

    def _now(self) -> list:
        with self._lock:
            return list(self._kept)

    def batches(self, spark: SparkSession) -> DataFrame:
        """A row for each batch."""
        return spark.createDataFrame([b for b, _, _ in self._now()], BATCHES)

    def phases(self, spark: SparkSession) -> DataFrame:
        """Milliseconds of each phase of a batch (planning, offsets, the batch itself, commits)."""
        return spark.createDataFrame([(b[0], b[2], k, v) for b, own, _ in self._now() for k, v in own], PHASES)

    def stages(self, spark: SparkSession) -> DataFrame:
        """Metrics of the places that ``marked`` names, for each batch."""
        return spark.createDataFrame([(b[0], b[2], *s) for b, _, own in self._now() for s in own], STAGES)


def marked(df: DataFrame, stage: str, value: str | None = None) -> DataFrame:
    """The same rows; as they pass they are counted under a name, with a column's finite values and its extremes."""
    more = []
    if value:
        x = F.col(value).cast("double")
        good = ~F.isnan(x) & (F.abs(x) < float("inf"))
        more = [F.count_if(good).alias("finite"), F.min(F.when(good, x)).alias("least"), F.max(F.when(good, x)).alias("largest")]
    return df.observe(stage, F.count(F.lit(1)).alias("rows"), *more)
