"""A lasting account of a stream: rows read, rejected and dropped as late, per epoch.

``recentProgress`` keeps the last hundred batches and dies with the query. Here a
listener writes one row for every finished micro-batch into a table; the folder
of a batch is named by the query's lasting id (that of its checkpoint) and its
batch number, so a batch that is run again after a restart replaces its row and
sums stay right over any number of batches, runs and drivers.

Late rows are those that Spark's stateful operators dropped behind the watermark
(live windows: rows; windowed histograms: Spark sums a task's rows of one window
and bin before it drops them, so there they count as one). ``rows_seen`` and
``rows_rejected`` come from the metrics observed by ``observed``.
"""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "run_id string, batch_time string, rows_read long, rows_late long, rows_seen long, rows_rejected long, watermark string"
OBSERVED = "routing"


def observed(routed: DataFrame) -> DataFrame:
    """``routed`` (with ``reject_reason``), counted on its way."""
    return routed.observe(OBSERVED, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"))


class StreamAccount(StreamingQueryListener):
    """Writes the account of the session's queries under ``path``; ``query_ids``
    restricts it. Register with ``spark.streams.addListener``."""

    def __init__(self, spark: SparkSession, path: str, query_ids: set[str] | None = None):
        super().__init__()
        self.spark, self.path, self.query_ids = spark, path.rstrip("/"), query_ids
        self._seen: dict[str, int] = {}
        self._lock = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        query = str(p.id)
        if self.query_ids is not None and query not in self.query_ids:
            return
        late = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        seen = p.observedMetrics.get(OBSERVED)
        row = (str(p.runId), p.timestamp, p.numInputRows, late, seen["rows"] if seen else None, seen["rejected"] if seen else None,
               p.eventTime.get("watermark"))
        (self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("overwrite")
             .parquet(f"{self.path}/query_id={query}/batch_id={p.batchId}"))
        with self._lock:
            self._seen[query] = max(p.batchId, self._seen.get(query, -1))
            self._lock.notify_all()

    def wait_for(self, query, timeout: float = 60.0) -> None:
        """Until the query's last finished batch is in the table (events come after the batch)."""
        end = time.monotonic() + timeout
        last = query.lastProgress
        while last is not None:
            with self._lock:
                if self._seen.get(str(query.id), -1) >= last["batchId"]:
                    return
                if not self._lock.wait(max(0.0, end - time.monotonic())):
                    raise TimeoutError(f"batch {last['batchId']} of {query.id} is not in the account")


def batches(spark: SparkSession, path: str) -> DataFrame:
    """One row per query and batch."""
    schema = f"{SCHEMA}, query_id string, batch_id long"
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, n_batches, n_runs, rows_read, rows_late, rows_seen, rows_rejected) over a query's whole life."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows_read", "rows_late", "rows_seen", "rows_rejected")]
    return batches(spark, path).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_batches"), F.count_distinct("run_id").alias("n_runs"), *sums)
