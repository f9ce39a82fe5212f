"""What streaming queries and executors did, as tables: Spark's own progress events and executor metrics.

`Recorder` is a listener that writes a row for each micro-batch of every query of the session to a folder that
driver and executors share; rows gather in the driver up to FLUSH of them, or until a query ends.  Totals and
running maxima are then aggregates and windows over these rows.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

ROWS = "query string, run string, batch long, at string, input_rows long, trigger_ms double, batch_ms double, state_rows long, state_bytes long"

#: Rows in the driver before they are written, and least milliseconds that count as blocked.
FLUSH, BLOCKED = 256, 0.05

#: Executor metrics by their names in Spark.
METRICS = {"heap_bytes": "JVMHeapMemory", "off_heap_bytes": "JVMOffHeapMemory", "execution_bytes": "OnHeapExecutionMemory", "storage_bytes": "OnHeapStorageMemory", "python_bytes": "ProcessTreePythonRSSMemory"}


class Recorder(StreamingQueryListener):
    """Use as a context: rows of queries that run inside are in `table()` when they have ended and `ended(query)` was waited for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._held, self._over, self._lock = [], {}, threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        took = p.durationMs
        row = (p.name or str(p.id), str(p.runId), p.batchId, p.timestamp, p.numInputRows, float(took.get("triggerExecution", 0)), float(took.get("addBatch", 0)), sum(s.numRowsTotal for s in p.stateOperators), sum(s.memoryUsedBytes for s in p.stateOperators))
        with self._lock:
            self._held.append(row)
            full = len(self._held) >= FLUSH
        if full:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        self.flush()
        self._event(str(event.runId)).set()

    def _event(self, run: str) -> threading.Event:
        with self._lock:
            return self._over.setdefault(run, threading.Event())

    def ended(self, query, seconds: float = 60) -> bool:
        """Waits until the listener has seen the end of a query's run: its rows are written then."""
        return self._event(str(query.runId)).wait(seconds)

    def flush(self) -> None:
        with self._lock:
            rows, self._held = self._held, []
        if rows:
            self.spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(self.folder)

    def table(self) -> DataFrame:
        """A row a micro-batch: what ran, how many rows came, how long it took, what state it holds."""
        self.flush()
        # an empty append makes the folder where no query has reported yet
        self.spark.createDataFrame([], ROWS).write.mode("append").parquet(self.folder)
        return self.spark.read.schema(ROWS).parquet(self.folder)

    def __enter__(self) -> Recorder:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)
        self.flush()


def blocked(interval_ms: float) -> F.Column:
    """By how much a micro-batch outlasted the trigger's interval: arrivals waited for that long."""
    over = F.col("trigger_ms") - interval_ms
    return F.when(over > BLOCKED, over).otherwise(0.0)


def running(rows: DataFrame, interval_ms: float) -> DataFrame:
    """Each micro-batch with totals and maxima of its run so far: maintenance time, pending rows, batches that came too late."""
    w = Window.partitionBy("query", "run").orderBy("batch")
    return rows.select(
        "query", "run", "batch", F.sum("batch_ms").over(w).alias("maintenance_ms_total"), F.max("batch_ms").over(w).alias("maintenance_ms_max"), F.max("input_rows").over(w).alias("max_pending"),
        F.sum(F.when(blocked(interval_ms) > 0, 1).otherwise(0)).over(w).alias("backpressure_count"), F.sum(blocked(interval_ms)).over(w).alias("backpressure_ms_total"), F.max("state_bytes").over(w).alias("max_state_bytes"),
    )


def totals(rows: DataFrame, interval_ms: float) -> DataFrame:
    """The same at the end, a row a query over all its runs; partial sums are shuffled, not batches."""
    return rows.groupBy("query").agg(
        F.count("*").alias("batches"), F.sum("input_rows").alias("rows"), F.sum("batch_ms").alias("maintenance_ms_total"), F.max("batch_ms").alias("maintenance_ms_max"), F.max("input_rows").alias("max_pending"),
        F.sum(F.when(blocked(interval_ms) > 0, 1).otherwise(0)).alias("backpressure_count"), F.sum(blocked(interval_ms)).alias("backpressure_ms_total"), F.max("state_bytes").alias("max_state_bytes"),
    )


def executors(spark: SparkSession) -> DataFrame:
    """A row an executor, the driver included: tasks done, bytes read and written by shuffles, and peaks of memory (null until its first heartbeat)."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    rows = []
    for i in range(found.size()):
        e = found.apply(i)
        peak = e.peakMemoryMetrics()
        held = [int(peak.get().getMetricValue(m)) if peak.isDefined() else None for m in METRICS.values()]
        rows.append((e.id(), int(e.completedTasks()), int(e.failedTasks()), int(e.totalShuffleRead()), int(e.totalShuffleWrite()), *held))
    return spark.createDataFrame(rows, "executor string, tasks long, failed_tasks long, shuffle_read_bytes long, shuffle_write_bytes long, " + ", ".join(f"{c} long" for c in METRICS))
