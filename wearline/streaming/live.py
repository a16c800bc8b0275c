"""Structured Streaming jobs on sensor events (extensions: the reference has no
streams; these are its per-request window and drift checks run continuously).

X1  live windows: last T readings per machine kept in state, one window every
    S readings, in event-time order: rows wait in the state until the watermark
    has passed them (``applyInPandasWithState`` with event-time timers).
X2  drift per event-time window: watermark + tumbling window + histogram on
    fixed training edges; PSI per closed window.
X3  row-quality routing of a stream (stateless P3 projection); late and rejected
    rows are kept per epoch by ``account``.

Each has a batch twin (same semantics on a static DataFrame) used by the
registered queries and by the stream = batch tests.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.grids import histogram_bin
from ..session import store

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark, directory: str, glob: str = "events*.parquet",
                 max_files: int | None = None) -> DataFrame:
    """Events files of a directory as a stream; ``ts`` cast to TIMESTAMP
    (watermarks reject TIMESTAMP_NTZ; the session time zone is UTC)."""
    r = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    s = r.parquet(directory)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


# ---------------------------------------------------------------- X1

WINDOW_OUT = T.StructType([
    T.StructField("machine_id", T.LongType()), T.StructField("end_seq", T.LongType()),
    T.StructField("end_ts", T.TimestampType()), T.StructField("values", T.ArrayType(T.DoubleType()))])
WINDOW_STATE = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType())),
    T.StructField("last_us", T.LongType()), T.StructField("wait_us", T.ArrayType(T.LongType())),
    T.StructField("wait_id", T.ArrayType(T.LongType())), T.StructField("wait_value", T.ArrayType(T.DoubleType()))])


def _window_fn(window_size: int, step_size: int, idle_ms: int | None):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        upto = state.getCurrentWatermarkMs()
        seq, held, last, us, ids, values = -1, np.zeros(0), -1, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if state.exists:
            seq, vals, last, *waiting = state.get
            held = np.array(vals, dtype=np.float64)
            us, ids, values = (np.array(w, dtype=t) for w, t in zip(waiting, (np.int64, np.int64, np.float64)))
        if state.hasTimedOut and not len(us):
            state.remove()  # silent for longer than a machine may be
            return
        for p in () if state.hasTimedOut else pdfs:
            us = np.concatenate((us, p["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)))
            ids = np.concatenate((ids, p["event_id"].to_numpy(dtype=np.int64)))
            values = np.concatenate((values, p["value"].to_numpy(dtype=np.float64)))
        order = np.lexsort((ids, us))
        us, ids, values = us[order], ids[order], values[order]
        # rows up to the watermark are complete: later ones so old are dropped (and counted) by Spark
        n = int(np.searchsorted(us, upto * 1000, side="right"))
        ready, at = values[:n], us[:n]
        series = np.concatenate((held, ready))
        first = seq + 1 - len(held)                      # position of series[0]
        ends = np.arange(seq + 1, seq + 1 + n)
        ends = ends[(ends >= window_size - 1) & ((ends - (window_size - 1)) % step_size == 0)]
        last = int(at[-1]) if n else int(last)
        state.update((int(seq + n), series[-window_size:].tolist(), last, us[n:].tolist(), ids[n:].tolist(), values[n:].tolist()))
        if n < len(us):
            state.setTimeoutTimestamp(max(int(us[n]) // 1000, upto + 1))
        elif idle_ms:
            state.setTimeoutTimestamp(max(last // 1000 + idle_ms, upto + 1))
        if len(ends):
            windows = np.lib.stride_tricks.sliding_window_view(series, window_size)[ends - first - (window_size - 1)]
            yield pd.DataFrame({"machine_id": int(key[0]), "end_seq": ends,
                                "end_ts": pd.to_datetime(at[ends - (seq + 1)], unit="us"), "values": list(windows)})
    return fn


def live_windows(events: DataFrame, window_size: int, step_size: int, watermark: str = "1 day",
                 idle_ms: int | None = None) -> DataFrame:
    """Per machine, a window of the last T values every S readings, in event-time order.

    Rows wait in the machine's state until the watermark has passed them, so they
    take their place by (ts, event_id) however the files or batches arrive; rows
    behind the watermark are dropped by Spark and counted (``account``). State per
    machine: T values and the rows of one watermark delay. Rows without user or
    time have no place in a window; ``route_events`` rejects them, here they are
    left out. ``idle_ms`` forgets a machine whose last reading lies that far
    behind the watermark (its positions then start anew).
    """
    ev = events.where("ts IS NOT NULL AND user_id IS NOT NULL").select(
        F.col("user_id").alias("machine_id"), F.coalesce("event_id", F.lit(-1).cast("long")).alias("event_id"), "ts", "value")
    return ev.withWatermark("ts", watermark).groupBy("machine_id").applyInPandasWithState(
        _window_fn(window_size, step_size, idle_ms), WINDOW_OUT, WINDOW_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def live_windows_batch(event_readings: DataFrame, window_size: int, step_size: int) -> DataFrame:
    """X1 batch twin on numbered event readings (timestep = position)."""
    from ..operators.prepare import sliding_windows
    w = sliding_windows(event_readings.withColumn("__y", F.lit(0)), ["value"], window_size, step_size,
                        label_col="__y")
    return w.select("machine_id", F.col("end_timestep").alias("end_seq"), F.col("features").alias("values"))


# ---------------------------------------------------------------- X2

def training_edges(reference: DataFrame, col: str = "value", n_bins: int = 10) -> list[float]:
    """Fixed bin edges from the training data (one small aggregate)."""
    r = reference.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return [float(x) for x in np.linspace(r["lo"], r["hi"], n_bins + 1)]


def windowed_histogram(events: DataFrame, edges: list[float], window: str = "1 day",
                       watermark: str | None = "1 day", col: str = "value") -> DataFrame:
    """Counts per (event-time window, bin) on fixed edges; values outside the
    training range are clipped into the end bins."""
    ev = events
    if watermark:
        ev = ev.withWatermark("ts", watermark)
    v = F.least(F.greatest(F.col(col), F.lit(edges[0])), F.lit(edges[-1]))
    return (ev.where(F.col(col).isNotNull() & ~F.isnan(col))
              .groupBy(F.window("ts", window).alias("w"), histogram_bin(v, edges).alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))


def psi_against(hist: DataFrame, ref_hist: DataFrame, n_bins: int, eps: float = 1e-6,
                ref_total: int | None = None) -> DataFrame:
    """PSI of each window's histogram against the training histogram (``ref_hist``:
    bin, n; ``ref_total`` rows if known). Works on a static DataFrame (inside
    ``foreachBatch`` for streams)."""
    spine = hist.select("w").distinct().select("w", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    tot = hist.groupBy("w").agg(F.sum("n").alias("nt"))
    rt = ref_total if ref_total is not None else ref_hist.agg(F.sum("n").alias("rn")).first()["rn"]
    j = (spine.join(hist, ["w", "bin"], "left").join(tot, "w")
              .join(F.broadcast(ref_hist.withColumnRenamed("n", "rh")), "bin", "left"))
    c = (F.coalesce("n", F.lit(0)) + eps) / (F.col("nt") + eps * n_bins)
    r = (F.coalesce("rh", F.lit(0)) + eps) / (F.lit(float(rt)) + eps * n_bins)
    from ..operators.drift import psi_status
    out = j.groupBy("w").agg(F.sum((c - r) * F.log(c / r)).alias("psi"), F.first("nt").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "n", "psi", psi_status(F.col("psi")).alias("status"))


def reference_histogram(reference: DataFrame, edges: list[float], col: str = "value") -> DataFrame:
    v = F.least(F.greatest(F.col(col), F.lit(edges[0])), F.lit(edges[-1]))
    return (reference.where(F.col(col).isNotNull() & ~F.isnan(col))
                     .groupBy(histogram_bin(v, edges).alias("bin")).agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- X3

def route_events(events: DataFrame, lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Stateless P3 routing of events (value bounds, known event type)."""
    v = F.col("value")
    reason = (F.when(v.isNull() | F.isnan(v), F.lit("missing:value"))
               .when((v < lo) | (v > hi), F.lit("range:value"))
               .when(F.col("user_id").isNull(), F.lit("missing:user_id"))
               .when(F.col("ts").isNull(), F.lit("missing:ts")))
    return events.withColumn("reject_reason", reason)


def run_available_now(df: DataFrame, sink_name: str, checkpoint: str, mode: str = "append"):
    """Drive a streaming query over everything available, into a memory sink."""
    q = (df.writeStream.outputMode(mode).format("memory").queryName(sink_name)
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def late_rows(query) -> int:
    """Rows dropped behind the watermark in the batches that the session still
    remembers (the last hundred by default); ``account`` keeps them all."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def drift_alerts(events: DataFrame, reference: DataFrame, out_path: str, checkpoint: str,
                 window: str = "1 day", watermark: str = "1 day", n_bins: int = 10,
                 available_now: bool = True):
    """X2 end to end: windowed histograms on fixed training edges (state bounded by
    the watermark); each micro-batch's closed windows get their PSI against the
    training histogram in ``foreachBatch``. A batch owns the folder
    ``out_path/epoch=<id>`` and replaces it, so a repeated batch writes once."""
    edges = training_edges(reference, n_bins=n_bins)
    ref_hist = store(reference_histogram(reference, edges))
    ref_total = ref_hist.agg(F.sum("n")).first()[0]
    hist = windowed_histogram(events, edges, window, watermark)

    def sink(batch: DataFrame, epoch_id: int) -> None:
        if not batch.isEmpty():
            psi_against(batch, ref_hist, n_bins, ref_total=ref_total).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch_id}")

    w = hist.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def live_scores(events: DataFrame, fitted, window_size: int, step_size: int, watermark: str = "1 day",
                idle_ms: int | None = None) -> DataFrame:
    """X1 scoring: every S readings a machine's last T values go through a fitted
    window classifier (``operators.models.FittedClassifier``; a JVM transform,
    valid on a streaming DataFrame). Output: model, machine_id, end_timestep,
    end_ts, y_true (0: unknown online), y_score."""
    w = live_windows(events, window_size, step_size, watermark, idle_ms)
    feats = w.select("machine_id", F.col("end_seq").alias("end_timestep"), "end_ts",
                     F.col("values").alias("features"), F.lit(0).alias("label"))
    return fitted.score(feats, keep=["end_ts"])
