"""Streams equal their batch twins; text-log readers; persistence round trips."""

import pytest
from pyspark.sql import functions as F

from testkit import SF
from wearline.operators import prepare as P
from wearline.sources import tables
from wearline.sources import text_logs as TL
from wearline.streaming import live as X


def closed(spark, batch, events, delay_days=1):
    """Batch windows whose last reading the final watermark has passed."""
    import datetime as dt
    upto = events.agg(F.max("ts")).first()[0] - dt.timedelta(days=delay_days)
    upto = upto.replace(microsecond=upto.microsecond // 1000 * 1000)  # watermarks are in milliseconds
    ends = events.where(F.col("timestep").isNotNull()).select("machine_id", F.col("timestep").alias("end_seq"), "ts")
    return batch.join(ends, ["machine_id", "end_seq"]).where(F.col("ts") <= F.lit(upto))


def test_live_windows_stream_equals_batch(spark, tmp_path):
    stream = X.event_stream(spark, SF)
    X.run_available_now(X.live_windows(stream, 10, 5), "x1_out", str(tmp_path / "ck1"))
    got = {(r.machine_id, r.end_seq): list(r["values"]) for r in spark.table("x1_out").collect()}
    events = tables.event_readings(spark, SF)
    batch = closed(spark, X.live_windows_batch(events, 10, 5), events).collect()
    want = {(r.machine_id, r.end_seq): list(r["values"]) for r in batch}
    assert got == want and len(got) > 0


def put_files(spark, folder, parts):
    """Parquet files that a stream reads one by one, in the order given."""
    import glob
    import os
    import shutil
    os.makedirs(folder, exist_ok=True)
    at = len(os.listdir(folder))
    for i, df in enumerate(parts):
        tmp = f"{folder}-tmp-{at + i}"
        df.coalesce(1).write.parquet(tmp)
        name = f"{folder}/events_{at + i:04d}.parquet"
        shutil.copy(glob.glob(f"{tmp}/part-*.parquet")[0], name)
        os.utime(name, (1_700_000_000 + at + i, 1_700_000_000 + at + i))


def test_shuffled_batches_give_the_same_windows(spark, tmp_path):
    """Rows dealt over seven files within two days of their time: the order of
    arrival plays no part, and nothing is late."""
    ev = spark.read.schema(X.EVENTS_SCHEMA).parquet(f"{SF}/events.parquet")
    day = F.datediff("ts", F.lit("2024-01-01"))
    slot = F.floor((day + F.pmod(F.xxhash64("event_id"), F.lit(2))) / 5)  # up to a day out of order
    parts = [ev.where(slot == k).orderBy(F.xxhash64("event_id", F.lit(1))) for k in range(7)]
    assert sum(p.count() for p in parts) == ev.count()
    put_files(spark, str(tmp_path / "in"), parts)
    stream = X.event_stream(spark, str(tmp_path / "in"), max_files=1)
    q = X.run_available_now(X.live_windows(stream, 10, 5, watermark="3 days"), "x1_shuffled", str(tmp_path / "ck"))
    rows = spark.table("x1_shuffled").collect()
    got = {(r.machine_id, r.end_seq): list(r["values"]) for r in rows}
    events = tables.event_readings(spark, SF)
    want = closed(spark, X.live_windows_batch(events, 10, 5), events, 3).collect()
    assert len(rows) == len(got) and X.late_rows(q) == 0 and len({p["batchId"] for p in q.recentProgress}) >= 7
    assert got == {(r.machine_id, r.end_seq): list(r["values"]) for r in want} and got


def days(spark, when, user=1):
    import datetime as dt
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), user, "x", float(d) if d is not None else None, "") for i, d in enumerate(when)]
    return spark.createDataFrame(rows, X.EVENTS_SCHEMA)


def test_state_is_bounded_and_late_rows_do_not_enter(spark, tmp_path):
    put_files(spark, str(tmp_path / "in"), [days(spark, range(20)), days(spark, [21, 20]), days(spark, [2, 22.5]), days(spark, [30])])
    stream = X.event_stream(spark, str(tmp_path / "in"), max_files=1)
    q = X.run_available_now(X.live_windows(stream, 3, 1), "x1_late", str(tmp_path / "ck"))
    rows = sorted((r.end_seq, list(r["values"])) for r in spark.table("x1_late").collect())
    order = [float(d) for d in range(22)] + [22.5]  # 20 and 21 in their places, the second 2 nowhere
    assert rows == [(i, order[i - 2:i + 1]) for i in range(2, 23)]
    assert X.late_rows(q) == 1
    spark.catalog.dropTempView("x1_late")


def test_account_outlives_progress_and_restarts(spark, tmp_path):
    from wearline.streaming import account as A
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    listener = A.StreamAccount(spark, str(tmp_path / "account"))
    spark.streams.addListener(listener)
    try:
        late = -2  # the second batch of all is still judged by the watermark before the first
        for run in range(2):
            parts = [days(spark, [100 + 10 * run])] + [days(spark, [1, 2, None if k % 2 else 200][:2] + [110 + run]) for k in range(4)]
            late += 8
            put_files(spark, str(tmp_path / "in"), parts)
            stream = A.observed(X.route_events(X.event_stream(spark, str(tmp_path / "in"), max_files=1), hi=105.0))
            hist = X.windowed_histogram(stream, [0.0, 1.0, 2.0])
            query = (hist.writeStream.outputMode("append").format("noop").option("checkpointLocation", str(tmp_path / "ck"))
                         .trigger(availableNow=True).start())
            query.awaitTermination()
            listener.wait_for(query)
            assert len(query.recentProgress) <= 2
        got = A.totals(spark, str(tmp_path / "account")).collect()
        assert len(got) == 1 and got[0].n_runs == 2 and got[0].query_id == str(query.id)
        assert got[0].rows_read == 26 and got[0].rows_late == late and got[0].n_batches >= 10
        assert got[0].rows_seen == 26 and got[0].rows_rejected == 9  # 110, 111 and the second 110 lie above the bound
    finally:
        spark.streams.removeListener(listener)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_stream_drift_histograms_equal_batch_on_closed_windows(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    edges = X.training_edges(ev.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp")))
    stream = X.event_stream(spark, SF)
    X.run_available_now(X.windowed_histogram(stream, edges, watermark="1 day"), "x2_out", str(tmp_path / "ck2"))
    got = {(r.w.start, r.bin): r.n for r in spark.table("x2_out").collect()}
    want = {(r.w.start, r.bin): r.n for r in X.windowed_histogram(ev, edges, watermark=None).collect()}
    assert got and all(want[k] == v for k, v in got.items())     # every emitted (closed) window agrees


def test_stream_routing_equals_batch(spark, tmp_path):
    stream = X.event_stream(spark, SF)
    X.run_available_now(X.route_events(stream).select("event_id", "reject_reason"), "x3_out", str(tmp_path / "ck3"))
    got = spark.table("x3_out")
    want = X.route_events(spark.read.parquet(f"{SF}/events.parquet")).select("event_id", "reject_reason")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


LOG = """1 1 -0.0007 -0.0004 100.0 518.67 641.82 1589.70 1400.60 14.62 21.61 554.36 2388.06 9046.19 1.30 47.47 521.66 2388.02 8138.62 8.4195 0.03 392 2388 100.00 39.06 23.4190  
1   2  0.0019 -0.0003 100.0 518.67 642.15 1591.82 1403.14 14.62 21.61 553.75 2388.04 9044.07 1.30 47.49 522.28 2388.07 8131.49 8.4318 0.03 392 2388 100.00 39.00 23.4236
2 1 -0.0043 0.0003 100.0 518.67 642.35 1587.99 1404.20 14.62 21.61 554.26 2388.08 9052.94 1.30 47.27 522.42 2388.03 8133.23 8.4178 0.03 390 2388 100.00 38.95 23.3442
2 2 0.0007 0.0000 100.0 518.67 642.37 1582.79 1401.87 14.62 21.61 554.45 2388.11 9049.48 1.30 47.13 522.86 2388.08 8133.83 8.3682 0.03 392 2388 100.00 38.88 23.3739
2 3 -0.0019 -0.0002 100.0 518.67 642.10 1584.47 1406.22 14.62 21.61 554.00 2388.06 9055.15 1.30 47.28 522.19 2388.04 8133.80 8.4294 0.03 393 2388 100.00 38.90 23.4044
"""


def test_sensor_log_and_rul_truth(spark, tmp_path):
    (tmp_path / "train.txt").write_text(LOG)
    (tmp_path / "RUL.txt").write_text("112\n98\n")
    log = TL.read_sensor_log(spark, str(tmp_path / "train.txt"))
    assert log.count() == 5 and len(TL.LOG_COLUMNS) == 26
    r = log.where("machine_id = 1 AND timestep = 2").first()
    assert r.sensor_2 == pytest.approx(642.15) and r.sensor_21 == pytest.approx(23.4236)
    truth = TL.attach_truth(log, TL.read_rul_file(spark, str(tmp_path / "RUL.txt")))
    assert {r.machine_id: r.rul_at_last for r in truth.collect()} == {1: 112, 2: 98}
    from wearline.operators.labels import add_rul_from_truth
    rul = {(r.machine_id, r.timestep): r.rul for r in add_rul_from_truth(log, truth).collect()}
    assert rul[(1, 1)] == 113 and rul[(2, 1)] == 100 and rul[(2, 3)] == 98
    assert TL.log_columns_for("FD002")[:2] == ["op_setting_1", "op_setting_2"]
    assert "sensor_1" not in TL.log_columns_for("FD001")
    (tmp_path / "RUL3.txt").write_text("1\n2\n3\n")
    with pytest.raises(ValueError):
        TL.attach_truth(log, TL.read_rul_file(spark, str(tmp_path / "RUL3.txt")))


def test_preprocessor_round_trip(spark, tmp_path):
    r = tables.readings(spark, SF)
    sp = P.split_machines(r)
    scaler = P.fit_scaler(r, tables.SENSORS, "robust")
    TL.save_preprocessor(spark, str(tmp_path / "prep"), scaler, {"test_size": 0.2, "val_size": 0.1, "seed": 42,
                                                                  "window_size": 50, "step_size": 10}, sp)
    s2, meta, sp2 = TL.load_preprocessor(spark, str(tmp_path / "prep"))
    assert s2 == scaler and meta["seed"] == 42 and sp2.exceptAll(sp).count() == 0


def test_readings_partitioned_sink(spark, tmp_path):
    r = tables.readings(spark, SF).select("machine_id", "timestep", "machine_type", "quantity")
    TL.write_readings(r, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == r.count()
    assert back.where(F.col("machine_type") == "ASIA").count() == r.where(F.col("machine_type") == "ASIA").count()


def test_drift_alerts_foreach_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ref = ev.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp"))
    q = X.drift_alerts(X.event_stream(spark, SF), ref, str(tmp_path / "alerts"), str(tmp_path / "ck4"))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "alerts"))
    assert out.count() > 0 and out.where("psi < 0").count() == 0
    assert set(r.status for r in out.collect()) <= {"OK", "WARNING", "CRITICAL"}


def test_live_scores_equal_batch_scores(spark, tmp_path):
    from wearline.operators import models as ML
    bw = X.live_windows_batch(tables.event_readings(spark, SF), 10, 5)
    train = bw.select("machine_id", F.col("end_seq").alias("end_timestep"), F.col("values").alias("features"),
                      (F.element_at("values", -1) > 50).cast("int").alias("label"))
    fitted = ML.fit_logistic(train)
    events = tables.event_readings(spark, SF)
    done = closed(spark, bw, events).select("machine_id", F.col("end_seq").alias("end_timestep"))
    want = {(r.machine_id, r.end_timestep): r.y_score for r in fitted.score(train).join(done, ["machine_id", "end_timestep"]).collect()}
    X.run_available_now(X.live_scores(X.event_stream(spark, SF), fitted, 10, 5), "x1_scores", str(tmp_path / "ck5"))
    got = {(r.machine_id, r.end_timestep): r.y_score for r in spark.table("x1_scores").collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_csv_reader_and_report_sink(spark, tmp_path):
    (tmp_path / "in.csv").write_text(",".join(f.name for f in TL.READINGS_CSV_SCHEMA) + "\n7,3,80.5,0.6,5.8,1790,12.5,pump,0,1,0.25\n7,4,,0.6,5.8,1790,12.5,pump,1,1,1.0\n")
    back = TL.read_readings_csv(spark, str(tmp_path / "in.csv")).orderBy("timestep").collect()
    assert (back[0].machine_id, back[0].temperature, back[0].machine_type) == (7, 80.5, "pump") and back[1].temperature is None
    df = spark.createDataFrame(back, TL.READINGS_CSV_SCHEMA)
    TL.write_readings(df, str(tmp_path / "csv"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    TL.write_report(df.select("machine_id", "timestep"), str(tmp_path / "report"))
    assert sorted((r.machine_id, r.timestep) for r in spark.read.json(str(tmp_path / "report")).collect()) == [(7, 3), (7, 4)]


def test_late_rows_are_counted(spark, tmp_path):
    import datetime as dt

    def put(name, days):
        rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), 1, "x", 1.0, "") for i, d in enumerate(days)]
        spark.createDataFrame(rows, X.EVENTS_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "tmp" / name))
        (tmp_path / "in").mkdir(exist_ok=True)
        import glob
        import os
        import shutil
        src = glob.glob(str(tmp_path / "tmp" / name / "part-*.parquet"))[0]
        shutil.copy(src, str(tmp_path / "in" / f"events_{name}.parquet"))
        os.utime(str(tmp_path / "in" / f"events_{name}.parquet"), (1_700_000_000 + len(name), 1_700_000_000 + len(name)))

    put("a", range(20))
    put("bb", [19])
    put("ccc", [0, 1, 19])  # two of them far behind the watermark of the first file
    stream = X.event_stream(spark, str(tmp_path / "in"), max_files=1)
    q = X.run_available_now(X.windowed_histogram(stream, [0.0, 1.0, 2.0]), "late_out", str(tmp_path / "ck"))
    assert X.late_rows(q) == 2


def test_alerts_of_a_repeated_batch_are_written_once(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ref = ev.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp"))
    counts = []
    for i in (1, 2):  # the same epochs again, from a fresh checkpoint
        X.drift_alerts(X.event_stream(spark, SF), ref, str(tmp_path / "alerts"), str(tmp_path / f"ck{i}")).awaitTermination()
        counts.append(spark.read.parquet(str(tmp_path / "alerts")).count())
    assert counts[0] == counts[1] > 0


def test_engines_are_ordered_without_sorting_their_rows(spark):
    """The first line decides, whatever the file, block or row order of the others."""
    rows = [(7, (0, 0, 5)), (7, (1, 0, 0)), (3, (0, 64, 0)), (3, (2, 0, 1)), (9, (0, 0, 6)), (9, (0, 0, 4)), (5, (0, 64, 2))]
    log = spark.createDataFrame(rows, "machine_id long, ingest_seq struct<file:int,block:long,row:long>")
    got = TL.engine_ordinals(log)
    assert {r.machine_id: r.ordinal for r in got.collect()} == {9: 0, 7: 1, 3: 2, 5: 3}
    assert got._jdf.queryExecution().executedPlan().toString().count("SortAggregate") == 0
