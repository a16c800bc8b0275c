"""File order of logs, backward carries, exact draws, the chi-square tail."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.functions.special import chi2_df1_sf
from wearline.operators import labels as L
from wearline.operators import prepare as P
from wearline.sources import text_logs as TL


def line(unit, cycle):
    return " ".join([str(unit), str(cycle)] + ["0.5"] * 24)


def test_engines_of_unequal_files_keep_their_order(spark, tmp_path):
    """Spark reads the large file first; the order of paths decides all the same."""
    log, rul = tmp_path / "log", tmp_path / "rul"
    log.mkdir(), rul.mkdir()
    (log / "part-1.txt").write_text("\n".join(line(7, c) for c in range(1, 4)) + "\n\n")
    (log / "part-2.txt").write_text("\n".join(line(u, c) for u in (2, 9) for c in range(1, 301)))
    (log / "part-3 b.txt").write_text("\n".join(line(1, c) for c in range(1, 3)))
    (rul / "a.txt").write_text("70\n")
    (rul / "b.txt").write_text("\n".join(["20", "90", "", "10"]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # the large file in several pieces
    try:
        readings = TL.read_sensor_log(spark, str(log))
        truth = TL.attach_truth(readings, TL.read_rul_file(spark, str(rul)))
        assert {r.machine_id: r.rul_at_last for r in truth.collect()} == {7: 70, 2: 20, 9: 90, 1: 10}
        assert {r.machine_id: r.ordinal for r in TL.engine_ordinals(readings).collect()} == {7: 0, 2: 1, 9: 2, 1: 3}
        order = [(r.machine_id, r.timestep) for r in readings.orderBy("ingest_seq").collect()]
        assert order == [(7, c) for c in (1, 2, 3)] + [(u, c) for u in (2, 9) for c in range(1, 301)] + [(1, 1), (1, 2)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_next_event_of_several(spark, chunk):
    rng = np.random.default_rng(chunk)
    rows = [(m, t, int(rng.random() < 0.04)) for m in (1, 2, None) for t in rng.permutation(100).tolist()] + [(3, t, 0) for t in range(5)]
    df = spark.createDataFrame(rows, "machine_id long, timestep long, failure_event int").repartition(3)
    got = {(r.machine_id, r.timestep): r.next_event for r in L.next_event(df, chunk_len=chunk).collect()}
    for m, t, _ in rows:
        assert got[m, t] == min((u for n, u, e in rows if n == m and e and u >= t), default=None)


def test_horizon_of_any_length(spark):
    rows = [(1, t, int(t in (10, 14, 60))) for t in range(70)]
    df = spark.createDataFrame(rows, "machine_id long, timestep long, failure_event int")
    for h in (0, 3, 1000):
        got = {r.timestep: r.failure_imminent_event for r in L.add_event_horizon_labels(df, h).collect()}
        assert got == {t: int(any(f - h <= t <= f for f in (10, 14, 60))) for t in range(70)}


def windows(spark, n=500):
    rows = [(i % 9, i, int(i % 25 == 0), "x") for i in range(n)]
    return spark.createDataFrame(rows, "machine_id long, end_timestep long, label int, extra string")


def test_draws_are_exact_and_balanced(spark):
    df, key = windows(spark), ["machine_id", "end_timestep"]
    out = P.balanced_draws(df, key, n=4000).collect()
    assert len(out) == 4000 and abs(sum(r.label for r in out) - 2000) < 5 * math.sqrt(1000)
    per = {}
    for r in out:
        per.setdefault(r.label, {}).setdefault(r.end_timestep, []).append(r.copy)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for g in per.values() for c in g.values())
    assert len(per[1]) == 20 and min(len(c) for c in per[1].values()) > 50  # each about 100 times
    again = P.balanced_draws(df.repartition(7), key, n=4000)
    assert sorted((r.end_timestep, r.copy) for r in again.collect()) == sorted((r.end_timestep, r.copy) for r in out)
    assert P.balanced_draws(df, key).count() == 500
    assert sorted((r.end_timestep, r.copy) for r in P.balanced_draws(df, key, n=4000, seed=1).collect()) != sorted((r.end_timestep, r.copy) for r in out)


def test_draws_of_one_class_and_of_nothing(spark):
    key = ["machine_id", "end_timestep"]
    out = P.balanced_draws(windows(spark).where("label = 0"), key, n=50).collect()
    assert len(out) == 50 and {r.label for r in out} == {0}
    none = P.balanced_draws(windows(spark).where("false"), key, n=50)
    assert none.collect() == [] and "copy" in none.columns


def test_chi_square_tail(spark):
    x = sorted({0.0, -1.0, 1e-12, 7.999999, 8.0, 8.000001, 10.778947368421053, 700.0, 1400.0} | {float(v) for v in np.geomspace(1e-8, 1300, 400)})
    rows = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double").select("x", chi2_df1_sf(F.col("x")).alias("p")).collect()
    for r in rows:
        if r.x is None:
            assert r.p is None
        else:
            assert r.p == pytest.approx(math.erfc(math.sqrt(r.x / 2)) if r.x > 0 else 1.0, rel=1e-12)
