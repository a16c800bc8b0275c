"""Distributed isotonic fit: brute force, borders of parts, many blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from testkit import preds_df
from wearline.operators import isotonic as ISO


def brute(y, s):
    """(lo, hi, value, n) by pooling adjacent violators over all distinct scores."""
    out = []
    for t in sorted(set(s)):
        hit = [a for a, b in zip(y, s) if b == t]
        out.append([t, t, sum(hit), len(hit)])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return [(a, b, p / n, n) for a, b, p, n in out]


def fitted(df):
    return sorted(tuple(r) for r in ISO.fit_blocks(df).select("lo", "hi", "value", "n").collect())


def shapes(n=300):
    rng = np.random.default_rng(5)
    s = rng.random(n).round(3)
    yield "informative", (rng.random(n) < s).astype(int), s
    yield "ties", (rng.random(n) < s).astype(int), s.round(1)
    yield "reversed", (rng.random(n) < 1 - s).astype(int), s
    yield "steps", (s > 0.5).astype(int), s
    yield "one", np.ones(n, int), s
    yield "zero", np.zeros(n, int), s
    # a late block that takes everything back to the first part, and an early one
    late = (rng.random(n) < s).astype(int)
    yield "late fall", np.concatenate((late, np.zeros(5 * n, int))), np.concatenate((s, np.full(5 * n, 2.0)))
    yield "early rise", np.concatenate((late, np.ones(5 * n, int))), np.concatenate((s, np.full(5 * n, -1.0)))
    # strictly rising means: every distinct score is a block of its own
    reps = np.arange(1, 60, 2)
    yield "rising", np.concatenate([[0] * (60 - k) + [1] * k for k in reps]), np.concatenate([[k / 60] * 60 for k in reps])


@pytest.mark.parametrize("settle,slopes,names", [(200_000, 512, ("informative", "late fall")), (3, 8, None)])
def test_fit_equals_brute_force(spark, monkeypatch, settle, slopes, names):
    monkeypatch.setattr(ISO, "SETTLE", settle)
    monkeypatch.setattr(ISO, "SLOPES", slopes)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many parts as there are
    try:
        for name, y, s in shapes():
            if names and name not in names:
                continue
            want = brute(y.tolist(), s.tolist())
            got = fitted(preds_df(spark, y, s).repartition(5))
            assert len(got) == len(want), name
            for a, b in zip(got, want):
                assert a[:2] == b[:2] and a[3] == b[3] and a[2] == pytest.approx(b[2], abs=1e-15), name
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("literal", [256, 0])
def test_scores_take_their_block(spark, monkeypatch, literal):
    monkeypatch.setattr(ISO, "LITERAL_BLOCKS", literal)
    blocks = spark.createDataFrame([(0.1, 0.2, 0.0, 3), (0.4, 0.4, 0.25, 1), (0.6, 0.9, 1.0, 4)], "lo double, hi double, value double, n long")
    s = [0.0, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.9, 1.0, None, float("nan")]
    want = [0.0, 0.0, 0.0, 0.0, 0.125, 0.25, 0.625, 1.0, 1.0, 1.0, 1.0, None, "nan"]
    df = spark.createDataFrame(list(enumerate(s)), "id int, y_score double").withColumn("lo", F.lit("kept"))
    got = {r.id: r.y_score for r in ISO.calibrated(df, blocks).collect()}
    for i, w in enumerate(want):
        g = got[i]
        assert (g is None) if w is None else (g != g) if w == "nan" else g == pytest.approx(w)


def test_no_rows(spark):
    empty = preds_df(spark, [0], [0.5]).where("false")
    assert fitted(empty) == []
    assert ISO.calibrated(preds_df(spark, [0], [0.5]), ISO.fit_blocks(empty)).first().y_score == 0.5
    odd = spark.createDataFrame([("m", 0, 0, 1, float("nan")), ("m", 0, 1, None, 0.5), ("m", 0, 2, 1, None), ("m", 0, 3, 1, 0.25)],
                                "model string, machine_id long, end_timestep long, y_true int, y_score double")
    assert fitted(odd) == [(0.25, 0.25, 1.0, 1)]


def test_every_score_a_block(spark, monkeypatch):
    """Strictly rising means over many parts: nothing pools, intervals are cut by slopes."""
    n = 120_000
    monkeypatch.setattr(ISO, "SETTLE", 20_000)
    counts = spark.range(n).select((F.col("id") / n).alias("s"), (F.col("id") + 1).alias("pos"), F.lit(n).cast("long").alias("n"))
    got = ISO.fit_counts(counts.repartition(4)).agg(F.count("*").alias("c"), F.max(F.abs(F.col("value") - F.col("lo") - 1 / n)).alias("e")).first()
    assert got.c == n and got.e < 1e-12
