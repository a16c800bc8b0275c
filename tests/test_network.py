"""The network's fit over packed blocks: against Spark ML, and however the rows lie."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier

from wearline.operators import models as ML
from wearline.operators import network as NW


def windows(spark, n, f=6, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, f))
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + 0.3 * rng.normal(size=n) > 0).astype(int)
    rows = [(i % 9, i, int(b), a) for i, (a, b) in enumerate(zip(x.tolist(), y))]
    return spark.createDataFrame(rows, "machine_id long, end_timestep long, label int, features array<double>")


def test_the_fit_is_spark_mls_where_its_blocks_are_equal(spark):
    train = windows(spark, 256).coalesce(1)  # two blocks of 128 rows
    std = ML.VectorStandardizer.fit(train)
    want = MultilayerPerceptronClassifier(featuresCol="x", layers=[6, 5, 4, 2], maxIter=40, seed=7).fit(std.transform(train))
    got = ML.fit_mlp(train, hidden=(5, 4), max_iter=40, seed=7)
    assert np.abs(got.model.weights.toArray() - want.weights.toArray()).max() < 1e-6
    assert isinstance(got.model, type(want)) and got.standardizer == std


def test_the_fit_does_not_depend_on_partitions(spark, monkeypatch):
    train = windows(spark, 300)
    a = ML.fit_mlp(train.coalesce(1), hidden=(5,), max_iter=25)
    monkeypatch.setattr(NW, "BLOCK", 16)
    monkeypatch.setattr(NW, "BLOCKS_A_TASK", 1)
    b = ML.fit_mlp(train.repartition(7), hidden=(5,), max_iter=25)
    assert np.abs(a.model.weights.toArray() - b.model.weights.toArray()).max() < 1e-6


def test_every_row_is_packed_once(spark, monkeypatch):
    monkeypatch.setattr(NW, "BLOCK", 16)
    got = NW.packed(windows(spark, 100, f=3).repartition(3), 3, "label").collect()
    x = np.concatenate([NW.unfold(r.x, r.at, 3) for r in got])
    assert all(len(r.y) <= 16 * 8 for r in got) and sum(len(r.y) for r in got) == 800
    want = np.array([r.features for r in windows(spark, 100, f=3).collect()])
    assert sorted(map(tuple, x)) == sorted(map(tuple, want))


def test_shared_values_are_kept_once():
    rng = np.random.default_rng(0)
    series = [rng.normal(size=(40, 2)) for _ in range(3)] + [np.ones((12, 2)), np.full((9, 2), np.nan)]
    x = np.array([s[i:i + 8].ravel() for s in series for i in range(0, len(s) - 7, 3)])
    for rows in (x, x[rng.permutation(len(x))], x[:1], x[-3:]):
        values, at = NW.fold(rows)
        assert np.array_equal(NW.unfold(values.tobytes(), at.tobytes(), 16), rows, equal_nan=True)
    assert len(NW.fold(x[:33])[0]) == 3 * (16 + 10 * 6)


def test_a_row_without_label_is_refused(spark):
    train = windows(spark, 40).selectExpr("machine_id", "end_timestep", "nullif(label, 1) AS label", "features")
    with pytest.raises(Exception, match="label of 0 or 1"):
        ML.fit_mlp(train, hidden=(3,), max_iter=2)
