"""Forests grown over scans: against plain computations on their own rows."""

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from wearline.operators import forest as FO
from wearline.operators import models as ML


def windows(spark, n=600, f=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, f)).round(2)
    y = (x[:, 0] + 0.5 * x[:, 3] + 0.4 * rng.normal(size=n) > 0.3).astype(int)
    rows = [(i % 9, i, int(b), a) for i, (a, b) in enumerate(zip(x.tolist(), y))]
    return spark.createDataFrame(rows, "machine_id long, end_timestep long, label int, features array<double>")


def nodes(fitted):
    return fitted.model.toDebugString.split("\n", 1)[1]


def test_a_forest_does_not_depend_on_partitions(spark, monkeypatch):
    train = windows(spark)
    a = ML.fit_random_forest(train, num_trees=5, max_depth=5)
    monkeypatch.setattr(FO, "ROWS_A_TASK", 90)
    monkeypatch.setattr(FO, "NODES_A_ROW", 3)
    b = ML.fit_random_forest(train.repartition(7), num_trees=5, max_depth=5)
    assert isinstance(a.model, RandomForestClassificationModel) and nodes(a) == nodes(b)
    assert a.model.getNumTrees == 5 and abs(sum(a.model.featureImportances.toArray()) - 1) < 1e-9


def test_every_split_is_the_best_of_its_features():
    rng = np.random.default_rng(0)
    c = rng.integers(0, 9, size=(20, 4, 8, 2))
    c[:, 1:] = c[:, :1][:, :, rng.permutation(8)]     # the same rows, whatever the feature
    j, cut, gain, sides = FO.best_splits(c, (0.7, 2.0), 2)

    def impurity(v):
        return 1 - ((v / v.sum()) ** 2).sum() if v.sum() else 0.0

    for i in range(20):
        best = -1.0
        for f in range(4):
            for k in range(7):
                lo, hi = c[i, f, :k + 1].sum(0), c[i, f, k + 1:].sum(0)
                if lo.sum() >= 2 and hi.sum() >= 2:
                    w = np.array([0.7, 2.0])
                    n = ((lo + hi) * w).sum()
                    best = max(best, impurity((lo + hi) * w) - (lo * w).sum() / n * impurity(lo * w) - (hi * w).sum() / n * impurity(hi * w))
        assert abs(gain[i] - best) < 1e-12
        assert (sides[i, 0] == c[i, j[i], :cut[i] + 1].sum(0)).all() and (sides[i].sum(0) == c[i, 0].sum(0)).all()


def test_thresholds_come_from_all_rows(spark):
    rows = spark.range(0, 50_000, 1, 5).select(F.array(F.col("id").cast("double"), (F.col("id") % 3).cast("double"), F.lit(4.0)).alias("x"))
    a, b, c = FO.thresholds(rows, 3, 31)
    assert len(a) == 31 and np.abs(a - np.arange(1, 32) * 50_000 / 32).max() < 150
    assert b.tolist() == [0.5, 1.5] and len(c) == 0


def test_one_class_gives_a_forest_of_leaves(spark):
    train = windows(spark, 40).withColumn("label", F.lit(0))
    fitted = ML.fit_random_forest(train, num_trees=2, max_depth=3)
    assert {r.y_score for r in fitted.score(train).collect()} == {0.0}


def grown(rng, depth, f):
    """A tree whose every fourth node is a leaf."""
    feature, cut, left, last = [0], [0], [-1], [0]
    for _ in range(depth):
        new = []
        for n in last:
            if n and rng.random() < 0.25:
                continue
            left[n], feature[n], cut[n] = len(left), int(rng.integers(f)), int(rng.integers(10, 22))
            new += [len(left), len(left) + 1]
            left += [-1, -1]
            feature += [0, 0]
            cut += [0, 0]
        last = new
    a = np.array
    return FO.Tree(a(feature, np.int32), a(cut, np.int16), a(left, np.int32), np.zeros(len(left)), np.zeros((len(left), 2)), a(last[::2] or [0], np.int32))


def test_counts_are_those_of_each_open_node(monkeypatch):
    rng = np.random.default_rng(2)
    b, y, drawn = rng.integers(0, 32, size=(900, 7)), rng.integers(0, 2, 900), rng.poisson(1.0, 900).astype(np.uint8)
    lines = (2 * b + y[:, None]).astype(np.uint8)
    for depth in (0, 1, 3, 5):
        tree = grown(rng, depth, 7)
        subset = np.argsort(rng.random((len(tree.open), 7)), axis=1)[:, :3].astype(np.uint16)
        want = np.zeros((len(tree.open), 3, 64), dtype=np.uint32)
        for i in range(900):
            node = 0
            while tree.left[node] >= 0:
                node = tree.left[node] + (b[i, tree.feature[node]] > tree.cut[node])
            for at in np.flatnonzero(tree.open == node):
                for j in range(3):
                    want[at, j, lines[i, subset[at, j]]] += drawn[i]
        for alone in (1, 40, 10_000):
            monkeypatch.setattr(FO, "ROWS_ALONE", alone)
            got = FO._counts(np.ascontiguousarray(lines.T), lines, drawn, tree, subset, depth, 64)
            assert (got == want).all() and want.any()
    assert [FO._small(np.array([n], np.uint32)).itemsize for n in (0, 255, 256, 65_535, 65_536)] == [1, 1, 2, 2, 4]


def test_rows_go_down_once_and_few_bytes_travel(spark, monkeypatch):
    """Rows of large nodes are read from their feature's column; a forest is the same either way."""
    train = windows(spark, 900)
    a = ML.fit_random_forest(train, num_trees=4, max_depth=6)
    monkeypatch.setattr(FO, "ROWS_ALONE", 5)
    assert nodes(ML.fit_random_forest(train.repartition(3), num_trees=4, max_depth=6)) == nodes(a)


def test_forests_of_many_sizes_are_those_grown_alone(spark, monkeypatch):
    train, scans = windows(spark, 500), []
    level = FO._level
    monkeypatch.setattr(FO, "_level", lambda *a: scans.append(a[3]) or level(*a))
    sizes = [(2, 3), (2, 6), (5, 3), (4, 0), (5, 5)]
    together = ML.fit_random_forests(train, sizes)
    assert scans == list(range(6))                  # one scan a level for all of them
    for (num_trees, max_depth), got in zip(sizes, together):
        want = ML.fit_random_forest(train, num_trees=num_trees, max_depth=max_depth)
        assert nodes(got) == nodes(want) and got.model.getNumTrees == num_trees
        assert got.model.featureImportances == want.model.featureImportances
        assert max(t.depth for t in got.model.trees) <= max_depth
