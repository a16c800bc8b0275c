"""Work that grows with the rows: tasks of bounded size, and margins in place of windows."""

import pytest
from pyspark.sql import functions as F

from test_models import planted
from wearline.operators import importance as IMP
from wearline.operators import models as ML
from wearline.operators import prepare as P
from wearline.session import store_in_tasks


def test_a_stored_task_holds_few_rows(spark):
    df = spark.range(0, 5000, 1, 2).select("id", F.array(F.col("id").cast("double")).alias("x"))
    stored = store_in_tasks(df, 100)
    assert max(r.n for r in stored.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()) <= 300
    assert sorted(r.id for r in stored.collect()) == list(range(5000)) and stored.dtypes == df.dtypes
    assert store_in_tasks(df, 5000).count() == 5000


def test_windows_are_built_by_more_tasks_when_rows_are_many(spark):
    rows = [(m, t, 0, float(t)) for m in range(6) for t in range(40)]
    df = spark.createDataFrame(rows, "machine_id long, timestep long, failure_imminent int, x double")
    assert P.window_partitions(df) is None and P.window_partitions(df, 10) == 24
    a, b = (sorted(P.sliding_windows(df, ["x"], 5, 5, partitions=n).collect()) for n in (None, 24))
    assert a == b and len(a) == 48


@pytest.mark.parametrize("kind", ["sensor", "temporal"])
def test_margins_give_the_importances_of_windows(spark, monkeypatch, kind):
    train, test = planted(spark, seed=1), planted(spark, 150, seed=2)
    fitted = ML.fit_logistic(train)

    def run():
        out = (IMP.sensor_permutation_importance(fitted, test, ["s0", "s1"]) if kind == "sensor"
               else IMP.temporal_permutation_importance(fitted, test, 6, 2, n_bins=3))
        return {tuple(r)[:-2]: tuple(r)[-2:] for r in out.collect()}

    monkeypatch.setattr(IMP, "_permuted", None)     # windows no longer travel
    got = run()
    monkeypatch.undo()
    monkeypatch.setattr(IMP, "LogisticRegressionModel", type("Other", (), {}))
    want = run()
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)
