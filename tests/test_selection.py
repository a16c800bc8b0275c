"""Exact quantiles by selection against NumPy, the ordered layout and odd values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.operators import selection as S
from wearline.operators.quantiles import exact_quantiles

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)


def test_keys_order_like_numbers():
    x = np.array([-np.inf, -1e300, -2.5, -1e-320, 0.0, 5e-324, 1.0, 1.0 + 2**-52, 1e308, np.inf])
    k = S.ordered_bits(x)
    assert (np.diff(k.astype(object)) > 0).all()
    assert [S.from_bits(int(i)) for i in k] == x.tolist()
    assert S.ordered_bits(np.array([-0.0]))[0] == S.ordered_bits(np.array([0.0]))[0]


@pytest.mark.parametrize("groups_at_once,held", [(4096, 1 << 20), (4096, 3), (1, 1 << 20)])
def test_quantiles(spark, monkeypatch, groups_at_once, held):
    monkeypatch.setattr(S, "MAX_GROUPS", groups_at_once)  # 1: the ordered layout takes over
    monkeypatch.setattr(S, "HELD", held)
    rng = np.random.default_rng(4)
    rows = []
    for g, n in (("a", 901), ("b", 2), ("c", 1), (None, 50)):
        for _ in range(n):
            rows.append((g, None if rng.random() < .1 else float(rng.normal() * 10.0 ** rng.integers(-5, 9)), float(rng.integers(-3, 3))))
    rows += [("a", float("nan"), -0.0), ("d", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(4)
    got = {(r.g, r.sensor): r.q for r in S.select_quantiles(df, ["g"], ["v", "w"], PROBS).collect()}
    assert ("d", "v") not in got and got["d", "w"] == [1.0] * len(PROBS)
    for (g, c), q in got.items():
        v = [r["vw".index(c) + 1] for r in rows if r[0] == g]
        assert q == pytest.approx(np.percentile([x for x in v if x is not None and x == x], [100 * p for p in PROBS]).tolist(), rel=1e-12)


def test_no_groups_and_no_rows(spark):
    df = spark.range(1000).select((F.col("id") % 97).alias("v"), F.lit(None).cast("double").alias("w"))
    out = S.select_quantiles(df, [], ["v", "w"], (0.5,)).collect()
    assert [(r.sensor, r.q) for r in out] == [("v", [pytest.approx(float(np.median(np.arange(1000) % 97)))])]
    assert S.select_quantiles(df.where("false"), [], ["v"], (0.5,)).collect() == []


def test_same_as_the_ordered_layout(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.sin("id").alias("v")).repartition(5)
    a = {r.g: r.q for r in S.select_quantiles(df, ["g"], ["v"], PROBS).collect()}
    assert a == {r.g: r.q for r in exact_quantiles(df, ["g"], "v", PROBS).collect()}
