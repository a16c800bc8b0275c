"""Labels, numbering, windows, scalers, split, quality, drift."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from testkit import SF
from wearline.operators import drift as D
from wearline.operators import labels as L
from wearline.operators import prepare as P
from wearline.operators import quality as Q
from wearline.operators import readings_ops as R
from wearline.operators import sequence as S
from wearline.operators.quantiles import exact_quantiles
from wearline.plans import fixtures as fx
from wearline.sources import tables


def series(spark, rows):
    return spark.createDataFrame(rows, "machine_id long, timestep long, x double, failure_imminent int")


def numbered(rows):
    """Brute force: 0-based position and total per key, NULLs first."""
    order = sorted(rows, key=lambda r: tuple((v is not None, v) for v in r[:3]))
    out, seen = {}, {}
    for r in order:
        out[r] = seen[r[0]] = seen.get(r[0], -1) + 1
    return {r: (p, seen[r[0]] + 1) for r, p in out.items()}


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_numbering_with_nulls_and_one_large_key(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(1 if i % 3 else (None if i % 30 == 0 else i % 7), None if rng.random() < .1 else int(rng.integers(0, 90_000)), i) for i in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k long, t long, i long").repartition(5)
        df = df.withColumn("ts", F.timestamp_seconds("t"))  # several rows of a day, in any order
        got = {(r.k, r.t, r.i): (r.pos, r.n_rows) for r in S.number_within_key(df, "k", ["ts", "i"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == numbered(rows)


def test_numbering_of_one_key_and_of_nothing(spark):
    one = spark.range(500).select(F.lit(1).alias("k"), (F.lit(499) - F.col("id")).alias("t"))
    assert [r.pos for r in S.number_within_key(one, "k", ["t"]).orderBy("t").collect()] == list(range(500))
    assert S.number_within_key(one.limit(0), "k", ["t"]).count() == 0


def test_readings_count_up(spark):
    n = tables.readings(spark, SF).groupBy("machine_id").agg(F.max("timestep").alias("m"), F.count("*").alias("n"))
    assert n.where("m != n - 1").count() == 0


def test_non_monotone_across_parts(spark):
    rows = [(m, t if not (m == 2 and t == 150) else 10, t) for m in (1, 2, 3) for t in range(300)]
    df = spark.createDataFrame(rows, "machine_id long, timestep long, seq long").repartition(4)
    assert [r.machine_id for r in Q.non_monotone_machines(df, ["seq"]).collect()] == [2]


def test_lag_coupling_chunks_and_short_machines(spark):
    rng = np.random.default_rng(1)
    rows = [(m, t, float(rng.random()), float(rng.random())) for m, n in ((1, 57), (2, 1), (3, 2)) for t in range(n)]
    df = spark.createDataFrame(rows, "machine_id long, timestep long, d double, f double")
    got = {r.machine_id: r for r in L.lag_coupling(df, "d", "f", chunk_len=10).collect()}
    d = np.array([(r[2], r[3]) for r in rows if r[0] == 1])
    assert got[1].n_pairs == 56 and got[1].lag_corr == pytest.approx(np.corrcoef(d[:-1, 0], d[1:, 1])[0, 1])
    assert (got[2].n_pairs, got[2].lag_corr) == (0, None) and got[3].n_pairs == 1


def test_windows_follow_machine_and_chunk(spark):
    """No plan node groups a machine as a whole under the windows."""
    lab = fx.labeled_readings(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = P.sliding_windows(lab, tables.SENSORS, 50, 10, keep_cols=["split"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and all("__chunk" in x or "__part" in x for x in exchanges)


def test_guard_raises_on_missing_values(spark):
    for bad in (None, float("nan")):
        df = spark.createDataFrame([(1, 0, bad, 0), (1, 1, 2.0, 0)], "machine_id long, timestep long, x double, y int")
        with pytest.raises(ValueError, match="missing sensor values"):
            Q.require_clean(df, ["x"], "y")
    ok = spark.createDataFrame([(1, 0, 1.0, 0)], "machine_id long, timestep long, x double, y int")
    assert Q.require_clean(ok, ["x"], "y").first().n_rows == 1
    with pytest.raises(ValueError, match="missing columns"):
        Q.require_clean(ok, ["x", "z"], "y")


@pytest.mark.parametrize("lam", [0.01, 0.4, 1.0, 7.3, 1000.0])
def test_poisson_copies(spark, lam):
    # n_pos rows of label 1 among n rows: lambda = n / (2 n_pos)
    n_pos = 400 if lam < 100 else 3
    n_neg = int(round(2 * n_pos * lam)) - n_pos
    label, other = (1, 0) if n_neg > 0 else (0, 1)
    n = 2 * lam * n_pos
    k = P.poisson_resample(_labels(spark, n_pos, max(n_neg, 1)), ["i"]) if n_neg > 0 else None
    if k is None:  # a rate below one half: the larger class
        rare = max(1, int(n_pos * lam))
        k = P.poisson_resample(_labels(spark, rare, n_pos * 10), ["i"])
        lam, n_pos, label = (rare + n_pos * 10) / (2 * n_pos * 10), n_pos * 10, 0
    copies = k.where(F.col("label") == label).count()
    assert abs(copies / n_pos - lam) < 6 * (lam / n_pos) ** 0.5 + 1e-9


def _labels(spark, n_pos, n_neg):
    return spark.range(n_pos + n_neg).select(F.col("id").alias("i"), (F.col("id") < n_pos).cast("int").alias("label"))


def test_poisson_draws_have_the_right_law(spark):
    for lam in (0.2, 1.0):
        cdf = P.poisson_cdf(lam)
        assert abs(cdf[-1] - 1) < 1e-15 and cdf[0] == pytest.approx(np.exp(-lam))
    with pytest.raises(ValueError):
        P.poisson_cdf(2.0)
    u = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (0.0, 0.36, 0.37, 0.999, 1 - 2**-53)])).alias("u"))
    assert [r.k for r in u.select(P.poisson_inverse(F.col("u"), 1.0).alias("k")).collect()] == [0, 0, 1, 5, 18]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(9)
    rows = [(g, None if rng.random() < .05 else float(np.round(rng.normal(), d))) for g, n, d in (("a", 1001, 3), ("b", 2, 9), ("c", 1, 9)) for _ in range(n)]
    df = spark.createDataFrame(rows + [("d", None), ("a", float("nan"))], "g string, v double").repartition(4)
    got = {r.g: r.q for r in exact_quantiles(df, ["g"], "v", (0.0, 0.1, 0.5, 0.75, 1.0)).collect()}
    assert "d" not in got
    for g in got:
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g] == pytest.approx(np.percentile(v, [0, 10, 50, 75, 100]).tolist())


def test_pruned_sensors(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0)], "machine_id long, a double, b double")
    assert R.prune_near_constant(df, ["machine_id"], ["a", "b"]).columns == ["machine_id", "a"]


def test_windows_short_and_exact_machine(spark):
    rows = [(1, t, float(t), 0) for t in range(3)] + [(2, t, float(t), int(t == 4)) for t in range(5)]
    w = P.sliding_windows(series(spark, rows), ["x"], 5, 2).collect()
    assert len(w) == 1 and w[0].machine_id == 2 and w[0].label == 1
    assert w[0].features == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_windows_chunked_equal_unchunked(spark):
    rows = [(m, t, float(t * 10 + m), int(t % 7 == 0)) for m in range(3) for t in range(137)]
    df = series(spark, rows)
    a = P.sliding_windows(df, ["x"], 12, 5, chunk_len=20).orderBy("machine_id", "end_timestep").collect()
    b = P.sliding_windows(df, ["x"], 12, 5, chunk_len=10_000).orderBy("machine_id", "end_timestep").collect()
    assert a == b
    assert len(a) == 3 * ((137 - 12) // 5 + 1)


def test_last_n_window_pads(spark):
    rows = [(1, t, float(t), 0) for t in range(3)]
    r = P.last_n_window(series(spark, rows), ["x"], 5).first()
    assert r.features == [0.0, 1.0, 2.0, 2.0, 2.0] and r.n_used == 3


def test_scalers_constant_column(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "x double")
    for kind in ("standard", "minmax", "robust"):
        s = P.fit_scaler(df, ["x"], kind)
        assert [r.x for r in P.apply_scaler(df, s).collect()] == [0.0, 0.0, 0.0]
    with pytest.raises(RuntimeError):
        P.apply_scaler(df, None)


def test_standard_scaler_is_population(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    s = P.fit_scaler(df, ["x"], "standard")
    assert s.scale["x"] == pytest.approx(np.std([1, 2, 4]))


def test_split_sizes_and_two_machine_error(spark):
    r = tables.readings(spark, SF)
    sp = {row.split: row.n for row in P.split_machines(r).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sp == {"test": 2, "val": 1, "train": 7}
    assert P.split_overlap(P.split_machines(r)).count() == 0
    two = spark.createDataFrame([(1,), (2,)], "machine_id long")
    with pytest.raises(ValueError):
        P.split_machines(two)


def test_clip_not_above_horizon_errors(spark):
    with pytest.raises(ValueError):
        L.add_run_to_failure_labels(series(spark, [(1, 0, 1.0, 0)]), horizon=30, clip_rul=30)


def test_steps_to_failure_before_at_after(spark):
    df = spark.createDataFrame([(4, 5), (5, 5), (6, 5)], "t long, f long")
    got = [r.s for r in df.select(L.steps_to_failure(F.col("t"), F.col("f")).alias("s")).collect()]
    assert got == [1, 0, None]


def test_forward_fill_null_and_nan(spark):
    rows = [(1, 0, 1.0), (1, 1, None), (1, 2, float("nan")), (1, 3, 4.0), (2, 0, None)]
    df = spark.createDataFrame(rows, "machine_id long, timestep long, x double")
    got = {(r.machine_id, r.timestep): r.x for r in L.forward_fill(df, ["x"], chunk_len=2).collect()}
    assert got == {(1, 0): 1.0, (1, 1): 1.0, (1, 2): 1.0, (1, 3): 4.0, (2, 0): None}


def test_quality_counts_null_and_nan_as_missing(spark):
    df = spark.createDataFrame([(1, 0, None, 0), (1, 1, float("nan"), 1), (1, 2, 3.0, 2)],
                               "machine_id long, timestep long, temperature double, failure_imminent int")
    schema = Q.SensorSchema(["temperature"], "failure_imminent", {"temperature": (0.0, 500.0)},
                            required_columns=["machine_id", "timestep"])
    rep = {(r.check, r.column): r for r in Q.validate(df, schema).collect()}
    assert rep[("nan", "temperature")].n_bad == 2 and rep[("nan", "temperature")].severity == "error"
    assert rep[("target_binary", "failure_imminent")].severity == "error"
    assert not Q.passed(Q.validate(df, schema))


def test_psi_identical_constant_and_shifted(spark):
    rng = np.random.default_rng(0)
    a = spark.createDataFrame([(float(v),) for v in rng.normal(0, 1, 1000)], "x double")
    b = spark.createDataFrame([(float(v),) for v in rng.normal(5, 1, 1000)], "x double")
    c = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert D.drift_report(a, a, ["x"]).first().psi < 0.01
    shifted = D.drift_report(a, b, ["x"]).first()
    assert shifted.psi > 0.25 and shifted.status == "CRITICAL"
    assert D.drift_report(c, c, ["x"]).first().psi == 0.0
    # symmetric formula
    assert D.drift_report(b, a, ["x"]).first().psi == pytest.approx(shifted.psi)


def test_api_reading_bounds_open_and_closed(spark):
    cols = "temperature double, vibration double, pressure double, rpm double, current double"
    rows = [(80.0, 0.6, 5.8, 1790.0, 12.5),      # accepted
            (0.0, 0.6, 5.8, 1790.0, 12.5),       # temperature must be > 0
            (80.0, 0.0, 0.0, 0.0, 0.0),          # zeros allowed for the others
            (80.0, 0.6, 5.8, 10000.0, 12.5),     # rpm must be < 10000
            (-5.0, 0.6, 5.8, 1790.0, 12.5),      # negative temperature
            (80.0, None, 5.8, 1790.0, 12.5)]     # missing field
    got = [r.reject_reason for r in Q.route_api_readings(spark.createDataFrame(rows, cols)).collect()]
    assert got == [None, "range:temperature", None, "range:rpm", "range:temperature", "missing:vibration"]
