"""Model training/scoring on the smallest scale (quality, not equality)."""

from pyspark.sql import functions as F

from testkit import SF
from wearline.operators import importance as IMP
from wearline.operators import metrics as M
from wearline.operators import models as ML
from wearline.plans.catalog import model_windows
from wearline.sources import text_logs as TL
from wearline.sources.tables import SENSORS


def test_logistic_scores_persist_and_importance(spark, tmp_path):
    w, scaler = model_windows(spark, SF)
    train = w.where(F.col("split") != "test")
    fitted = ML.fit_logistic(train)
    preds = fitted.score(w)
    assert preds.count() == w.count()
    assert preds.where((F.col("y_score") < 0) | (F.col("y_score") > 1)).count() == 0
    TL.save_model(fitted, str(tmp_path / "lr"))
    back = TL.load_model(str(tmp_path / "lr"))
    a = {(r.machine_id, r.end_timestep): r.y_score for r in preds.collect()}
    b = {(r.machine_id, r.end_timestep): r.y_score for r in back.score(w).collect()}
    assert a == b
    imp = ML.intrinsic_importance(fitted, 50, len(SENSORS), SENSORS)
    assert abs(sum(r.importance for r in imp.collect()) - 1.0) < 1e-6
    sens = IMP.sensitivity_map(fitted, w.where(F.col("split") == "test"), 50, SENSORS)
    assert max(r.sensitivity for r in sens.collect()) <= 1.0


def test_calibrators_bounded(spark):
    w, _ = model_windows(spark, SF)
    fitted = ML.fit_logistic(w.where(F.col("split") == "train"))
    val, test = fitted.score(w.where(F.col("split") == "val")), fitted.score(w.where(F.col("split") == "test"))
    iso = ML.IsotonicCalibrator.fit(val).transform(test)
    assert iso.where((F.col("y_score") < 0) | (F.col("y_score") > 1)).count() == 0
    cmp = ML.compare_calibrators(val, test).collect()
    assert {r.method for r in cmp} == {"uncalibrated", "platt_scaling", "isotonic_regression"}


def planted(spark, n=240, seed=0, T=6):
    """Windows of two sensors; the label follows sensor 0 in the last two steps."""
    import numpy as np
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.normal(size=(T, 2))
        rows.append((i % 12, i, int(x[-2:, 0].sum() > 0), [float(v) for v in x.ravel()]))
    return spark.createDataFrame(rows, "machine_id long, end_timestep long, label int, features array<double>")


def test_models_find_a_planted_signal(spark, tmp_path):
    train, test = planted(spark, seed=1), planted(spark, 200, seed=2)
    for fitted in (ML.fit_random_forest(train, num_trees=40), ML.fit_mlp(train, hidden=(8,), max_iter=60), ML.fit_logistic(train)):
        assert M.classification_metrics(fitted.score(test)).first().roc_auc > 0.85
        TL.save_model(fitted, str(tmp_path / fitted.name))
        back = TL.load_model(str(tmp_path / fitted.name))
        a, b = ({r.end_timestep: r.y_score for r in m.score(test).collect()} for m in (fitted, back))
        assert a == b
        sens = {r.sensor: r.importance_mean for r in IMP.sensor_permutation_importance(fitted, test, ["s0", "s1"]).collect()}
        assert sens["s0"] > 0.15 > abs(sens["s1"])
    bins = {r.t_start: r.importance_mean for r in IMP.temporal_permutation_importance(fitted, test, 6, 2, n_bins=3).collect()}
    assert bins[4] > 0.15 and max(abs(bins[0]), abs(bins[2])) < 0.1
    kinds = {r.kind for r in IMP.all_importances(fitted, test, 6, ["s0", "s1"]).collect()}
    assert kinds == {"intrinsic", "sensor_permutation", "temporal_permutation"}
    sens = {(r.t, r.sensor): r.sensitivity for r in IMP.sensitivity_map(fitted, test, 6, ["s0", "s1"]).collect()}
    # closed form for a logistic model: proportional to |coefficient| / std
    w = [abs(c) / s for c, s in zip(fitted.model.coefficients.toArray(), fitted.standardizer.std)]
    for (t, name), v in sens.items():
        assert abs(v - w[t * 2 + int(name[1])] / max(w)) < 0.01


def test_donors_are_a_permutation(spark):
    keys = planted(spark, 50)
    rows = IMP.donors(keys, 3).collect()
    for rep in range(3):
        mine = [r for r in rows if r.rep == rep]
        assert len(mine) == 50 and {r.end_timestep for r in mine} == {r.donor_end_timestep for r in mine} == set(range(50))
        assert sum(r.end_timestep == r.donor_end_timestep for r in mine) < 10


def test_search_and_weight_study(spark):
    train = planted(spark)
    rows = ML.hyperparameter_search(train, [("logistic_regression", {"C": 1.0}), ("random_forest", {"num_trees": 10, "max_depth": 4})]).collect()
    assert len(rows) == 6 and all(r.f1 > 0.6 for r in rows)
    folds = ML.machine_folds(train).groupBy("machine_id").agg(F.count_distinct("fold").alias("n")).collect()
    assert all(r.n == 1 for r in folds)
    study = {r.variant: r.roc_auc for r in ML.pos_weight_study(train, planted(spark, seed=3)).collect()}
    assert set(study) == {"unweighted", "balanced"} and min(study.values()) > 0.9


def test_platt_coefficients(spark):
    import numpy as np
    from testkit import preds_df
    rng = np.random.default_rng(0)
    s = rng.random(2000)
    platt = ML.PlattScaler.fit(preds_df(spark, (rng.random(2000) < s).astype(int), s))
    assert platt.coef > 2 and platt.intercept < 0
    p = platt.transform(preds_df(spark, [0, 1], [0.2, 0.9])).collect()
    assert p[1].y_score == 1 / (1 + np.exp(-(platt.coef * 0.9 + platt.intercept))) or abs(
        p[1].y_score - 1 / (1 + np.exp(-(platt.coef * 0.9 + platt.intercept)))) < 1e-12


def test_requests(spark):
    fitted = ML.fit_logistic(planted(spark))
    nan = float("nan")
    ok = [0.5, -0.5]
    bounds = [(-1.0, 1.0, False, False), (-1.0, 1.0, True, True)]
    rows = [("a", [ok] * 6, 0.5), ("a", [[0.9, 0.9]] * 6, 0.5), (None, [ok] * 9, 0.0), ("short", [ok], 1.0),
            ("e", [], 0.5), ("n", None, 0.5), ("w", [[0.1]], 0.5), ("m", [[None, 0.1]], 0.5), ("q", [[nan, 0.1]], 0.5),
            ("o", [[1.0, 0.1]], 0.5), ("c", [[0.1, 1.0]], 0.5), ("t", [ok], 1.5), ("u", [ok], None), ("v", [ok], nan), ("x", [None], 0.5)]
    df = spark.createDataFrame(rows, "request_id string, readings array<array<double>>, threshold double")
    out = ML.score_requests(df, fitted, 6, 2, bounds).collect()
    assert len(out) == len(rows)
    why = sorted((str(r.request_id), r.reject_reason) for r in out)
    assert [w for w in why if w[1]] == sorted([("e", "empty window"), ("n", "empty window"), ("w", "wrong reading width"),
                                               ("x", "wrong reading width"), ("m", "missing reading"), ("q", "missing reading"),
                                               ("o", "reading out of bounds"), ("t", "threshold outside [0,1]"),
                                               ("u", "threshold outside [0,1]"), ("v", "threshold outside [0,1]")])
    assert all((r.failure_probability is None) == (r.reject_reason is not None) for r in out)
    twins = [r for r in out if r.request_id == "a"]
    assert len(twins) == 2 and len({r.failure_probability for r in twins}) == 2
    unnamed = next(r for r in out if r.request_id is None)
    assert unnamed.failure_predicted and unnamed.window_length == 9
    assert ML.score_requests(df.drop("request_id"), fitted, 6, 2, bounds).count() == len(rows)
    import pytest
    with pytest.raises(ValueError, match="missing columns"):
        ML.score_requests(df.drop("threshold"), fitted, 6, 2, bounds)


def test_search_tries_the_default_forest():
    import inspect
    size = inspect.signature(ML.fit_random_forest).parameters["num_trees"].default
    tried = [p for name, p in ML.GRID if name == "random_forest"]
    assert {p["num_trees"] for p in tried} == {50, size} and len(ML.GRID) == 7


def test_points_fitted_together_are_those_fitted_alone(spark):
    """Newton steps over stacked models against Spark ML, fold by fold."""
    import numpy as np
    from wearline.operators.search import fit_folds, fold_cells
    train = ML.machine_folds(planted(spark, 240, seed=5))
    points = [(c, f) for c in (0.01, 1.0) for f in range(3)]
    models = fit_folds(train, points)
    cells = fold_cells(train, models, 0.5)
    for (c, f), m, (tp, fp, fn) in zip(points, models, cells):
        alone = ML.fit_logistic(train.where(F.col("fold") != f), C=c, max_iter=500)
        assert np.allclose(m.beta[:-1], alone.model.coefficients.toArray(), atol=2e-4) and abs(m.beta[-1] - alone.model.intercept) < 2e-4
        assert np.allclose(m.mean, alone.standardizer.mean) and np.allclose(m.std, alone.standardizer.std)
        got = alone.score(train.where(F.col("fold") == f)).agg(
            *[F.count_if(F.expr(f"y_true = {y} AND y_score {op} 0.5")) for y, op in ((1, ">="), (0, ">="), (1, "<"))]).first()
        assert abs(got[0] - tp) <= 1 and abs(got[1] - fp) <= 1 and abs(got[2] - fn) <= 1


def test_slopes_agree_with_steps(spark):
    train, test = planted(spark, seed=1), planted(spark, 150, seed=2)
    for fitted, eps, near in ((ML.fit_logistic(train, C=0.1), 1e-7, 1e-6), (ML.fit_mlp(train, hidden=(6, 4), max_iter=30), 1e-5, 1e-3)):
        by = {way: {(r.t, r.sensor): r.sensitivity for r in IMP.sensitivity_map(fitted, test, 6, ["s0", "s1"], eps, way).collect()}
              for way in ("slopes", "steps")}
        assert len(by["slopes"]) == 12 and by["slopes"].keys() == by["steps"].keys()
        assert max(abs(by["slopes"][k] - by["steps"][k]) for k in by["steps"]) < near
    forest = ML.fit_random_forest(train, num_trees=5, max_depth=3)
    assert IMP.mean_slopes(forest, test) is None and IMP.sensitivity_map(forest, test, 6, ["s0", "s1"], 0.5).count() == 12
