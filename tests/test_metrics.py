"""Point metrics, ranking, curves, calibration and cost -- golden numbers and
hand-computed edge cases."""

import math

import numpy as np
import pytest

from testkit import preds_df
from wearline.functions.grids import linspace
from wearline.operators import curves as C
from wearline.operators import metrics as M
from pyspark.sql import functions as F


def one(df):
    return df.collect()[0].asDict()


def test_golden_confusion_metrics(spark):
    # published cells tp 562, fp 39, fn 58, tn 2613
    cells = spark.createDataFrame([(562, 39, 58, 2613)], "tp long, fp long, fn long, tn long")
    m = M.metrics_from_cells(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    r = one(cells.select(*[v.alias(k) for k, v in m.items()]))
    assert r["f1"] == pytest.approx(0.920557, abs=1e-6)
    assert r["mcc"] == pytest.approx(0.902505, abs=1e-6)
    assert r["precision"] == pytest.approx(0.9351, abs=1e-4)
    assert r["recall"] == pytest.approx(0.9065, abs=1e-4)


def test_perfect_predictions(spark):
    p = preds_df(spark, [0, 0, 0, 1, 1, 1], [.01, .02, .03, .97, .98, .99])
    r = one(M.classification_metrics(p))
    for k in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "mcc"):
        assert r[k] == pytest.approx(1.0)


def test_ranking_without_ties(spark):
    r = one(M.classification_metrics(preds_df(spark, [0, 0, 1, 1], [.1, .4, .35, .8])))
    assert r["roc_auc"] == pytest.approx(0.75)
    assert r["pr_auc"] == pytest.approx(0.833333, abs=1e-6)


def test_all_scores_tied(spark):
    r = one(M.classification_metrics(preds_df(spark, [0, 1], [.5, .5])))
    assert r["roc_auc"] == pytest.approx(0.5)
    assert r["pr_auc"] == pytest.approx(0.5)


def test_one_class_gives_null_and_status(spark):
    p = preds_df(spark, [1, 1, 1], [.2, .5, .9])
    assert one(M.classification_metrics(p))["roc_auc"] is None
    d = one(C.delong(C.score_table(p)))
    assert d["auc"] is None and d["status"] == "single class"


def test_cells_sum_to_n_and_threshold_monotone(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 500)
    s = np.clip(y + rng.normal(0, .3, 500), 0, 1)
    p = preds_df(spark, y, s)
    sweep = C.threshold_confusion(p, linspace(0.01, 0.99, 100)).orderBy("grid_idx").collect()
    assert all(r.tp + r.fp + r.fn + r.tn == 500 for r in sweep)
    tps = [r.tp + r.fp for r in sweep]
    assert all(a >= b for a, b in zip(tps, tps[1:]))


def test_auc_matches_pairwise_definition(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300), 2)  # many ties
    pos, neg = s[y == 1], s[y == 0]
    expect = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    r = one(M.classification_metrics(preds_df(spark, y, s)))
    assert r["roc_auc"] == pytest.approx(expect, abs=1e-12)


def test_delong_matches_pairwise_placements(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 200)
    s = np.round(rng.random(200) * 0.6 + 0.4 * y, 3)
    pos, neg = s[y == 1], s[y == 0]
    v10 = np.array([np.mean(p > neg) + 0.5 * np.mean(p == neg) for p in pos])
    v01 = np.array([np.mean(pos > n) + 0.5 * np.mean(pos == n) for n in neg])
    var = np.var(v10, ddof=1) / len(pos) + np.var(v01, ddof=1) / len(neg)
    d = one(C.delong(C.score_table(preds_df(spark, y, s))))
    assert d["auc"] == pytest.approx(v10.mean(), abs=1e-12)
    assert d["variance"] == pytest.approx(var, rel=1e-9)


def test_delong_golden_ci():
    # published: LSTM auc 0.99398, variance 1.01718e-06 -> [0.99201, 0.99596]
    z = C.normal_quantile(0.975)
    se = math.sqrt(1.01718e-06)
    assert 0.99398 - z * se == pytest.approx(0.99201, abs=2e-5)
    assert 0.99398 + z * se == pytest.approx(0.99596, abs=2e-5)


def test_optimal_threshold_first_maximum_and_unknown_metric(spark):
    p = preds_df(spark, [0, 0, 1, 1], [.1, .4, .35, .8])
    r = one(C.optimal_threshold(p, "f1"))
    grid = linspace(0.01, 0.99, 200)
    # brute force with the reference's strict '>' rule
    best_t, best = 0.5, -1.0
    s, y = np.array([.1, .4, .35, .8]), np.array([0, 0, 1, 1])
    for t in grid:
        pr = (s >= t).astype(int)
        tp, fp, fn = ((pr == 1) & (y == 1)).sum(), ((pr == 1) & (y == 0)).sum(), ((pr == 0) & (y == 1)).sum()
        f = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        if f > best:
            best, best_t = f, t
    assert r["threshold"] == pytest.approx(best_t) and r["score"] == pytest.approx(best)
    with pytest.raises(ValueError):
        C.optimal_threshold(p, "nope")


def test_brier_baseline_and_skill(spark):
    y = [0] * 8 + [1] * 2
    r = one(M.brier_and_ece(preds_df(spark, y, [0.2] * 10)))
    assert r["brier_score"] == pytest.approx(0.2 * 0.8)
    assert r["brier_skill_score"] == pytest.approx(0.0, abs=1e-12)


def test_ece_drops_score_one_reliability_keeps_it(spark):
    p = preds_df(spark, [1, 0], [1.0, 0.5])
    r = one(M.brier_and_ece(p))
    # only the 0.5 score is binned: |0.5 - 0| * 1/2
    assert r["ece"] == pytest.approx(0.25)
    rel = {x.bin: x["count"] for x in M.reliability_table(p).collect()}
    assert rel[9] == 1 and sum(rel.values()) == 2 and len(rel) == 10


def test_bin_edge_point_three_is_bin_two(spark):
    rel = {x.bin: x["count"] for x in M.reliability_table(preds_df(spark, [1], [0.3])).collect()}
    assert rel[2] == 1


def test_cost_curve_and_comparison(spark):
    p = preds_df(spark, [0, 0, 1, 1, 1], [.1, .6, .4, .7, .9])
    costs = C.CostMatrix(50000, 5000)
    curve = C.cost_curve(p, costs).orderBy("grid_idx").collect()
    assert curve[0].expected_cost == pytest.approx(2 * 5000)          # t=0: all positive
    assert curve[-1].fn == 3 and curve[-1].fp == 0                     # t=1: no score reaches 1
    best = one(C.cost_optimal_threshold(C.cost_curve(p, costs)))
    assert best["min_cost"] == min(r.expected_cost for r in curve)
    cmp = one(C.cost_threshold_comparison(p, costs))
    assert cmp["cost_saving"] == cmp["f1_total_cost"] - cmp["cost_total_cost"]


def test_theoretical_threshold(spark):
    p = preds_df(spark, [1] + [0] * 3, [.5] * 4)
    r = one(C.theoretical_threshold(p, C.CostMatrix(50000, 5000)))
    assert r["theoretical_threshold"] == pytest.approx(5000 * .25 / (5000 * .25 + 50000 * .75))
    assert r["bayes_threshold"] == pytest.approx(5000 / 55000)
    bad = one(C.theoretical_threshold(preds_df(spark, [1, 1], [.5, .5]), C.CostMatrix(1, 1)))
    assert bad["theoretical_threshold"] is None


def test_kl_and_distribution(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = np.clip(0.3 + 0.4 * y + rng.normal(0, .1, 400), 0, 1)
    r = one(M.class_separation(preds_df(spark, y, s)))
    bins = np.linspace(0, 1, 51)
    ph, _ = np.histogram(s[y == 1], bins=bins, density=True)
    nh, _ = np.histogram(s[y == 0], bins=bins, density=True)
    ph, nh = ph + 1e-10, nh + 1e-10
    ph, nh = ph / ph.sum(), nh / nh.sum()
    assert r["kl_divergence_pos_neg"] == pytest.approx(float(np.sum(ph * np.log(ph / nh))), rel=1e-9)
    d = {x.y_class: x for x in M.score_distribution(preds_df(spark, y, s)).collect()}
    assert d[1]["median"] == pytest.approx(float(np.median(s[y == 1])))
    assert d[0]["q25"] == pytest.approx(float(np.percentile(s[y == 0], 25)))
    assert d[0]["std"] == pytest.approx(float(np.std(s[y == 0])))


def test_score_distribution_empty_class_zeros(spark):
    rows = {r.y_class: r for r in M.score_distribution(preds_df(spark, [1, 1], [.2, .4])).collect()}
    assert rows[0]["n"] == 0 and rows[0]["mean"] == 0.0 and rows[0]["median"] == 0.0
    assert rows[1]["n"] == 2 and rows[1]["median"] == pytest.approx(0.3)


def test_pr_curve_ends_at_recall_zero(spark):
    p = preds_df(spark, [0, 0, 1, 1], [.1, .4, .35, .8])
    end = C.pr_curve(C.score_table(p)).where("threshold IS NULL").collect()
    assert [(r.precision, r.recall) for r in end] == [(1.0, 0.0)]


def test_cells_of_error_summary_and_quartiles(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 301), np.round(rng.random(301), 2)
    r = one(M.error_summary(preds_df(spark, y, s)))
    tp = s[(y == 1) & (s >= .5)]
    assert r["n_tp"] == len(tp) and r["tp_score_mean"] == pytest.approx(tp.mean()) and r["tp_score_max"] == tp.max()
    for row in M.score_distribution(preds_df(spark, y, s)).collect():
        got = s[y == row.y_class]
        assert [row.q25, row.median, row.q75] == pytest.approx(np.percentile(got, [25, 50, 75]).tolist())


def test_score_table_over_many_parts(spark):
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 2, 4000), np.round(rng.random(4000), 3)
    rows = [(f"m{i % 2}", i, i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))]
    p = spark.createDataFrame(rows, "model string, machine_id long, end_timestep long, y_true int, y_score double").repartition(8)
    for r in C.score_table(p).collect():
        mine = np.arange(len(y)) % 2 == int(r.model[1])
        at = mine & (s >= r.score)
        assert (r.cum_pos, r.cum_neg) == (y[at].sum(), (1 - y[at]).sum())


def test_delong_width_shrinks_with_n(spark):
    rng = np.random.default_rng(5)
    width = []
    for n in (100, 1000, 5000):
        y = rng.integers(0, 2, n)
        r = one(C.delong(C.score_table(preds_df(spark, y, np.clip(.3 * y + .7 * rng.random(n), 0, 1)))))
        width.append(r["upper"] - r["lower"])
    assert width[0] > width[1] > width[2]


def test_calibrated_scores_have_small_ece(spark):
    rng = np.random.default_rng(6)
    s = rng.random(20_000)
    r = one(M.brier_and_ece(preds_df(spark, (rng.random(20_000) < s).astype(int), s)))
    assert r["ece"] < 0.05
