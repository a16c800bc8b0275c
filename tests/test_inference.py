"""McNemar, DeLong pairs, permutation and bootstrap."""

import pytest
from pyspark.sql import functions as F

from testkit import preds_df
from wearline.functions.special import chi2_df1_sf, chi2_df1_sf_exact
from wearline.operators import inference as I


def test_golden_mcnemar_statistic_and_p(spark):
    b, c = 64, 31
    stat = (abs(b - c) - 1) ** 2 / (b + c)
    assert stat == pytest.approx(10.778947, abs=1e-6)
    assert chi2_df1_sf_exact(stat) == pytest.approx(0.0010266, abs=1e-7)
    row = spark.range(1).select(chi2_df1_sf(F.lit(stat)).alias("p")).first()
    assert row.p == pytest.approx(0.0010266, abs=1e-7)


def _pair(spark, y, a, b):
    return preds_df(spark, y, a, "a").unionByName(preds_df(spark, y, b, "b"))


def test_mcnemar_no_disagreement(spark):
    y = [0, 1, 0, 1, 1, 0]
    s = [.1, .9, .2, .8, .7, .3]
    r = I.mcnemar(_pair(spark, y, s, s)).first()
    assert (r.b, r.c, r.statistic, r.p_value) == (0, 0, 0.0, 1.0)


def test_mcnemar_counts(spark):
    y = [1, 1, 1, 0, 0, 0]
    a = [.9, .9, .9, .1, .1, .9]   # one error (fp on the last)
    b = [.1, .1, .9, .1, .1, .1]   # two errors (fn on the first two)
    r = I.mcnemar(_pair(spark, y, a, b)).first()
    assert (r.b, r.c) == (2, 1)
    assert r.statistic == pytest.approx(0.0)
    assert 0 <= r.p_value <= 1


def test_permutation_p_in_unit_interval(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 100)
    r = I.permutation_test(_pair(spark, y, rng.random(100), np.clip(y * .5 + rng.random(100) * .5, 0, 1)),
                           "a", "b", n_permutations=50).first()
    assert 0.0 <= r.p_value <= 1.0 and r.observed_diff >= 0


def test_bootstrap_ci_orders_bounds(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 200)
    s = np.clip(y * .6 + rng.random(200) * .4, 0, 1)
    rows = I.bootstrap_ci(preds_df(spark, y, s), n_samples=40).collect()
    assert {r.metric for r in rows} >= {"f1", "roc_auc", "pr_auc"}
    for r in rows:
        assert r.lower <= r.mean + 1e-12 and r.mean <= r.upper + 1e-12


def brute_auc_ap(y, s, w):
    import numpy as np
    P, N = (w * y).sum(), (w * (1 - y)).sum()
    auc = ap = cp = cn = 0.0
    for t in sorted(set(s.tolist()), reverse=True):
        p, n = (w * y)[s == t].sum(), (w * (1 - y))[s == t].sum()
        auc += n * (2 * cp + p)
        cp, cn = cp + p, cn + n
        ap += p * cp / (cp + cn) if cp + cn else 0
    return auc / (2 * P * N), ap / P


@pytest.mark.parametrize("ties", [1, 3])
def test_replicates_equal_brute_force(spark, ties):
    import numpy as np
    from wearline.operators import resample as R
    rng = np.random.default_rng(ties)
    n, reps = 900, 12
    y = rng.integers(0, 2, n)
    s = np.round(np.clip(.4 * y + .6 * rng.random(n), 0, 1), ties)
    df = preds_df(spark, y, s).repartition(6)
    rows = df.select("model", F.col("y_score").alias("score"), F.col("y_true").alias("y"), F.lit(False).alias("__other"),
                     F.lit(1).cast("long").alias("__n"), *R.draw_key(F.col("machine_id"), seed=1))
    keys = {r.machine_id: (r["__a"], r["__b"]) for r in df.select("machine_id", *R.draw_key(F.col("machine_id"), seed=1)).collect()}
    w = R.weights(np.array([keys[i][0] for i in range(n)]), np.array([keys[i][1] for i in range(n)]), np.zeros(n, bool), reps, "poisson")
    assert abs(w[:, 1:].mean() - 1) < 0.05 and abs(w[:, 1:].var() - 1) < 0.1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.rep: r for r in R.replicate_cells(rows, ["model"], reps, "poisson", 0.5).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(got) == list(range(reps + 1))
    for r in range(reps + 1):
        auc, ap = brute_auc_ap(y, s, w[:, r])
        assert got[r].roc_auc == pytest.approx(auc) and got[r].pr_auc == pytest.approx(ap)
        assert got[r].tp == (w[:, r] * y)[s >= .5].sum() and got[r].tn == (w[:, r] * (1 - y))[s < .5].sum()


def test_permutation_of_any_metric(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    good, bad = np.clip(.7 * y + .3 * rng.random(400), 0, 1), rng.random(400)
    p = _pair(spark, y, good, bad)
    for metric in ("f1", "roc_auc"):
        r = I.permutation_tests(p, metric=metric, n_permutations=200).first()
        assert r.p_value < 0.01 and r.interpretation == I.HIGHLY and r.metric_a > r.metric_b
    same = I.permutation_tests(_pair(spark, y, good, good), n_permutations=50).first()
    assert same.p_value == 1.0 and same.interpretation == I.NONE
    with pytest.raises(ValueError):
        I.permutation_tests(p, metric="nope")


def test_sums_of_draws_have_the_right_law():
    import numpy as np
    from wearline.operators import resample as R
    rng = np.random.default_rng(0)
    u = rng.random((1, 200_000))
    for c in (1, 2, 7, 300, 40_000):
        w = R.quantiles(u, np.array([c]), "poisson")
        assert abs(w.mean() - c) < 5 * (c / 2e5) ** .5 and abs(w.var() / c - 1) < 0.03
        s = R.quantiles(u, np.array([c]), "swap")
        assert s.min() >= 0 and s.max() <= c and abs(s.mean() - c / 2) < 5 * (c / 8e5) ** .5 and abs(s.var() / (c / 4) - 1) < 0.03


def test_score_counts_agree_with_rows(spark):
    """Both modes estimate the same sampling law; ties make the counts large."""
    import numpy as np
    rng = np.random.default_rng(3)
    n = 3000
    y = rng.integers(0, 2, n)
    a, b = (np.round(np.clip(.2 * y + .8 * rng.random(n), 0, 1), 1) for _ in range(2))
    p = _pair(spark, y, a, b)
    got = {by: {(r.model, r.metric): r for r in I.bootstrap_ci(p, n_samples=400, by=by).collect()} for by in ("rows", "scores")}
    assert got["rows"].keys() == got["scores"].keys()
    for k, r in got["rows"].items():
        s = got["scores"][k]
        assert abs(r["mean"] - s["mean"]) < 0.3 * r["std"] and abs(r["std"] / s["std"] - 1) < 0.2
        assert abs(r.lower - s.lower) < 0.6 * r["std"] and abs(r.upper - s.upper) < 0.6 * r["std"]
    perm = {by: I.permutation_test(p, "a", "b", n_permutations=400, by=by).first() for by in ("rows", "scores")}
    assert perm["rows"].observed_diff == pytest.approx(perm["scores"].observed_diff)
    assert abs(perm["rows"].p_value - perm["scores"].p_value) < 0.12


def test_the_registered_bootstrap_draws_for_every_window(spark, monkeypatch):
    from wearline.plans import catalog as K
    p = preds_df(spark, [i % 2 for i in range(400)], [(i * 7 % 10) / 10 for i in range(400)])
    monkeypatch.setattr(K, "_preds", lambda spark, sf: p)
    want = K.rounded(I.bootstrap_ci(p, n_samples=K.N_BOOT, by="rows"))
    assert sorted(K.SPARK["bootstrap_ci"](spark, "").collect()) == sorted(want.collect())
    assert K.SQL["bootstrap_ci"] == K.SQL["bootstrap_ci_rows"] != K.SQL["bootstrap_ci_scores"]


def test_auc_permutations_rank_once_and_equal_the_ranked_swaps(spark, monkeypatch):
    import numpy as np
    from wearline.operators import resample as R
    rng = np.random.default_rng(7)
    n = 500
    y = rng.integers(0, 2, n)
    s = {"a": np.round(np.clip(.3 * y + .7 * rng.random(n), 0, 1), 1), "b": np.round(rng.random(n), 2), "c": np.round(rng.random(n), 1)}
    p = _pair(spark, y, s["a"], s["b"]).unionByName(preds_df(spark, y, s["c"], "c")).repartition(5)

    def ranked(*_, **__):
        raise AssertionError("a ranking a replicate")

    cells = []
    real = R.swapped_auc
    monkeypatch.setattr(I, "replicate_cells", ranked)
    monkeypatch.setattr(I, "swapped_auc", lambda c, *rest: cells.append((c, real(c, *rest))) or cells[-1][1])
    got = {(r.model_a, r.model_b): r for r in I.permutation_tests(p, n_permutations=30, seed=5).collect()}
    diffs = {(r.model_a, r.model_b, r.rep): r["diff"] for r in cells[0][1][1].collect()}
    rows = cells[0][0].select("*", *R.draw_key(I.score_bits("sa"), I.score_bits("sb"), F.col("y"), seed=5)).collect()
    assert len(got) == 3 and len(diffs) == 90
    for (a, b), r in got.items():
        mine = [x for x in rows if (x.model_a, x.model_b) == (a, b)]
        col = {k: np.array([x[k] for x in mine for _ in (0, 1)]) for k in ("y", "__a", "__b", "__n")}
        other = np.array([False, True] * len(mine))
        score = np.array([x[k] for x in mine for k in ("sa", "sb")])
        w = R.weights(col["__a"], col["__b"], other, 30, "swap", col["__n"])
        auc = [brute_auc_ap(col["y"], score, w[:, k])[0] for k in range(62)]
        assert r.metric_a == pytest.approx(auc[0]) and r.metric_b == pytest.approx(auc[31])
        want = [abs(auc[k] - auc[31 + k]) for k in range(31)]
        assert [diffs[a, b, k] for k in range(1, 31)] == pytest.approx(want[1:])
        assert r.p_value == pytest.approx(np.mean([d >= want[0] - 1e-12 for d in want[1:]]))


def test_draws_are_those_of_the_plain_remainders():
    import numpy as np
    from wearline.operators import resample as R
    a = np.array([0, 1, R.MODULUS - 1, 12345, R.MODULUS - 1, 0], dtype=np.int64)
    b = np.array([0, R.MODULUS - 1, R.MODULUS - 1, 999_999_937, 0, 1], dtype=np.int64)
    want = [[(lambda x: (x * x + q) % R.MODULUS)(((p + r * q) % R.MODULUS) ** 2 + p) / R.MODULUS for r in range(1, 2001)]
            for p, q in zip(a.tolist(), b.tolist())]
    assert (R.uniforms(a, b, 2000) == np.array(want)).all()
