"""Statistical inference on predictions: McNemar, DeLong pairs, permutation
tests and bootstrap confidence intervals.

* Paired model comparisons pivot the models of each window into one row
  (``groupBy(window key)``, one shuffle) instead of self-joining all model
  pairs; every pair's b/c counts are columns of one aggregation.
* Resampling collapses equal rows (score and label), shuffles them once, into
  score order; tasks draw all replicates and return sums per replicate (``resample``).
  Results are distributionally equal to the reference's NumPy draws, not
  draw-equal.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_df1_sf
from ..session import store
from .curves import delong, score_table
from .metrics import decision, metrics_from_cells
from .resample import draw_key, replicate_cells, swapped_auc

KEY = ["machine_id", "end_timestep"]


def model_names(preds: DataFrame, model_col: str = "model") -> list[str]:
    """Distinct model names (one small aggregate; the model count is user-chosen)."""
    return sorted(r[0] for r in preds.select(model_col).distinct().collect())


def paired_table(preds: DataFrame, models: list[str], key=KEY, model_col: str = "model",
                 threshold=0.5) -> DataFrame:
    """One row per window: y_true and, per model, score and correctness."""
    y = F.col("y_true")
    aggs = [F.max(y).alias("y_true")]
    for m in models:
        sel = F.col(model_col) == m
        aggs.append(F.max(F.when(sel, F.col("y_score"))).alias(f"s_{m}"))
    wide = preds.groupBy(*key).agg(*aggs)
    for m in models:
        wide = wide.withColumn(f"ok_{m}", decision(F.col(f"s_{m}"), threshold) == F.col("y_true"))
    return wide


def mcnemar(preds: DataFrame, threshold=0.5, continuity: bool = True, model_col: str = "model",
            models: list[str] | None = None) -> DataFrame:
    """A18 for every model pair (a < b): b = a right & b wrong, c = a wrong & b right.

    statistic = (|b-c|-1)^2/(b+c) (or uncorrected); p = chi2(1) upper tail,
    evaluated JVM-side; b+c = 0 -> statistic 0, p 1.
    """
    models = models or model_names(preds, model_col)
    wide = paired_table(preds, models, model_col=model_col, threshold=threshold)
    pairs = list(combinations(models, 2))
    aggs = []
    for a, b in pairs:
        oa, ob = F.col(f"ok_{a}"), F.col(f"ok_{b}")
        aggs += [F.count_if(oa & ~ob).alias(f"b__{a}__{b}"), F.count_if(~oa & ob).alias(f"c__{a}__{b}")]
    counts = wide.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                                        F.col(f"b__{a}__{b}").alias("b"), F.col(f"c__{a}__{b}").alias("c"))
                               for a, b in pairs]))
    t = counts.select(rows.alias("r")).select("r.*")
    bc = (F.col("b") + F.col("c")).cast("double")
    diff = F.abs(F.col("b") - F.col("c")).cast("double")
    stat = (F.pow(diff - 1.0, 2) if continuity else F.pow(diff, 2)) / bc
    t = t.withColumn("statistic", F.when(bc > 0, stat).otherwise(F.lit(0.0)))
    t = t.withColumn("p_value", F.when(bc > 0, chi2_df1_sf(F.col("statistic"))).otherwise(F.lit(1.0)))
    return t.withColumn("interpretation", interpretation(F.col("p_value"), F.col("b") + F.col("c")))


# ---- fixed values: readings of a p-value ----
AGREE = "Models agree on all samples — test not informative."
HIGHLY = "Highly significant difference (p < 0.01)."
SIGNIFICANT = "Significant difference (p < 0.05)."
NONE = "No significant difference (p ≥ 0.05). Cannot reject H0."
# ---------------------------------------------


def interpretation(p: Column, bc: Column | None = None) -> Column:
    """P10: p-value reading (<0.01, <0.05, else)."""
    out = F.when(p < 0.01, F.lit(HIGHLY))
    if bc is not None:
        out = F.when(bc == 0, F.lit(AGREE)).when(p < 0.01, F.lit(HIGHLY))
    return out.when(p < 0.05, F.lit(SIGNIFICANT)).otherwise(F.lit(NONE))


def compare_models(preds: DataFrame, threshold=0.5, model_col: str = "model",
                   confidence: float = 0.95) -> DataFrame:
    """Every pair's McNemar result with both models' DeLong AUC and CI."""
    mc = mcnemar(preds, threshold, model_col=model_col)
    dl = delong(score_table(preds, (model_col,)), (model_col,), confidence)
    da = dl.select(F.col(model_col).alias("model_a"), F.col("auc").alias("auc_a"),
                   F.col("lower").alias("auc_a_lower"), F.col("upper").alias("auc_a_upper"))
    db = dl.select(F.col(model_col).alias("model_b"), F.col("auc").alias("auc_b"),
                   F.col("lower").alias("auc_b_lower"), F.col("upper").alias("auc_b_upper"))
    return mc.join(da, "model_a").join(db, "model_b")


def compare_models_full(preds: DataFrame, threshold=0.5, n_permutations: int = 1000, seed: int = 42,
                        model_col: str = "model") -> DataFrame:
    """A21 as the reference runs it: McNemar + DeLong of both models + the AUC
    permutation test, for every pair (a < b); all pairs share one resampling job.
    The predictions are read five times: they are stored once."""
    preds = store(preds.select(model_col, *KEY, "y_true", "y_score"))
    base = compare_models(preds, threshold, model_col)
    perm = permutation_tests(preds, n_permutations=n_permutations, seed=seed, model_col=model_col).select(
        "model_a", "model_b", F.col("p_value").alias("auc_permutation_p"), F.col("observed_diff").alias("auc_observed_diff"))
    return base.join(perm, ["model_a", "model_b"])


REPLICATE_METRICS = ("accuracy", "precision", "recall", "f1", "specificity", "balanced_accuracy", "mcc",
                     "roc_auc", "pr_auc")


def score_bits(score: str) -> Column:
    """A score as a whole number (scores from 2^-52 apart differ), the same text in any engine."""
    return F.floor(F.col(score) * float(1 << 52)).cast("long")


def _with_metrics(cells: DataFrame) -> DataFrame:
    m = metrics_from_cells(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    return cells.select("*", *[v.alias(k) for k, v in m.items()])


def permutation_tests(preds: DataFrame, pairs: list[tuple[str, str]] | None = None, metric: str = "roc_auc",
                      n_permutations: int = 1000, seed: int = 42, threshold: float = 0.5,
                      model_col: str = "model", by: str = "scores") -> DataFrame:
    """Paired permutation tests of a metric's difference, all pairs in one job.

    Replicate r swaps the two models' scores on a window with probability 1/2. p =
    share of replicates with |diff| >= observed, with its reading (P10).
    ``by="scores"`` draws how many of the windows with equal scores and label are
    swapped (windows that one model of a pair has not scored are left out);
    ``by="rows"``, the checked parity mode, draws for every window.
    """
    if metric not in REPLICATE_METRICS:
        raise ValueError(f"no replicate metric {metric!r}")
    pairs = pairs or list(combinations(model_names(preds, model_col), 2))
    tags = F.explode(F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b")) for a, b in pairs])).alias("p")
    if by == "rows":
        rows = preds.select(model_col, *KEY, F.col("y_score").cast("double").alias("score"), F.col("y_true").alias("y"), tags)
        rows = rows.where(F.col(model_col).isin(F.col("p.model_a"), F.col("p.model_b"))).select(
            "p.model_a", "p.model_b", "score", "y", (F.col(model_col) == F.col("p.model_b")).alias("__other"),
            *draw_key(*[F.col(k) for k in KEY], seed=seed), F.lit(1).cast("long").alias("__n"))
    else:
        names = sorted({m for pair in pairs for m in pair})
        wide = preds.groupBy(*KEY).agg(F.max("y_true").alias("y"), *[
            F.max(F.when(F.col(model_col) == m, F.col("y_score").cast("double"))).alias(f"s{i}") for i, m in enumerate(names)])
        both = F.explode(F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"s{names.index(a)}").alias("sa"),
                                            F.col(f"s{names.index(b)}").alias("sb")) for a, b in pairs])).alias("p")
        cells = wide.select("y", both).where("p.sa IS NOT NULL AND p.sb IS NOT NULL").groupBy("p.model_a", "p.model_b", "p.sa", "p.sb", "y").agg(
            F.count(F.lit(1)).alias("__n"))
        if metric == "roc_auc":
            return _auc_permutations(cells, n_permutations, seed)
        sides = F.explode(F.array(F.struct(F.col("sa").alias("score"), F.lit(False).alias("other")),
                                  F.struct(F.col("sb").alias("score"), F.lit(True).alias("other")))).alias("x")
        rows = cells.select("model_a", "model_b", "y", "__n", *draw_key(score_bits("sa"), score_bits("sb"), F.col("y"), seed=seed), sides).select(
            "model_a", "model_b", F.col("x.score").alias("score"), "y", F.col("x.other").alias("__other"), "__a", "__b", "__n")
    reps = _with_metrics(replicate_cells(rows, ["model_a", "model_b"], n_permutations, "swap", threshold))
    g = ["model_a", "model_b"]
    wide = reps.groupBy(*g, "rep").agg(*[F.max(F.when(F.col("side") == s, F.col(metric))).alias(f"metric_{n}")
                                         for s, n in ((0, "a"), (1, "b"))])
    wide = wide.withColumn("d", F.abs(F.col("metric_a") - F.col("metric_b")))
    obs = wide.where("rep = 0").select(*g, "metric_a", "metric_b", F.col("d").alias("observed_diff"))
    return _permutation_rows(wide.where("rep > 0").select(*g, "d"), obs, metric, n_permutations)


def _permutation_rows(reps: DataFrame, obs: DataFrame, metric: str, n_permutations: int) -> DataFrame:
    """One row a pair from its replicates' |diff| (``d``) and the observed one."""
    g = ["model_a", "model_b"]
    # 1e-12: a replicate that repeats the observed split must count as equal
    ge = (F.col("d") >= F.col("observed_diff") - 1e-12).cast("double")
    out = reps.join(F.broadcast(obs), g).groupBy(*g, "metric_a", "metric_b", "observed_diff").agg(F.avg(ge).alias("p_value"))
    return out.select(*g, F.lit(metric).alias("metric"), "metric_a", "metric_b", "observed_diff", "p_value",
                      F.lit(n_permutations).alias("n_permutations"), interpretation(F.col("p_value")).alias("interpretation"))


def _auc_permutations(cells: DataFrame, n_permutations: int, seed: int) -> DataFrame:
    """The same swaps for the ROC AUC, whose difference is a sum over windows (``swapped_auc``)."""
    obs, diffs = swapped_auc(cells, ["model_a", "model_b"], n_permutations,
                             draw_key(score_bits("sa"), score_bits("sb"), F.col("y"), seed=seed))
    obs = obs.select("model_a", "model_b", "metric_a", "metric_b", F.abs(F.col("metric_a") - F.col("metric_b")).alias("observed_diff"))
    return _permutation_rows(diffs.select("model_a", "model_b", F.col("diff").alias("d")), obs, "roc_auc", n_permutations)


def permutation_test(preds: DataFrame, model_a: str, model_b: str, n_permutations: int = 1000,
                     seed: int = 42, model_col: str = "model", metric: str = "roc_auc", by: str = "scores") -> DataFrame:
    """A20 for one pair."""
    return permutation_tests(preds, [(model_a, model_b)], metric, n_permutations, seed, model_col=model_col, by=by)


def bootstrap_ci(preds: DataFrame, n_samples: int = 500, ci: float = 0.95, threshold: float = 0.5,
                 seed: int = 42, group_cols=("model",), by: str = "scores") -> DataFrame:
    """Poisson(1) bootstrap of every float metric; single-class replicates skipped.

    ``by="scores"`` draws the summed weight of the rows with equal score and label,
    Poisson(count); ``by="rows"``, the checked parity mode, one weight a row.
    Output per (group, metric): mean, std (ddof 0), lower/upper percentiles
    (linear interpolation, as NumPy; over ``n_samples`` values), n_replicates.
    The threshold is not bootstrapped (it is a parameter, not a metric).
    """
    g = list(group_cols)
    y, score = F.col("y_true").alias("y"), F.col("y_score").cast("double").alias("score")
    if by == "rows":
        rows = preds.select(*g, score, y, F.lit(False).alias("__other"), F.lit(1).cast("long").alias("__n"),
                            *draw_key(*[F.col(c) for c in g], *[F.col(k) for k in KEY], seed=seed))
    else:
        cells = preds.groupBy(*g, score, y).agg(F.count(F.lit(1)).alias("__n"))
        rows = cells.select(*g, "score", "y", F.lit(False).alias("__other"), "__n",
                            *draw_key(*[F.col(c) for c in g], score_bits("score"), F.col("y"), seed=seed))
    reps = _with_metrics(replicate_cells(rows, g, n_samples, "poisson", threshold))
    reps = reps.where((F.col("rep") > 0) & (F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0))
    long = reps.select(*g, F.explode(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value")) for k in REPLICATE_METRICS])).alias("x"))
    alpha = 1.0 - ci
    return (long.groupBy(*g, F.col("x.metric").alias("metric"))
                .agg(F.avg("x.value").alias("mean"), F.stddev_pop("x.value").alias("std"),
                     F.percentile("x.value", alpha / 2).alias("lower"),
                     F.percentile("x.value", 1 - alpha / 2).alias("upper"),
                     F.count(F.lit(1)).alias("n_replicates")))
