"""Ranking and threshold metrics from one cumulative score table.

Inputs are prediction tables with ``group_cols`` (e.g. ``model``), a 0/1
label and a score in [0, 1].

Two shapes, both without a global running window:

* **Cumulative score table** (A3, A4, A17, W11, W12): rows are first
  collapsed to distinct (group, score) with pos/neg counts, which are laid
  out in score order over range partitions; running sums start at a prefix
  offset from the small part table -- a group spans as many tasks as its
  distinct scores fill.
* **Threshold grids** (A5, A6, A11-A13): each row gets the number of grid
  thresholds <= its score (exact literal comparison), rows collapse to at
  most G+1 counts per group, and every threshold's confusion cells are
  read off that tiny array -- O(N) instead of the reference's O(G*N).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grids import count_le, linspace
from ..functions.special import normal_quantile
from .sequence import PART, before, inside, join_parts, lay_out, part_table

SCORE = "y_score"
LABEL = "y_true"


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- cumulative score table

def distinct_score_counts(preds: DataFrame, group_cols=("model",), score: str = SCORE,
                          label: str = LABEL, weight: str | None = None) -> DataFrame:
    """(group, score, pos, neg): rows collapsed to distinct scores (``weight``
    counts a row that many times)."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    return preds.groupBy(*group_cols, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(F.lit(0))).alias("pos"),
        F.sum(F.when(F.col(label) == 0, w).otherwise(F.lit(0))).alias("neg"))


def score_table(preds: DataFrame, group_cols=("model",), score: str = SCORE,
                label: str = LABEL, weight: str | None = None) -> DataFrame:
    """Distinct (group, score) with pos, neg, cum_pos/cum_neg (# with score >= s), P, N.
    ``weight`` (optional column) counts each row that many times."""
    return cumulative_table(distinct_score_counts(preds, group_cols, score, label, weight), group_cols)


def cumulative_table(d: DataFrame, group_cols=("model",)) -> DataFrame:
    """Running pos/neg sums over descending score on a distinct-score table ``d``
    (group, score, pos, neg): the table is laid out once by (group, score) over
    range partitions; sums run inside a part and start at the part's offset."""
    g = list(group_cols)
    laid = lay_out(d, g, [F.col("score").desc()])
    parts = part_table(laid, g, {"__bp": F.sum("pos"), "__bn": F.sum("neg")})
    above, whole = before(g), Window.partitionBy(*g)
    offs = parts.select(*g, PART,
                        F.coalesce(F.sum("__bp").over(above), F.lit(0)).alias("__op"),
                        F.coalesce(F.sum("__bn").over(above), F.lit(0)).alias("__on"),
                        F.sum("__bp").over(whole).alias("P"),
                        F.sum("__bn").over(whole).alias("N"))
    run = inside(g).rowsBetween(Window.unboundedPreceding, 0)
    j = join_parts(laid.withColumn("__rp", F.sum("pos").over(run)).withColumn("__rn", F.sum("neg").over(run)), offs, g)
    return j.select(*g, "score", "pos", "neg",
                    (F.col("__rp") + F.col("__op")).alias("cum_pos"),
                    (F.col("__rn") + F.col("__on")).alias("cum_neg"),
                    "P", "N")


def ranking_metrics(table: DataFrame, group_cols=("model",)) -> DataFrame:
    """A3 ROC-AUC (trapezoid, ties = midrank) and A4 average precision per group."""
    g = list(group_cols)
    auc_term = F.col("neg") * (2.0 * (F.col("cum_pos") - F.col("pos")) + F.col("pos"))
    ap_term = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    agg = table.groupBy(*g).agg(F.sum(auc_term).alias("__a"), F.sum(ap_term).alias("__p"),
                                F.first("P").alias("P"), F.first("N").alias("N"))
    return agg.select(*g,
                      F.when((F.col("P") > 0) & (F.col("N") > 0),
                             F.col("__a") / (2.0 * F.col("P") * F.col("N"))).alias("roc_auc"),
                      F.when(F.col("P") > 0, F.col("__p") / F.col("P")).alias("pr_auc"))


def roc_curve(table: DataFrame, group_cols=("model",)) -> DataFrame:
    """One point per distinct score (threshold = score), descending."""
    return table.select(*group_cols, F.col("score").alias("threshold"),
                        _safe_div(F.col("cum_neg"), F.col("N")).alias("fpr"),
                        _safe_div(F.col("cum_pos"), F.col("P")).alias("tpr"))


def pr_curve(table: DataFrame, group_cols=("model",)) -> DataFrame:
    """precision/recall at each distinct score threshold, and the end point
    (precision 1, recall 0, no threshold) of every group."""
    points = table.select(*group_cols, F.col("score").alias("threshold"),
                          (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                          _safe_div(F.col("cum_pos"), F.col("P")).alias("recall"))
    end = table.select(*group_cols).distinct().select(
        *group_cols, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def delong(table: DataFrame, group_cols=("model",), confidence: float = 0.95) -> DataFrame:
    """DeLong AUC, variance (var ddof=1 of placement values), CI clamped to [0,1].

    Placement values come from the cumulative table: a positive at score s
    has V10 = (#neg below s + 0.5 #neg at s)/N, a negative has
    V01 = (#pos above s + 0.5 #pos at s)/P. Single-class groups get NULLs
    and status 'single class'.
    """
    g = list(group_cols)
    z = normal_quantile((1 + confidence) / 2)
    # try_divide: a single-class group (N or P = 0) yields NULL, not an error
    v10 = F.try_divide(F.col("N") - F.col("cum_neg") + 0.5 * F.col("neg"), F.col("N"))
    v01 = F.try_divide(F.col("cum_pos") - 0.5 * F.col("pos"), F.col("P"))
    agg = table.groupBy(*g).agg(
        F.first("P").alias("P"), F.first("N").alias("N"),
        F.sum(F.col("pos") * v10).alias("s1"), F.sum(F.col("pos") * v10 * v10).alias("s2"),
        F.sum(F.col("neg") * v01).alias("t1"), F.sum(F.col("neg") * v01 * v01).alias("t2"))
    ok = (F.col("P") > 0) & (F.col("N") > 0)
    auc = F.try_divide(F.col("s1"), F.col("P"))
    s10 = F.when(F.col("P") > 1, (F.col("s2") - F.col("s1") * F.col("s1") / F.col("P")) / (F.col("P") - 1)).otherwise(0.0)
    s01 = F.when(F.col("N") > 1, (F.col("t2") - F.col("t1") * F.col("t1") / F.col("N")) / (F.col("N") - 1)).otherwise(0.0)
    var = F.try_divide(s10, F.col("P")) + F.try_divide(s01, F.col("N"))
    out = agg.select(*g, F.when(ok, auc).alias("auc"), F.when(ok, var).alias("variance"))
    se = F.sqrt(F.greatest(F.col("variance"), F.lit(0.0)))
    return out.select(*g, "auc", "variance", se.alias("std_error"),
                      F.greatest(F.lit(0.0), F.col("auc") - z * se).alias("lower"),
                      F.least(F.lit(1.0), F.col("auc") + z * se).alias("upper"),
                      F.when(F.col("auc").isNull(), F.lit("single class")).otherwise(F.lit("ok")).alias("status"))


# ---------------------------------------------------------------- threshold grids

F1_GRID = (0.01, 0.99, 200)        # find_optimal_threshold
SWEEP_GRID = (0.01, 0.99, 100)     # threshold_analysis default
COST_GRID = (0.0, 1.0, 200)        # expected cost curve


def _per_k(preds: DataFrame, grids: dict[str, list[float]], group_cols, score: str, label: str) -> DataFrame:
    """ONE pass: rows collapse to (group, k_grid1, k_grid2, ...) counts. Every
    k is a monotone function of the score, so the result has at most
    sum(G)+1 rows per group whatever the data size."""
    ks = [count_le(F.col(score), grid).alias(f"k_{name}") for name, grid in grids.items()]
    return preds.groupBy(*group_cols, *ks).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("neg"))


def _confusion_from_k(per_k: DataFrame, name: str, grid: list[float], group_cols) -> DataFrame:
    g = list(group_cols)
    per_g = per_k.groupBy(*g).agg(F.collect_list(F.struct(F.col(f"k_{name}").alias("k"), "pos", "neg")).alias("e"),
                                  F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    # one array literal for the grid, indexed by an exploded sequence
    ex = per_g.select(*g, "e", "P", "N", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("gi"))
    ex = ex.withColumn("gt", F.element_at(F.lit([float(t) for t in grid]), F.col("gi") + 1))

    def above(field):
        return F.aggregate(F.filter("e", lambda x: x["k"] > F.col("gi")), F.lit(0).cast("long"),
                           lambda acc, x: acc + x[field])
    return ex.select(*g, F.col("gi").alias("grid_idx"), F.col("gt").alias("threshold"),
                     above("pos").alias("tp"), above("neg").alias("fp"),
                     (F.col("P") - above("pos")).alias("fn"), (F.col("N") - above("neg")).alias("tn"))


def threshold_confusions(preds: DataFrame, grids: dict[str, list[float]], group_cols=("model",),
                         score: str = SCORE, label: str = LABEL) -> dict[str, DataFrame]:
    """Confusion cells on several grids from a single scan of ``preds``."""
    per_k = _per_k(preds, grids, list(group_cols), score, label)
    return {name: _confusion_from_k(per_k, name, grid, group_cols) for name, grid in grids.items()}


def threshold_confusion(preds: DataFrame, grid: list[float], group_cols=("model",),
                        score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Confusion cells at every grid threshold, decision ``score >= t`` (inclusive).

    Output: group cols, grid_idx, threshold, tp, fp, fn, tn.
    """
    return threshold_confusions(preds, {"g": grid}, group_cols, score, label)["g"]


def prf(tp: Column, fp: Column, fn: Column):
    precision = _safe_div(tp, tp + fp)
    recall = _safe_div(tp, tp + fn)
    f1 = _safe_div(2.0 * tp, 2.0 * tp + fp + fn)
    return precision, recall, f1


def threshold_sweep(preds: DataFrame, n_steps: int = 100, group_cols=("model",), **kw) -> DataFrame:
    """A5: precision / recall / F1 on ``linspace(0.01, 0.99, n_steps)``."""
    grid = linspace(0.01, 0.99, n_steps)
    c = threshold_confusion(preds, grid, group_cols, **kw)
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select(*group_cols, "grid_idx", "threshold", p.alias("precision"),
                    r.alias("recall"), f1.alias("f1"))


def _metric_on_cells(metric: str, beta: float) -> Column:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r, f1 = prf(tp, fp, fn)
    if metric == "f1":
        return f1
    if metric == "fbeta":
        b2 = beta * beta
        return F.when(b2 * p + r > 0, (1 + b2) * p * r / (b2 * p + r)).otherwise(F.lit(0.0))
    if metric == "j_stat":
        return _safe_div(tp, tp + fn) + _safe_div(tn, tn + fp) - 1.0
    raise ValueError(f"no threshold metric {metric!r}: f1, fbeta or j_stat")


def optimal_threshold(preds: DataFrame, metric: str = "f1", beta: float = 1.0,
                      group_cols=("model",), n_steps: int = 200, **kw) -> DataFrame:
    """Best grid threshold on ``linspace(0.01, 0.99, 200)``; the first maximum wins.

    Starting point (0.5, -1.0) is kept when no grid value beats -1.
    """
    return optimal_thresholds(preds, [(metric, beta)], group_cols, n_steps, **kw)


def optimal_thresholds(preds: DataFrame, metrics=(("f1", 1.0), ("fbeta", 2.0), ("j_stat", 1.0)),
                       group_cols=("model",), n_steps: int = 200, **kw) -> DataFrame:
    """A6 for several metrics from ONE confusion table (one scan of ``preds``)."""
    cols = [_metric_on_cells(m, b) for m, b in metrics]  # raises for unknown metric names
    c = threshold_confusion(preds, linspace(0.01, 0.99, n_steps), group_cols, **kw)
    s = c.select(*group_cols, "grid_idx", "threshold", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), col.alias("score")) for (m, _), col in zip(metrics, cols)])).alias("x"))
    best = s.groupBy(*group_cols, F.col("x.metric").alias("metric")).agg(
        F.max(F.struct(F.col("x.score").alias("score"), (-F.col("grid_idx")).alias("neg_idx"),
                       F.col("threshold"))).alias("b"))
    beat = F.col("b.score") > -1.0
    return best.select(*group_cols, "metric",
                       F.when(beat, F.col("b.threshold")).otherwise(F.lit(0.5)).alias("threshold"),
                       F.when(beat, F.col("b.score")).otherwise(F.lit(-1.0)).alias("score"))


@dataclass(frozen=True)
class CostMatrix:
    cost_fn: float
    cost_fp: float
    cost_tp: float = 0.0
    cost_tn: float = 0.0


def cost_curve(preds: DataFrame, costs: CostMatrix, n_steps: int = 200, group_cols=("model",), **kw) -> DataFrame:
    """cost = fn*Cfn + fp*Cfp - tp*Ctp - tn*Ctn on linspace(0,1,n); normalised by max(P*Cfn, 1)."""
    return _cost_columns(threshold_confusion(preds, linspace(0.0, 1.0, n_steps), group_cols, **kw),
                         costs, group_cols)


def _cost_columns(c: DataFrame, costs: CostMatrix, group_cols) -> DataFrame:
    cost = (F.col("fn") * costs.cost_fn + F.col("fp") * costs.cost_fp
            - F.col("tp") * costs.cost_tp - F.col("tn") * costs.cost_tn)
    worst = F.greatest((F.col("tp") + F.col("fn")) * costs.cost_fn, F.lit(1.0))
    return c.select(*group_cols, "grid_idx", "threshold", "tp", "fp", "fn", "tn",
                    cost.cast("double").alias("expected_cost"), (cost / worst).alias("normalised_cost"))


def cost_optimal_threshold(curve: DataFrame, group_cols=("model",)) -> DataFrame:
    """First argmin of the expected cost curve."""
    best = curve.groupBy(*group_cols).agg(
        F.min(F.struct("expected_cost", "grid_idx", "threshold")).alias("b"))
    return best.select(*group_cols, F.col("b.threshold").alias("threshold"),
                       F.col("b.expected_cost").alias("min_cost"))


def cost_threshold_comparison(preds: DataFrame, costs: CostMatrix, group_cols=("model",), **kw) -> DataFrame:
    """F1-optimal vs cost-optimal decision (total cost ignores Ctp/Ctn)."""
    g = list(group_cols)
    both = threshold_confusions(preds, {"f1": linspace(*F1_GRID[:2], F1_GRID[2]),
                                        "cost": linspace(*COST_GRID[:2], COST_GRID[2])}, g, **kw)
    f1c = both["f1"]
    _, _, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    f1best = (f1c.withColumn("f1", f1).groupBy(*g)
                 .agg(F.max(F.struct(F.col("f1"), (-F.col("grid_idx")).alias("ni"), "threshold",
                                     "tp", "fp", "fn", "tn")).alias("a")))
    cc = _cost_columns(both["cost"], costs, g)
    cbest = cc.groupBy(*g).agg(F.min(F.struct("expected_cost", "grid_idx", "threshold",
                                               "tp", "fp", "fn", "tn")).alias("b"))
    j = f1best.join(cbest, g)

    def cells(prefix, s):
        tp, fp, fn = F.col(f"{s}.tp"), F.col(f"{s}.fp"), F.col(f"{s}.fn")
        p, r, f = prf(tp, fp, fn)
        total = fp * costs.cost_fp + fn * costs.cost_fn
        return [F.col(f"{s}.threshold").alias(f"{prefix}_threshold"), tp.alias(f"{prefix}_tp"),
                fp.alias(f"{prefix}_fp"), fn.alias(f"{prefix}_fn"), F.col(f"{s}.tn").alias(f"{prefix}_tn"),
                p.alias(f"{prefix}_precision"), r.alias(f"{prefix}_recall"), f.alias(f"{prefix}_f1"),
                total.cast("double").alias(f"{prefix}_total_cost"),
                (fn * costs.cost_fn).cast("double").alias(f"{prefix}_cost_fn_contribution"),
                (fp * costs.cost_fp).cast("double").alias(f"{prefix}_cost_fp_contribution")]
    out = j.select(*g, *cells("f1", "a"), *cells("cost", "b"))
    saving = F.col("f1_total_cost") - F.col("cost_total_cost")
    return out.select("*", saving.alias("cost_saving"),
                      (100.0 * saving / F.greatest(F.col("f1_total_cost"), F.lit(1.0))).alias("cost_saving_pct"))


def theoretical_threshold(preds: DataFrame, costs: CostMatrix, group_cols=("model",),
                          label: str = LABEL) -> DataFrame:
    """``Cfp*pi / (Cfp*pi + Cfn*(1-pi))`` as coded by the reference, and the
    Bayes threshold ``Cfp/(Cfp+Cfn)`` for calibrated scores. pi outside (0,1) -> NULL + status."""
    pi = F.avg(F.col(label).cast("double"))
    agg = preds.groupBy(*group_cols).agg(pi.alias("prevalence"))
    ok = (F.col("prevalence") > 0) & (F.col("prevalence") < 1)
    num = costs.cost_fp * F.col("prevalence")
    den = num + costs.cost_fn * (1 - F.col("prevalence"))
    return agg.select(*group_cols, "prevalence",
                      F.when(ok, num / den).alias("theoretical_threshold"),
                      F.lit(costs.cost_fp / (costs.cost_fp + costs.cost_fn)).alias("bayes_threshold"),
                      F.when(ok, F.lit("ok")).otherwise(F.lit("prevalence outside (0,1)")).alias("status"))
