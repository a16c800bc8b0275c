"""Point metrics, calibration, score distributions and error reports.

Every function groups by ``group_cols`` (default ``model``) and returns a
small tidy DataFrame; all are partial+final hash aggregations, running sums
and quartiles over laid-out distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grids import digitize_clipped, half_open_bin, histogram_bin, linspace
from .curves import LABEL, SCORE, _safe_div, cumulative_table, distinct_score_counts, ranking_metrics
from .selection import select_quantiles


def decision(score: Column, threshold) -> Column:
    """``score >= t`` as 0/1 (compare unrounded scores)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (score >= t).cast("int")


def confusion_cell(y: Column, p: Column) -> Column:
    """Tp / fp / fn / tn label per row."""
    return (F.when((y == 1) & (p == 1), F.lit("tp")).when((y == 0) & (p == 1), F.lit("fp"))
             .when((y == 1) & (p == 0), F.lit("fn")).otherwise(F.lit("tn")))


def confusion_counts(preds: DataFrame, threshold=0.5, group_cols=("model",),
                     score: str = SCORE, label: str = LABEL) -> DataFrame:
    """A1: tp, fp, fn, tn per group (and the row-normalised rates)."""
    p = decision(F.col(score), threshold)
    y = F.col(label)
    out = preds.groupBy(*group_cols).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    return out.select("*",
                      _safe_div(F.col("tn"), F.col("tn") + F.col("fp")).alias("tn_rate"),
                      _safe_div(F.col("fp"), F.col("tn") + F.col("fp")).alias("fp_rate"),
                      _safe_div(F.col("fn"), F.col("fn") + F.col("tp")).alias("fn_rate"),
                      _safe_div(F.col("tp"), F.col("fn") + F.col("tp")).alias("tp_rate"))


def metrics_from_cells(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """A2 on cells. MCC multiplies square roots of doubles (no int64 overflow)."""
    n = tp + fp + fn + tn
    precision = _safe_div(tp, tp + fp)
    recall = _safe_div(tp, tp + fn)
    f1 = _safe_div(2.0 * tp, 2.0 * tp + fp + fn)
    spec = _safe_div(tn, tn + fp)
    d = (F.sqrt((tp + fp).cast("double")) * F.sqrt((tp + fn).cast("double"))
         * F.sqrt((tn + fp).cast("double")) * F.sqrt((tn + fn).cast("double")))
    mcc = F.when(d > 0, (tp.cast("double") * tn - fp.cast("double") * fn) / d).otherwise(F.lit(0.0))
    return {"accuracy": _safe_div(tp + tn, n), "precision": precision, "recall": recall, "f1": f1,
            "specificity": spec, "balanced_accuracy": (recall + spec) / 2.0, "mcc": mcc}


def classification_metrics(preds: DataFrame, threshold=0.5, group_cols=("model",),
                           score: str = SCORE, label: str = LABEL) -> DataFrame:
    """A2 (+A3, A4): all point metrics at a threshold plus ROC-AUC and PR-AUC, both
    from one table of distinct scores. A threshold column must depend on the
    group alone."""
    g = list(group_cols)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    d = distinct_score_counts(preds.withColumn("__t", t), [*g, "__t"], score, label)
    table = cumulative_table(d, [*g, "__t"])
    ge = F.col("score") >= F.col("__t")
    zero = F.lit(0)
    cells = table.groupBy(*g, "__t").agg(
        F.sum(F.when(ge, F.col("pos")).otherwise(zero)).alias("tp"), F.sum(F.when(ge, F.col("neg")).otherwise(zero)).alias("fp"),
        F.sum(F.when(ge, zero).otherwise(F.col("pos"))).alias("fn"), F.sum(F.when(ge, zero).otherwise(F.col("neg"))).alias("tn"))
    m = metrics_from_cells(*(F.col(x) for x in ("tp", "fp", "fn", "tn")))
    pm = cells.select(*g, "__t", "tp", "fp", "fn", "tn", *[v.alias(k) for k, v in m.items()])
    return pm.join(ranking_metrics(table, [*g, "__t"]), [*g, "__t"]).drop("__t")


def brier_and_ece(preds: DataFrame, n_bins: int = 15, group_cols=("model",),
                  score: str = SCORE, label: str = LABEL) -> DataFrame:
    """A7 Brier, A8 Brier skill score, A9 ECE (bins [lo, hi); a score of exactly
    1.0 falls in no bin but still counts in n)."""
    g = list(group_cols)
    edges = linspace(0.0, 1.0, n_bins + 1)
    b = half_open_bin(F.col(score), edges)
    y = F.col(label).cast("double")
    per_bin = preds.groupBy(*g, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("nb"), F.avg(F.col(score)).alias("conf"), F.avg(y).alias("acc"),
        F.sum(F.pow(F.col(score) - y, 2)).alias("sq"), F.sum(y).alias("ys"))
    agg = per_bin.groupBy(*g).agg(
        F.sum("nb").alias("n"), F.sum("sq").alias("sq"), F.sum("ys").alias("ys"),
        F.sum(F.when(F.col("bin").isNotNull(), F.col("nb") * F.abs(F.col("conf") - F.col("acc")))).alias("gap"))
    brier = F.col("sq") / F.col("n")
    pi = F.col("ys") / F.col("n")
    ref = pi * (1 - pi)
    return agg.select(*g, brier.alias("brier_score"),
                      F.when(ref == 0, F.lit(0.0)).otherwise(1.0 - brier / ref).alias("brier_skill_score"),
                      F.coalesce(F.col("gap") / F.col("n"), F.lit(0.0)).alias("ece"))


def reliability_table(preds: DataFrame, n_bins: int = 10, group_cols=("model",),
                      score: str = SCORE, label: str = LABEL) -> DataFrame:
    """A10: ``digitize`` bins clipped so 1.0 lands in the last bin; empty bins kept as 0."""
    g = list(group_cols)
    edges = linspace(0.0, 1.0, n_bins + 1)
    b = digitize_clipped(F.col(score), edges)
    per_bin = preds.groupBy(*g, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("cnt"), F.avg(F.col(score)).alias("mp"),
        F.avg(F.col(label).cast("double")).alias("fp"))
    spine = preds.select(*g).distinct().select(*g, F.explode(F.array(*[
        F.struct(F.lit(i).alias("bin"), F.lit((edges[i] + edges[i + 1]) / 2).alias("bin_center"))
        for i in range(n_bins)])).alias("s")).select(*g, "s.bin", "s.bin_center")
    j = spine.join(per_bin, [*g, "bin"], "left")
    return j.select(*g, "bin", "bin_center", F.coalesce("mp", F.lit(0.0)).alias("mean_predicted"),
                    F.coalesce("fp", F.lit(0.0)).alias("fraction_positive"),
                    F.coalesce("cnt", F.lit(0)).alias("count"))


def score_distribution(preds: DataFrame, group_cols=("model",), score: str = SCORE,
                       label: str = LABEL) -> DataFrame:
    """Per (group, class) mean, std (ddof 0), median, q25, q75, n; quartiles are
    exact (linear interpolation, as NumPy) by selection on counts."""
    g = list(group_cols)
    classed = preds.withColumn("y_class", F.col(label))
    agg = classed.groupBy(*g, "y_class").agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    q = select_quantiles(classed, [*g, "y_class"], [score], (0.25, 0.5, 0.75)).drop("sensor")
    # both classes always reported; an empty class gets zeros (as the reference)
    spine = preds.select(*g).distinct().select(*g, F.explode(F.array(F.lit(0), F.lit(1))).alias("y_class"))
    j = spine.join(agg, [*g, "y_class"], "left").join(q, [*g, "y_class"], "left")
    z = F.lit(0.0)
    return j.select(*g, "y_class", F.coalesce("n", F.lit(0).cast("long")).alias("n"),
                    F.coalesce("mean", z).alias("mean"), F.coalesce("std", z).alias("std"),
                    F.coalesce(F.col("q")[1], z).alias("median"), F.coalesce(F.col("q")[0], z).alias("q25"),
                    F.coalesce(F.col("q")[2], z).alias("q75"))


def class_separation(preds: DataFrame, n_bins: int = 50, group_cols=("model",),
                     score: str = SCORE, label: str = LABEL) -> DataFrame:
    """A15 counts + A16: KL(pos || neg) over ``n_bins`` density bins, +1e-10, renormalised.

    NULL when a class is empty (the reference yields NaN there).
    """
    g = list(group_cols)
    edges = linspace(0.0, 1.0, n_bins + 1)
    width = 1.0 / n_bins
    b = histogram_bin(F.col(score), edges)
    y = F.col(label)
    per_bin = (preds.where(b.isNotNull()).groupBy(*g, b.alias("bin"))
                    .agg(F.count_if(y == 1).alias("cp"), F.count_if(y == 0).alias("cn")))
    totals = preds.groupBy(*g).agg(F.count_if(y == 1).alias("n_positive"),
                                   F.count_if(y == 0).alias("n_negative"))
    spine = preds.select(*g).distinct().select(*g, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    inb = per_bin.groupBy(*g).agg(F.sum("cp").alias("ip"), F.sum("cn").alias("in_"))
    j = spine.join(per_bin, [*g, "bin"], "left").join(inb, g, "left")
    # density = count / (in-range count * width); + eps; renormalise
    eps = 1e-10
    dp = F.coalesce(F.col("cp"), F.lit(0)) / (F.col("ip") * width) + eps
    dn = F.coalesce(F.col("cn"), F.lit(0)) / (F.col("in_") * width) + eps
    d = j.select(*g, dp.alias("dp"), dn.alias("dn"), "ip", "in_")
    s = d.groupBy(*g).agg(F.sum("dp").alias("sp"), F.sum("dn").alias("sn"),
                          F.sum(F.col("dp") * F.log(F.col("dp") / F.col("dn"))).alias("x"),
                          F.sum("dp").alias("sp2"), F.first("ip").alias("ip"), F.first("in_").alias("in_"))
    # sum p_i/sp * ln((p_i/sp)/(q_i/sn)) = x/sp + ln(sn/sp)
    kl = F.col("x") / F.col("sp") + F.log(F.col("sn") / F.col("sp"))
    s = s.select(*g, F.when((F.col("ip") > 0) & (F.col("in_") > 0), kl).alias("kl_divergence_pos_neg"))
    return totals.join(s, g, "left").select(
        *g, "n_positive", "n_negative",
        (F.col("n_negative") / F.greatest(F.col("n_positive"), F.lit(1))).alias("class_imbalance_ratio"),
        "kl_divergence_pos_neg")


def score_histogram(preds: DataFrame, n_edges: int = 40, group_cols=("model",),
                    score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Per (group, class) density over ``linspace(0,1,n_edges)`` edges (n_edges-1 bins)."""
    g = list(group_cols)
    edges = linspace(0.0, 1.0, n_edges)
    nb = n_edges - 1
    b = histogram_bin(F.col(score), edges)
    per = (preds.where(b.isNotNull()).groupBy(*g, F.col(label).alias("y_class"), b.alias("bin"))
                .agg(F.count(F.lit(1)).alias("cnt")))
    tot = per.groupBy(*g, "y_class").agg(F.sum("cnt").alias("tot"))
    spine = tot.select(*g, "y_class", "tot", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("bin"))
    j = spine.join(per, [*g, "y_class", "bin"], "left")
    width = F.lit(edges[1] - edges[0])
    lo = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("bin") + 1)
    return j.select(*g, "y_class", "bin", lo.alias("bin_left"),
                    F.coalesce("cnt", F.lit(0)).alias("count"),
                    (F.coalesce("cnt", F.lit(0)) / (F.col("tot") * width)).alias("density"))


def error_summary(preds: DataFrame, threshold=0.5, group_cols=("model",),
                  score: str = SCORE, label: str = LABEL) -> DataFrame:
    """A24 + P6: counts, error rates and n/mean/std/min/max of the scores in each
    confusion cell (0 when empty)."""
    s = F.col(score)
    cell = confusion_cell(F.col(label), decision(s, threshold))

    def desc(name):
        v = F.when(F.col("__cell") == name, s)
        out = [F.count(v).alias(f"n_{name}")]
        return out + [F.coalesce(a(v), F.lit(0.0)).alias(f"{name}_score_{n}") for n, a in (
            ("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    agg = preds.withColumn("__cell", cell).groupBy(*group_cols).agg(*[x for c in ("fp", "fn", "tp", "tn") for x in desc(c)])
    pos, neg = F.col("n_fn") + F.col("n_tp"), F.col("n_fp") + F.col("n_tn")
    return agg.select(*group_cols, *[f"n_{c}" for c in ("fp", "fn", "tp", "tn")],
                      (F.col("n_fn") / F.greatest(pos, F.lit(1))).alias("fn_rate_overall"),
                      (F.col("n_fp") / F.greatest(neg, F.lit(1))).alias("fp_rate_overall"),
                      *[c for c in agg.columns if "_score_" in c])


def comparison_table(metrics: DataFrame, model_col: str = "model",
                     columns=("f1", "precision", "recall", "roc_auc", "pr_auc", "mcc")) -> DataFrame:
    """A33 + T2: models x chosen metrics, ranked by F1 (rank 1 = best)."""
    from pyspark.sql import Window
    w = Window.orderBy(F.col("f1").desc(), F.col(model_col))
    return metrics.select(model_col, *columns, F.row_number().over(w).alias("rank"))


def metrics_at_selected_threshold(preds: DataFrame, splits: DataFrame | None = None, metric: str = "f1",
                                  select_on: str = "val", evaluate_on: str = "test",
                                  model_col: str = "model") -> DataFrame:
    """Pick each model's threshold on ``select_on`` machines (A6, first maximum),
    then report A2 on ``evaluate_on`` machines at that threshold. With
    select_on='test' this is the reference's (optimistic) protocol.
    The threshold table has one row per model (broadcast). Without ``splits``
    the predictions carry their machine's split."""
    from .curves import optimal_thresholds
    p = preds if splits is None else preds.join(splits, "machine_id")
    thr = optimal_thresholds(p.where(F.col("split") == select_on), [(metric, 1.0)], (model_col,)) \
        .select(model_col, F.col("threshold").alias("selected_threshold"))
    ev = p.where(F.col("split") == evaluate_on).join(F.broadcast(thr), model_col)
    out = classification_metrics(ev, F.col("selected_threshold"), (model_col,))
    return out.join(thr, model_col)
