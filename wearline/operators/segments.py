"""Error breakdowns by segment: machine type, degradation stage, proximity to failure.

Predictions are joined to window metadata **by key** (machine_id,
end_timestep), never by position (the reference attributes rates to the
wrong windows when the two orders differ).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curves import _safe_div
from .metrics import decision

KEY = ["machine_id", "end_timestep"]


def join_metadata(preds: DataFrame, metadata: DataFrame) -> DataFrame:
    """Inner equi-join on the window key."""
    meta = metadata.drop(*[c for c in ("y_true", "y_score", "model") if c in metadata.columns])
    return preds.join(meta, KEY)


def _rate_aggs(y: Column, p: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("n_windows"), F.count_if(y == 1).alias("n_positives"),
            F.count_if(y == 0).alias("n_negatives"),
            F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
            F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn")]


def _rates(df: DataFrame, keep: list[str]) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    prec = _safe_div(tp, tp + fp)
    rec = _safe_div(tp, tp + fn)
    return df.select(*keep, "n_windows", "n_positives", "n_negatives", "tp", "fp", "fn", "tn",
                     _safe_div(fn, F.col("n_positives")).alias("fn_rate"),
                     _safe_div(fp, F.col("n_negatives")).alias("fp_rate"),
                     prec.alias("precision"), rec.alias("recall"),
                     F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0)).alias("f1"))


def error_by_group(joined: DataFrame, group_cols=("machine_type", "degradation_stage"),
                   threshold=0.5, model_col: str = "model") -> DataFrame:
    """Per (model, group column, value) error rates, all group columns in ONE
    scan via GROUPING SETS ((model, c1), (model, c2), ...)."""
    p = decision(F.col("y_score"), threshold)
    y = F.col("y_true")
    base = joined.select(model_col, *[F.col(c).cast("string").alias(c) for c in group_cols],
                         y.alias("__y"), p.alias("__p"))
    sets = [[F.col(model_col), F.col(c)] for c in group_cols]
    gid, val = None, None
    for c in group_cols:
        cond = F.grouping(c) == 0
        gid = (F.when(cond, F.lit(c)) if gid is None else gid.when(cond, F.lit(c)))
        val = (F.when(cond, F.col(c)) if val is None else val.when(cond, F.col(c)))
    __y, __p = F.col("__y"), F.col("__p")
    agg = base.groupingSets(sets, model_col, *group_cols).agg(
        gid.alias("group_by"), val.alias("group_value"),
        F.count(F.lit(1)).alias("n_windows"), F.count_if(__y == 1).alias("n_positives"),
        F.count_if(__y == 0).alias("n_negatives"),
        F.count_if((__y == 1) & (__p == 1)).alias("tp"), F.count_if((__y == 0) & (__p == 1)).alias("fp"),
        F.count_if((__y == 1) & (__p == 0)).alias("fn"), F.count_if((__y == 0) & (__p == 0)).alias("tn"))
    return _rates(agg, [model_col, "group_by", "group_value"])


# Proximity bucket edges (steps before failure), right-open.
PROXIMITY_EDGES = [5, 10, 20, 30, 60, 100]


def proximity_bucket(ttf: Column, edges=PROXIMITY_EDGES) -> tuple[Column, Column]:
    """(ordinal, label) of the bucket; NULL steps -> 'no failure in window' (last)."""
    order = F.when(ttf.isNull(), F.lit(len(edges) + 1))
    label = F.when(ttf.isNull(), F.lit("no failure in window"))
    prev = 0
    for i, e in enumerate(edges):
        cond = (ttf >= prev) & (ttf < e)
        order = order.when(cond, F.lit(i))
        label = label.when(cond, F.lit(f"{prev}–{e - 1}"))
        prev = e
    order = order.when(ttf >= prev, F.lit(len(edges)))
    label = label.when(ttf >= prev, F.lit(f"≥{prev}"))
    return order, label


def error_by_proximity(joined: DataFrame, threshold=0.5, model_col: str = "model",
                       edges=PROXIMITY_EDGES) -> DataFrame:
    """Error rates per proximity bucket; empty buckets are omitted."""
    p = decision(F.col("y_score"), threshold)
    y = F.col("y_true")
    order, label = proximity_bucket(F.col("timesteps_to_failure"), edges)
    agg = (joined.select(model_col, order.alias("bucket_order"), label.alias("bucket"), y.alias("__y"), p.alias("__p"))
                 .where(F.col("bucket_order").isNotNull())
                 .groupBy(model_col, "bucket_order", "bucket")
                 .agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(F.col("__y") == 1).alias("n_positives"),
                      F.count_if(F.col("__y") == 0).alias("__neg"),
                      F.count_if((F.col("__y") == 1) & (F.col("__p") == 0)).alias("__fn"),
                      F.count_if((F.col("__y") == 0) & (F.col("__p") == 1)).alias("__fp")))
    return agg.select(model_col, "bucket_order", "bucket", "n_windows", "n_positives",
                      _safe_div(F.col("__fn"), F.col("n_positives")).alias("fn_rate"),
                      _safe_div(F.col("__fp"), F.col("__neg")).alias("fp_rate"))


def worst_groups(by_group: DataFrame, metrics=("fn_rate", "fp_rate"), model_col: str = "model") -> DataFrame:
    """Per (model, group_by, metric) the group with the highest value; ties go
    to the smallest group value (first in sorted order)."""
    rows = by_group.select(model_col, "group_by", "group_value",
                           F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                                               for m in metrics])).alias("m"))
    best = rows.groupBy(model_col, "group_by", F.col("m.metric").alias("metric")).agg(
        F.min(F.struct((-F.col("m.value")).alias("nv"), F.col("group_value"))).alias("b"))
    return best.select(model_col, "group_by", "metric", F.col("b.group_value").alias("group_value"),
                       (-F.col("b.nv")).alias("value"))


def best_model(metrics: DataFrame, metric: str = "f1", model_col: str = "model") -> DataFrame:
    """Model with the highest metric (ties -> smallest model name)."""
    b = metrics.agg(F.min(F.struct((-F.col(metric)).alias("nv"), F.col(model_col))).alias("b"))
    return b.select(F.lit(metric).alias("metric"), F.col(f"b.{model_col}").alias(model_col),
                    (-F.col("b.nv")).alias("value"))
