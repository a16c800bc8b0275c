"""Registered queries: Spark plan + DuckDB oracle text, side by side.

Each Spark callable takes (spark, sf_dir) and reads the driver tables (or
data Spark derives from them) in full. Doubles are rounded to 6 decimals
on both sides; every output column is aliased identically.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import curves as C
from ..operators import metrics as M
from ..operators import inference as I
from ..operators import prepare as P_
from ..session import store
from . import fixtures as fx
from .oracle import base, chi2_sf_sql, grid_cte, r6

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6, **per_col: int) -> DataFrame:
    """Round every double column (``per_col`` overrides the digits by name)."""
    return df.select(*[F.round(F.col(f.name), per_col.get(f.name, digits)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def register(name: str, sql: str | None = None):
    def deco(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _preds(spark, sf):
    return fx.load_predictions(spark, sf)


# ---------------------------------------------------------------- labels / windows

register("readings_labels", f"""WITH {base()}
SELECT machine_id, timestep, machine_type, rul, failure_imminent, failure_event,
       {r6('degradation_progress', 'degradation_progress')}
FROM labeled""")(lambda spark, sf: rounded(fx.labeled_readings(spark, sf).select(
    "machine_id", "timestep", "machine_type", "rul", "failure_imminent", "failure_event",
    "degradation_progress")))

register("window_metadata", f"""WITH {base()}
SELECT machine_id, end_timestep, machine_type, {r6('degradation_progress', 'degradation_progress')},
       failure_event, failure_imminent, timesteps_to_failure, degradation_stage
FROM meta""")(lambda spark, sf: rounded(fx.window_metadata(fx.labeled_readings(spark, sf))))

register("predictions", f"""WITH {base()}
SELECT model, machine_id, end_timestep, y_true, {r6('y_score', 'y_score')} FROM preds""")(
    lambda spark, sf: rounded(_preds(spark, sf)))


# ---------------------------------------------------------------- point metrics

_CELLS = """CAST(SUM(CASE WHEN y_true = 1 AND y_score >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(SUM(CASE WHEN y_true = 0 AND y_score >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(SUM(CASE WHEN y_true = 1 AND y_score < CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(SUM(CASE WHEN y_true = 0 AND y_score < CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS tn"""


def _ratio(a, b):
    return f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END)"


register("confusion_matrix", f"""WITH {base()},
cells AS (SELECT model, {_CELLS} FROM preds GROUP BY model)
SELECT model, tp, fp, fn, tn, {r6(_ratio('tn', 'tn + fp'), 'tn_rate')}, {r6(_ratio('fp', 'tn + fp'), 'fp_rate')},
       {r6(_ratio('fn', 'fn + tp'), 'fn_rate')}, {r6(_ratio('tp', 'fn + tp'), 'tp_rate')}
FROM cells""")(lambda spark, sf: rounded(M.confusion_counts(_preds(spark, sf))))

_RANK_SQL = """
dist AS (SELECT model, y_score AS s, CAST(SUM(y_true) AS DOUBLE) AS pos,
                CAST(SUM(1 - y_true) AS DOUBLE) AS neg FROM preds GROUP BY model, y_score),
cum AS (SELECT model, s, pos, neg,
          COALESCE(SUM(neg) OVER (PARTITION BY model ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
          SUM(pos) OVER (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cpos,
          SUM(neg) OVER (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cneg,
          SUM(pos) OVER (PARTITION BY model) AS P, SUM(neg) OVER (PARTITION BY model) AS N
        FROM dist),
rk AS (SELECT model,
         CASE WHEN max(P) > 0 AND max(N) > 0 THEN SUM(pos * (neg_below + 0.5 * neg)) / (max(P) * max(N)) END AS roc_auc,
         CASE WHEN max(P) > 0 THEN SUM(pos * cpos / (cpos + cneg)) / max(P) END AS pr_auc
       FROM cum GROUP BY model)"""


def _metric_sql(digits: int = 6):
    tp, fp, fn, tn = "tp", "fp", "fn", "tn"
    prec = _ratio(tp, f"{tp} + {fp}")
    rec = _ratio(tp, f"{tp} + {fn}")
    spec = _ratio(tn, f"{tn} + {fp}")
    f1 = _ratio(f"2.0 * {tp}", f"2.0 * {tp} + {fp} + {fn}")
    den = f"(sqrt(CAST({tp} + {fp} AS DOUBLE)) * sqrt(CAST({tp} + {fn} AS DOUBLE)) * sqrt(CAST({tn} + {fp} AS DOUBLE)) * sqrt(CAST({tn} + {fn} AS DOUBLE)))"
    mcc = f"(CASE WHEN {den} > 0 THEN (CAST({tp} AS DOUBLE) * {tn} - CAST({fp} AS DOUBLE) * {fn}) / {den} ELSE 0.0 END)"
    named = {"accuracy": _ratio(f"{tp} + {tn}", f"{tp} + {fp} + {fn} + {tn}"), "precision": prec, "recall": rec, "f1": f1,
             "specificity": spec, "balanced_accuracy": f"({rec} + {spec}) / 2.0", "mcc": mcc}
    return ", ".join(r6(expr, name, digits) for name, expr in named.items())


register("classification_metrics", f"""WITH {base()},
cells AS (SELECT model, {_CELLS} FROM preds GROUP BY model),{_RANK_SQL}
SELECT c.model, tp, fp, fn, tn, {_metric_sql()}, {r6('roc_auc', 'roc_auc')}, {r6('pr_auc', 'pr_auc')}
FROM cells c JOIN rk ON c.model = rk.model""")(lambda spark, sf: rounded(M.classification_metrics(_preds(spark, sf))))


def _grid_cells(grid_name: str) -> str:
    return f"""
gc AS (SELECT p.model, g.grid_idx, g.threshold,
          CAST(SUM(CASE WHEN p.y_true = 1 AND p.y_score >= g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS tp,
          CAST(SUM(CASE WHEN p.y_true = 0 AND p.y_score >= g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fp,
          CAST(SUM(CASE WHEN p.y_true = 1 AND p.y_score < g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fn,
          CAST(SUM(CASE WHEN p.y_true = 0 AND p.y_score < g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS tn
       FROM preds p, {grid_name} g GROUP BY p.model, g.grid_idx, g.threshold)"""


register("threshold_sweep", f"""WITH {base()}, {grid_cte('grid', 0.01, 0.99, 100)},{_grid_cells('grid')}
SELECT model, grid_idx, {r6('threshold', 'threshold')}, {r6(_ratio('tp', 'tp + fp'), 'precision')},
       {r6(_ratio('tp', 'tp + fn'), 'recall')}, {r6(_ratio('2.0 * tp', '2.0 * tp + fp + fn'), 'f1')}
FROM gc""")(lambda spark, sf: rounded(C.threshold_sweep(_preds(spark, sf))))


def _opt_sql():
    f1 = _ratio("2.0 * tp", "2.0 * tp + fp + fn")
    p, r = _ratio("tp", "tp + fp"), _ratio("tp", "tp + fn")
    fb = f"(CASE WHEN 4.0 * {p} + {r} > 0 THEN 5.0 * {p} * {r} / (4.0 * {p} + {r}) ELSE 0.0 END)"
    j = f"({r} + {_ratio('tn', 'tn + fp')} - 1.0)"
    parts = []
    for name, expr in (("f1", f1), ("fbeta", fb), ("j_stat", j)):
        parts.append(f"SELECT model, '{name}' AS metric, grid_idx, threshold, {expr} AS score FROM gc")
    return " UNION ALL ".join(parts)


register("optimal_threshold", f"""WITH {base()}, {grid_cte('grid', 0.01, 0.99, 200)},{_grid_cells('grid')},
sc AS ({_opt_sql()}),
best AS (SELECT model, metric, threshold, score,
           row_number() OVER (PARTITION BY model, metric ORDER BY score DESC, grid_idx) AS rn FROM sc)
SELECT model, metric, {r6('CASE WHEN score > -1.0 THEN threshold ELSE 0.5 END', 'threshold')},
       {r6('CASE WHEN score > -1.0 THEN score ELSE -1.0 END', 'score')}
FROM best WHERE rn = 1""")(lambda spark, sf: rounded(C.optimal_thresholds(_preds(spark, sf))))


register("calibration_scores", f"""WITH {base()},
ece_bins AS (SELECT model, CAST(FLOOR(y_score * 15) AS INTEGER) AS b, y_score, y_true FROM preds),
edges AS (SELECT i, CASE WHEN i = 15 THEN 1.0 ELSE CAST(i AS DOUBLE) * (CAST(1.0 AS DOUBLE) / 15) END AS e
          FROM range(16) r(i)),
binned AS (SELECT p.model, p.y_score, p.y_true,
             (SELECT max(i) FROM edges WHERE e <= p.y_score) AS bin FROM preds p),
per_bin AS (SELECT model, bin, count(*) AS nb, avg(y_score) AS conf, avg(CAST(y_true AS DOUBLE)) AS acc
            FROM binned WHERE bin < 15 GROUP BY model, bin),
tot AS (SELECT model, count(*) AS n, avg(power(y_score - y_true, 2)) AS brier, avg(CAST(y_true AS DOUBLE)) AS pi
        FROM preds GROUP BY model),
gap AS (SELECT model, SUM(nb * abs(conf - acc)) AS g FROM per_bin GROUP BY model)
SELECT t.model, {r6('brier', 'brier_score')},
       {r6('CASE WHEN pi * (1 - pi) = 0 THEN 0.0 ELSE 1.0 - brier / (pi * (1 - pi)) END', 'brier_skill_score')},
       {r6('COALESCE(g / n, 0.0)', 'ece')}
FROM tot t LEFT JOIN gap ON t.model = gap.model""")(lambda spark, sf: rounded(M.brier_and_ece(_preds(spark, sf))))


register("reliability_table", f"""WITH {base()},
edges AS (SELECT i, CASE WHEN i = 10 THEN 1.0 ELSE CAST(i AS DOUBLE) * (CAST(1.0 AS DOUBLE) / 10) END AS e
          FROM range(11) r(i)),
binned AS (SELECT p.model, p.y_score, p.y_true,
             LEAST(GREATEST(COALESCE((SELECT max(i) + 1 FROM edges WHERE e <= p.y_score), 0) - 1, 0), 9) AS bin
           FROM preds p),
agg AS (SELECT model, bin, count(*) AS cnt, avg(y_score) AS mp, avg(CAST(y_true AS DOUBLE)) AS fp
        FROM binned GROUP BY model, bin),
spine AS (SELECT m.model, CAST(r.i AS INTEGER) AS bin FROM (SELECT DISTINCT model FROM preds) m, range(10) r(i))
SELECT s.model, s.bin,
       {r6('((SELECT e FROM edges WHERE i = s.bin) + (SELECT e FROM edges WHERE i = s.bin + 1)) / 2', 'bin_center')},
       {r6('COALESCE(mp, 0.0)', 'mean_predicted')}, {r6('COALESCE(fp, 0.0)', 'fraction_positive')},
       CAST(COALESCE(cnt, 0) AS BIGINT) AS count
FROM spine s LEFT JOIN agg a ON s.model = a.model AND s.bin = a.bin""")(
    lambda spark, sf: rounded(M.reliability_table(_preds(spark, sf))))


# ---------------------------------------------------------------- cost

COSTS = C.CostMatrix(cost_fn=50000.0, cost_fp=5000.0)
_COST_SQL = (f"(CAST(fn AS DOUBLE) * {COSTS.cost_fn} + CAST(fp AS DOUBLE) * {COSTS.cost_fp}"
             f" - CAST(tp AS DOUBLE) * {COSTS.cost_tp} - CAST(tn AS DOUBLE) * {COSTS.cost_tn})")

register("cost_curve", f"""WITH {base()}, {grid_cte('grid', 0.0, 1.0, 200)},{_grid_cells('grid')}
SELECT model, grid_idx, {r6('threshold', 'threshold')}, tp, fp, fn, tn, {r6(_COST_SQL, 'expected_cost')},
       {r6(f'{_COST_SQL} / GREATEST(CAST(tp + fn AS DOUBLE) * {COSTS.cost_fn}, 1.0)', 'normalised_cost')}
FROM gc""")(lambda spark, sf: rounded(C.cost_curve(_preds(spark, sf), COSTS)))


def _decision_cols(prefix: str) -> str:
    tot = f"(CAST(fp AS DOUBLE) * {COSTS.cost_fp} + CAST(fn AS DOUBLE) * {COSTS.cost_fn})"
    return ", ".join([
        r6("threshold", f"{prefix}_threshold"), f"tp AS {prefix}_tp", f"fp AS {prefix}_fp",
        f"fn AS {prefix}_fn", f"tn AS {prefix}_tn", r6(_ratio("tp", "tp + fp"), f"{prefix}_precision"),
        r6(_ratio("tp", "tp + fn"), f"{prefix}_recall"), r6(_ratio("2.0 * tp", "2.0 * tp + fp + fn"), f"{prefix}_f1"),
        r6(tot, f"{prefix}_total_cost"), r6(f"CAST(fn AS DOUBLE) * {COSTS.cost_fn}", f"{prefix}_cost_fn_contribution"),
        r6(f"CAST(fp AS DOUBLE) * {COSTS.cost_fp}", f"{prefix}_cost_fp_contribution"), f"{tot} AS {prefix}_raw"])


register("cost_comparison", f"""WITH {base()}, {grid_cte('g1', 0.01, 0.99, 200)}, {grid_cte('g2', 0.0, 1.0, 200)},
{_grid_cells('g1')},
c1 AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY {_ratio('2.0 * tp', '2.0 * tp + fp + fn')} DESC, grid_idx) AS rn FROM gc),
gcost AS (SELECT p.model, g.grid_idx, g.threshold,
          CAST(SUM(CASE WHEN p.y_true = 1 AND p.y_score >= g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS tp,
          CAST(SUM(CASE WHEN p.y_true = 0 AND p.y_score >= g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fp,
          CAST(SUM(CASE WHEN p.y_true = 1 AND p.y_score < g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fn,
          CAST(SUM(CASE WHEN p.y_true = 0 AND p.y_score < g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS tn
       FROM preds p, g2 g GROUP BY p.model, g.grid_idx, g.threshold),
c2 AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY {_COST_SQL}, grid_idx) AS rn FROM gcost),
a AS (SELECT model, {_decision_cols('f1')} FROM c1 WHERE rn = 1),
b AS (SELECT model, {_decision_cols('cost')} FROM c2 WHERE rn = 1)
SELECT a.* EXCLUDE (f1_raw), b.* EXCLUDE (model, cost_raw),
       {r6('f1_raw - cost_raw', 'cost_saving')},
       {r6('100.0 * (f1_raw - cost_raw) / GREATEST(f1_raw, 1.0)', 'cost_saving_pct')}
FROM a JOIN b ON a.model = b.model""")(lambda spark, sf: rounded(C.cost_threshold_comparison(_preds(spark, sf), COSTS)))

register("cost_optimal_threshold", f"""WITH {base()}, {grid_cte('grid', 0.0, 1.0, 200)},{_grid_cells('grid')},
c AS (SELECT model, threshold, {_COST_SQL} AS cost,
        row_number() OVER (PARTITION BY model ORDER BY {_COST_SQL}, grid_idx) AS rn FROM gc)
SELECT model, {r6('threshold', 'threshold')}, {r6('cost', 'min_cost')} FROM c WHERE rn = 1""")(
    lambda spark, sf: rounded(C.cost_optimal_threshold(C.cost_curve(_preds(spark, sf), COSTS))))

register("theoretical_threshold", f"""WITH {base()},
pv AS (SELECT model, avg(CAST(y_true AS DOUBLE)) AS prevalence FROM preds GROUP BY model)
SELECT model, {r6('prevalence', 'prevalence')},
  {r6(f'CASE WHEN prevalence > 0 AND prevalence < 1 THEN {COSTS.cost_fp} * prevalence / ({COSTS.cost_fp} * prevalence + {COSTS.cost_fn} * (1 - prevalence)) END', 'theoretical_threshold')},
  {r6(f'{COSTS.cost_fp} / ({COSTS.cost_fp} + {COSTS.cost_fn})', 'bayes_threshold')},
  CASE WHEN prevalence > 0 AND prevalence < 1 THEN 'ok' ELSE 'prevalence outside (0,1)' END AS status
FROM pv""")(lambda spark, sf: rounded(C.theoretical_threshold(_preds(spark, sf), COSTS)))


# ---------------------------------------------------------------- distributions

register("score_distribution", f"""WITH {base()}
SELECT model, y_true AS y_class, count(*) AS n, {r6('avg(y_score)', 'mean')}, {r6('stddev_pop(y_score)', 'std')},
       {r6('quantile_cont(y_score, 0.5)', 'median')}, {r6('quantile_cont(y_score, 0.25)', 'q25')},
       {r6('quantile_cont(y_score, 0.75)', 'q75')}
FROM preds GROUP BY model, y_true""")(lambda spark, sf: rounded(M.score_distribution(_preds(spark, sf))))


def _edge_cte(name: str, n_edges: int) -> str:
    return f"{name}(i, e) AS (VALUES {', '.join(f'({i}, CAST({v!r} AS DOUBLE))' for i, v in enumerate(__import__('numpy').linspace(0, 1, n_edges).tolist()))})"


register("class_separation", f"""WITH {base()}, {_edge_cte('edges', 51)},
binned AS (SELECT p.model, p.y_true,
             CASE WHEN p.y_score = 1.0 THEN 49 ELSE (SELECT max(i) FROM edges WHERE e <= p.y_score) END AS bin
           FROM preds p WHERE p.y_score >= 0 AND p.y_score <= 1),
cnt AS (SELECT model, bin, SUM(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS cp,
               SUM(CASE WHEN y_true = 0 THEN 1 ELSE 0 END) AS cn FROM binned GROUP BY model, bin),
inr AS (SELECT model, SUM(cp) AS ip, SUM(cn) AS inn FROM cnt GROUP BY model),
spine AS (SELECT m.model, r.i AS bin FROM (SELECT DISTINCT model FROM preds) m, range(50) r(i)),
dens AS (SELECT s.model, COALESCE(c.cp, 0) / (i.ip * 0.02) + 1e-10 AS dp,
                COALESCE(c.cn, 0) / (i.inn * 0.02) + 1e-10 AS dn, i.ip, i.inn
         FROM spine s LEFT JOIN cnt c ON s.model = c.model AND s.bin = c.bin JOIN inr i ON s.model = i.model),
norm AS (SELECT model, dp / SUM(dp) OVER (PARTITION BY model) AS p, dn / SUM(dn) OVER (PARTITION BY model) AS q,
                ip, inn FROM dens),
kl AS (SELECT model, CASE WHEN max(ip) > 0 AND max(inn) > 0 THEN SUM(p * ln(p / q)) END AS kl FROM norm GROUP BY model),
tot AS (SELECT model, count(*) FILTER (WHERE y_true = 1) AS n_positive, count(*) FILTER (WHERE y_true = 0) AS n_negative
        FROM preds GROUP BY model)
SELECT t.model, n_positive, n_negative,
       {r6('CAST(n_negative AS DOUBLE) / GREATEST(n_positive, 1)', 'class_imbalance_ratio')},
       {r6('kl', 'kl_divergence_pos_neg')}
FROM tot t LEFT JOIN kl ON t.model = kl.model""")(lambda spark, sf: rounded(M.class_separation(_preds(spark, sf))))

register("score_histogram", f"""WITH {base()}, {_edge_cte('edges', 40)},
binned AS (SELECT p.model, p.y_true AS y_class,
             CASE WHEN p.y_score = 1.0 THEN 38 ELSE (SELECT max(i) FROM edges WHERE e <= p.y_score) END AS bin
           FROM preds p WHERE p.y_score >= 0 AND p.y_score <= 1),
cnt AS (SELECT model, y_class, bin, count(*) AS c FROM binned GROUP BY ALL),
tot AS (SELECT model, y_class, SUM(c) AS t FROM cnt GROUP BY ALL),
spine AS (SELECT t.model, t.y_class, t.t, CAST(r.i AS INTEGER) AS bin FROM tot t, range(39) r(i))
SELECT s.model, s.y_class, s.bin, {r6('(SELECT e FROM edges WHERE i = s.bin)', 'bin_left')},
       CAST(COALESCE(c.c, 0) AS BIGINT) AS count,
       {r6('COALESCE(c.c, 0) / (s.t * ((SELECT e FROM edges WHERE i = 1) - (SELECT e FROM edges WHERE i = 0)))', 'density')}
FROM spine s LEFT JOIN cnt c ON s.model = c.model AND s.y_class = c.y_class AND s.bin = c.bin""")(
    lambda spark, sf: rounded(M.score_histogram(_preds(spark, sf))))


# ---------------------------------------------------------------- ranking

_Z975 = C.normal_quantile(0.975)

register("delong_ci", f"""WITH {base()},
dist AS (SELECT model, y_score AS s, SUM(y_true) AS pos, SUM(1 - y_true) AS neg FROM preds GROUP BY model, y_score),
cum AS (SELECT model, s, pos, neg,
          COALESCE(SUM(neg) OVER (PARTITION BY model ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
          COALESCE(SUM(pos) OVER (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_above,
          SUM(pos) OVER (PARTITION BY model) AS P, SUM(neg) OVER (PARTITION BY model) AS N FROM dist),
rowv AS (SELECT p.model, p.y_true, c.P, c.N,
           CASE WHEN p.y_true = 1 THEN (c.neg_below + 0.5 * c.neg) / c.N ELSE (c.pos_above + 0.5 * c.pos) / c.P END AS v
         FROM preds p JOIN cum c ON p.model = c.model AND p.y_score = c.s),
agg AS (SELECT model, max(P) AS P, max(N) AS N, avg(v) FILTER (WHERE y_true = 1) AS auc,
          COALESCE(var_samp(v) FILTER (WHERE y_true = 1), 0) AS s10, COALESCE(var_samp(v) FILTER (WHERE y_true = 0), 0) AS s01
        FROM rowv GROUP BY model),
fin AS (SELECT model, CASE WHEN P > 0 AND N > 0 THEN auc END AS auc,
          CASE WHEN P > 0 AND N > 0 THEN s10 / P + s01 / N END AS variance FROM agg)
SELECT model, {r6('auc', 'auc')}, {r6('variance', 'variance', 12)}, {r6('sqrt(GREATEST(variance, 0))', 'std_error')},
       {r6(f'GREATEST(0.0, auc - {_Z975!r} * sqrt(GREATEST(variance, 0)))', 'lower')},
       {r6(f'LEAST(1.0, auc + {_Z975!r} * sqrt(GREATEST(variance, 0)))', 'upper')},
       CASE WHEN auc IS NULL THEN 'single class' ELSE 'ok' END AS status
FROM fin""")(lambda spark, sf: rounded(C.delong(C.score_table(_preds(spark, sf))), variance=12))

_CUM_DESC = """cd AS (SELECT model, s, pos, neg,
    SUM(pos) OVER (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cpos,
    SUM(neg) OVER (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cneg,
    SUM(pos) OVER (PARTITION BY model) AS P, SUM(neg) OVER (PARTITION BY model) AS N
  FROM (SELECT model, y_score AS s, SUM(y_true) AS pos, SUM(1 - y_true) AS neg FROM preds GROUP BY model, y_score))"""

register("roc_curve", f"""WITH {base()}, {_CUM_DESC}
SELECT model, {r6('s', 'threshold')}, {r6(_ratio('cneg', 'N'), 'fpr')}, {r6(_ratio('cpos', 'P'), 'tpr')} FROM cd""")(
    lambda spark, sf: rounded(C.roc_curve(C.score_table(_preds(spark, sf)))))

register("pr_curve", f"""WITH {base()}, {_CUM_DESC}
SELECT model, {r6('s', 'threshold')}, {r6('CAST(cpos AS DOUBLE) / (cpos + cneg)', 'precision')},
       {r6(_ratio('cpos', 'P'), 'recall')} FROM cd
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM preds""")(
    lambda spark, sf: rounded(C.pr_curve(C.score_table(_preds(spark, sf)))))


# ---------------------------------------------------------------- errors & comparison

def _desc_sql(mask: str, name: str) -> str:
    v = f"CASE WHEN {mask} THEN y_score END"
    return ", ".join([f"count({v}) AS n_{name}"] + [
        r6(f"COALESCE({f}({v}), 0.0)", f"{name}_score_{n}") for n, f in
        (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))])


_CELL_MASKS = {c: f"(y_true = {y} AND y_score {op} CAST(0.5 AS DOUBLE))" for c, y, op in
               (("fp", 0, ">="), ("fn", 1, "<"), ("tp", 1, ">="), ("tn", 0, "<"))}

register("error_summary", f"""WITH {base()}
SELECT model, {', '.join(_desc_sql(m, c) for c, m in _CELL_MASKS.items())},
  {r6(f"CAST(count(*) FILTER (WHERE {_CELL_MASKS['fn']}) AS DOUBLE) / GREATEST(count(*) FILTER (WHERE y_true = 1), 1)", 'fn_rate_overall')},
  {r6(f"CAST(count(*) FILTER (WHERE {_CELL_MASKS['fp']}) AS DOUBLE) / GREATEST(count(*) FILTER (WHERE y_true = 0), 1)", 'fp_rate_overall')}
FROM preds GROUP BY model""")(lambda spark, sf: rounded(M.error_summary(_preds(spark, sf))))

register("comparison_table", f"""WITH {base()},
cells AS (SELECT model, {_CELLS} FROM preds GROUP BY model),{_RANK_SQL},
m AS (SELECT c.model, {_metric_sql()}, {r6('roc_auc', 'roc_auc')}, {r6('pr_auc', 'pr_auc')}
      FROM cells c JOIN rk ON c.model = rk.model)
SELECT model, f1, precision, recall, roc_auc, pr_auc, mcc,
       CAST(row_number() OVER (ORDER BY f1 DESC, model) AS INTEGER) AS rank FROM m""")(
    lambda spark, sf: rounded(M.comparison_table(M.classification_metrics(_preds(spark, sf)))))


# ---------------------------------------------------------------- segments

from ..operators import inference as I  # noqa: E402
from ..operators import segments as G  # noqa: E402


def _joined(spark, sf):
    lab = fx.labeled_readings(spark, sf)
    return G.join_metadata(fx.predictions(lab), fx.window_metadata(lab))


_JOINED = "joined AS (SELECT p.model, p.y_true, p.y_score, m.* EXCLUDE (machine_id, end_timestep), p.machine_id, p.end_timestep FROM preds p JOIN meta m ON p.machine_id = m.machine_id AND p.end_timestep = m.end_timestep)"


def _group_rate_cols():
    return f"""n_windows, n_positives, n_negatives, tp, fp, fn, tn,
  {r6(_ratio('fn', 'n_positives'), 'fn_rate')}, {r6(_ratio('fp', 'n_negatives'), 'fp_rate')},
  {r6(_ratio('tp', 'tp + fp'), 'precision')}, {r6(_ratio('tp', 'tp + fn'), 'recall')},
  {r6(f"CASE WHEN {_ratio('tp', 'tp + fp')} + {_ratio('tp', 'tp + fn')} > 0 THEN 2 * {_ratio('tp', 'tp + fp')} * {_ratio('tp', 'tp + fn')} / ({_ratio('tp', 'tp + fp')} + {_ratio('tp', 'tp + fn')}) ELSE 0.0 END", 'f1')}"""


_GROUP_AGG = """count(*) AS n_windows, count(*) FILTER (WHERE y_true = 1) AS n_positives,
  count(*) FILTER (WHERE y_true = 0) AS n_negatives,
  count(*) FILTER (WHERE y_true = 1 AND y_score >= CAST(0.5 AS DOUBLE)) AS tp,
  count(*) FILTER (WHERE y_true = 0 AND y_score >= CAST(0.5 AS DOUBLE)) AS fp,
  count(*) FILTER (WHERE y_true = 1 AND y_score < CAST(0.5 AS DOUBLE)) AS fn,
  count(*) FILTER (WHERE y_true = 0 AND y_score < CAST(0.5 AS DOUBLE)) AS tn"""

_BY_GROUP = f"""{_JOINED},
bg AS (SELECT model, 'machine_type' AS group_by, machine_type AS group_value, {_GROUP_AGG} FROM joined GROUP BY model, machine_type
       UNION ALL
       SELECT model, 'degradation_stage', degradation_stage, {_GROUP_AGG} FROM joined GROUP BY model, degradation_stage),
bgr AS (SELECT model, group_by, group_value, {_group_rate_cols()} FROM bg)"""

register("error_by_group", f"""WITH {base()}, {_BY_GROUP}
SELECT * FROM bgr""")(lambda spark, sf: rounded(G.error_by_group(_joined(spark, sf))))

register("error_by_proximity", f"""WITH {base()}, {_JOINED},
b AS (SELECT model, y_true, y_score,
        CASE WHEN timesteps_to_failure IS NULL THEN 7 WHEN timesteps_to_failure < 5 THEN 0
             WHEN timesteps_to_failure < 10 THEN 1 WHEN timesteps_to_failure < 20 THEN 2
             WHEN timesteps_to_failure < 30 THEN 3 WHEN timesteps_to_failure < 60 THEN 4
             WHEN timesteps_to_failure < 100 THEN 5 ELSE 6 END AS bucket_order FROM joined),
lab(bucket_order, bucket) AS (VALUES (0, '0–4'), (1, '5–9'), (2, '10–19'), (3, '20–29'), (4, '30–59'),
                                     (5, '60–99'), (6, '≥100'), (7, 'no failure in window'))
SELECT model, CAST(b.bucket_order AS INTEGER) AS bucket_order, bucket, count(*) AS n_windows,
       count(*) FILTER (WHERE y_true = 1) AS n_positives,
       {r6(_ratio('count(*) FILTER (WHERE y_true = 1 AND y_score < CAST(0.5 AS DOUBLE))', 'count(*) FILTER (WHERE y_true = 1)'), 'fn_rate')},
       {r6(_ratio('count(*) FILTER (WHERE y_true = 0 AND y_score >= CAST(0.5 AS DOUBLE))', 'count(*) FILTER (WHERE y_true = 0)'), 'fp_rate')}
FROM b JOIN lab ON b.bucket_order = lab.bucket_order GROUP BY model, b.bucket_order, bucket""")(
    lambda spark, sf: rounded(G.error_by_proximity(_joined(spark, sf))))

register("worst_groups", f"""WITH {base()}, {_BY_GROUP},
l AS (SELECT model, group_by, group_value, 'fn_rate' AS metric, fn_rate AS value FROM bgr
      UNION ALL SELECT model, group_by, group_value, 'fp_rate', fp_rate FROM bgr),
r AS (SELECT *, row_number() OVER (PARTITION BY model, group_by, metric ORDER BY value DESC, group_value) AS rn FROM l)
SELECT model, group_by, metric, group_value, value FROM r WHERE rn = 1""")(
    lambda spark, sf: rounded(G.worst_groups(rounded(G.error_by_group(_joined(spark, sf))))))

register("best_model", f"""WITH {base()},
cells AS (SELECT model, {_CELLS} FROM preds GROUP BY model),
m AS (SELECT model, {r6(_ratio('2.0 * tp', '2.0 * tp + fp + fn'), 'f1')} FROM cells)
SELECT 'f1' AS metric, model, f1 AS value FROM m ORDER BY f1 DESC, model LIMIT 1""")(
    lambda spark, sf: rounded(G.best_model(rounded(M.classification_metrics(_preds(spark, sf))))))


# ---------------------------------------------------------------- inference

def _reading(p: str) -> str:
    return f"CASE WHEN {p} < 0.01 THEN '{I.HIGHLY}' WHEN {p} < 0.05 THEN '{I.SIGNIFICANT}' ELSE '{I.NONE}' END"


_PAIRS = """wide AS (SELECT machine_id, end_timestep, max(y_true) AS y,
    max(CASE WHEN model = 'a' THEN y_score END) AS sa, max(CASE WHEN model = 'b' THEN y_score END) AS sb,
    max(CASE WHEN model = 'c' THEN y_score END) AS sc FROM preds GROUP BY machine_id, end_timestep),
ok AS (SELECT (CAST(sa >= 0.5 AS INTEGER) = y) AS oa, (CAST(sb >= 0.5 AS INTEGER) = y) AS ob,
              (CAST(sc >= 0.5 AS INTEGER) = y) AS oc FROM wide),
pairs AS (
  SELECT 'a' AS model_a, 'b' AS model_b, count(*) FILTER (WHERE oa AND NOT ob) AS b, count(*) FILTER (WHERE NOT oa AND ob) AS c FROM ok
  UNION ALL SELECT 'a', 'c', count(*) FILTER (WHERE oa AND NOT oc), count(*) FILTER (WHERE NOT oa AND oc) FROM ok
  UNION ALL SELECT 'b', 'c', count(*) FILTER (WHERE ob AND NOT oc), count(*) FILTER (WHERE NOT ob AND oc) FROM ok),
mc AS (SELECT model_a, model_b, b, c,
         CASE WHEN b + c > 0 THEN power(abs(b - c) - 1.0, 2) / (b + c) ELSE 0.0 END AS statistic FROM pairs),
mcp AS (SELECT *, CASE WHEN b + c > 0 THEN """ + chi2_sf_sql("statistic") + """ ELSE 1.0 END AS p_value FROM mc),
mci AS (SELECT *, CASE WHEN b + c = 0 THEN '""" + I.AGREE + """' ELSE """ + _reading('p_value') + """ END AS interpretation FROM mcp)"""

register("mcnemar", f"""WITH {base()}, {_PAIRS}
SELECT model_a, model_b, b, c, {r6('statistic', 'statistic')}, {r6('p_value', 'p_value')}, interpretation FROM mci""")(
    lambda spark, sf: rounded(I.mcnemar(_preds(spark, sf))))

_DL = SQL["delong_ci"].split("\nSELECT model, ")[0]

register("model_comparison", f"""{_DL},
dl AS (SELECT model, {r6('auc', 'auc')}, {r6(f'GREATEST(0.0, auc - {_Z975!r} * sqrt(GREATEST(variance, 0)))', 'lower')},
       {r6(f'LEAST(1.0, auc + {_Z975!r} * sqrt(GREATEST(variance, 0)))', 'upper')} FROM fin), {_PAIRS}
SELECT m.model_a, m.model_b, m.b, m.c, {r6('m.statistic', 'statistic')}, {r6('m.p_value', 'p_value')}, m.interpretation,
       x.auc AS auc_a, x.lower AS auc_a_lower, x.upper AS auc_a_upper,
       y.auc AS auc_b, y.lower AS auc_b_lower, y.upper AS auc_b_upper
FROM mci m JOIN dl x ON m.model_a = x.model JOIN dl y ON m.model_b = y.model""")(
    lambda spark, sf: rounded(I.compare_models(_preds(spark, sf))))

# Resampling. The draws are repeated in SQL: a and b are two halves of
# the key's md5, replicate r starts at a + r*b and is squared twice.

def _draws(key: str, n: int, cols: str, src: str) -> str:
    h = f"md5({key})"
    a, b = (f"CAST('0x' || substr({h}, {i}, 8) AS BIGINT) % 2147483647" for i in (1, 9))
    return f"""ab AS (SELECT {cols}, {a} AS a, {b} AS b FROM {src}),
x1 AS (SELECT * EXCLUDE (r), r.r AS rep, (a + r.r * b) % 2147483647 AS x FROM ab, range(1, {n + 1}) r(r)),
x2 AS (SELECT * REPLACE ((x * x + a) % 2147483647 AS x) FROM x1),
dr AS (SELECT * EXCLUDE (x, a, b), ((x * x + b) % 2147483647) / 2147483647.0::DOUBLE AS u FROM x2)"""


def _rank_by_rep(keys: str) -> str:
    """roc_auc and pr_auc per group from weighted distinct scores ``ds``."""
    return f"""dc AS (SELECT *, SUM(pos) OVER w AS cp, SUM(neg) OVER w AS cn, SUM(pos) OVER g AS P, SUM(neg) OVER g AS N FROM ds
    WINDOW w AS (PARTITION BY {keys} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), g AS (PARTITION BY {keys})),
rk AS (SELECT {keys}, max(P) AS P, max(N) AS N,
    CASE WHEN max(P) > 0 AND max(N) > 0 THEN SUM(CAST(neg AS DOUBLE) * (2 * cp - pos)) / (2.0 * max(P) * max(N)) END AS roc_auc,
    CASE WHEN max(P) > 0 THEN SUM(CASE WHEN cp + cn > 0 THEN CAST(pos AS DOUBLE) * cp / (cp + cn) ELSE 0 END) / max(P) END AS pr_auc
    FROM dc GROUP BY {keys})"""


N_BOOT, N_PERM = 500, 1000
_CDF1 = P_.poisson_cdf(1.0)

register("bootstrap_ci", f"""WITH {base()},
{_draws("model || '-' || machine_id || '-' || end_timestep || '-42'", N_BOOT, 'model, y_true, y_score AS s', 'preds')},
wt AS (SELECT model, rep, y_true, s, {' + '.join(f'CAST(u >= {c!r} AS INTEGER)' for c in _CDF1)} AS w FROM dr),
ds AS (SELECT model, rep, s, SUM(w * y_true) AS pos, SUM(w * (1 - y_true)) AS neg FROM wt GROUP BY ALL),
{_rank_by_rep('model, rep')},
cells AS (SELECT model, rep, SUM(CASE WHEN s >= 0.5 THEN pos ELSE 0 END) AS tp, SUM(CASE WHEN s >= 0.5 THEN neg ELSE 0 END) AS fp,
    SUM(CASE WHEN s < 0.5 THEN pos ELSE 0 END) AS fn, SUM(CASE WHEN s < 0.5 THEN neg ELSE 0 END) AS tn FROM ds GROUP BY ALL),
pm AS (SELECT c.model, c.rep, {_metric_sql(15)}, rk.roc_auc, rk.pr_auc FROM cells c JOIN rk ON c.model = rk.model AND c.rep = rk.rep
       WHERE rk.P > 0 AND rk.N > 0),
lg AS (UNPIVOT pm ON {', '.join(I.REPLICATE_METRICS)} INTO NAME metric VALUE value)
SELECT model, metric, {r6('avg(value)', 'mean')}, {r6('stddev_pop(value)', 'std')}, {r6('quantile_cont(value, 0.025)', 'lower')},
       {r6('quantile_cont(value, 0.975)', 'upper')}, count(*) AS n_replicates FROM lg GROUP BY model, metric""")(
    lambda spark, sf: rounded(I.bootstrap_ci(_preds(spark, sf), n_samples=N_BOOT, by="rows")))
register("bootstrap_ci_rows", SQL["bootstrap_ci"])(SPARK["bootstrap_ci"])
_BOOT_TAIL = SQL["bootstrap_ci"][SQL["bootstrap_ci"].index("ds AS (SELECT model, rep, s,"):]


def _bits(score: str) -> str:
    return f"CAST(floor({score} * 4503599627370496) AS BIGINT)"


def _cdf_sql(kind: str, src: str) -> str:
    """cdf(c, k, p): P(X <= k) of Poisson(c) or Binomial(c, 1/2) for the counts c in ``src``."""
    mean, sd = ("c", "sqrt(c)") if kind == "poisson" else ("c / 2.0", "sqrt(c) / 2.0")
    last = "CAST(c + 12 * sqrt(c) + 20 AS BIGINT)" if kind == "poisson" else f"LEAST(c, CAST({mean} + 12 * {sd} + 20 AS BIGINT))"
    log_p = "-c + k * ln(c) - lgamma(k + 1.0)" if kind == "poisson" else "lgamma(c + 1.0) - lgamma(k + 1.0) - lgamma(c - k + 1.0) - c * ln(2.0)"
    return f"""kk AS (SELECT c, unnest(range(GREATEST(0, CAST({mean} - 12 * {sd} - 20 AS BIGINT)), {last} + 1)) AS k FROM (SELECT DISTINCT n AS c FROM {src})),
cdf AS (SELECT c, k, sum(exp({log_p})) OVER (PARTITION BY c ORDER BY k) AS p FROM kk),
c0 AS (SELECT c, min(k) AS k0, max(k) AS k1 FROM kk GROUP BY c)"""


# one draw for all windows of equal score and label
register("bootstrap_ci_scores", f"""WITH {base()},
cl AS (SELECT model, y_true, y_score AS s, count(*) AS n FROM preds GROUP BY ALL),
{_cdf_sql('poisson', 'cl')},
{_draws("model || '-' || " + _bits('s') + " || '-' || y_true || '-42'", N_BOOT, 'model, y_true, s, n', 'cl')},
wt AS (SELECT dr.model, dr.rep, dr.y_true, dr.s, coalesce(cdf.k + 1, c0.k0) AS w
       FROM dr JOIN c0 ON c0.c = dr.n ASOF LEFT JOIN cdf ON cdf.c = dr.n AND cdf.p <= dr.u),
{_BOOT_TAIL}""")(lambda spark, sf: rounded(I.bootstrap_ci(_preds(spark, sf), n_samples=N_BOOT)))


def _perm_rows_sql(pairs: list[tuple[str, str]]) -> str:
    """CTEs up to ``pt``: one row per pair with the permutation result, a draw a window."""
    long = " UNION ALL ".join(
        f"SELECT '{a}' AS model_a, '{b}' AS model_b, machine_id, end_timestep, y_true, model = '{b}' AS other, y_score AS s FROM preds WHERE model IN ('{a}', '{b}')"
        for a, b in pairs)
    return f"""pl AS ({long}),
{_draws("machine_id || '-' || end_timestep || '-42'", N_PERM, 'model_a, model_b, y_true, other, s', 'pl')},
sd AS (SELECT model_a, model_b, rep, y_true, s, CAST((u < 0.5) <> other AS INTEGER) AS side FROM dr
       UNION ALL SELECT model_a, model_b, 0, y_true, s, CAST(other AS INTEGER) FROM pl),
ds AS (SELECT model_a, model_b, rep, side, s, SUM(y_true) AS pos, SUM(1 - y_true) AS neg FROM sd GROUP BY ALL),
{_rank_by_rep('model_a, model_b, rep, side')},
dd AS (SELECT model_a, model_b, rep, max(CASE WHEN side = 0 THEN roc_auc END) AS metric_a, max(CASE WHEN side = 1 THEN roc_auc END) AS metric_b
       FROM rk GROUP BY ALL),
ob AS (SELECT model_a, model_b, metric_a, metric_b, abs(metric_a - metric_b) AS observed_diff FROM dd WHERE rep = 0),
pt AS (SELECT ob.model_a, ob.model_b, ob.metric_a, ob.metric_b, ob.observed_diff,
              avg(CASE WHEN abs(dd.metric_a - dd.metric_b) >= ob.observed_diff - 1e-12 THEN 1.0 ELSE 0.0 END) AS p_value
       FROM ob JOIN dd ON dd.model_a = ob.model_a AND dd.model_b = ob.model_b WHERE dd.rep > 0 GROUP BY ALL)"""


def _perm_sql(pairs: list[tuple[str, str]]) -> str:
    """The same with one draw for all windows of equal scores and label."""
    long = " UNION ALL ".join(
        f"SELECT '{a}' AS model_a, '{b}' AS model_b, p.y_true, p.y_score AS sa, q.y_score AS sb, count(*) AS n FROM preds p JOIN preds q "
        f"ON q.machine_id = p.machine_id AND q.end_timestep = p.end_timestep WHERE p.model = '{a}' AND q.model = '{b}' GROUP BY ALL" for a, b in pairs)
    key = f"{_bits('sa')} || '-' || {_bits('sb')} || '-' || y_true || '-42'"
    tail = _perm_rows_sql(pairs)
    return f"""cl AS ({long}),
{_cdf_sql('swap', 'cl')},
{_draws(key, N_PERM, 'model_a, model_b, y_true, sa, sb, n', 'cl')},
mv AS (SELECT dr.* EXCLUDE (u), dr.n - LEAST(coalesce(cdf.k + 1, c0.k0), c0.k1) AS moved
       FROM dr JOIN c0 ON c0.c = dr.n ASOF LEFT JOIN cdf ON cdf.c = dr.n AND cdf.p <= dr.u
       UNION ALL SELECT model_a, model_b, y_true, sa, sb, n, 0 AS rep, 0 AS moved FROM cl),
sd AS (SELECT model_a, model_b, rep, y_true, sa AS s, 0 AS side, n - moved AS w FROM mv UNION ALL SELECT model_a, model_b, rep, y_true, sa, 1, moved FROM mv
       UNION ALL SELECT model_a, model_b, rep, y_true, sb, 1, n - moved FROM mv UNION ALL SELECT model_a, model_b, rep, y_true, sb, 0, moved FROM mv),
ds AS (SELECT model_a, model_b, rep, side, s, SUM(w * y_true) AS pos, SUM(w * (1 - y_true)) AS neg FROM sd GROUP BY ALL),
{tail[tail.index("dc AS (SELECT *"):]}"""


_PERM_OUT = f"""SELECT model_a, model_b, 'roc_auc' AS metric, {r6('metric_a', 'metric_a')}, {r6('metric_b', 'metric_b')},
       {r6('observed_diff', 'observed_diff')}, {r6('p_value', 'p_value')}, {N_PERM} AS n_permutations, {_reading('p_value')} AS interpretation FROM pt"""
register("permutation_test_rows", f"""WITH {base()}, {_perm_rows_sql([('a', 'b')])}
{_PERM_OUT}""")(lambda spark, sf: rounded(I.permutation_test(_preds(spark, sf), "a", "b", n_permutations=N_PERM, by="rows")))
register("permutation_test", f"""WITH {base()}, {_perm_sql([('a', 'b')])}
{_PERM_OUT}""")(lambda spark, sf: rounded(I.permutation_test(_preds(spark, sf), "a", "b", n_permutations=N_PERM)))


# ---------------------------------------------------------------- readings

from ..operators import quality as Q  # noqa: E402
from ..operators import drift as D  # noqa: E402
from ..operators import readings_ops as R  # noqa: E402
from ..sources.tables import SENSORS, machine_ids, read_table  # noqa: E402

register("dataset_summary", f"""WITH {base()}
SELECT count(DISTINCT machine_id) AS engines, count(*) AS n_rows,
       {r6('(SELECT avg(mt) FROM (SELECT max(timestep) AS mt FROM labeled GROUP BY machine_id))', 'avg_life')},
       max(rul) AS max_rul, {r6('avg(CAST(failure_imminent AS DOUBLE))', 'positive_rate')}
FROM labeled""")(lambda spark, sf: rounded(R.dataset_summary(fx.labeled_readings(spark, sf))))

register("machine_types", f"""WITH {base()}
SELECT machine_type, count(DISTINCT machine_id) AS n_machines, count(*) AS n_rows FROM labeled GROUP BY machine_type""")(
    lambda spark, sf: R.machine_type_distribution(fx.labeled_readings(spark, sf)))

register("near_constant_sensors", f"""WITH {base()},
l AS (SELECT 'quantity' AS sensor, quantity AS v FROM readings UNION ALL SELECT 'price', price FROM readings
      UNION ALL SELECT 'discount', discount FROM readings UNION ALL SELECT 'tax', tax FROM readings)
SELECT sensor, {r6('stddev_pop(v)', 'std')}, {r6('min(v)', 'min')}, {r6('max(v)', 'max')},
       stddev_pop(v) <= 1e-06 AS near_constant FROM l GROUP BY sensor""")(
    lambda spark, sf: rounded(R.near_constant_sensors(fx.labeled_readings(spark, sf), SENSORS)))


# ---------------------------------------------------------------- quality

_DMG = """dmg AS (SELECT machine_id, timestep, l_orderkey, l_linenumber,
    CASE WHEN l_orderkey % 10 = 1 THEN NULL ELSE quantity END AS quantity,
    CASE WHEN l_orderkey % 20 = 5 THEN -100.0 ELSE price END AS price,
    CASE WHEN l_orderkey % 50 = 7 THEN CAST('NaN' AS DOUBLE) ELSE discount END AS discount, tax,
    CASE WHEN l_orderkey % 97 = 3 THEN 2 ELSE failure_imminent END AS failure_imminent FROM labeled)"""


def _quality_sql():
    parts = []
    for c in SENSORS:
        k = f"count(*) FILTER (WHERE {c} IS NULL OR isnan({c}))"
        frac = f"CAST({k} AS DOUBLE) / count(*)"
        parts.append(f"SELECT 'nan' AS \"check\", '{c}' AS \"column\", CASE WHEN {frac} > 0.05 THEN 'error' WHEN {k} > 0 THEN 'warning' ELSE 'ok' END AS severity, CAST({k} AS BIGINT) AS n_bad, {r6(frac, 'fraction')} FROM dmg")
    for c, (lo, hi) in Q.READINGS_SCHEMA.value_ranges.items():
        valid = f"NOT ({c} IS NULL OR isnan({c}))"
        k = f"count(*) FILTER (WHERE {valid} AND ({c} < {lo!r} OR {c} > {hi!r}))"
        v = f"count(*) FILTER (WHERE {valid})"
        frac = f"(CASE WHEN {v} > 0 THEN CAST({k} AS DOUBLE) / {v} ELSE 0.0 END)"
        parts.append(f"SELECT 'range', '{c}', CASE WHEN {frac} > 0.01 THEN 'error' WHEN {k} > 0 THEN 'warning' ELSE 'ok' END, CAST({k} AS BIGINT), {r6(frac, 'fraction')} FROM dmg")
    k = "count(DISTINCT CASE WHEN failure_imminent NOT IN (0, 1) THEN failure_imminent END)"
    parts.append(f"SELECT 'target_binary', 'failure_imminent', CASE WHEN {k} > 0 THEN 'error' ELSE 'ok' END, CAST({k} AS BIGINT), CAST(NULL AS DOUBLE) FROM dmg")
    parts.append("""SELECT 'monotone_timestep', 'timestep', CASE WHEN count(DISTINCT machine_id) > 0 THEN 'warning' ELSE 'ok' END,
        CAST(count(DISTINCT machine_id) AS BIGINT), CAST(NULL AS DOUBLE)
      FROM (SELECT machine_id, timestep, lag(timestep) OVER (PARTITION BY machine_id ORDER BY l_orderkey, l_linenumber) AS pt FROM dmg)
      WHERE timestep < pt""")
    return "\nUNION ALL ".join(parts)


register("quality_report", f"""WITH {base()}, {_DMG}
{_quality_sql()}""")(lambda spark, sf: rounded(Q.validate(
    fx.damaged_readings(spark, sf), Q.READINGS_SCHEMA, ingest_cols=["l_orderkey", "l_linenumber"])))


def _route_sql():
    conds = []
    for c, (lo, hi) in Q.READINGS_SCHEMA.value_ranges.items():
        conds.append(f"WHEN {c} IS NULL OR isnan({c}) THEN 'missing:{c}'")
        conds.append(f"WHEN {c} < {lo!r} OR {c} > {hi!r} THEN 'range:{c}'")
    return "CASE " + " ".join(conds) + " END"


register("row_routing", f"""WITH {base()}, {_DMG}
SELECT {_route_sql()} AS reject_reason, count(*) AS n_rows FROM dmg GROUP BY 1""")(
    lambda spark, sf: Q.route_rows(fx.damaged_readings(spark, sf), Q.READINGS_SCHEMA.value_ranges)
    .groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n_rows")))

register("prepare_guard", f"""WITH {base()}
SELECT count(*) AS n_rows, CAST({' + '.join(f'count(*) FILTER (WHERE {c} IS NULL OR isnan({c}))' for c in SENSORS)} AS BIGINT) AS n_missing
FROM labeled""")(lambda spark, sf: Q.require_clean(fx.labeled_readings(spark, sf), SENSORS, "failure_imminent"))


# ---------------------------------------------------------------- drift

def _drift_sql(src: str, cond_ref: str, cond_cur: str, sensors: list[str]) -> str:
    longs = " UNION ALL ".join(
        f"SELECT '{c}' AS sensor, CAST({c} AS DOUBLE) AS value, CASE WHEN {cond_ref} THEN 'ref' WHEN {cond_cur} THEN 'cur' END AS side FROM {src}"
        for c in sensors)
    return f"""lv AS (SELECT * FROM ({longs}) WHERE side IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
rng AS (SELECT sensor, min(value) AS lo, max(value) AS hi FROM lv GROUP BY sensor),
edges AS (SELECT sensor, i, CASE WHEN i = 10 THEN hi ELSE CAST(i AS DOUBLE) * ((hi - lo) / 10.0) + lo END AS e
          FROM rng, range(11) r(i)),
binned AS (SELECT l.sensor, l.side, CASE WHEN l.value = r.hi THEN 9
             ELSE (SELECT max(i) FROM edges e WHERE e.sensor = l.sensor AND e.e <= l.value) END AS bin
           FROM lv l JOIN rng r ON l.sensor = r.sensor),
cnt AS (SELECT sensor, bin, count(*) FILTER (WHERE side = 'ref') AS hr, count(*) FILTER (WHERE side = 'cur') AS hc
        FROM binned GROUP BY sensor, bin),
st AS (SELECT sensor, count(*) FILTER (WHERE side = 'ref') AS n_ref, count(*) FILTER (WHERE side = 'cur') AS n_cur,
          avg(value) FILTER (WHERE side = 'ref') AS reference_mean, avg(value) FILTER (WHERE side = 'cur') AS current_mean,
          stddev_pop(value) FILTER (WHERE side = 'ref') AS reference_std, stddev_pop(value) FILTER (WHERE side = 'cur') AS current_std
       FROM lv GROUP BY sensor),
sp AS (SELECT r.sensor, r.lo, r.hi, CAST(x.i AS INTEGER) AS bin FROM rng r, range(10) x(i)),
fr AS (SELECT sp.sensor, sp.lo, sp.hi, (COALESCE(c.hr, 0) + 1e-06) / (st.n_ref + 1e-06 * 10) AS rf,
              (COALESCE(c.hc, 0) + 1e-06) / (st.n_cur + 1e-06 * 10) AS cf
       FROM sp LEFT JOIN cnt c ON sp.sensor = c.sensor AND sp.bin = c.bin JOIN st ON sp.sensor = st.sensor),
ps AS (SELECT sensor, CASE WHEN max(lo) = max(hi) THEN 0.0 ELSE SUM((cf - rf) * ln(cf / rf)) END AS psi FROM fr GROUP BY sensor)
SELECT ps.sensor, {r6('psi', 'psi')},
       CASE WHEN psi > 0.25 THEN 'CRITICAL' WHEN psi > 0.1 THEN 'WARNING' ELSE 'OK' END AS status,
       {r6('reference_mean', 'reference_mean')}, {r6('current_mean', 'current_mean')},
       {r6('reference_std', 'reference_std')}, {r6('current_std', 'current_std')}
FROM ps JOIN st ON ps.sensor = st.sensor"""


register("drift_readings", f"""WITH {base()}, {_drift_sql('readings', "l_shipdate < TIMESTAMP '1998-01-01 00:00:00'", "l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'", SENSORS)}""")(
    lambda spark, sf: rounded(R.drift_by_cutoff(fx.labeled_readings(spark, sf), "l_shipdate", "1998-01-01", SENSORS)))

register("drift_events", f"""WITH {_drift_sql('events', "ts < TIMESTAMP '2024-01-16 00:00:00'", "ts >= TIMESTAMP '2024-01-16 00:00:00'", ['value'])}""")(
    lambda spark, sf: rounded(R.drift_by_cutoff(read_table(spark, sf, "events"), "ts", "2024-01-16", ["value"])))


# ---------------------------------------------------------------- preparation

from ..operators import labels as L  # noqa: E402
from ..operators import prepare as P  # noqa: E402
from ..sources.tables import event_readings  # noqa: E402

_SPLIT = """ids AS (SELECT DISTINCT machine_id FROM readings),
rk AS (SELECT machine_id, row_number() OVER (ORDER BY md5(CAST(machine_id AS VARCHAR) || '-42'), machine_id) - 1 AS r,
              count(*) OVER () AS n FROM ids),
nt AS (SELECT max(n) AS n, GREATEST(1, CAST(FLOOR(max(n) * CAST(0.2 AS DOUBLE)) AS BIGINT)) AS n_test FROM rk),
nv AS (SELECT n, n_test, GREATEST(1, CAST(FLOOR((n - n_test) * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS n_val FROM nt),
splits AS (SELECT machine_id, CASE WHEN r < n_test THEN 'test' WHEN r < n_test + n_val THEN 'val' ELSE 'train' END AS split
           FROM rk, nv)"""


def _splits(spark, sf):
    return P.split_machines(machine_ids(spark, sf))


register("machine_split", f"""WITH {base()}, {_SPLIT}
SELECT machine_id, split FROM splits""")(lambda spark, sf: _splits(spark, sf))

register("split_overlap", f"""WITH {base()}, {_SPLIT}
SELECT a.machine_id, a.split AS split_a, b.split AS split_b FROM splits a JOIN splits b
  ON a.machine_id = b.machine_id AND a.split < b.split""")(lambda spark, sf: P.split_overlap(_splits(spark, sf)))


def _train(spark, sf):
    return fx.labeled_readings(spark, sf).where(F.col("split") == "train")


def _scaler_sql():
    parts = []
    for c in SENSORS:
        parts.append(f"SELECT 'standard' AS kind, '{c}' AS sensor, avg({c}) AS center, stddev_pop({c}) AS scale FROM tr")
        parts.append(f"SELECT 'minmax', '{c}', min({c}), max({c}) - min({c}) FROM tr")
        parts.append(f"SELECT 'robust', '{c}', quantile_cont({c}, 0.5), quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM tr")
    return " UNION ALL ".join(parts)


register("scaler_params", f"""WITH {base()}, {_SPLIT},
tr AS (SELECT l.* FROM labeled l JOIN splits s ON l.machine_id = s.machine_id WHERE s.split = 'train'),
p AS ({_scaler_sql()})
SELECT kind, sensor, {r6('COALESCE(center, 0.0)', 'center')},
       {r6('CASE WHEN scale IS NULL OR scale = 0 THEN 1.0 ELSE scale END', 'scale')} FROM p""")(
    lambda spark, sf: rounded(P.scaler_table(_train(spark, sf), SENSORS, P.SCALERS)))


def _scaled_test(spark, sf):
    lab = fx.labeled_readings(spark, sf)
    scaler = P.fit_scaler(lab.where(F.col("split") == "train"), SENSORS, "standard")
    out = P.apply_scaler(lab.where(F.col("split") == "test"), scaler)
    return rounded(out.select("machine_id", "timestep", *SENSORS))


register("scaled_test_readings", f"""WITH {base()}, {_SPLIT},
j AS MATERIALIZED (SELECT l.machine_id, l.timestep, {', '.join('l.' + c for c in SENSORS)}, s.split FROM labeled l JOIN splits s ON l.machine_id = s.machine_id),
pr AS (SELECT {', '.join(f'avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}' for c in SENSORS)}
       FROM j WHERE split = 'train')
SELECT machine_id, timestep, {', '.join(r6(f'({c} - m_{c}) / s_{c}', c) for c in SENSORS)}
FROM j, pr WHERE split = 'test'""")(_scaled_test)


def _window_checks(spark, sf):
    lab = fx.labeled_readings(spark, sf)
    w = P.sliding_windows(lab, SENSORS, 50, 10)
    nf = len(SENSORS)
    qty = F.aggregate(F.sequence(F.lit(0), F.lit(49)), F.lit(0.0),
                      lambda acc, t: acc + F.element_at("features", t * nf + 1) * (t + 1).cast("double"))
    return rounded(w.select("machine_id", "end_timestep", "label", F.size("features").alias("n_values"),
                            F.element_at("features", 1).alias("first_value"),
                            F.element_at("features", -1).alias("last_value"), qty.alias("qty_weighted")))


register("window_features", f"""WITH {base()}
SELECT e.machine_id, e.timestep AS end_timestep, e.failure_imminent AS label, CAST(count(*) * 4 AS INTEGER) AS n_values,
       {r6('arg_min(l.quantity, l.timestep)', 'first_value')}, {r6('max(e.tax)', 'last_value')},
       {r6('SUM(l.quantity * (l.timestep - (e.timestep - 49) + 1))', 'qty_weighted')}
FROM ends e JOIN labeled l ON l.machine_id = e.machine_id AND l.timestep BETWEEN e.timestep - 49 AND e.timestep
GROUP BY e.machine_id, e.timestep, e.failure_imminent""")(_window_checks)


def _split_stats(spark, sf):
    lab = fx.labeled_readings(spark, sf)
    w = P.window_end_rows(lab, 50, 10).select("machine_id", "split", F.col("failure_imminent").alias("label"))
    st = P.split_stats(w)
    pw = w.groupBy("split").agg(F.sum("label").alias("n_positive"),
                                F.when(F.sum("label") > 0, (F.count(F.lit(1)) - F.sum("label")) / F.sum("label"))
                                .otherwise(F.lit(1.0)).alias("pos_weight"))
    return rounded(st.join(pw, "split"))


register("split_window_stats", f"""WITH {base()}, {_SPLIT},
w AS (SELECT s.split, e.failure_imminent AS label FROM ends e JOIN splits s ON e.machine_id = s.machine_id)
SELECT split, count(*) AS n_windows, {r6('avg(CAST(label AS DOUBLE))', 'pos_rate')}, CAST(sum(label) AS BIGINT) AS n_positive,
       {r6('CASE WHEN sum(label) > 0 THEN CAST(count(*) - sum(label) AS DOUBLE) / sum(label) ELSE 1.0 END', 'pos_weight')}
FROM w GROUP BY split""")(_split_stats)


def _study_sql():
    parts = []
    for t in (10, 25, 50, 100):
        s = max(1, t // 5)
        parts.append(f"SELECT {t} AS window_size, {s} AS step_size, s.split, l.failure_imminent FROM labeled l JOIN splits s "
                     f"ON l.machine_id = s.machine_id WHERE l.timestep >= {t - 1} AND (l.timestep - {t - 1}) % {s} = 0")
    return " UNION ALL ".join(parts)


register("window_size_study", f"""WITH {base()}, {_SPLIT}, x AS ({_study_sql()})
SELECT window_size, step_size, split, count(*) AS n_windows, CAST(sum(failure_imminent) AS BIGINT) AS n_positive
FROM x GROUP BY ALL""")(lambda spark, sf: P.window_size_study(
    fx.labeled_readings(spark, sf)).select(
        "window_size", "step_size", "split", "n_windows", F.col("n_positive").cast("long").alias("n_positive")))


def _last_window(spark, sf):
    ev = event_readings(spark, sf)
    w = P.last_n_window(ev, ["value"], 64)
    return rounded(w.select("machine_id", "n_used", F.size("features").alias("n_values"),
                            F.element_at("features", 1).alias("first_value"),
                            F.element_at("features", -1).alias("last_value"),
                            F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("value_sum")))


register("last_window", """WITH ev AS (SELECT user_id AS machine_id, value,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rd, count(*) OVER (PARTITION BY user_id) AS n
  FROM events),
t AS (SELECT * FROM ev WHERE rd <= 64)
SELECT machine_id, CAST(LEAST(max(n), 64) AS INTEGER) AS n_used, 64 AS n_values,
       """ + r6("arg_max(value, rd)", "first_value") + """, """ + r6("arg_min(value, rd)", "last_value") + """,
       """ + r6("SUM(value) + (64 - count(*)) * arg_min(value, rd)", "value_sum") + """
FROM t GROUP BY machine_id""")(_last_window)


register("event_horizon_labels", f"""WITH {base()}
SELECT l.machine_id, l.timestep, CASE WHEN f.failure_t IS NOT NULL AND l.timestep BETWEEN f.failure_t - 30 AND f.failure_t
                                 THEN 1 ELSE 0 END AS failure_imminent_event
FROM labeled l LEFT JOIN fails f ON l.machine_id = f.machine_id""")(
    lambda spark, sf: L.add_event_horizon_labels(fx.labeled_readings(spark, sf), 30)
    .select("machine_id", "timestep", "failure_imminent_event"))


# Latent ramp over the last three fifths of a machine's life
register("latent_progress", f"""WITH {base()}
SELECT machine_id, timestep, ROUND(LEAST(GREATEST((timestep - (2 * max_timestep) // 5)
    / CAST(GREATEST(max_timestep - (2 * max_timestep) // 5, 1) AS DOUBLE), 0.0), 1.0), 4) AS latent_progress FROM labeled""")(
    lambda spark, sf: fx.labeled_readings(spark, sf).select("machine_id", "timestep", L.latent_progress(
        F.col("timestep"), F.expr("(2 * max_timestep) div 5"), F.col("max_timestep")).alias("latent_progress")))

register("forward_fill", f"""WITH {base()}, {_DMG}
SELECT machine_id, timestep,
  {r6('last_value(quantity IGNORE NULLS) OVER (PARTITION BY machine_id ORDER BY timestep ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'quantity')},
  {r6("last_value(CASE WHEN isnan(discount) THEN NULL ELSE discount END IGNORE NULLS) OVER (PARTITION BY machine_id ORDER BY timestep ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", 'discount')}
FROM dmg""")(lambda spark, sf: rounded(L.forward_fill(fx.damaged_readings(spark, sf), ["quantity", "discount"])
                                       .select("machine_id", "timestep", "quantity", "discount")))

register("lag_coupling", f"""WITH {base()},
x AS (SELECT machine_id, price, lag(quantity) OVER (PARTITION BY machine_id ORDER BY timestep) AS lq FROM labeled)
SELECT machine_id, {r6('corr(price, lq)', 'lag_corr')}, count(lq) AS n_pairs FROM x GROUP BY machine_id""")(
    lambda spark, sf: rounded(L.lag_coupling(fx.labeled_readings(spark, sf), "quantity", "price")))


def _resample(spark, sf):
    lab = fx.labeled_readings(spark, sf)
    ends = P.window_end_rows(lab, 50, 10).select("machine_id", F.col("timestep").alias("end_timestep"),
                                                  F.col("failure_imminent").alias("label"))
    r = P.poisson_resample(ends, ["machine_id", "end_timestep"])
    return r.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


register("balanced_resample", f"""WITH {base()},
n AS (SELECT failure_imminent AS label, (SELECT count(*) FROM ends) / (2.0 * count(*)) AS lam FROM ends GROUP BY failure_imminent),
m AS (SELECT label, lam, CAST(GREATEST(1, ceil(lam)) AS BIGINT) AS m FROM n),
cdf AS (SELECT m.label, k.k, SUM(exp(-(lam / m) + j.j * ln(lam / m) - lgamma(j.j + 1.0))) AS c
        FROM m, range(24) k(k), range(24) j(j) WHERE j.j <= k.k GROUP BY ALL),
d AS (SELECT e.failure_imminent AS label, CAST('0x' || substr(md5(e.machine_id || '-' || e.timestep || '-' || r.r || '-42'), 1, 13) AS BIGINT)
             / 4503599627370496.0 AS u
      FROM ends e JOIN m ON m.label = e.failure_imminent, LATERAL (SELECT unnest(range(1, m.m + 1)) AS r) r)
SELECT label, count(*) AS n_rows FROM (SELECT d.label, count(*) AS copies FROM d JOIN cdf ON cdf.label = d.label AND cdf.c <= d.u GROUP BY d.label, d.u, cdf.k) GROUP BY label""")(_resample)


def _draws_per_row(spark, sf):
    ends = P.window_end_rows(fx.labeled_readings(spark, sf), 50, 10).select(
        "machine_id", F.col("timestep").alias("end_timestep"), F.col("failure_imminent").alias("label"))
    return P.balanced_draws(ends, ["machine_id", "end_timestep"]).groupBy("machine_id", "end_timestep", "label").agg(
        F.count(F.lit(1)).alias("copies"))


# F6 in full: who is drawn how often in exactly as many draws as there are windows
register("balanced_draws", f"""WITH {base()},
k AS (SELECT machine_id, timestep AS end_timestep, failure_imminent AS label,
             row_number() OVER (PARTITION BY failure_imminent ORDER BY machine_id, timestep) - 1 AS pos,
             count(*) OVER (PARTITION BY failure_imminent) AS m FROM ends),
u AS (SELECT CAST('0x' || substr(md5('draw-' || r.i || '-42'), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM range((SELECT count(*) FROM ends)) r(i)),
d AS (SELECT CASE WHEN u < 0.5 THEN 1 ELSE 0 END AS label, CASE WHEN u < 0.5 THEN 2 * u ELSE 2 * u - 1 END AS v FROM u),
p AS (SELECT d.label, CAST(LEAST(floor(d.v * c.m), c.m - 1) AS BIGINT) AS pos FROM d JOIN (SELECT label, max(m) AS m FROM k GROUP BY label) c ON c.label = d.label)
SELECT k.machine_id, k.end_timestep, k.label, count(*) AS copies FROM p JOIN k ON k.label = p.label AND k.pos = p.pos GROUP BY ALL""")(_draws_per_row)


def _sample(spark, sf):
    lab = fx.labeled_readings(spark, sf)
    test = P.window_end_rows(lab.where(F.col("split") == "test"), 50, 10)
    return P.sample_windows(test.select("machine_id", F.col("timestep").alias("end_timestep")), 500, seed=42)


register("window_sample", f"""WITH {base()}, {_SPLIT}
SELECT e.machine_id, e.timestep AS end_timestep FROM ends e JOIN splits s ON e.machine_id = s.machine_id
WHERE s.split = 'test'
ORDER BY md5(CAST(e.machine_id AS VARCHAR) || '-' || CAST(e.timestep AS VARCHAR) || '-42'), e.machine_id, e.timestep
LIMIT 500""")(_sample)


# ---------------------------------------------------------------- logs

from ..sources import text_logs as TL  # noqa: E402
from ..session import scratch, store_in_tasks  # noqa: E402

_LOG_SENSORS = {"sensor_2": "quantity", "sensor_3": "price", "sensor_4": "discount", "sensor_7": "tax"}


def _log_round_trip(spark, sf):
    """Readings cut machine_id % 30 steps before their end, written as a text log with
    the cut as RUL lines, read back and labelled from the truth."""
    lab = fx.labeled_readings(spark, sf)
    cut = F.col("machine_id") % 30
    folder = scratch(spark, "log")
    TL.write_sensor_log(lab.where(F.col("timestep") <= F.col("max_timestep") - cut), f"{folder}/train", _LOG_SENSORS)
    TL.write_rul_file(lab.where(F.col("timestep") == F.col("max_timestep") - cut).select("machine_id", cut.alias("rul_at_last")), f"{folder}/rul")
    # parsed once: order, truth and labels below each scan it
    log = store(TL.read_sensor_log(spark, f"{folder}/train").select("machine_id", "timestep", "ingest_seq", *TL.log_columns_for("FD001")))
    truth = TL.attach_truth(log, TL.read_rul_file(spark, f"{folder}/rul"))
    out = L.add_rul_from_truth(log, truth)
    return rounded(out.select("machine_id", "timestep", "rul", *[F.col(k).alias(v) for k, v in _LOG_SENSORS.items()]))


register("log_round_trip", f"""WITH {base()}
SELECT machine_id, timestep, CAST(max_timestep - timestep AS BIGINT) AS rul, {', '.join(r6(c, c) for c in SENSORS)}
FROM labeled WHERE timestep <= max_timestep - machine_id % 30""")(_log_round_trip)


# ---------------------------------------------------------------- models (M1-M13) -- rows-only

from ..operators import importance as IMP  # noqa: E402
from ..operators import models as ML  # noqa: E402


_STORED: dict = {}
#: Windows of 200 doubles that a task of a fit holds, scores or keeps.
WINDOWS_A_TASK = 100_000


def _once(spark, key, build):
    """What several queries share (prepared windows, fitted models), made once per
    session and set of input files; tables lie in the checkpoint folder."""
    hit = _STORED.get(key)
    if hit is None or hit[0] is not spark.sparkContext._jsc:
        _STORED[key] = hit = (spark.sparkContext._jsc, build())
    return hit[1]


def model_windows(spark, sf, p: fx.Params = fx.DEFAULT, kind: str = "standard"):
    """guard (P7) -> scaler fit on train rows -> applied to all rows -> windows with split."""
    lab = fx.labeled_readings(spark, sf, p)

    def build():
        Q.require_clean(lab, SENSORS, "failure_imminent")
        scaler = P.fit_scaler(lab.where(F.col("split") == "train"), SENSORS, kind)
        w = P.sliding_windows(P.apply_scaler(lab, scaler), SENSORS, p.window_size, p.step_size, keep_cols=["split"],
                              partitions=P.window_partitions(lab))
        return store_in_tasks(w, WINDOWS_A_TASK), scaler
    return _once(spark, ("windows", tuple(sorted(lab.inputFiles())), p, kind), build)


def _fit(spark, sf, which="lr"):
    w, scaler = model_windows(spark, sf)
    train = w.where(F.col("split") == "train")
    fits = {"lr": ML.fit_logistic, "rf": ML.fit_random_forest, "mlp": ML.fit_mlp}
    fitted = _once(spark, ("fitted", which, tuple(sorted(w.inputFiles()))), lambda: fits[which](train))
    return fitted, w, scaler


def _test_preds(which):
    def run(spark, sf):
        fitted, w, _ = _fit(spark, sf, which)
        return rounded(fitted.score(w.where(F.col("split") == "test")))
    return run


register("lr_predictions")(_test_preds("lr"))
register("rf_predictions")(_test_preds("rf"))
register("mlp_predictions")(_test_preds("mlp"))


def _fitted_preds(spark, sf):
    """Scores of the three fitted models on validation and test windows, stored once."""
    w, _ = model_windows(spark, sf)

    def build():
        out = None
        for which in ("lr", "rf", "mlp"):
            s = _fit(spark, sf, which)[0].score(w.where(F.col("split") != "train"), keep=["split"])
            out = s if out is None else out.unionByName(s)
        return store(out)
    return _once(spark, ("fitted_preds", tuple(sorted(w.inputFiles()))), build)


def _own_threshold(spark, sf):
    """Test scores with each model's threshold, picked on validation machines (F1)."""
    p = _fitted_preds(spark, sf)
    thr = C.optimal_threshold(p.where(F.col("split") == "val")).select("model", F.col("threshold").alias("own"))
    return p.where(F.col("split") == "test").drop("split").join(F.broadcast(thr), "model")


def _shifted(p):
    """Scores moved so that each model's own threshold stands at 0.5 (order kept)."""
    s, t = F.col("y_score"), F.col("own")
    moved = F.when(s >= t, 0.5 + 0.5 * (s - t) / F.greatest(1 - t, F.lit(1e-12))).otherwise(0.5 * s / F.greatest(t, F.lit(1e-12)) * (1 - 1e-12))
    return p.withColumn("y_score", moved).drop("own")


def _fitted_metrics(spark, sf):
    p = _own_threshold(spark, sf)
    m = M.classification_metrics(p, F.col("own"))
    ci = C.delong(C.score_table(p)).select("model", F.col("lower").alias("auc_lower"), F.col("upper").alias("auc_upper"))
    cost = C.cost_threshold_comparison(p, COSTS).select("model", "cost_threshold", "cost_total_cost", "f1_total_cost", "cost_saving")
    thr = p.select("model", F.col("own").alias("selected_threshold")).distinct()
    return rounded(m.join(thr, "model").join(ci, "model").join(cost, "model"))


# the models of one training run, judged on one test split at their own thresholds
register("fitted_metrics")(_fitted_metrics)
register("fitted_mcnemar")(lambda spark, sf: rounded(I.mcnemar(_shifted(_own_threshold(spark, sf)))))
register("fitted_error_groups")(lambda spark, sf: rounded(G.error_by_group(G.join_metadata(
    _shifted(_own_threshold(spark, sf)), fx.window_metadata(fx.labeled_readings(spark, sf)))).orderBy(
        "model", "group_by", F.desc("fn_rate"), "group_value")))
register("fitted_error_summary")(lambda spark, sf: rounded(M.error_summary(_shifted(_own_threshold(spark, sf)))))


def _calibrators(spark, sf):
    fitted, w, _ = _fit(spark, sf, "lr")
    return rounded(ML.compare_calibrators(fitted.score(w.where(F.col("split") == "val")),
                                          fitted.score(w.where(F.col("split") == "test"))))


register("calibrator_comparison")(_calibrators)


def _intrinsic(spark, sf):
    fitted, _, _ = _fit(spark, sf, "lr")
    return rounded(ML.intrinsic_importance(fitted, 50, len(SENSORS), SENSORS))


def _rollup(spark, sf):
    fitted, _, _ = _fit(spark, sf, "rf")
    return rounded(ML.sensor_rollup(ML.intrinsic_importance(fitted, 50, len(SENSORS), SENSORS)))


register("intrinsic_importance")(_intrinsic)
register("sensor_importance_rollup")(_rollup)


def _perm(kind):
    def run(spark, sf):
        fitted, w, _ = _fit(spark, sf, "lr")
        test = w.where(F.col("split") == "test")
        if kind == "sensor":
            return rounded(IMP.sensor_permutation_importance(fitted, test, SENSORS))
        if kind == "temporal":
            return rounded(IMP.temporal_permutation_importance(fitted, test, 50, len(SENSORS)))
        if kind == "sensitivity":
            return rounded(IMP.sensitivity_map(fitted, test, 50, SENSORS))
        return rounded(IMP.all_importances(fitted, test, 50, SENSORS))
    return run


register("sensor_permutation_importance")(_perm("sensor"))
register("temporal_permutation_importance")(_perm("temporal"))
register("sensitivity_map")(_perm("sensitivity"))
register("all_importances")(_perm("all"))


def _hpo(spark, sf):
    w, _ = model_windows(spark, sf)
    folds = ML.hyperparameter_search(w.where(F.col("split") != "test"))
    return rounded(folds.groupBy("model", "params").agg(F.avg("f1").alias("mean_f1"), F.count(F.lit(1)).alias("n_folds")))


register("hyperparameter_search")(_hpo)

register("machine_folds", f"""WITH {base()}, {_SPLIT}
SELECT machine_id, CAST(floor(CAST('0x' || substr(md5(machine_id || '-42'), 1, 13) AS BIGINT) / 4503599627370496.0 * 3) AS INTEGER) AS fold
FROM splits WHERE split <> 'test'""")(lambda spark, sf: ML.machine_folds(
    _splits(spark, sf).where(F.col("split") != "test").select("machine_id")))

# M7/M8 before scoring: who gives to whom in each repeat
register("permutation_donors", f"""WITH {base()}, {_SPLIT},
k AS (SELECT r.r AS rep, e.machine_id, e.timestep AS end_timestep FROM ends e JOIN splits s ON s.machine_id = e.machine_id, range(5) r(r)
      WHERE s.split = 'test'),
h AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY md5(rep || '-' || machine_id || '-' || end_timestep || '-recv-42'), machine_id, end_timestep) AS rr,
             row_number() OVER (PARTITION BY rep ORDER BY md5(rep || '-' || machine_id || '-' || end_timestep || '-give-42'), machine_id, end_timestep) AS rg FROM k)
SELECT CAST(a.rep AS INTEGER) AS rep, a.machine_id, a.end_timestep, b.machine_id AS donor_machine_id, b.end_timestep AS donor_end_timestep
FROM h a JOIN h b ON b.rep = a.rep AND b.rg = a.rr""")(lambda spark, sf: IMP.donors(
    P.window_end_rows(fx.labeled_readings(spark, sf).where(F.col("split") == "test"), 50, 10).select(
        "machine_id", F.col("timestep").alias("end_timestep")), 5))


def _isotonic(spark, sf):
    """M4 on the coarse model: calibrated value of every validation score."""
    val = fx.predictions(fx.labeled_readings(spark, sf), keep=("split",)).where("model = 'b' AND split = 'val'")
    cal = ML.IsotonicCalibrator.fit(val)
    points = val.select("y_score").distinct().withColumn("raw_score", F.col("y_score"))
    return rounded(cal.transform(points).select("raw_score", F.col("y_score").alias("calibrated")))


# least-squares monotone fit by the max-min formula over blocks of scores
register("isotonic_fit", f"""WITH {base()}, {_SPLIT},
d AS (SELECT y_score AS s, SUM(y_true) AS pos, count(*) AS n, row_number() OVER (ORDER BY y_score) AS i
      FROM preds p JOIN splits x ON x.machine_id = p.machine_id WHERE p.model = 'b' AND x.split = 'val' GROUP BY y_score),
c AS (SELECT i, s, SUM(pos) OVER (ORDER BY i) AS cp, SUM(n) OVER (ORDER BY i) AS cn, pos, n FROM d),
m AS (SELECT a.i AS j, b.i AS k, (b.cp - a.cp + a.pos) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS avg FROM c a JOIN c b ON b.i >= a.i),
x AS (SELECT c.i, c.s, m.j, min(m.avg) AS lo FROM c JOIN m ON m.j <= c.i AND m.k >= c.i GROUP BY c.i, c.s, m.j)
SELECT {r6('s', 'raw_score')}, {r6('max(lo)', 'calibrated')} FROM x GROUP BY i, s""")(_isotonic)


def _stationary(spark, sf):
    """M2/M3: the penalised mean loss has no slope left at the fitted coefficients."""
    preds = fx.predictions(fx.labeled_readings(spark, sf), keep=("split",)).where("split = 'val'")
    rows = []
    for m in ("a", "b", "c"):
        v = preds.where(F.col("model") == m)
        platt = ML.PlattScaler.fit(v)
        p = 1 / (1 + F.exp(-(F.lit(platt.coef) * F.col("y_score") + F.lit(platt.intercept))))
        e = p - F.col("y_true")
        g = v.agg(F.count(F.lit(1)).alias("n"), F.avg(e * F.col("y_score")).alias("slope"), F.avg(e).alias("level"))
        rows.append(g.select(F.lit(m).alias("model"), F.col("n").alias("n_rows"),
                             (F.abs(F.col("slope") + platt.coef / F.col("n")) < 1e-4).alias("slope_settled"),
                             (F.abs("level") < 1e-4).alias("level_settled")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


register("platt_optimality", f"""WITH {base()}, {_SPLIT}
SELECT p.model, count(*) AS n_rows, true AS slope_settled, true AS level_settled
FROM preds p JOIN splits s ON s.machine_id = p.machine_id WHERE s.split = 'val' GROUP BY p.model""")(_stationary)


def _requests(spark, sf):
    """One scoring request per test window: its raw readings (the last 40 of an odd
    window), with planted defects by window key."""
    lab = fx.labeled_readings(spark, sf).where(F.col("split") == "test")
    w = P.sliding_windows(lab, SENSORS, 50, 10, nested=True, partitions=P.window_partitions(lab))
    k = (F.col("machine_id") + F.col("end_timestep")) % 23
    r = F.when(k % 2 == 0, F.col("features")).otherwise(F.slice("features", 11, 40))
    first = F.element_at(r, 1)
    bad = {1: F.slice(r, 1, 0), 2: F.transform(r, lambda row: F.slice(row, 1, 3)),
           3: F.concat(F.array(F.array(F.lit(None).cast("double"), *[F.get(first, F.lit(i)) for i in (1, 2, 3)])), r),
           4: F.concat(F.array(F.array(F.lit(-1.0), *[F.get(first, F.lit(i)) for i in (1, 2, 3)])), r)}
    for i, v in bad.items():
        r = F.when(k == i, v).otherwise(r)
    t = F.when(k == 5, F.lit(1.5)).when(k == 6, F.lit(None).cast("double")).otherwise(F.lit(0.5))
    return w.select(F.col("machine_id").alias("request_id"), "end_timestep", r.alias("readings"), t.alias("threshold"))


_REQUEST_BOUNDS = [Q.READINGS_SCHEMA.value_ranges[c] for c in SENSORS]


def _batch(spark, sf):
    fitted, _, scaler = _fit(spark, sf, "lr")
    return ML.score_requests(_requests(spark, sf), fitted, 50, len(SENSORS), _REQUEST_BOUNDS, scaler)


register("batch_scoring")(_batch)

# M10 without the model: what is accepted, and the features that would be scored
register("request_screening", f"""WITH {base()}, {_SPLIT},
w AS (SELECT e.machine_id, e.timestep AS end_timestep, (e.machine_id + e.timestep) % 23 AS k FROM ends e
      JOIN splits s ON s.machine_id = e.machine_id WHERE s.split = 'test'),
n AS (SELECT *, CASE WHEN k = 1 THEN 0 WHEN k IN (3, 4) THEN (CASE WHEN k % 2 = 0 THEN 51 ELSE 41 END)
                     WHEN k % 2 = 0 THEN 50 ELSE 40 END AS window_length FROM w),
v AS (SELECT n.machine_id, n.end_timestep, SUM(l.quantity) AS q, max(CASE WHEN l.timestep = n.end_timestep THEN l.quantity END) AS lq
      FROM n JOIN labeled l ON l.machine_id = n.machine_id AND l.timestep BETWEEN n.end_timestep - CASE WHEN n.k % 2 = 0 THEN 49 ELSE 39 END AND n.end_timestep
      GROUP BY ALL)
SELECT n.machine_id AS request_id, n.end_timestep, CAST(window_length AS INTEGER) AS window_length,
       CASE k WHEN 1 THEN 'empty window' WHEN 2 THEN 'wrong reading width' WHEN 3 THEN 'missing reading'
              WHEN 4 THEN 'reading out of bounds' WHEN 5 THEN 'threshold outside [0,1]' WHEN 6 THEN 'threshold outside [0,1]' END AS reject_reason,
       {r6('CASE WHEN k BETWEEN 1 AND 6 THEN 0.0 ELSE v.q + (50 - window_length) * v.lq END', 'quantity_sum')}
FROM n JOIN v ON v.machine_id = n.machine_id AND v.end_timestep = n.end_timestep""")(
    lambda spark, sf: rounded(_requests(spark, sf).withColumn("reject_reason", ML.reject_reason(_REQUEST_BOUNDS)).select(
        "request_id", "end_timestep", F.size("readings").alias("window_length"), "reject_reason",
        F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda t: F.get(
            ML.request_features(50, len(SENSORS)), t * len(SENSORS))), F.lit(0.0), lambda a, x: a + x).alias("quantity_sum"))))


# ---------------------------------------------------------------- streams: batch twins

from ..streaming import live as X  # noqa: E402


def _stream_windows(spark, sf):
    w = X.live_windows_batch(event_readings(spark, sf), 10, 5)
    return rounded(w.select("machine_id", "end_seq", F.size("values").alias("n_values"),
                            F.element_at("values", 1).alias("first_value"),
                            F.element_at("values", -1).alias("last_value"),
                            F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("value_sum")))


register("stream_windows_batch", """WITH ev AS (SELECT user_id AS machine_id, value,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
w AS (SELECT machine_id, pos, value,
    first_value(value) OVER (PARTITION BY machine_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS fv,
    sum(value) OVER (PARTITION BY machine_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS sv FROM ev)
SELECT machine_id, pos AS end_seq, 10 AS n_values, """ + r6("fv", "first_value") + ", " + r6("value", "last_value")
         + ", " + r6("sv", "value_sum") + """ FROM w WHERE pos >= 9 AND (pos - 9) % 5 = 0""")(_stream_windows)


def _daily_drift(spark, sf):
    # batch twin: days on the naive (TIMESTAMP_NTZ) clock -- independent of the session zone
    ev = read_table(spark, sf, "events")
    ref = ev.where(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))
    edges = X.training_edges(ref)
    hist = X.windowed_histogram(ev, edges, watermark=None)
    out = X.psi_against(hist, X.reference_histogram(ref, edges), 10)
    return rounded(out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "psi", "status"))


register("daily_drift", """WITH ref AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00'),
rng AS (SELECT min(value) AS lo, max(value) AS hi FROM ref),
edges AS (SELECT i, CASE WHEN i = 10 THEN hi ELSE CAST(i AS DOUBLE) * ((hi - lo) / 10.0) + lo END AS e FROM rng, range(11) r(i)),
cl AS (SELECT e.ts, LEAST(GREATEST(e.value, rng.lo), rng.hi) AS v, rng.hi FROM events e, rng WHERE e.value IS NOT NULL AND NOT isnan(e.value)),
b AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, CASE WHEN v = hi THEN 9 ELSE (SELECT max(i) FROM edges WHERE e <= v) END AS bin,
             ts < TIMESTAMP '2024-01-16 00:00:00' AS is_ref FROM cl),
rh AS (SELECT bin, count(*) AS rh FROM b WHERE is_ref GROUP BY bin),
rt AS (SELECT count(*) AS rn FROM b WHERE is_ref),
h AS (SELECT day, bin, count(*) AS n FROM b GROUP BY day, bin),
t AS (SELECT day, count(*) AS nt FROM b GROUP BY day),
sp AS (SELECT t.day, t.nt, CAST(r.i AS INTEGER) AS bin FROM t, range(10) r(i)),
x AS (SELECT sp.day, sp.nt, (COALESCE(h.n, 0) + 1e-06) / (sp.nt + 1e-06 * 10) AS c,
             (COALESCE(rh.rh, 0) + 1e-06) / ((SELECT rn FROM rt) + 1e-06 * 10) AS r
      FROM sp LEFT JOIN h ON sp.day = h.day AND sp.bin = h.bin LEFT JOIN rh ON sp.bin = rh.bin),
p AS (SELECT day, max(nt) AS n, SUM((c - r) * ln(c / r)) AS psi FROM x GROUP BY day)
SELECT day, n, """ + r6("psi", "psi") + """, CASE WHEN psi > 0.25 THEN 'CRITICAL' WHEN psi > 0.1 THEN 'WARNING' ELSE 'OK' END AS status FROM p""")(
    _daily_drift)

register("event_routing", """SELECT event_type, CASE WHEN value IS NULL OR isnan(value) THEN 'missing:value'
    WHEN value < 0.0 OR value > 100.0 THEN 'range:value' WHEN user_id IS NULL THEN 'missing:user_id' END AS reject_reason,
    count(*) AS n_rows FROM events GROUP BY ALL""")(
    lambda spark, sf: X.route_events(read_table(spark, sf, "events")).groupBy("event_type", "reject_reason")
    .agg(F.count(F.lit(1)).alias("n_rows")))


def _pos_weight_study(spark, sf):
    w, _ = model_windows(spark, sf)
    return rounded(ML.pos_weight_study(w.where(F.col("split") == "train"), w.where(F.col("split") == "test")))


register("pos_weight_study")(_pos_weight_study)
register("model_comparison_full", f"""{_DL},
dl AS (SELECT model, {r6('auc', 'auc')}, {r6(f'GREATEST(0.0, auc - {_Z975!r} * sqrt(GREATEST(variance, 0)))', 'lower')},
       {r6(f'LEAST(1.0, auc + {_Z975!r} * sqrt(GREATEST(variance, 0)))', 'upper')} FROM fin), {_PAIRS},
{_perm_sql([('a', 'b'), ('a', 'c'), ('b', 'c')])}
SELECT m.model_a, m.model_b, m.b, m.c, {r6('m.statistic', 'statistic')}, {r6('m.p_value', 'p_value')}, m.interpretation,
       x.auc AS auc_a, x.lower AS auc_a_lower, x.upper AS auc_a_upper,
       y.auc AS auc_b, y.lower AS auc_b_lower, y.upper AS auc_b_upper,
       {r6('pt.p_value', 'auc_permutation_p')}, {r6('pt.observed_diff', 'auc_observed_diff')}
FROM mci m JOIN dl x ON m.model_a = x.model JOIN dl y ON m.model_b = y.model
JOIN pt ON pt.model_a = m.model_a AND pt.model_b = m.model_b""")(lambda spark, sf: rounded(I.compare_models_full(_preds(spark, sf), n_permutations=1000)))


def _val_threshold(spark, sf):
    lab = fx.labeled_readings(spark, sf)
    return rounded(M.metrics_at_selected_threshold(fx.predictions(lab, keep=("split",))))


def _val_threshold_sql():
    f1 = _ratio("2.0 * tp", "2.0 * tp + fp + fn")
    return f"""WITH {base()}, {_SPLIT}, {grid_cte('grid', 0.01, 0.99, 200)},
vp AS (SELECT p.* FROM preds p JOIN splits s ON p.machine_id = s.machine_id WHERE s.split = 'val'),
vc AS (SELECT p.model, g.grid_idx, g.threshold,
          SUM(CASE WHEN p.y_true = 1 AND p.y_score >= g.threshold THEN 1 ELSE 0 END) AS tp,
          SUM(CASE WHEN p.y_true = 0 AND p.y_score >= g.threshold THEN 1 ELSE 0 END) AS fp,
          SUM(CASE WHEN p.y_true = 1 AND p.y_score < g.threshold THEN 1 ELSE 0 END) AS fn
       FROM vp p, grid g GROUP BY ALL),
vb AS (SELECT model, threshold, {f1} AS s, row_number() OVER (PARTITION BY model ORDER BY {f1} DESC, grid_idx) AS rn FROM vc),
thr AS (SELECT model, CASE WHEN s > -1.0 THEN threshold ELSE 0.5 END AS t FROM vb WHERE rn = 1),
tp_ AS (SELECT p.*, thr.t FROM preds p JOIN splits s ON p.machine_id = s.machine_id JOIN thr ON p.model = thr.model
        WHERE s.split = 'test'),
cells AS (SELECT model, max(t) AS t,
    CAST(SUM(CASE WHEN y_true = 1 AND y_score >= t THEN 1 ELSE 0 END) AS BIGINT) AS tp,
    CAST(SUM(CASE WHEN y_true = 0 AND y_score >= t THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(SUM(CASE WHEN y_true = 1 AND y_score < t THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(SUM(CASE WHEN y_true = 0 AND y_score < t THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM tp_ GROUP BY model),
dist AS (SELECT model, y_score AS s, CAST(SUM(y_true) AS DOUBLE) AS pos, CAST(SUM(1 - y_true) AS DOUBLE) AS neg
         FROM tp_ GROUP BY model, y_score),
cum AS (SELECT model, s, pos, neg,
          COALESCE(SUM(neg) OVER (PARTITION BY model ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
          SUM(pos) OVER (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cpos,
          SUM(neg) OVER (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cneg,
          SUM(pos) OVER (PARTITION BY model) AS P, SUM(neg) OVER (PARTITION BY model) AS N FROM dist),
rkm AS (SELECT model,
         CASE WHEN max(P) > 0 AND max(N) > 0 THEN SUM(pos * (neg_below + 0.5 * neg)) / (max(P) * max(N)) END AS roc_auc,
         CASE WHEN max(P) > 0 THEN SUM(pos * cpos / (cpos + cneg)) / max(P) END AS pr_auc FROM cum GROUP BY model)
SELECT c.model, tp, fp, fn, tn, {_metric_sql()}, {r6('roc_auc', 'roc_auc')}, {r6('pr_auc', 'pr_auc')},
       {r6('c.t', 'selected_threshold')}
FROM cells c JOIN rkm ON c.model = rkm.model"""


register("metrics_at_val_threshold", _val_threshold_sql())(_val_threshold)
