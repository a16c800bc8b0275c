"""Reference SQL for the DuckDB oracle: an independent, brute-force statement
of each query over the raw parquet views (no Spark code is shared).

``base(...)`` yields the common CTEs: readings, labelled readings, window
end rows, window metadata and fixture predictions.
"""

from __future__ import annotations

from ..functions.grids import linspace
from .fixtures import DEFAULT, Params


def r6(expr: str, name: str, digits: int = 6) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), {digits}) AS {name}"


def base(p: Params = DEFAULT) -> str:
    T, S, H, C = p.window_size, p.step_size, p.horizon, p.clip_rul
    return f"""
rd AS (
  SELECT l.l_suppkey AS machine_id, l.l_orderkey, l.l_linenumber, l.l_shipdate,
         l.l_quantity AS quantity, l.l_extendedprice AS price, l.l_discount AS discount, l.l_tax AS tax,
         r.r_name AS machine_type,
         (l.l_returnflag = 'R' AND l.l_linestatus = 'F') AS rf,
         CAST(row_number() OVER (PARTITION BY l.l_suppkey
              ORDER BY l.l_shipdate, l.l_orderkey, l.l_linenumber) - 1 AS BIGINT) AS timestep,
         CAST(count(*) OVER (PARTITION BY l.l_suppkey) - 1 AS BIGINT) AS max_timestep
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
       JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
readings AS (
  SELECT *, CAST(rf AND timestep = max(CASE WHEN rf THEN timestep END)
                 OVER (PARTITION BY machine_id) AS INTEGER) AS failure_event
  FROM rd),
labeled AS (
  SELECT *, CAST(LEAST(max_timestep - timestep, {C}) AS BIGINT) AS rul,
         CAST(LEAST(max_timestep - timestep, {C}) <= {H} AS INTEGER) AS failure_imminent,
         LEAST(GREATEST(CASE WHEN max_timestep > 0 THEN CAST(timestep AS DOUBLE) / max_timestep
                             ELSE 0.0 END, 0.0), 1.0) AS degradation_progress
  FROM readings),
ends AS (
  SELECT * FROM labeled WHERE timestep >= {T - 1} AND (timestep - {T - 1}) % {S} = 0),
fails AS (
  SELECT machine_id, min(timestep) AS failure_t FROM labeled WHERE failure_event = 1 GROUP BY machine_id),
meta AS (
  SELECT e.machine_id, e.timestep AS end_timestep, e.machine_type, e.degradation_progress,
         e.failure_event, e.failure_imminent,
         CASE WHEN f.failure_t IS NOT NULL AND f.failure_t >= e.timestep THEN f.failure_t - e.timestep END
           AS timesteps_to_failure,
         CASE WHEN e.degradation_progress = 0.0 THEN 'normal'
              WHEN e.degradation_progress < 1.0 THEN 'degradation'
              ELSE 'post_failure_region' END AS degradation_stage
  FROM ends e LEFT JOIN fails f ON e.machine_id = f.machine_id),
preds AS (
  SELECT 'a' AS model, machine_id, timestep AS end_timestep, failure_imminent AS y_true,
         CAST(LEAST(1000000, (600000 * timestep) // max_timestep
              + CAST(ROUND(discount * 100) AS BIGINT) * 40000) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS y_score
  FROM ends
  UNION ALL
  SELECT 'b', machine_id, timestep, failure_imminent,
         CAST(LEAST(100, (55 * timestep) // max_timestep + CAST(ROUND(tax * 100) AS BIGINT) * 3
              + CAST(quantity AS BIGINT) % 5) AS DOUBLE) / CAST(100 AS DOUBLE)
  FROM ends
  UNION ALL
  SELECT 'c', machine_id, timestep, failure_imminent,
         CAST((timestep * 7919 + machine_id * 104729) % 1001 AS DOUBLE) / CAST(1000 AS DOUBLE)
  FROM ends)"""


def grid_values(start: float, stop: float, num: int) -> str:
    """VALUES list of (grid_idx, t) with the exact doubles NumPy produces."""
    vals = linspace(start, stop, num)
    return ", ".join(f"({i}, CAST('{v!r}' AS DOUBLE))" for i, v in enumerate(vals))


def grid_cte(name: str, start: float, stop: float, num: int) -> str:
    return f"{name}(grid_idx, threshold) AS (VALUES {grid_values(start, stop, num)})"


def chi2_sf_sql(x: str) -> str:
    """Chi-square(1) upper tail as 1 - erf(z), z = sqrt(x/2), by the positive series
    erf(z) = exp(-z^2) * sum z^(2n+1) / gamma(n + 3/2)."""
    z = f"sqrt(CAST({x} AS DOUBLE) / 2.0)"
    total = f"list_sum(list_transform(range(600), lambda n: exp((2 * n + 1) * ln({z}) - lgamma(n + 1.5) - {z} * {z})))"
    return f"(CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} > 400 THEN 0.0 ELSE GREATEST(0.0, 1.0 - {total}) END)"
