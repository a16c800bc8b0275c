"""Distribution drift: PSI per sensor between a reference and a current table.

All sensors in two scans: one wide aggregate for ranges and statistics (one row
per sensor -- a fixed, schema-sized table, stored and broadcast), one for the
bins against the per-sensor ``linspace`` edges; PSI is summed over a
(sensor x bin) spine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grids import count_le_array, linspace_array
from ..session import store


def psi_status(psi: Column, warning: float = 0.1, critical: float = 0.25) -> Column:
    """> critical CRITICAL, > warning WARNING, else OK (strict)."""
    return (F.when(psi > critical, F.lit("CRITICAL")).when(psi > warning, F.lit("WARNING"))
             .otherwise(F.lit("OK")))


def drift_report(reference: DataFrame, current: DataFrame, sensors: list[str], n_bins: int = 10,
                 eps: float = 1e-6, warning: float = 0.1, critical: float = 0.25) -> DataFrame:
    """A26 + A27: per sensor psi, status, reference/current mean and std (ddof 0).

    Sensors missing on either side are skipped; NULL/NaN values are dropped.
    PSI uses the shared min/max, ``n_bins`` equal bins (last closed),
    fractions ``(h + eps)/(n + eps*bins)``; a constant sensor gives 0.
    """
    shared = [c for c in sensors if c in reference.columns and c in current.columns]
    both = reference.select(*shared, F.lit(True).alias("__ref")).unionByName(current.select(*shared, F.lit(False).alias("__ref")))
    return drift_of_sides(both, shared, "__ref", n_bins, eps, warning, critical)


def drift_of_sides(df: DataFrame, sensors: list[str], ref_col: str, n_bins: int = 10, eps: float = 1e-6,
                   warning: float = 0.1, critical: float = 0.25) -> DataFrame:
    """``drift_report`` of one table whose rows are reference (``ref_col`` true) or
    current (false; NULL is neither): one scan for wide statistics, one for bins."""
    wide = []
    for c in sensors:
        x = F.col(c).cast("double")
        v = F.when(F.col(ref_col).isNotNull() & ~F.isnan(x), x)
        r, u = F.when(F.col(ref_col), v), F.when(~F.col(ref_col), v)
        wide.append(F.struct(F.lit(c).alias("sensor"), F.min(v).alias("lo"), F.max(v).alias("hi"),
                             F.count(r).alias("n_ref"), F.count(u).alias("n_cur"),
                             F.avg(r).alias("reference_mean"), F.avg(u).alias("current_mean"),
                             F.stddev_pop(r).alias("reference_std"), F.stddev_pop(u).alias("current_std")))
    # one row per sensor, read three times below
    stats = store(df.agg(F.array(*wide).alias("s")).select(F.explode("s").alias("s")).select("s.*").where("lo IS NOT NULL"))
    edges = linspace_array(F.col("lo"), F.col("hi"), n_bins + 1)
    rng = stats.select("sensor", "lo", "hi", edges.alias("edges"),
                       ((F.col("hi") - F.col("lo")) / F.lit(float(n_bins))).alias("h"))
    long = df.where(F.col(ref_col).isNotNull()).select(F.col(ref_col).alias("ref"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("sensor"), F.col(c).cast("double").alias("value")) for c in sensors])).alias("x")).select("ref", "x.*")
    v = F.col("value")
    j = long.where(v.isNotNull() & ~F.isnan(v)).join(F.broadcast(rng), "sensor")
    c = count_le_array(v, F.col("edges"), F.col("lo"),
                       F.when(F.col("h") > 0, F.col("h")).otherwise(F.lit(1.0)), n_bins + 1)
    b = F.when(v == F.col("hi"), F.lit(n_bins - 1)).otherwise(c - 1)
    hist = j.groupBy("sensor", b.alias("bin")).agg(F.count_if("ref").alias("hr"), F.count_if(~F.col("ref")).alias("hc"))
    spine = stats.select("sensor", "lo", "hi", "n_ref", "n_cur", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    s = spine.join(hist, ["sensor", "bin"], "left")
    r = (F.coalesce("hr", F.lit(0)) + eps) / (F.col("n_ref") + eps * n_bins)
    cu = (F.coalesce("hc", F.lit(0)) + eps) / (F.col("n_cur") + eps * n_bins)
    psi = s.groupBy("sensor").agg(
        F.sum((cu - r) * F.log(cu / r)).alias("__psi"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    psi = psi.select("sensor", F.when(F.col("lo") == F.col("hi"), F.lit(0.0)).otherwise(F.col("__psi")).alias("psi"))
    return psi.join(F.broadcast(stats), "sensor").select(
        "sensor", "psi", psi_status(F.col("psi"), warning, critical).alias("status"),
        "reference_mean", "current_mean", "reference_std", "current_std")
