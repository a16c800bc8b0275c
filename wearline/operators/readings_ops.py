"""Readings-level summaries and selections (S11, S12, P1, P2) and drift splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .drift import drift_of_sides
from .labels import MACHINE, TIME


def dataset_summary(labeled: DataFrame) -> DataFrame:
    """Engines, rows, average life (mean of max timestep), max RUL, positive rate.

    Per-machine partial aggregates first, then one global row.
    """
    per = labeled.groupBy(MACHINE).agg(F.count(F.lit(1)).alias("n"), F.max(TIME).alias("mt"),
                                       F.max("rul").alias("mr"), F.sum("failure_imminent").alias("pos"))
    return per.agg(F.count(F.lit(1)).alias("engines"), F.sum("n").alias("n_rows"),
                   F.avg("mt").alias("avg_life"), F.max("mr").alias("max_rul"),
                   (F.sum("pos") / F.sum("n")).alias("positive_rate"))


def machine_type_distribution(df: DataFrame) -> DataFrame:
    """Machines and rows per machine type."""
    return df.groupBy("machine_type").agg(F.countDistinct(MACHINE).alias("n_machines"),
                                          F.count(F.lit(1)).alias("n_rows"))


def near_constant_sensors(df: DataFrame, sensors: list[str], eps: float = 1e-6) -> DataFrame:
    """One pass of std/min/max per sensor; ``near_constant`` when std <= eps."""
    aggs = []
    for c in sensors:
        aggs += [F.stddev_pop(c).alias(f"{c}__std"), F.min(c).cast("double").alias(f"{c}__min"),
                 F.max(c).cast("double").alias(f"{c}__max")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("sensor"), F.col(f"{c}__std").alias("std"),
                                        F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"))
                               for c in sensors]))
    return one.select(rows.alias("r")).select("r.*").withColumn("near_constant", F.col("std") <= eps)


def select_sensors(df: DataFrame, keep_cols: list[str], sensors: list[str], drop: list[str]) -> DataFrame:
    """Keep id/label columns plus the sensors not listed in ``drop``."""
    return df.select(*keep_cols, *[c for c in sensors if c not in set(drop)])


def prune_near_constant(df: DataFrame, keep_cols: list[str], sensors: list[str], eps: float = 1e-6) -> DataFrame:
    """P1 driven by P2: drop sensors whose std is <= eps (one aggregate row)."""
    flags = near_constant_sensors(df, sensors, eps).where("near_constant").select("sensor").collect()
    return select_sensors(df, keep_cols, sensors, [r[0] for r in flags])


def drift_by_cutoff(df: DataFrame, time_col: str, cutoff: str, sensors: list[str]) -> DataFrame:
    """Drift of rows before ``cutoff`` (reference) vs from it (current)."""
    cut = F.lit(cutoff).cast(df.schema[time_col].dataType)
    return drift_of_sides(df.select(*sensors, (F.col(time_col) < cut).alias("__ref")), sensors, "__ref")
