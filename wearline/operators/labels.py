"""Per-machine labels: remaining life, failure horizon, life-cycle position.

All operators are lazy ``DataFrame -> DataFrame`` functions over a readings
table keyed by (machine_id, timestep). Per-machine facts are computed with
``groupBy`` (partial aggregation) and joined back, so a hot machine is
handled by AQE's skew-join split rather than landing in one window task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MACHINE = "machine_id"
TIME = "timestep"


def with_machine_max(df: DataFrame, col: str = TIME, out: str = "max_timestep") -> DataFrame:
    """W3 helper: ``max(col)`` per machine attached to every row."""
    if out in df.columns:
        return df
    per_machine = df.groupBy(MACHINE).agg(F.max(col).alias(out))
    return df.join(per_machine, MACHINE)


def add_rul(df: DataFrame, clip_rul: int | None = 125) -> DataFrame:
    """W3 + P5: ``rul = max(t) - t`` per machine, clipped at ``clip_rul``."""
    df = with_machine_max(df)
    rul = F.col("max_timestep") - F.col(TIME)
    if clip_rul is not None:
        rul = F.least(rul, F.lit(int(clip_rul)))
    return df.withColumn("rul", rul.cast("long"))


def add_rul_from_truth(df: DataFrame, truth: DataFrame) -> DataFrame:
    """W4 + J2: ``rul = rul_at_last + (max(t) - t)``; ``truth`` = (machine_id, rul_at_last)."""
    df = with_machine_max(df)
    return (df.join(truth, MACHINE)
              .withColumn("rul", (F.col("rul_at_last") + F.col("max_timestep") - F.col(TIME))
                          .cast("long")))


def add_run_to_failure_labels(df: DataFrame, horizon: int = 30, clip_rul: int = 125) -> DataFrame:
    """W5 (run-to-failure form), W7: labels on the clipped RUL.

    ``failure_imminent = rul <= horizon``, ``failure_event = (t == max t)``
    (kept if the input already carries one), ``degradation_progress = t/max t``
    clipped to [0, 1].
    """
    if clip_rul is not None and clip_rul <= horizon:
        raise ValueError(f"clip_rul ({clip_rul}) must exceed the horizon ({horizon}); "
                         "otherwise every row is labelled positive")
    df = add_rul(df, clip_rul)
    out = df.withColumn("failure_imminent", (F.col("rul") <= horizon).cast("int"))
    if "failure_event" not in df.columns:
        out = out.withColumn("failure_event", (F.col(TIME) == F.col("max_timestep")).cast("int"))
    progress = F.when(F.col("max_timestep") > 0, F.col(TIME) / F.col("max_timestep")).otherwise(F.lit(0.0))
    return out.withColumn("degradation_progress", F.least(F.greatest(progress, F.lit(0.0)), F.lit(1.0)))


def failure_times(df: DataFrame, event_col: str = "failure_event") -> DataFrame:
    """First failure step per machine (machine_id, failure_t); one row per failing machine."""
    return (df.where(F.col(event_col) == 1).groupBy(MACHINE)
              .agg(F.min(TIME).alias("failure_t")))


def next_event(df: DataFrame, event_col: str = "failure_event", out: str = "next_event", chunk_len: int = 100_000) -> DataFrame:
    """Step of the machine's first event at or after each row, NULL if none follows.

    Carried backwards: rows are cut into chunks of ``chunk_len`` steps; a window
    over (machine, chunk) finds the first event at or after a row inside its
    chunk, and a small table (one row a machine and chunk) holds the first event
    of all later chunks. Any number of events per machine.
    """
    step = F.when(F.col(event_col) == 1, F.col(TIME))
    tagged = df.withColumn("__c", F.floor(F.col(TIME) / F.lit(chunk_len)).cast("long"))
    firsts = tagged.groupBy(MACHINE, "__c").agg(F.min(step).alias("__first"))
    later = Window.partitionBy(MACHINE).orderBy("__c").rowsBetween(1, Window.unboundedFollowing)
    carry = firsts.select(F.col(MACHINE).alias("__km"), F.col("__c").alias("__kc"), F.min("__first").over(later).alias("__carry"))
    rows = tagged.join(carry, F.col(MACHINE).eqNullSafe(F.col("__km")) & F.col("__c").eqNullSafe(F.col("__kc")))
    ahead = Window.partitionBy(MACHINE, "__c").orderBy(TIME).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumn(out, F.coalesce(F.min(step).over(ahead), F.col("__carry"))).drop("__c", "__km", "__kc", "__carry")


def add_event_horizon_labels(df: DataFrame, horizon: int = 30, event_col: str = "failure_event",
                             out: str = "failure_imminent_event") -> DataFrame:
    """W5 (event form): 1 on the H+1 steps [f-H, f] before each failure f, else 0; the
    first failure at or after a row decides, whatever the horizon."""
    rows = next_event(df, event_col, "__next")
    return rows.withColumn(out, F.coalesce((F.col("__next") - F.col(TIME) <= horizon).cast("int"), F.lit(0))).drop("__next")


def steps_to_failure(t: Column, failure_t: Column) -> Column:
    """failure_t - t when a failure exists at or after t, else NULL."""
    return F.when(failure_t.isNotNull() & (failure_t >= t), failure_t - t)


def degradation_stage(progress: Column) -> Column:
    """0 -> normal, < 1 -> degradation, otherwise post_failure_region."""
    return (F.when(progress == 0.0, F.lit("normal"))
             .when(progress < 1.0, F.lit("degradation"))
             .otherwise(F.lit("post_failure_region")))


def latent_progress(t: Column, start: Column, end: Column) -> Column:
    """W7 latent ramp: 0 before ``start``, linear to 1 at ``end``, rounded to 4."""
    span = F.greatest(end - start, F.lit(1))
    return F.round(F.least(F.greatest((t - start) / span, F.lit(0.0)), F.lit(1.0)), 4)


def _clean(c: str) -> Column:
    return F.when(~F.isnan(F.col(c)), F.col(c))


def forward_fill(df: DataFrame, cols: list[str], order_col: str = TIME,
                 chunk_len: int = 100_000) -> DataFrame:
    """Replace NULL/NaN by the machine's previous non-missing value.

    Skew-safe: rows are cut into chunks of ``chunk_len`` steps; the last value
    of each chunk (small table) gives the carry into the next chunk, and the
    fill inside a chunk is a window over (machine, chunk). Rows with no
    earlier value stay NULL.
    """
    tagged = df.withColumn("__c", F.floor(F.col(order_col) / F.lit(chunk_len)).cast("long"))
    lasts = tagged.groupBy(MACHINE, "__c").agg(
        *[F.max_by(_clean(c), F.when(_clean(c).isNotNull(), F.col(order_col))).alias(f"__last_{c}")
          for c in cols])
    prev = Window.partitionBy(MACHINE).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    carries = lasts.select(MACHINE, "__c", *[
        F.last(f"__last_{c}", ignorenulls=True).over(prev).alias(f"__carry_{c}") for c in cols])
    right = carries.withColumnsRenamed({MACHINE: "__km", "__c": "__kc"})
    joined = tagged.join(right, F.col(MACHINE).eqNullSafe(F.col("__km")) & F.col("__c").eqNullSafe(F.col("__kc"))).drop("__km", "__kc")
    w = (Window.partitionBy(MACHINE, "__c").orderBy(order_col)
         .rowsBetween(Window.unboundedPreceding, 0))
    out = joined
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.last(_clean(c), ignorenulls=True).over(w),
                                           F.col(f"__carry_{c}")))
    return out.drop("__c", *[f"__carry_{c}" for c in cols])


def lag_coupling(df: DataFrame, driver: str, follower: str, chunk_len: int = 100_000) -> DataFrame:
    """Per-machine correlation of ``follower`` with the previous reading of ``driver``.

    The lag runs inside chunks of ``chunk_len`` steps; a chunk's first reading
    takes the last value of the machine's chunk before it from the small chunk
    table. A machine with one reading has no pair (NULL, 0).
    """
    tagged = df.select(MACHINE, TIME, F.col(driver).alias("__d"), F.col(follower).alias("__f"),
                       F.floor(F.col(TIME) / F.lit(chunk_len)).cast("long").alias("__c"))
    last = tagged.groupBy(MACHINE, "__c").agg(F.max(F.struct(TIME, "__d")).alias("__last"))
    carry = last.select(F.col(MACHINE).alias("__km"), F.col("__c").alias("__kc"),
                        F.lag("__last").over(Window.partitionBy(MACHINE).orderBy("__c"))["__d"].alias("__carry"))
    w = Window.partitionBy(MACHINE, "__c").orderBy(TIME)
    rows = tagged.withColumn("__first", F.row_number().over(w) == 1).withColumn("__prev", F.lag("__d").over(w))
    rows = rows.join(carry, F.col(MACHINE).eqNullSafe(F.col("__km")) & F.col("__c").eqNullSafe(F.col("__kc")))
    prev = F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__prev"))
    return (rows.withColumn("__lag", prev).groupBy(MACHINE)
                .agg(F.corr("__f", "__lag").alias("lag_corr"), F.count("__lag").alias("n_pairs")))
