"""Data-quality validation: missing columns, NaN share, value ranges, target
domain and timestep monotonicity -- one wide aggregation, reported as tidy
(check, column, severity, n_bad, fraction) rows.

NULL and NaN are both "missing" (pandas' ``isnull`` covers both).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labels import MACHINE, TIME
from .sequence import MARK, PART, inside, lay_out, part_table


@dataclass
class SensorSchema:
    columns: list[str]
    target_column: str
    value_ranges: dict[str, tuple[float, float]]
    max_nan_fraction: float = 0.05
    max_out_of_range_fraction: float = 0.01
    required_columns: list[str] = field(default_factory=list)


# The reference's default sensor schema (name, valid range).
DEFAULT_SCHEMA = SensorSchema(
    columns=["temperature", "vibration", "pressure", "rpm", "current"],
    target_column="failure_imminent",
    value_ranges={"temperature": (0.0, 500.0), "vibration": (0.0, 100.0), "pressure": (0.0, 50.0),
                  "rpm": (0.0, 10000.0), "current": (0.0, 100.0)},
    required_columns=["machine_id", "timestep"])

# Schema of the readings derived from the driver tables.
READINGS_SCHEMA = SensorSchema(
    columns=["quantity", "price", "discount", "tax"],
    target_column="failure_imminent",
    value_ranges={"quantity": (0.0, 50.0), "price": (0.0, 200000.0), "discount": (0.0, 0.1),
                  "tax": (0.0, 0.08)},
    required_columns=["machine_id", "timestep"])


# Per-reading bounds of an inference request, as
# (low, high, low inclusive, high inclusive).
API_READING_BOUNDS = {
    "temperature": (0.0, 500.0, False, False),
    "vibration": (0.0, 100.0, True, False),
    "pressure": (0.0, 50.0, True, False),
    "rpm": (0.0, 10000.0, True, False),
    "current": (0.0, 100.0, True, False),
}


def route_api_readings(df: DataFrame) -> DataFrame:
    """P3 with the request bounds: reject_reason per reading row."""
    return route_rows(df, {c: (lo, hi) for c, (lo, hi, _, _) in API_READING_BOUNDS.items()},
                      closed={c: (li, hi_) for c, (_, _, li, hi_) in API_READING_BOUNDS.items()})


def missing(c: str) -> Column:
    """NULL or NaN."""
    return F.col(c).isNull() | F.isnan(F.col(c))


def _row(check, column, severity, n_bad, fraction) -> Column:
    return F.struct(F.lit(check).alias("check"), F.lit(column).cast("string").alias("column"),
                    severity.alias("severity"), n_bad.cast("long").alias("n_bad"),
                    fraction.cast("double").alias("fraction"))


def _sev(frac: Column, n_bad: Column, error_above: float) -> Column:
    return (F.when(frac > error_above, F.lit("error")).when(n_bad > 0, F.lit("warning"))
             .otherwise(F.lit("ok")))


def non_monotone_machines(df: DataFrame, ingest_cols: list[str]) -> DataFrame:
    """Machines whose timestep decreases somewhere in ingest order (non-strict).

    Rows are laid out in ingest order; the previous reading is a ``lag`` inside
    each (machine, part), and the borders between parts are compared in the
    small part table -- no self-join, no per-machine task.
    """
    laid = lay_out(df.select(MACHINE, TIME, *ingest_cols), MACHINE, ingest_cols)
    prev = F.lag(TIME).over(inside(MACHINE))
    within = laid.withColumn("__prev", prev).where(F.col(TIME) < F.col("__prev")).select(MACHINE)
    parts = part_table(laid, MACHINE, {"__t0": F.min_by(TIME, MARK), "__t1": F.max_by(TIME, MARK)})
    border = F.lag("__t1").over(Window.partitionBy(MACHINE).orderBy(PART))
    across = parts.withColumn("__prev", border).where(F.col("__t0") < F.col("__prev")).select(MACHINE)
    return within.unionByName(across).distinct()


def validate(df: DataFrame, schema: SensorSchema = READINGS_SCHEMA,
             ingest_cols: list[str] | None = None) -> DataFrame:
    """Tidy validation report; ``passed`` = no 'error' rows (see ``passed``)."""
    cols = set(df.columns)
    required = sorted((set(schema.required_columns) | set(schema.columns)) - cols)
    present = [c for c in schema.columns if c in cols]
    ranged = [(c, lo, hi) for c, (lo, hi) in schema.value_ranges.items() if c in cols]
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in present:
        aggs.append(F.count_if(missing(c)).alias(f"nan__{c}"))
    for c, lo, hi in ranged:
        valid = ~missing(c)
        aggs += [F.count_if(valid).alias(f"valid__{c}"),
                 F.count_if(valid & ((F.col(c) < lo) | (F.col(c) > hi))).alias(f"oor__{c}")]
    tgt = schema.target_column
    if tgt in cols:
        bad = F.when(~F.col(tgt).cast("double").isin(0.0, 1.0) & F.col(tgt).isNotNull(), F.col(tgt))
        aggs.append(F.count_distinct(bad).alias("__badtgt"))
    one = df.agg(*aggs)
    n = F.col("__n")
    rows = [_row("missing_columns", c, F.lit("error"), F.lit(1), F.lit(None)) for c in required]
    for c in present:
        k = F.col(f"nan__{c}")
        frac = F.when(n > 0, k / n).otherwise(F.lit(0.0))
        rows.append(_row("nan", c, _sev(frac, k, schema.max_nan_fraction), k, frac))
    for c, lo, hi in ranged:
        k, v = F.col(f"oor__{c}"), F.col(f"valid__{c}")
        frac = F.when(v > 0, k / v).otherwise(F.lit(0.0))
        rows.append(_row("range", c, _sev(frac, k, schema.max_out_of_range_fraction), k, frac))
    if tgt in cols:
        k = F.col("__badtgt")
        rows.append(_row("target_binary", tgt, F.when(k > 0, F.lit("error")).otherwise(F.lit("ok")), k,
                         F.lit(None)))
    report = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if ingest_cols and MACHINE in cols and TIME in cols:
        nm = non_monotone_machines(df, ingest_cols).agg(F.count(F.lit(1)).alias("k"))
        k = F.col("k")
        mono = nm.select(_row("monotone_timestep", TIME,
                              F.when(k > 0, F.lit("warning")).otherwise(F.lit("ok")), k, F.lit(None)).alias("r"))
        report = report.unionByName(mono.select("r.*"))
    return report


def passed(report: DataFrame) -> bool:
    return report.where(F.col("severity") == "error").limit(1).count() == 0


def guard_counts(df: DataFrame, sensor_cols: list[str], target: str) -> DataFrame:
    """P7's one-row check (n_rows, n_missing); a missing column raises ``ValueError``."""
    absent = ({MACHINE, TIME, target} | set(sensor_cols)) - set(df.columns)
    if absent:
        raise ValueError(f"DataFrame missing columns: {sorted(absent)}")
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  sum((F.count_if(missing(c)) for c in sensor_cols), F.lit(0)).alias("n_missing"))


def require_clean(df: DataFrame, sensor_cols: list[str], target: str) -> DataFrame:
    """Guard before windowing. Missing columns and missing sensor values
    (NULL or NaN) raise ``ValueError``; returns the one-row check."""
    check = guard_counts(df, sensor_cols, target)
    n = check.first()["n_missing"]
    if n:
        raise ValueError(f"{n} missing sensor values: impute or drop them before windowing")
    return check


def route_rows(df: DataFrame, bounds: dict[str, tuple[float, float]],
               closed: dict[str, tuple[bool, bool]] | None = None) -> DataFrame:
    """``reject_reason`` = first failing rule (column order): 'missing:<c>' for
    NULL/NaN, 'range:<c>' outside bounds; NULL when the row is accepted.
    ``closed`` gives (low inclusive, high inclusive) per column (default both)."""
    reason = None
    for c, (lo, hi) in bounds.items():
        lo_inc, hi_inc = (closed or {}).get(c, (True, True))
        below = (F.col(c) < lo) if lo_inc else (F.col(c) <= lo)
        above = (F.col(c) > hi) if hi_inc else (F.col(c) >= hi)
        for cond, label in ((missing(c), f"missing:{c}"), (below | above, f"range:{c}")):
            reason = F.when(cond, F.lit(label)) if reason is None else reason.when(cond, F.lit(label))
    return df.withColumn("reject_reason", reason)
