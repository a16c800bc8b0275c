"""Preparation: machine split, scalers, sliding windows, class weights.

Scale notes
-----------
* The split is decided on the *distinct machine ids* (one row per machine)
  and reaches the readings as a machine attribute of the numbering's small
  part table -- one ``split`` column, no fact-table join on the machine.
* Scaler parameters are one aggregate row (F sensors x 2 numbers) turned
  into literals on the driver; applying them is a projection.
* Windows are built per (machine, chunk) where a chunk holds ``chunk_len``
  steps plus the T-1 steps before it, so no group ever holds a whole
  machine's series -- a hot machine is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, asdict
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .labels import MACHINE, TIME
from .selection import select_quantiles
from .sequence import MARK, number_within_key

SCALERS = ("standard", "minmax", "robust")


# ---------------------------------------------------------------- split (F1)

def split_machines(df: DataFrame, test_size: float = 0.2, val_size: float = 0.1,
                   seed: int = 42) -> DataFrame:
    """(machine_id, split) with split in {train, val, test}.

    Machines are ordered by ``md5(concat(id, '-', seed))``;
    ``n_test = max(1, int(n*test_size))``, ``n_val = max(1, int((n-n_test)*val_size))``.
    The ordering runs over the distinct-id table (one row per machine), laid
    out by hash over range partitions.
    """
    ids = df.select(MACHINE).distinct()
    key = F.md5(F.concat(F.col(MACHINE).cast("string"), F.lit(f"-{seed}")))
    ranked = number_within_key(ids.select(MACHINE, key.alias("__h"), F.lit(0).alias("__all")), "__all",
                               ["__h", MACHINE], pos_col="__r", total_col=None)
    n = ranked.count()
    n_test = max(1, int(n * test_size))
    n_val = max(1, int((n - n_test) * val_size))
    if n - n_test - n_val <= 0:
        raise ValueError(f"{n} machines leave no training machine "
                         f"(test {n_test}, val {n_val})")
    split = (F.when(F.col("__r") < n_test, F.lit("test"))
              .when(F.col("__r") < n_test + n_val, F.lit("val"))
              .otherwise(F.lit("train")))
    return ranked.select(MACHINE, split.alias("split"))


def attach_split(df: DataFrame, splits: DataFrame) -> DataFrame:
    """One equi-join attaching ``split`` (machine table: one row per machine).
    Tables built with the split as a machine attribute need no such join."""
    return df.join(splits, MACHINE)


def split_overlap(splits: DataFrame) -> DataFrame:
    """U4: machines appearing in more than one split (must be empty)."""
    a, b = splits.alias("a"), splits.alias("b")
    return (a.join(b, (F.col("a.machine_id") == F.col("b.machine_id")) &
                   (F.col("a.split") < F.col("b.split")))
             .select(F.col("a.machine_id").alias(MACHINE),
                     F.col("a.split").alias("split_a"), F.col("b.split").alias("split_b")))


# ---------------------------------------------------------------- scalers

@dataclass
class FittedScaler:
    kind: str
    columns: list[str]
    center: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "FittedScaler":
        return FittedScaler(**json.loads(text))

    def params_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c, float(self.center[c]), float(self.scale[c])) for c in self.columns]
        return spark.createDataFrame(rows, "sensor string, center double, scale double")


QUARTILES = (0.25, 0.5, 0.75)


def scaler_table(df: DataFrame, columns: list[str], kinds: str | Sequence[str] = "standard") -> DataFrame:
    """F2/F3/F4 parameters as rows (kind, sensor, center, scale); zero scale -> 1.

    Standard (ddof 0) and min-max come from one aggregate of ``df`` whatever the
    number of sensors; robust from exact quartiles by selection (four scans).
    """
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    if unknown := set(kinds) - set(SCALERS):
        raise ValueError(f"unknown scaler {sorted(unknown)[0]!r}")
    out = None
    if plain := [k for k in kinds if k != "robust"]:
        x = {c: F.col(c).cast("double") for c in columns}
        one = df.agg(*[a.alias(f"{c}__{n}") for c in columns for n, a in (
            ("mean", F.avg(x[c])), ("std", F.stddev_pop(x[c])), ("min", F.min(x[c])), ("max", F.max(x[c])))])
        center = {"standard": lambda c: F.col(f"{c}__mean"), "minmax": lambda c: F.col(f"{c}__min")}
        scale = {"standard": lambda c: F.col(f"{c}__std"), "minmax": lambda c: F.col(f"{c}__max") - F.col(f"{c}__min")}
        out = one.select(F.explode(F.array(*[
            F.struct(F.lit(k).alias("kind"), F.lit(c).alias("sensor"), center[k](c).alias("center"), scale[k](c).alias("scale"))
            for k in plain for c in columns])).alias("r")).select("r.*")
    if "robust" in kinds:
        q = select_quantiles(df, [], columns, QUARTILES)
        every = df.sparkSession.createDataFrame([(c,) for c in columns], "sensor string")
        robust = F.broadcast(every).join(q, "sensor", "left").select(
            F.lit("robust").alias("kind"), "sensor", F.col("q")[1].alias("center"), (F.col("q")[2] - F.col("q")[0]).alias("scale"))
        out = robust if out is None else out.unionByName(robust)
    return out.select("kind", "sensor", F.coalesce("center", F.lit(0.0)).alias("center"),
                      F.when(F.col("scale").isNull() | (F.col("scale") == 0), F.lit(1.0)).otherwise(F.col("scale")).alias("scale"))


def fit_scaler(df: DataFrame, columns: list[str], kind: str = "standard") -> FittedScaler:
    """F2/F3/F4 fit: standard (ddof 0, sigma 0 -> 1), min-max (range 0 -> 1), robust (IQR 0 -> 1)."""
    rows = {r["sensor"]: r for r in scaler_table(df, columns, kind).collect()}
    return FittedScaler(kind, list(columns), {c: float(rows[c]["center"]) for c in columns},
                        {c: float(rows[c]["scale"]) for c in columns})


def apply_scaler(df: DataFrame, scaler: FittedScaler | None) -> DataFrame:
    """projection with literal parameters; an unfitted scaler is an error."""
    if scaler is None:
        raise RuntimeError("scaler is not fitted")
    out = df
    for c in scaler.columns:
        out = out.withColumn(c, (F.col(c) - F.lit(scaler.center[c])) / F.lit(scaler.scale[c]))
    return out


# ---------------------------------------------------------------- windows (W1, W2, W8 rows)

def is_window_end(pos: Column, window_size: int, step_size: int) -> Column:
    """Row at position ``pos`` closes a window: pos >= T-1 and (pos-(T-1)) % S == 0."""
    return (pos >= window_size - 1) & (((pos - (window_size - 1)) % step_size) == 0)


def window_end_rows(df: DataFrame, window_size: int, step_size: int,
                    pos_col: str = TIME) -> DataFrame:
    """Rows that close a window -- the window table without feature arrays."""
    return df.where(is_window_end(F.col(pos_col), window_size, step_size))


def sliding_windows(df: DataFrame, feature_cols: list[str], window_size: int, step_size: int,
                    label_col: str = "failure_imminent", pos_col: str = TIME,
                    keep_cols: list[str] | None = None, chunk_len: int = 4096,
                    nested: bool = False, partitions: int | None = None) -> DataFrame:
    """W1 + W2: one row per window with flattened ``features`` (index t*F + f).

    ``pos_col`` must be a dense 0-based position per machine (the readings
    timestep is). Windows start at 0, S, 2S... while start+T <= n, carry the
    label of their last row, never span two machines, and machines with
    n < T give none. Output: machine_id, end_timestep, label, features
    (array<double>, T*F), plus ``keep_cols`` taken from the last row.
    ``partitions`` (see ``window_partitions``) fixes how many tasks build them.
    """
    T, S = int(window_size), int(step_size)
    C = max(int(chunk_len), T)
    keep_cols = list(keep_cols or [])
    row = F.struct(F.col(pos_col).alias("p"),
                   F.array(*[F.col(c).cast("double") for c in feature_cols]).alias("v"),
                   F.col(label_col).cast("int").alias("y"),
                   *[F.col(c).alias(c) for c in keep_cols])
    home = F.floor(F.col(pos_col) / C).cast("long")
    # a row is also needed by the next chunk when it lies in that chunk's first T-1 lookback
    spill = F.when((F.col(pos_col) % C) >= C - (T - 1), home + 1)
    tagged = df.select(MACHINE, row.alias("r"),
                       F.explode(F.array_compact(F.array(home, spill))).alias("__chunk"))
    if partitions:
        tagged = tagged.repartition(partitions, MACHINE, "__chunk")
    grouped = tagged.groupBy(MACHINE, "__chunk").agg(F.array_sort(F.collect_list("r")).alias("seq"))
    p0 = F.col("seq")[0]["p"]
    p_last = F.element_at("seq", -1)["p"]
    lo = F.greatest(F.col("__chunk") * C, F.lit(T - 1))
    first_end = lo + (F.lit(S) - ((lo - (T - 1)) % S)) % S
    last_end = F.least(F.col("__chunk") * C + (C - 1), p_last)
    ends = grouped.where(first_end <= last_end).select(
        MACHINE, "seq", p0.alias("__p0"),
        F.explode(F.sequence(first_end, last_end, F.lit(S).cast("long"))).alias("end_timestep"))
    win = F.slice(F.col("seq"), (F.col("end_timestep") - (T - 1) - F.col("__p0") + 1).cast("int"), T)
    last = F.element_at(F.col("seq"), (F.col("end_timestep") - F.col("__p0") + 1).cast("int"))
    out = ends.select(
        MACHINE, "end_timestep",
        last["y"].alias("label"),
        *[last[c].alias(c) for c in keep_cols],
        (F.transform(win, lambda r: r["v"]) if nested else
         F.flatten(F.transform(win, lambda r: r["v"]))).alias("features"))
    return out


def window_partitions(df: DataFrame, rows_a_task: int = 500_000) -> int | None:
    """Tasks that build the windows of ``df`` (its rows with arrays are sorted in memory),
    None where the session's shuffle partitions are enough."""
    need = -(-df.count() // rows_a_task)
    return need if need > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def last_n_window(df: DataFrame, feature_cols: list[str], window_size: int,
                  pos_col: str = TIME, total_col: str = "n_readings") -> DataFrame:
    """The last T rows of each machine; fewer rows are padded by
    repeating the last row. One window per machine.

    ``total_col`` (rows of the machine, as the numbering attaches it) lets rows
    beyond the last T go before any shuffle; without it the table is numbered
    first. A group holds at most T rows.
    """
    T = int(window_size)
    if total_col not in df.columns:
        df = number_within_key(df, MACHINE, [pos_col], pos_col="__p", total_col=total_col)
        pos_col = "__p"
    tail = df.where(F.col(pos_col) >= F.col(total_col) - T)
    row = F.struct(F.col(pos_col).alias("p"),
                   F.array(*[F.col(c).cast("double") for c in feature_cols]).alias("v"))
    g = tail.groupBy(MACHINE).agg(F.array_sort(F.collect_list(row)).alias("seq"), F.first(total_col).alias("n"))
    vals = F.transform(F.col("seq"), lambda r: r["v"])
    pad = F.array_repeat(F.element_at(vals, -1), F.greatest(F.lit(T) - F.size(vals), F.lit(0)))
    return g.select(MACHINE, F.least(F.col("n"), F.lit(T)).cast("int").alias("n_used"),
                    F.flatten(F.concat(vals, pad)).alias("features"))


# ---------------------------------------------------------------- weights & stats

def pos_weight(labels: DataFrame, label_col: str = "label") -> DataFrame:
    """n_neg / n_pos (1.0 without positives) and balanced weights n/(2 n_c)."""
    n_pos = F.sum(F.col(label_col))
    n = F.count(F.lit(1))
    return labels.agg(
        n.alias("n"), n_pos.alias("n_pos"),
        F.when(n_pos > 0, (n - n_pos) / n_pos).otherwise(F.lit(1.0)).alias("pos_weight"),
        F.when(n_pos > 0, n / (2.0 * n_pos)).alias("weight_pos"),
        F.when(n - n_pos > 0, n / (2.0 * (n - n_pos))).alias("weight_neg"))


def with_balanced_weight(df: DataFrame, label_col: str = "label", out: str = "weight") -> DataFrame:
    """``class_weight='balanced'`` as a column: n / (2 n_class) via one small aggregate."""
    w = pos_weight(df, label_col).first()
    wp = w["weight_pos"] or 1.0
    wn = w["weight_neg"] or 1.0
    return df.withColumn(out, F.when(F.col(label_col) == 1, F.lit(wp)).otherwise(F.lit(wn)))


def split_stats(windows: DataFrame, label_col: str = "label") -> DataFrame:
    """Windows and positive rate per split."""
    return windows.groupBy("split").agg(F.count(F.lit(1)).alias("n_windows"),
                                        F.avg(F.col(label_col).cast("double")).alias("pos_rate"))


def poisson_resample(df: DataFrame, key_cols: list[str], label_col: str = "label",
                     seed: int = 42) -> DataFrame:
    """class-balanced resampling with replacement, distributed.

    Each row is replicated k ~ Poisson(lambda_c) times with lambda_c = n/(2 n_c)
    (the expected total is n, each class half). k is a sum of m = ceil(lambda_c)
    draws from Poisson(lambda_c / m), each from its own hash of the key, so any
    lambda is exact and a row's work is in proportion to its copies.
    """
    w = pos_weight(df, label_col).first()
    lam = {1: float(w["weight_pos"] or 0.0), 0: float(w["weight_neg"] or 0.0)}
    parts = {y: max(1, math.ceil(x)) for y, x in lam.items()}
    is_pos = F.col(label_col) == 1
    m = F.when(is_pos, F.lit(parts[1])).otherwise(F.lit(parts[0]))
    draws = df.withColumn("__draw", F.explode(F.sequence(F.lit(1), m)))
    u = uniform_hash(*[F.col(c) for c in key_cols], F.col("__draw"), F.lit(seed))
    k = F.when(is_pos, poisson_inverse(u, lam[1] / parts[1])).otherwise(poisson_inverse(u, lam[0] / parts[0]))
    return (draws.withColumn("__k", k).where(F.col("__k") > 0)
                 .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__k")))).drop("__k"))


def balanced_draws(df: DataFrame, key_cols: list[str], label_col: str = "label", n: int | None = None, seed: int = 42) -> DataFrame:
    """exactly ``n`` rows (default: as many as ``df`` has) drawn with replacement,
    each draw a row of either class with probability 1/2, and any row of the
    class alike (weights 1 / n_class). With one class all draws go to it.

    Draw i has a uniform number from its own hash: the first half of [0, 1) is
    the positive class, and the place inside the half is a position in the
    class, whose rows are numbered by key over range partitions. Draws are
    counted per (class, position) and joined to the rows on it, so the result
    depends on keys and seed alone, not on partitions; a row travels once
    whatever its copies. Columns of ``df`` and ``copy`` (from 1).
    """
    spark = df.sparkSession
    y = (F.col(label_col) == 1).cast("int")
    numbered = number_within_key(df.withColumn("__y", y), "__y", key_cols, pos_col="__at", total_col=None).drop(MARK)
    sizes = {r["__y"]: r["n"] for r in df.groupBy(y.alias("__y")).agg(F.count(F.lit(1)).alias("n")).collect() if r["__y"] is not None}
    total = sum(sizes.values())
    if not total:
        return numbered.drop("__y", "__at").withColumn("copy", F.lit(1)).where("false")
    u = uniform_hash(F.lit("draw"), F.col("id"), F.lit(seed))
    both = len(sizes) == 2
    side = F.when(u < 0.5, F.lit(1)).otherwise(F.lit(0)) if both else F.lit(next(iter(sizes)))
    inside = F.when(u < 0.5, 2 * u).otherwise(2 * u - 1) if both else u
    m = F.when(side == 1, F.lit(sizes.get(1, 0))).otherwise(F.lit(sizes.get(0, 0)))
    draws = spark.range(n if n is not None else total).select(side.alias("__y"), F.least(F.floor(inside * m), m - 1).cast("long").alias("__at"))
    copies = draws.groupBy("__y", "__at").agg(F.count(F.lit(1)).cast("int").alias("__k"))
    return (numbered.join(copies, ["__y", "__at"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__k"))))
                    .drop("__y", "__at", "__k"))


def uniform_hash(*cols: Column) -> Column:
    """Deterministic uniform in [0, 1): the first 52 bits of the md5 of the values
    joined by '-' (any SQL engine can repeat it)."""
    h = F.md5(F.concat_ws("-", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_cdf(lam: float) -> list[float]:
    """P(X <= k), k = 0, 1, ... until it reaches 1 in double precision; lam <= 1."""
    if not 0 <= lam <= 1:
        raise ValueError("split larger rates into draws of at most 1")
    p, cum, out = math.exp(-lam), 0.0, []
    while cum + p > cum:
        cum += p
        out.append(min(cum, 1.0))
        p = p * lam / len(out)
    return out


def poisson_inverse(u: Column, lam: float) -> Column:
    """Smallest k with P(X <= k) > u for X ~ Poisson(lam), lam <= 1: one flat CASE
    over literal CDF values (stays in generated code)."""
    cdf = poisson_cdf(float(lam))
    expr = F.when(u < F.lit(cdf[0]), F.lit(0))
    for k, c in enumerate(cdf[1:], 1):
        expr = expr.when(u < F.lit(c), F.lit(k))
    return expr.otherwise(F.lit(len(cdf)))


def window_size_study(readings: DataFrame, splits: DataFrame | None = None, sizes=(10, 25, 50, 100),
                      label_col: str = "failure_imminent", pos_col: str = TIME) -> DataFrame:
    """F8: windows and positive rate per (window_size, split), stride max(1, T//5).

    End rows only (no arrays): one pass over readings with one row per
    configuration a row closes. Without ``splits`` the readings carry the split.
    """
    confs = F.array(*[F.struct(F.lit(t).alias("T"), F.lit(max(1, t // 5)).alias("S")) for t in sizes])
    r = (readings.select(MACHINE, pos_col, label_col, "split") if splits is None
         else attach_split(readings.select(MACHINE, pos_col, label_col), splits))
    e = r.select("*", F.explode(confs).alias("c"))
    e = e.where(is_window_end(F.col(pos_col), F.col("c.T"), F.col("c.S")))
    return (e.groupBy(F.col("c.T").alias("window_size"), F.col("c.S").alias("step_size"), "split")
             .agg(F.count(F.lit(1)).alias("n_windows"),
                  F.sum(F.col(label_col)).alias("n_positive")))


def sample_windows(windows: DataFrame, n: int = 500, seed: int = 42,
                   key=("machine_id", "end_timestep")) -> DataFrame:
    """T5: deterministic sample of at most ``n`` windows without replacement
    (order by md5 of the key; a distributed top-n, never more than n rows per task)."""
    h = F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    return windows.orderBy(h, *key).limit(n).select(*key)
