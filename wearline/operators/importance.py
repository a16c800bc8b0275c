"""Model-agnostic importances: sensor / time-bin permutation (M7, M8), input
sensitivity (M13) and their composition (M9).

Every variant (sensor, bin or position) is a tag on a copy of the windows, so
ONE ``transform`` scores all of them; metrics are then grouped by the tag.

Permutation across samples: per repeat, window keys are ranked by two
independent hashes and rank k of the first order receives the donor values of
rank k of the second -- a uniformly random permutation. Keys are ranked and
donor windows fetched once per repeat; the variants are made without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegressionModel, MultilayerPerceptronClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .curves import prf
from .metrics import decision
from .models import KEY, FittedClassifier
from .sequence import number_within_key


def donors(keys: DataFrame, n_repeats: int, seed: int = 42) -> DataFrame:
    """(rep, key, donor_key): per repeat a random permutation of the windows. Rank k
    of one md5 order receives from rank k of another; only keys are ranked."""
    reps = keys.select(*KEY, F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("rep"))

    def ranked(salt: str) -> DataFrame:
        h = F.md5(F.concat_ws("-", F.col("rep").cast("string"), *[F.col(k).cast("string") for k in KEY], F.lit(salt), F.lit(str(seed))))
        out = number_within_key(reps.withColumn("__h", h), "rep", ["__h", *KEY], pos_col="__rank", total_col=None)
        return out.select("rep", "__rank", *KEY)

    give = ranked("give").select("rep", "__rank", *[F.col(k).alias(f"donor_{k}") for k in KEY])
    return ranked("recv").join(give, ["rep", "__rank"]).drop("__rank")


def _permuted(windows: DataFrame, variants: list[tuple[int, int]], n_repeats: int, seed: int) -> DataFrame:
    """windows x repeats with the donor's features (shuffled once per repeat); the
    variants are then a narrow explode."""
    give = windows.select(*[F.col(k).alias(f"donor_{k}") for k in KEY], F.col("features").alias("donor"))
    rows = windows.select(*KEY, "label", "features").join(donors(windows, n_repeats, seed), KEY).join(
        give, [f"donor_{k}" for k in KEY]).drop(*[f"donor_{k}" for k in KEY])
    return rows.withColumn("v", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in variants]))
                           ).select(*KEY, "label", "features", "donor", "rep", "v.*")


def _f1_drop(fitted: FittedClassifier, windows: DataFrame, perm: DataFrame, threshold: float) -> DataFrame:
    base = fitted.score(windows)
    p = decision(F.col("y_score"), threshold)
    y = F.col("y_true")

    def cells(df, keys):
        return df.groupBy(*keys).agg(F.count_if((y == 1) & (p == 1)).alias("tp"),
                                     F.count_if((y == 0) & (p == 1)).alias("fp"),
                                     F.count_if((y == 1) & (p == 0)).alias("fn"))
    b = cells(base, [])
    _, _, f1b = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    base_f1 = b.select(f1b.alias("f1")).first()["f1"]
    scored = fitted.score(perm, keep=["a", "b", "rep"])
    c = cells(scored, ["a", "b", "rep"])
    _, _, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("a", "b", "rep", (F.lit(base_f1) - f1).alias("drop"))


def _linear_f1_drop(fitted: FittedClassifier, windows: DataFrame, variants: list[tuple[int, int]], inside: Callable, n_repeats: int,
                    seed: int, threshold: float) -> DataFrame:
    """The same for logistic models. A window's margin is a sum over its inputs, so a
    variant's permuted margin is the window's, less the variant's share, plus the donor's: windows
    travel as their margin and shares, not as features."""
    m, std = fitted.model, fitted.standardizer
    coef, intercept = m.coefficients.toArray(), float(m.intercept)
    mean, dev = (np.array(std.mean), np.array(std.std)) if std else (np.zeros(len(coef)), np.ones(len(coef)))
    pick = np.array([[inside(a, b)(i) for a, b in variants] for i in range(len(coef))], dtype=float)
    mix = np.column_stack((coef, coef[:, None] * pick))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = ((batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1) - mean) / dev) @ mix
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*KEY, "y")], pa.array(out[:, 0] + intercept),
                                                  pa.array(out[:, 1:].tolist(), pa.list_(pa.float64()))], names=[*KEY, "y", "m", "s"])

    typed = [f"{k} {windows.schema[k].dataType.simpleString()}" for k in KEY]
    rows = store(windows.select(*KEY, F.col("label").cast("int").alias("y"), "features").mapInArrow(
        run, ", ".join([*typed, "y int", "m double", "s array<double>"])))
    y = F.col("y")

    def cells(df: DataFrame, *keys: str) -> DataFrame:
        p = decision(1 / (1 + F.exp(-F.col("m"))), threshold)
        c = df.groupBy(*keys).agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                                  F.count_if((y == 1) & (p == 0)).alias("fn"))
        return c.select(*keys, prf(F.col("tp"), F.col("fp"), F.col("fn"))[2].alias("f1"))

    base_f1 = cells(rows).first()["f1"]
    give = rows.select(*[F.col(k).alias(f"donor_{k}") for k in KEY], F.col("s").alias("d"))
    perm = rows.join(donors(rows, n_repeats, seed), KEY).join(give, [f"donor_{k}" for k in KEY])
    tags = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col("m") - F.get("s", F.lit(i)) + F.get("d", F.lit(i))).alias("m"))
                     for i, (a, b) in enumerate(variants)])
    f1 = cells(perm.select("y", "rep", F.explode(tags).alias("v")).select("y", "rep", "v.*"), "a", "b", "rep")
    return f1.select("a", "b", "rep", (F.lit(base_f1) - F.col("f1")).alias("drop"))


def sensor_permutation_importance(fitted: FittedClassifier, windows: DataFrame, sensors: list[str],
                                  n_repeats: int = 5, seed: int = 42, threshold: float = 0.5) -> DataFrame:
    """M7: permute one sensor's whole window sequence across samples (time order
    inside the window kept); F1 drop mean / std (ddof 0) over repeats."""
    nf = len(sensors)
    variants = [(f, f + 1) for f in range(nf)]
    if isinstance(fitted.model, LogisticRegressionModel):
        d = _linear_f1_drop(fitted, windows, variants, lambda a, b: lambda i: i % nf == a, n_repeats, seed, threshold)
    else:
        perm = _permuted(windows, variants, n_repeats, seed)
        perm = perm.withColumn("features", F.transform(
            "features", lambda x, i: F.when((i % nf) == F.col("a"), F.element_at("donor", i + 1)).otherwise(x)))
        d = _f1_drop(fitted, windows, perm.drop("donor"), threshold)
    names = F.lit(sensors)
    return (d.groupBy("a").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))
             .select(F.element_at(names, F.col("a") + 1).alias("sensor"), "importance_mean", "importance_std"))


def time_bins(window_size: int, n_bins: int = 10) -> list[tuple[int, int]]:
    """M8 bins: ``linspace(0, T, k+1).astype(int)`` with k = min(n_bins, T)."""
    k = min(n_bins, window_size)
    e = np.linspace(0, window_size, k + 1).astype(int).tolist()
    return [(e[i], e[i + 1]) for i in range(k)]


def temporal_permutation_importance(fitted: FittedClassifier, windows: DataFrame, window_size: int,
                                    n_sensors: int, n_bins: int = 10, n_repeats: int = 5, seed: int = 42,
                                    threshold: float = 0.5) -> DataFrame:
    """M8: permute all sensors inside one time bin across samples; F1 drop per bin."""
    nf, variants = n_sensors, time_bins(window_size, n_bins)
    if isinstance(fitted.model, LogisticRegressionModel):
        d = _linear_f1_drop(fitted, windows, variants, lambda a, b: lambda i: a <= i // nf < b, n_repeats, seed, threshold)
    else:
        perm = _permuted(windows, variants, n_repeats, seed)
        perm = perm.withColumn("features", F.transform(
            "features", lambda x, i: F.when(((i / nf).cast("int") >= F.col("a")) & ((i / nf).cast("int") < F.col("b")),
                                            F.element_at("donor", i + 1)).otherwise(x)))
        d = _f1_drop(fitted, windows, perm.drop("donor"), threshold)
    return (d.groupBy("a", "b").agg(F.avg("drop").alias("importance_mean"),
                                    F.stddev_pop("drop").alias("importance_std"))
             .select(F.col("a").alias("t_start"), F.col("b").alias("t_end"), "importance_mean", "importance_std"))


def mean_slopes(fitted: FittedClassifier, windows: DataFrame) -> list[float] | None:
    """Mean |d score / d input| of every input by the chain rule, in one pass over the
    windows; None for models without derivatives (forests).

    Logistic: |coefficient| / deviation * mean p (1 - p). Networks: the score's derivative goes
    back through the layers, a block of windows at a time; a task returns one sum
    an input.
    """
    m, std = fitted.model, fitted.standardizer
    if isinstance(m, LogisticRegressionModel):
        p = F.col("y_score")
        level = fitted.score(windows).agg(F.avg(p * (1 - p))).first()[0] or 0.0
        return [abs(float(c)) / s * level for c, s in zip(m.coefficients.toArray(), std.std if std else repeat(1.0))]
    if not isinstance(m, MultilayerPerceptronClassificationModel):
        return None
    sizes, flat = list(m.getLayers()), m.weights.toArray()
    layers, at = [], 0
    for n_in, n_out in zip(sizes, sizes[1:]):  # a layer's weights by input, then its offsets
        layers.append((flat[at:at + n_in * n_out].reshape(n_in, n_out), flat[at + n_in * n_out:at + n_in * n_out + n_out]))
        at += (n_in + 1) * n_out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(sizes[0]), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out, hidden = batch.column("z").flatten().to_numpy().reshape(batch.num_rows, -1), []
            for w, b in layers[:-1]:
                out = 1 / (1 + np.exp(-(out @ w + b)))
                hidden.append(out)
            w, b = layers[-1]
            margin = out @ (w[:, 1] - w[:, 0]) + b[1] - b[0]
            p = 1 / (1 + np.exp(-margin))
            slope = (p * (1 - p))[:, None] * (w[:, 1] - w[:, 0])
            for (w, _), h in zip(reversed(layers[:-1]), reversed(hidden)):
                slope = (slope * h * (1 - h)) @ w.T
            total += np.abs(slope).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sizes[0], dtype=np.int32)), pa.array(total), pa.array(np.full(sizes[0], n))],
                                         names=["pos", "g", "n"])

    z = windows.select((std.standardized() if std else F.col("features")).alias("z"))
    rows = z.mapInArrow(run, "pos int, g double, n long").groupBy("pos").agg((F.sum("g") / F.greatest(F.sum("n"), F.lit(1))).alias("g")).collect()
    return [r["g"] / s for r, s in zip(sorted(rows, key=lambda r: r["pos"]), std.std if std else repeat(1.0))]


def sensitivity_map(fitted: FittedClassifier, windows: DataFrame, window_size: int, sensors: list[str],
                    eps: float = 1e-3, by: str = "slopes") -> DataFrame:
    """Mean sensitivity of the score to each (t, sensor), divided by its maximum
    + 1e-10 (re-aim of gradient saliency).

    ``by="slopes"``: mean |derivative| by the chain rule, one pass and no copies
    (``mean_slopes``). Forests have no derivative: they, and ``by="steps"``, the
    checked parity mode, take mean |score(x + eps e_tf) - score(x)| / eps.
    """
    nf = len(sensors)
    slopes = mean_slopes(fitted, windows) if by == "slopes" else None
    if slopes is not None:
        agg = windows.sparkSession.createDataFrame(list(enumerate(slopes)), "pos int, g double")
        mx = max(slopes, default=0.0)
    else:
        agg = store(_stepped(fitted, windows, window_size * nf, eps))  # one row per position, read twice
        mx = agg.agg(F.max("g")).first()[0] or 0.0
    names = F.lit(sensors)
    return agg.select((F.col("pos") / nf).cast("int").alias("t"),
                      F.element_at(names, (F.col("pos") % nf) + 1).alias("sensor"),
                      (F.col("g") / (mx + 1e-10)).alias("sensitivity"))


def _stepped(fitted: FittedClassifier, windows: DataFrame, n: int, eps: float) -> DataFrame:
    """(pos, g): mean absolute change of the score by a step of ``eps`` in each input."""
    std = fitted.standardizer
    z = std.standardized() if std else F.col("features")
    step = F.element_at(F.lit([eps / s for s in std.std]), F.col("pos") + 1) if std else F.lit(eps)
    base = fitted.score_inputs(windows.select(z.alias("z")), "z", "s0")
    pert = base.select("s0", "z", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos"))
    # one changed value between two copied slices
    pert = pert.select("s0", "pos", F.concat(F.slice("z", F.lit(1), F.col("pos")), F.array(F.get("z", "pos") + step),
                                             F.slice("z", F.col("pos") + 2, F.lit(n))).alias("z"))
    s = fitted.score_inputs(pert, "z", "y_score")
    return s.groupBy("pos").agg((F.avg(F.abs(F.col("y_score") - F.col("s0"))) / eps).alias("g"))


def all_importances(fitted: FittedClassifier, windows: DataFrame, window_size: int, sensors: list[str],
                    n_repeats: int = 5, seed: int = 42, threshold: float = 0.5) -> DataFrame:
    """M9: intrinsic (if the model has one), sensor and temporal permutation
    importances as one tidy table (kind, item, importance)."""
    from .models import intrinsic_importance, sensor_rollup
    parts = []
    try:
        imp = sensor_rollup(intrinsic_importance(fitted, window_size, len(sensors), sensors))
        parts.append(imp.select(F.lit("intrinsic").alias("kind"), F.col("sensor").alias("item"),
                                F.col("importance")))
    except AttributeError:
        pass
    sp = sensor_permutation_importance(fitted, windows, sensors, n_repeats, seed, threshold)
    parts.append(sp.select(F.lit("sensor_permutation").alias("kind"), F.col("sensor").alias("item"),
                           F.col("importance_mean").alias("importance")))
    tp = temporal_permutation_importance(fitted, windows, window_size, len(sensors), 10, n_repeats, seed, threshold)
    parts.append(tp.select(F.lit("temporal_permutation").alias("kind"),
                           F.concat_ws("-", F.col("t_start").cast("string"), F.col("t_end").cast("string")).alias("item"),
                           F.col("importance_mean").alias("importance")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
