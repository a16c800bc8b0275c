"""Window classifiers, calibrators and batch scoring on Spark ML.

Windows arrive as ``features array<double>`` (flattened t*F+f); models see
them as ML vectors (``array_to_vector``). Training, scoring and calibration
are Spark ML estimators/transformers -- executors do the work, the driver
only holds fitted parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .curves import prf
from .forest import fit_forests
from .isotonic import calibrated, fit_blocks
from .metrics import brier_and_ece, decision
from .network import fit_weights
from .prepare import pos_weight, uniform_hash, with_balanced_weight
from .search import MOST_FEATURES, fit_folds, fold_cells, side_by_side

KEY = ["machine_id", "end_timestep"]


@dataclass
class VectorStandardizer:
    """F2 on flattened windows: per-index mean / population std (0 -> 1)."""
    mean: list[float]
    std: list[float]

    @staticmethod
    def fit(windows: DataFrame, features: str = "features") -> "VectorStandardizer":
        v = windows.select(array_to_vector(features).alias("v"))
        row = v.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).first()["s"]
        n = float(row["count"])
        mean = [float(x) for x in row["mean"]]
        var = [float(x) * (n - 1) / n if n > 1 else 0.0 for x in row["variance"]]
        std = [(x ** 0.5) if x > 0 else 1.0 for x in var]
        return VectorStandardizer(mean, std)

    def standardized(self, features: str = "features") -> Column:
        m, s = F.lit(self.mean), F.lit(self.std)
        return F.transform(F.col(features), lambda x, i: (x - F.element_at(m, i + 1)) / F.element_at(s, i + 1))

    def transform(self, windows: DataFrame, features: str = "features", out: str = "x") -> DataFrame:
        return windows.withColumn(out, array_to_vector(self.standardized(features)))


def to_vector(windows: DataFrame, features: str = "features", out: str = "x") -> DataFrame:
    return windows.withColumn(out, array_to_vector(features))


def positive_probability(df: DataFrame, prob_col: str = "probability", out: str = "y_score") -> DataFrame:
    return df.withColumn(out, vector_to_array(prob_col)[1])


@dataclass
class FittedClassifier:
    name: str
    model: Model
    standardizer: VectorStandardizer | None = None

    def score(self, windows: DataFrame, label_col: str = "label", keep: list[str] | None = None) -> DataFrame:
        """(model, window key, y_true, y_score) -- the predictions table."""
        w = (self.standardizer.transform(windows) if self.standardizer else to_vector(windows))
        out = positive_probability(self.model.transform(w))
        return out.select(F.lit(self.name).alias("model"), *KEY, *(keep or []),
                          F.col(label_col).cast("int").alias("y_true"), "y_score")


    def score_inputs(self, df: DataFrame, inputs: str, out: str) -> DataFrame:
        """Adds the score of rows whose ``inputs`` array is already standardised."""
        return positive_probability(self.model.transform(df.withColumn("x", array_to_vector(inputs))), out=out).drop(
            "x", "rawPrediction", "probability", "prediction")


def fit_logistic(train: DataFrame, C: float = 1.0, balanced: bool = True, max_iter: int = 200,
                 label_col: str = "label") -> FittedClassifier:
    """M2: L2 logistic regression on standardised flattened windows.

    sklearn minimises C*sum(w*loss) + ||b||^2/2; Spark averages the weighted
    loss, so regParam = 1/(C * sum(w)).
    """
    std = VectorStandardizer.fit(train)
    t = std.transform(with_balanced_weight(train, label_col) if balanced
                      else train.withColumn("weight", F.lit(1.0)))
    sw = t.agg(F.sum("weight")).first()[0]
    lr = LogisticRegression(featuresCol="x", labelCol=label_col, weightCol="weight",
                            regParam=1.0 / (C * sw), elasticNetParam=0.0, standardization=False,
                            maxIter=max_iter)
    return FittedClassifier("logistic_regression", lr.fit(t), std)


def fit_random_forests(train: DataFrame, sizes: list[tuple[int, int]], balanced: bool = True, seed: int = 42,
                       label_col: str = "label") -> list[FittedClassifier]:
    """M1 for each (trees, depth) of ``sizes``; trees that forests have in common are grown once."""
    w = pos_weight(train, label_col).first() if balanced else {"weight_neg": 1.0, "weight_pos": 1.0}
    weight = (float(w["weight_neg"] or 1.0), float(w["weight_pos"] or 1.0))
    return [FittedClassifier("random_forest", m) for m in fit_forests(train, sizes, weight, seed, label_col)]


def fit_random_forest(train: DataFrame, num_trees: int = 200, max_depth: int = 12,
                      balanced: bool = True, seed: int = 42, label_col: str = "label") -> FittedClassifier:
    """M1: random forest (depth 12, min leaf 2, sqrt features, balanced weights), grown
    over binned windows (``forest``)."""
    return fit_random_forests(train, [(num_trees, max_depth)], balanced, seed, label_col)[0]


def fit_mlp(train: DataFrame, hidden: tuple[int, ...] = (64, 32), max_iter: int = 200, seed: int = 42,
            label_col: str = "label") -> FittedClassifier:
    """Multilayer perceptron on standardised flattened windows (re-aim of the
    reference's sequence networks), fitted over packed blocks (``network``)."""
    std = VectorStandardizer.fit(train)
    layers = [len(std.mean), *hidden, 2]
    # Spark ML draws the start and holds the result; neither needs the windows
    two = train.sparkSession.createDataFrame([(Vectors.dense([0.0] * layers[0]), float(y)) for y in (0, 1)], ["x", label_col])
    mlp = MultilayerPerceptronClassifier(featuresCol="x", labelCol=label_col, layers=layers, maxIter=0, seed=seed)
    start = mlp.fit(two).weights.toArray().tolist()
    weights = fit_weights(train, train.count(), layers, std.mean, std.std, start, max_iter, label_col)
    return FittedClassifier("mlp", mlp.setInitialWeights(Vectors.dense(weights)).fit(two), std)


# ---------------------------------------------------------------- calibration (M3-M5)

@dataclass
class PlattScaler:
    """M3: logistic regression on the raw probability (C = 1, unweighted)."""
    model: Model

    @staticmethod
    def fit(val_preds: DataFrame) -> "PlattScaler":
        d = val_preds.select(array_to_vector(F.array("y_score")).alias("s"), F.col("y_true").cast("double").alias("y"))
        n = d.count()
        lr = LogisticRegression(featuresCol="s", labelCol="y", regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                                standardization=False, maxIter=1000)
        return PlattScaler(lr.fit(d))

    @property
    def coef(self) -> float:
        return float(self.model.coefficients[0])

    @property
    def intercept(self) -> float:
        return float(self.model.intercept)

    def transform(self, preds: DataFrame) -> DataFrame:
        d = preds.withColumn("s", array_to_vector(F.array("y_score")))
        out = self.model.transform(d)
        return out.withColumn("y_score", vector_to_array("probability")[1]).select(*preds.columns)


@dataclass
class IsotonicCalibrator:
    """M4: isotonic fit of label on score (``blocks``: lo, hi, value, n); fitted values
    lie in [0, 1], scores outside the fitted range take the nearest block's."""
    blocks: DataFrame

    @staticmethod
    def fit(val_preds: DataFrame) -> "IsotonicCalibrator":
        return IsotonicCalibrator(fit_blocks(val_preds))

    def transform(self, preds: DataFrame) -> DataFrame:
        return calibrated(preds, self.blocks)


def compare_calibrators(val_preds: DataFrame, test_preds: DataFrame) -> DataFrame:
    """M5: {uncalibrated, platt_scaling, isotonic_regression} x {brier, BSS, ECE} on test."""
    platt = PlattScaler.fit(val_preds)
    iso = IsotonicCalibrator.fit(val_preds)
    tagged = (test_preds.withColumn("method", F.lit("uncalibrated"))
              .unionByName(platt.transform(test_preds).withColumn("method", F.lit("platt_scaling")))
              .unionByName(iso.transform(test_preds).withColumn("method", F.lit("isotonic_regression"))))
    return brier_and_ece(tagged, group_cols=("model", "method"))


# ---------------------------------------------------------------- importance (M6), HPO

def intrinsic_importance(fitted: FittedClassifier, window_size: int, n_sensors: int,
                         sensors: list[str]) -> DataFrame:
    """M6: (t, sensor, importance) from tree importances or |coefficients|,
    normalised by sum + 1e-10; the length must be T*F."""
    m = fitted.model
    vec = m.featureImportances if hasattr(m, "featureImportances") else m.coefficients
    vals = [abs(float(x)) for x in vec.toArray()]
    if len(vals) != window_size * n_sensors:
        raise ValueError(f"importance length {len(vals)} != T*F = {window_size * n_sensors}")
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "pos int, raw double")
    total = sum(vals) + 1e-10
    names = F.lit(sensors)
    return df.select((F.col("pos") / n_sensors).cast("int").alias("t"),
                     F.element_at(names, (F.col("pos") % n_sensors) + 1).alias("sensor"),
                     (F.col("raw") / total).alias("importance"))


def sensor_rollup(importance: DataFrame) -> DataFrame:
    """Mean importance over t per sensor, normalised by the sum + 1e-10; T3 rank."""
    from pyspark.sql import Window
    per = importance.groupBy("sensor").agg(F.avg("importance").alias("m"))
    tot = F.sum("m").over(Window.partitionBy())
    out = per.select("sensor", (F.col("m") / (tot + 1e-10)).alias("importance"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "sensor")))


def machine_folds(windows: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Fold id per machine (md5 of id and seed), so no machine spans two folds."""
    return windows.withColumn("fold", F.floor(uniform_hash(F.col("machine_id"), F.lit(seed)) * k).cast("int"))


#: Search space: model, then its parameters.
GRID = ([("logistic_regression", {"C": c}) for c in (0.01, 0.1, 1.0)]
        + [("random_forest", {"num_trees": t, "max_depth": d}) for t in (50, 200) for d in (6, 12)])


def hyperparameter_search(train: DataFrame, grid=None, k: int = 3, seed: int = 42, threshold: float = 0.5,
                          label_col: str = "label", parallelism: int = 3) -> DataFrame:
    """Machine-fold cross-validation over ``grid`` (M1 and M2 points), scored by
    F1 of the positive class. Scaler, class weights and model are fitted on the
    training folds alone. All logistic points of all folds share the passes over
    the windows, the forests of a fold the trees they have in common; other fits, and folds'
    forests, run ``parallelism`` at a time (``search``).
    Returns (model, params, fold, f1) per point and fold."""
    folded = store(machine_folds(train, k, seed).select("fold", "features", F.col(label_col).alias("label"), *KEY))
    points = [(name, params, f) for name, params in (grid if grid is not None else GRID) for f in range(k)]
    width = folded.select(F.size("features").alias("n")).first()
    together = [p for p in points if p[0] == "logistic_regression" and set(p[1]) <= {"C"} and width and width["n"] <= MOST_FEATURES]
    cells: dict[int, tuple[int, int, int]] = {}
    if together:
        fitted = fit_folds(folded, [(p[1].get("C", 1.0), p[2]) for p in together])
        cells |= {id(p): c for p, c in zip(together, fold_cells(folded, fitted, threshold))}
    fits = {"logistic_regression": fit_logistic, "random_forest": fit_random_forest}
    size = {"num_trees": 200, "max_depth": 12}

    def some(points) -> list[tuple[int, int, int]]:
        """Points of one fold: one point, or forests that differ in size alone."""
        name, params, f = points[0]
        rest, held = folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)
        fitted = ([fits[name](rest, **params)] if len(points) == 1 else
                  fit_random_forests(rest, [tuple({**size, **p}[k] for k in size) for _, p, _ in points]))
        p, y = decision(F.col("y_score"), threshold), F.col("y_true")
        return [tuple(m.score(held).agg(F.count_if((y == 1) & (p == 1)), F.count_if((y == 0) & (p == 1)), F.count_if((y == 1) & (p == 0))).first())
                for m in fitted]

    alone = [p for p in points if id(p) not in cells]
    units: dict = {}
    for p in alone:
        units.setdefault(("forests", p[2]) if p[0] == "random_forest" and set(p[1]) <= set(size) else id(p), []).append(p)
    done = side_by_side(train.sparkSession, some, list(units.values()), parallelism)
    cells |= {id(p): c for unit, got in zip(units.values(), done) for p, c in zip(unit, got)}
    rows = [(name, ",".join(f"{a}={b}" for a, b in params.items()), f, *cells[id(p)]) for p in points for name, params, f in [p]]
    table = train.sparkSession.createDataFrame(rows, "model string, params string, fold int, tp long, fp long, fn long")
    return table.select("model", "params", "fold", prf(F.col("tp"), F.col("fp"), F.col("fn"))[2].alias("f1"))


# ---------------------------------------------------------------- batch scoring

def reject_reason(bounds: list[tuple], readings: str = "readings", threshold_col: str = "threshold") -> Column:
    """First broken rule of a request, NULL when it is accepted. ``bounds`` has
    (low, high[, low inclusive, high inclusive]) per sensor; NULL and NaN readings
    are missing values, a NULL or NaN threshold is invalid."""
    r, n = F.col(readings), len(bounds)

    def every(test) -> Column:
        return F.coalesce(F.forall(r, lambda row: F.coalesce(test(row), F.lit(False))), F.lit(False))

    def within(row: Column) -> Column:
        ok = F.lit(True)
        for i, (lo, hi, *closed) in enumerate(bounds):
            lo_in, hi_in = closed or (True, True)
            x = F.get(row, F.lit(i))
            ok = ok & ((x >= lo) if lo_in else (x > lo)) & ((x <= hi) if hi_in else (x < hi))
        return ok

    t = F.col(threshold_col)
    return (F.when(r.isNull() | (F.size(r) == 0), F.lit("empty window"))
             .when(~every(lambda row: F.size(row) == n), F.lit("wrong reading width"))
             .when(~every(lambda row: F.forall(row, lambda x: x.isNotNull() & ~F.isnan(x))), F.lit("missing reading"))
             .when(~every(within), F.lit("reading out of bounds"))
             .when(~F.coalesce((t >= 0) & (t <= 1), F.lit(False)), F.lit("threshold outside [0,1]")))


def request_features(window_size: int, n_sensors: int, scaler=None, readings: str = "readings") -> Column:
    """Flattened last T readings, padded by the last one and scaled; zeros for a
    rejected request (its score is never shown), so no join is needed."""
    r, n = F.col(readings), F.size(readings)
    tail = F.slice(r, F.greatest(n - window_size + 1, F.lit(1)), window_size)
    rows = F.concat(tail, F.array_repeat(F.element_at(r, -1), F.greatest(F.lit(window_size) - n, F.lit(0))))
    if scaler is not None:  # F5 on every reading: (x - center_f) / scale_f
        ctr = F.lit([float(scaler.center[c]) for c in scaler.columns])
        scl = F.lit([float(scaler.scale[c]) for c in scaler.columns])
        rows = F.transform(rows, lambda row: F.transform(
            row, lambda x, i: (x - F.element_at(ctr, i + 1)) / F.element_at(scl, i + 1)))
    return F.when(F.col("reject_reason").isNull(), F.flatten(rows)).otherwise(
        F.array_repeat(F.lit(0.0), window_size * n_sensors))


def score_requests(requests: DataFrame, fitted: FittedClassifier, window_size: int, n_sensors: int,
                   bounds: list[tuple], scaler=None, model_version: str = "1.0.0",
                   threshold_col: str = "threshold") -> DataFrame:
    """Validate -> pad -> scale -> score -> decide, one row per request row.

    ``requests``: readings array<array<double>> (one inner array of F values per
    step), threshold, and optionally request_id (repeated or NULL ids are
    fine: rows are never joined). Rejected rows carry ``reject_reason`` and a
    NULL probability (the HTTP 422 path). Windows shorter than T are padded by
    repeating their last reading, longer ones keep the last T.
    """
    absent = {"readings", threshold_col} - set(requests.columns)
    if absent:
        raise ValueError(f"requests missing columns: {sorted(absent)}")
    rid = F.col("request_id") if "request_id" in requests.columns else F.lit(None).cast("string")
    v = requests.select(rid.alias("request_id"), "readings", F.col(threshold_col).cast("double").alias("threshold_used"))
    v = v.withColumn("reject_reason", reject_reason(bounds, threshold_col="threshold_used"))
    w = v.select("request_id", "reject_reason", "threshold_used", F.coalesce(F.size("readings"), F.lit(0)).alias("window_length"),
                 request_features(window_size, n_sensors, scaler).alias("features"), F.lit(0).alias("label"),
                 F.lit(0).cast("long").alias("machine_id"), F.lit(0).cast("long").alias("end_timestep"))
    out = fitted.score(w, keep=["request_id", "reject_reason", "threshold_used", "window_length"])
    p = F.when(F.col("reject_reason").isNull(), F.col("y_score"))
    return out.select("request_id", "reject_reason", F.round(p, 6).alias("failure_probability"),
                      (p >= F.col("threshold_used")).alias("failure_predicted"), "threshold_used", "window_length",
                      F.lit(model_version).alias("model_version"))


def pos_weight_study(train: DataFrame, test: DataFrame, threshold: float = 0.5) -> DataFrame:
    """logistic model without class weights vs balanced weights
    (pos_weight 1 vs n_neg/n_pos); point and ranking metrics per variant."""
    from .metrics import classification_metrics
    scored = None
    for name, balanced in (("unweighted", False), ("balanced", True)):
        s = fit_logistic(train, balanced=balanced).score(test).withColumn("variant", F.lit(name))
        scored = s if scored is None else scored.unionByName(s)
    return classification_metrics(scored, threshold, group_cols=("variant",))
