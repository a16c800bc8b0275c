"""Hyper-parameter search: all logistic points in one pass a step, forests side by side.

Every (C, held-out fold) is a column of one coefficient matrix. A step of
Newton's method reads the windows once: a task multiplies its rows with all
columns, and returns each model's loss, gradient and second derivatives summed;
one row per model and task is shuffled and the driver receives one per model.
Standardisation and class weights are those of each model's own training folds,
from one aggregate by fold; they are folded into the coefficients, so the
windows are never rewritten. The driver holds models x (features + 1)^2
numbers; above ``MOST_FEATURES`` features the points are fitted one by one.

The forests of a fold are grown together (``forest.fit_forests``), at most ``parallelism`` folds at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FEATURES = 1024
STEPS, TOLERANCE = 40, 1e-9


@dataclass
class FoldModel:
    """A logistic model on standardised features, without one fold."""
    C: float
    fold: int
    mean: np.ndarray
    std: np.ndarray
    weight: tuple[float, float]          # of a negative, of a positive
    beta: np.ndarray                     # intercept last, on standardised features

    def raw(self, beta: np.ndarray) -> np.ndarray:
        """Coefficients on features as they are, intercept last."""
        w = beta[:-1] / self.std
        return np.append(w, beta[-1] - (w * self.mean).sum())


def fold_statistics(windows: DataFrame, label_col: str) -> tuple[dict[int, tuple], dict[int, tuple[int, int]]]:
    """Per fold: (n, mean, sum of squared deviations) of the features, and (negatives, positives)."""
    x = windows.select("fold", F.posexplode("features").alias("pos", "x"))
    rows = x.groupBy("fold", "pos").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")).collect()
    size = max((r["pos"] for r in rows), default=-1) + 1
    stats: dict[int, tuple] = {}
    for r in rows:
        n, mean, square = stats.setdefault(r["fold"], (np.zeros(size), np.zeros(size), np.zeros(size)))
        n[r["pos"]], mean[r["pos"]], square[r["pos"]] = r["n"], r["m"], r["v"] * r["n"]
    labels = windows.groupBy("fold").agg(F.count_if(F.col(label_col) != 1).alias("neg"), F.count_if(F.col(label_col) == 1).alias("pos")).collect()
    return stats, {r["fold"]: (r["neg"], r["pos"]) for r in labels}


def without(stats: dict[int, tuple], fold: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation (0 -> 1) over all folds but one."""
    n, mean, square = (np.zeros_like(a) for a in next(iter(stats.values())))
    for f, (m, mu, sq) in stats.items():
        if f != fold:
            total = n + m
            shift = mu - mean
            share = np.divide(m, total, out=np.zeros_like(total), where=total > 0)
            square = square + sq + shift * shift * n * share
            mean, n = mean + shift * share, total
    std = np.sqrt(square / np.maximum(n, 1))
    return mean, np.where(std > 0, std, 1.0)


def _derivatives(windows: DataFrame, models: list[FoldModel], trial: list[np.ndarray], label_col: str) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(loss, gradient, second derivatives) of every model at its trial coefficients: one scan."""
    raw = np.stack([m.raw(b) for m, b in zip(models, trial)], axis=1)
    shape, k = raw.shape[0], len(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad, second = np.zeros(k), np.zeros((k, shape)), np.zeros((k, shape, shape))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            margin = x @ raw[:-1] + raw[-1]
            for i, m in enumerate(models):
                w = np.where(y == 1, m.weight[1], m.weight[0]) * (fold != m.fold)
                z = np.column_stack(((x - m.mean) / m.std, np.ones(len(x))))
                loss[i] += (w * (np.logaddexp(0, margin[:, i]) - y * margin[:, i])).sum()
                p = 1 / (1 + np.exp(-margin[:, i]))
                grad[i] += z.T @ (w * (p - y))
                second[i] += z.T @ (z * (w * p * (1 - p))[:, None])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, dtype=np.int32)),
             pa.array([np.concatenate(([loss[i]], grad[i], second[i].ravel())).tobytes() for i in range(k)], pa.binary())], names=["k", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, b in zip(batch.column("k").to_pylist(), batch.column("sums").to_pylist()):
                held[i] = held.get(i, 0) + np.frombuffer(b)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())],
                                         names=["k", "sums"])

    src = windows.select("fold", F.col(label_col).cast("long").alias("y"), F.col("features").alias("x"))
    rows = src.mapInArrow(run, "k int, sums binary").repartition(k, "k").mapInArrow(add, "k int, sums binary").collect()
    out = {}
    for r in rows:
        v = np.frombuffer(r["sums"])
        out[r["k"]] = v[0], v[1:1 + shape], v[1 + shape:].reshape(shape, shape)
    return [out[i] for i in range(k)]


def fit_folds(folded: DataFrame, points: Sequence[tuple[float, int]], balanced: bool = True, label_col: str = "label") -> list[FoldModel]:
    """L2 logistic models (``C``, fold left out) as ``models.fit_logistic`` fits them,
    all together; ``folded`` has ``fold`` and ``features``."""
    stats, labels = fold_statistics(folded, label_col)
    models = []
    for C, fold in points:
        neg, pos = (sum(n[i] for f, n in labels.items() if f != fold) for i in (0, 1))
        weight = tuple((neg + pos) / (2.0 * n) if balanced and n else 1.0 for n in (neg, pos))
        mean, std = without(stats, fold)
        models.append(FoldModel(C, fold, mean, std, weight, np.zeros(len(mean) + 1)))
    trial = [m.beta for m in models]
    best = [np.inf] * len(models)
    done = [False] * len(models)
    for _ in range(STEPS):
        some = [i for i, d in enumerate(done) if not d]
        if not some:
            break
        got = _derivatives(folded, [models[i] for i in some], [trial[i] for i in some], label_col)
        for i, (loss, grad, second) in zip(some, got):
            ridge = np.append(np.full(len(grad) - 1, 1.0 / models[i].C), 0.0)
            loss = loss + 0.5 * (ridge * trial[i] ** 2).sum()
            if loss > best[i] * (1 + 1e-12):  # too far: half the way back
                trial[i] = (models[i].beta + trial[i]) / 2
                done[i] = np.abs(trial[i] - models[i].beta).max() < TOLERANCE
                continue
            best[i], models[i].beta = loss, trial[i]
            step = np.linalg.solve(second + np.diag(ridge + 1e-12), grad + ridge * trial[i])
            trial[i] = trial[i] - step
            done[i] = np.abs(step).max() < TOLERANCE * max(1.0, np.abs(trial[i]).max())
            if done[i]:
                models[i].beta = trial[i]
    return models


def fold_cells(folded: DataFrame, models: list[FoldModel], threshold: float, label_col: str = "label") -> list[tuple[int, int, int]]:
    """(tp, fp, fn) of every model on the fold it was fitted without: one scan."""
    raw = np.stack([m.raw(m.beta) for m in models], axis=1)
    left_out = np.array([m.fold for m in models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((len(left_out), 3), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                y, fold = batch.column("y").to_numpy()[:, None], batch.column("fold").to_numpy()[:, None]
                hit = 1 / (1 + np.exp(-(x @ raw[:-1] + raw[-1]))) >= threshold
                mine = fold == left_out[None, :]
                cells += np.stack([(mine & hit & (y == 1)).sum(0), (mine & hit & (y != 1)).sum(0), (mine & ~hit & (y == 1)).sum(0)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), *[pa.array(cells[:, j]) for j in range(3)]],
                                         names=["k", "tp", "fp", "fn"])

    src = folded.select("fold", F.col(label_col).cast("long").alias("y"), F.col("features").alias("x"))
    rows = src.mapInArrow(run, "k int, tp long, fp long, fn long").groupBy("k").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).collect()
    out = {r["k"]: (r["tp"], r["fp"], r["fn"]) for r in rows}
    return [out.get(i, (0, 0, 0)) for i in range(len(models))]


def side_by_side(spark: SparkSession, fit, points: Sequence, parallelism: int) -> list:
    """``fit(point)`` for every point, at most ``parallelism`` Spark jobs at a time."""
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fit), points))
