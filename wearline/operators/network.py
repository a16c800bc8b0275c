"""Multilayer perceptrons fitted over windows packed into blocks.

L-BFGS passes over all windows some 200 times, so a pass must be cheap. The windows
are packed into blocks of bytes that Spark keeps, values that a window shares with
the one before it once; a pass streams the blocks through NumPy's matrix products, a
task returns one sum of losses and gradients (as long as the weights), and the driver
takes the step.

Loss, start and steps are those of Spark ML's perceptron: sigmoid layers, softmax
with cross entropy, Breeze's L-BFGS (10 corrections, strong Wolfe search). The
loss is the mean over windows; Spark ML's is the mean over blocks of at most 128
rows, where a partition's short last block weighs as much as a full one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 1024
#: Rows of a block that are tried for an overlap.
SHIFT_ROWS = 16
#: Blocks for which a task is worth its start, and tasks a core: each returns a gradient to the driver.
BLOCKS_A_TASK, TASKS_A_CORE = 64, 4

CORRECTIONS, TOLERANCE, SEARCH_STEPS, C1, C2 = 10, 1e-6, 10, 1e-4, 0.9


def layer_parts(layers: list[int], flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(inputs x outputs, offsets) views of each layer in Spark ML's weight vector."""
    out, at = [], 0
    for n_in, n_out in zip(layers, layers[1:]):
        out.append((flat[at:at + n_in * n_out].reshape(n_in, n_out), flat[at + n_in * n_out:at + (n_in + 1) * n_out]))
        at += (n_in + 1) * n_out
    return out


def loss_and_gradient(layers: list[int], flat: np.ndarray, blocks) -> np.ndarray:
    """Sums over the rows of ``blocks``: the loss, then the gradient in the weights' order."""
    sums = np.zeros(1 + len(flat))
    parts, slopes = layer_parts(layers, flat), layer_parts(layers, sums[1:])
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for x, y in blocks:
            held = [x]
            for w, b in parts[:-1]:
                z = held[-1] @ w
                z += b
                np.negative(z, out=z)
                np.exp(z, out=z)
                z += 1.0
                held.append(np.reciprocal(z, out=z))
            w, b = parts[-1]
            z = held[-1] @ w + b
            z -= z.max(axis=1, keepdims=True)
            delta = np.exp(z)
            total = delta.sum(axis=1, keepdims=True)
            rows = np.arange(len(y))
            sums[0] += (np.log(total[:, 0]) - z[rows, y]).sum()
            delta /= total
            delta[rows, y] -= 1.0
            for i in range(len(parts) - 1, -1, -1):
                slopes[i][0][...] += held[i].T @ delta
                slopes[i][1][...] += delta.sum(axis=0)
                if i:
                    delta = (delta @ parts[i][0].T) * (held[i] * (1.0 - held[i]))
    return sums


# ---------------------------------------------------------------- L-BFGS

class SearchFailed(ArithmeticError):
    """No step, or no direction, satisfies the search."""


def dot(a: np.ndarray, b: np.ndarray) -> np.float64:
    return np.float64(a @ b)


def direction(grad: np.ndarray, steps: list[np.ndarray], deltas: list[np.ndarray]) -> np.ndarray:
    """Minus the approximate inverse Hessian times the gradient; newest step first."""
    d, kept = grad.copy(), []
    scale = np.float64(1.0)
    if steps:
        sy = dot(steps[0], deltas[0])
        if sy < 0 or np.isnan(sy):
            raise SearchFailed
        scale = sy / dot(deltas[0], deltas[0])
    for s, g in zip(steps, deltas):
        rho = dot(s, g)
        a = dot(s, d) / rho
        if np.isnan(a):
            raise SearchFailed
        d -= a * g
        kept.append((a, rho))
    d *= scale
    for s, g, (a, rho) in zip(steps[::-1], deltas[::-1], kept[::-1]):
        d += (a - dot(g, d) / rho) * s
    return -d


def strong_wolfe(phi: Callable, start: tuple, t: float) -> tuple:
    """A point (t, value, slope, ...) of ``phi`` with the strong Wolfe conditions, from ``start`` at 0."""
    _, value, slope = start[:3]
    if slope > 0:
        raise SearchFailed

    def between(a, b):
        lo, hi = (b, a) if a[0] > b[0] else (a, b)
        d1 = lo[2] + hi[2] - 3 * (lo[1] - hi[1]) / (lo[0] - hi[0])
        d2 = np.sqrt(d1 * d1 - lo[2] * hi[2])
        u = hi[0] - (hi[0] - lo[0]) * (hi[2] + d2 - d1) / (hi[2] - lo[2] + 2 * d2)
        least, most = lo[0] + 0.1 * (hi[0] - lo[0]), lo[0] + 0.9 * (hi[0] - lo[0])
        return least if u < least else most if u > most else u

    def zoom(low, high):
        for _ in range(SEARCH_STEPS):
            c = phi(between(low, high))
            if c[1] > value + C1 * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= C2 * abs(slope):
                return c
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise SearchFailed

    low, t = start, np.float64(t)
    for i in range(SEARCH_STEPS):
        c = phi(t)
        if not np.isfinite(c[1]):
            t = t / 2
            continue
        if c[1] > value + C1 * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= C2 * abs(slope):
            return c
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise SearchFailed


def minimise(f: Callable, x: np.ndarray, max_iter: int) -> np.ndarray:
    """L-BFGS from ``x``; ``f`` gives (value, gradient). A failed search forgets the past steps once."""
    value, grad = f(x)
    first, seen, steps, deltas = value, [np.inf], [], []
    done, failed = 0, False
    with np.errstate(all="ignore"):
        while done < max_iter:
            if len(seen) > 1 and abs(value - max(seen)) <= TOLERANCE * first:
                break
            if np.sqrt(dot(grad, grad)) <= max(TOLERANCE * value, 1e-8):
                break

            def phi(t):
                v, g = f(x + t * d)
                return t, v, dot(g, d), g

            try:
                d = direction(grad, steps, deltas)
                t, new, _, slope = strong_wolfe(phi, (np.float64(0.0), value, dot(grad, d)),
                                                1.0 / np.sqrt(dot(d, d)) if not done else 1.0)
                if t * np.sqrt(dot(grad, grad)) < 1e-10:
                    raise SearchFailed
            except SearchFailed:
                if failed:
                    break
                failed, steps, deltas = True, [], []
                continue
            moved = x + t * d
            steps, deltas = [moved - x, *steps][:CORRECTIONS], [slope - grad, *deltas][:CORRECTIONS]
            x, value, grad, failed = moved, new, slope, False
            seen = [*seen, value][-10:]
            done += 1
    return x


# ---------------------------------------------------------------- the fit

def shift(x: np.ndarray) -> int:
    """Values by which a row goes on the row before (windows of one series overlap), 0 if none does."""
    for i in range(1, min(len(x), SHIFT_ROWS)):
        for k in range(1, x.shape[1]):
            if x[i, 0] == x[i - 1, k] and (x[i, :-k] == x[i - 1, k:]).all():
                return k
    return 0


def fold(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values of the rows ``x``, those shared with the row before only once, and where each row starts."""
    n, width = x.shape
    k, goes_on = shift(x), np.zeros(n, dtype=bool)
    if k:
        goes_on[1:] = (x[1:, :-k] == x[:-1, k:]).all(axis=1)
    new = np.ones(x.shape, dtype=bool)
    new[goes_on, :width - k] = False
    return x[new], np.cumsum(np.where(goes_on, k, width)) - width


def unfold(values: bytes, at: bytes, width: int) -> np.ndarray:
    """The rows again (a copy)."""
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(values), width)[np.frombuffer(at, np.int64)]


def packed(train: DataFrame, width: int, label_col: str) -> DataFrame:
    """Blocks of windows as bytes: ``fold`` of them, and their labels (a task's last block may be short)."""
    rows = train.select(F.col("features").cast("array<double>").alias("x"), F.col(label_col).cast("double").alias("y"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, held = [], [], 0

        def block(n: int) -> pa.RecordBatch:
            nonlocal xs, ys, held
            x, y = np.concatenate(xs), np.concatenate(ys)
            xs, ys, held = [x[n:]], [y[n:]], held - n
            values, at = fold(x[:n])
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (values, at.astype(np.int64), y[:n])], names=["x", "at", "y"])

        for batch in batches:
            x, y = batch.column("x"), batch.column("y").to_numpy(zero_copy_only=False)
            if x.null_count or not np.isin(y, (0, 1)).all():
                raise ValueError("windows need features and a label of 0 or 1")
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(y), width)
            for i in range(0, len(y), BLOCK):
                xs.append(x[i:i + BLOCK])
                ys.append(y[i:i + BLOCK].astype(np.int64))
                held += len(ys[-1])
                if held >= BLOCK:
                    yield block(BLOCK)
        if held:
            yield block(held)

    return rows.mapInArrow(pack, "x binary, at binary, y binary")


def fit_weights(train: DataFrame, n_rows: int, layers: list[int], mean: list[float], std: list[float],
                start: list[float], max_iter: int, label_col: str = "label") -> list[float]:
    """Weights of the perceptron on the standardised ``features`` of ``train``."""
    width, sc = layers[0], train.sparkSession.sparkContext
    centre, scale = np.array(mean), np.array(std)
    tasks = sc.defaultParallelism * max(1, min(TASKS_A_CORE, math.ceil(n_rows / (BLOCK * BLOCKS_A_TASK * sc.defaultParallelism))))
    blocks = packed(train, width, label_col).repartition(tasks).rdd.map(lambda r: tuple(map(bytes, r)))
    blocks.persist(StorageLevel.MEMORY_AND_DISK_DESER)  # blocks are byte arrays: nothing to decode in a pass

    def objective(w: np.ndarray) -> tuple[np.float64, np.ndarray]:
        def sums(part):
            def standardised():
                for values, at, y in part:
                    x = unfold(values, at, width)
                    x -= centre
                    x /= scale
                    yield x, np.frombuffer(y, np.int64)

            yield loss_and_gradient(layers, w, standardised())

        total = sum(blocks.mapPartitions(sums).collect()) / n_rows
        return total[0], total[1:]

    try:
        return minimise(objective, np.array(start), max_iter).tolist()
    finally:
        blocks.unpersist()
