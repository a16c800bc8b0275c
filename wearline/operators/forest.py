"""Random forests grown level by level over binned windows.

Every value becomes the number of its bin, one byte, by the thresholds of its
feature (quantiles of all rows, from sketches merged feature by feature); a
window is then one short binary. A level is one scan: a task walks its rows down
the trees grown so far and counts, for every open node, label and bin of the
node's features. Counts are summed and the best split found tree by tree in
the shuffle; the driver receives splits alone.

Draws depend on a hash of the row, the tree and the seed and counts are whole
numbers, so a forest does not depend on partitions. Rows equal in key, label and
features are drawn alike. The rest follows Spark ML: Poisson(1) bagging, a new
set of sqrt(features) for every node, Gini gain on weighted counts, a node with
no gain is a leaf. The result is Spark ML's own model, read from its file format.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, store
from .prepare import poisson_cdf

MAX_BINS = 32
SKETCH = 1024
#: Rows that a task holds at once (a byte a feature).
ROWS_A_TASK = 400_000
#: Rows of a node that are counted by themselves (feature after feature, from its column).
ROWS_ALONE = 1000
#: Nodes whose counts travel as one row.
NODES_A_ROW = 256


# ---------------------------------------------------------------- thresholds and bins

def _sketch(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted values with their counts (default 1 each), thinned to ``SKETCH`` ranks when more."""
    if counts is None:
        v, n = np.unique(values, return_counts=True)
        n = n.astype(float)
    else:
        v, at = np.unique(values, return_inverse=True)
        n = np.bincount(at, weights=counts, minlength=len(v))
    if len(v) <= SKETCH:
        return v, n
    slot = np.minimum(((np.cumsum(n) - n / 2) / n.sum() * SKETCH).astype(int), SKETCH - 1)
    first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
    middle = (first + np.append(first[1:], len(v)) - 1) // 2
    return v[middle], np.add.reduceat(n, first)


def split_points(v: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds between sorted values, about equal in count."""
    middles = (v[1:] + v[:-1]) / 2
    if len(middles) <= most:
        return middles
    out, stride = [], n.sum() / (most + 1)
    target, below = stride, n[0]
    for i in range(1, len(v)):
        now = below + n[i]
        if abs(below - target) < abs(now - target):
            out.append(middles[i - 1])
            target += stride
        below = now
    return np.array(out[:most])


def thresholds(rows: DataFrame, n_features: int, most: int) -> list[np.ndarray]:
    """Thresholds of every feature from all rows of ``x``."""
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n_features)]

        def merge(parts):
            return [_sketch(np.concatenate([v for v, _ in parts]), np.concatenate([n for _, n in parts]))]

        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                for f in range(n_features):
                    held[f].append(_sketch(x[:, f]))
                    if len(held[f]) > 16:
                        held[f] = merge(held[f])
        if held and held[0]:
            done = [merge(parts)[0] for parts in held]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n_features, dtype=np.int32)), pa.array([v.tobytes() for v, _ in done], pa.binary()),
                 pa.array([n.tobytes() for _, n in done], pa.binary())], names=["f", "v", "n"])

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for f, v, n in zip(*(batch.column(c).to_pylist() for c in ("f", "v", "n"))):
                held.setdefault(f, []).append((np.frombuffer(v), np.frombuffer(n)))
        out = {}
        for f, parts in held.items():
            v, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
            out[f] = split_points(v, np.bincount(at, weights=np.concatenate([n for _, n in parts])), most)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([t.tobytes() for t in out.values()], pa.binary())],
                                         names=["f", "t"])

    got = rows.select("x").mapInArrow(sketches, "f int, v binary, n binary").repartition(min(n_features, 32), "f")
    found = {r["f"]: np.frombuffer(r["t"]) for r in got.mapInArrow(points, "f int, t binary").collect()}
    return [found.get(f, np.zeros(0)) for f in range(n_features)]


def binned(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """(h, y, b): row hash, label, one byte a feature: how many thresholds lie below the value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(cuts)))
            b = np.empty(x.shape, dtype=np.uint8)
            for f, c in enumerate(cuts):
                b[:, f] = np.searchsorted(c, x[:, f], side="left")
            data = pa.Array.from_buffers(pa.binary(len(cuts)), len(x), [None, pa.py_buffer(b.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), data.cast(pa.binary())], names=["h", "y", "b"])

    return rows.mapInArrow(run, "h long, y int, b binary")


# ---------------------------------------------------------------- growing

@dataclass
class Tree:
    """Nodes in the order they were made (children after parents); ``left`` -1 marks a leaf."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    counts: np.ndarray                   # negatives, positives (bagged rows)
    open: np.ndarray                     # nodes of the last level to be split


def _mix(z: np.ndarray) -> np.ndarray:
    """splitmix64's finish."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_CDF = np.array(poisson_cdf(1.0))


def bagged(h: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson(1)."""
    salt = _mix(np.array([(seed * 1_000_003 + tree + 1) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0]
    u = (_mix(h ^ salt) >> np.uint64(11)) * (1.0 / (1 << 53))
    return np.searchsorted(_CDF, u, side="right").astype(np.uint8)


def _counts(columns: np.ndarray, lines: np.ndarray, drawn: np.ndarray, tree: Tree, subset: np.ndarray, level: int, cells: int) -> np.ndarray:
    """(open node, feature of its subset, bin and label) counts of the drawn rows.

    ``columns`` (feature, row) and ``lines`` (row, feature) hold 2 * bin + label. Rows
    go down from the root, those of large nodes part by part, the others together; a
    row whose node has no open node below it is left behind."""
    m, k = subset.shape
    left, feature, cut = tree.left, tree.feature, 2 * tree.cut.astype(np.int32) + 1
    slot = np.full(len(left), -1, dtype=np.int32)
    slot[tree.open] = np.arange(m)
    leads = slot >= 0                               # to an open node
    for n in np.flatnonzero(left >= 0)[::-1].tolist():
        leads[n] = leads[left[n]] or leads[left[n] + 1]
    out = np.zeros((m, k, cells), dtype=np.uint32)
    if not leads[0]:
        return out
    n_features, flat = lines.shape[1], lines.ravel()
    large = [(0, np.flatnonzero(drawn))]
    rows, node = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    for depth in range(level + 1):
        few, deeper = [], []
        for n, some in large:
            if len(some) < ROWS_ALONE:
                few.append((n, some))
            elif depth == level:
                weight = drawn.take(some).astype(np.float64)
                for j in range(k):
                    out[slot[n], j] = np.bincount(columns[subset[slot[n], j]].take(some), weights=weight, minlength=cells)
            else:
                right = columns[feature[n]].take(some) > cut[n]
                deeper += [(c, some[at]) for c, at in ((left[n], ~right), (left[n] + 1, right)) if leads[c]]
        large = deeper
        if few:
            rows = np.concatenate((rows, *[r for _, r in few]))
            node = np.concatenate((node, np.repeat(np.array([n for n, _ in few], dtype=np.int32), [len(r) for _, r in few])))
        if depth < level and len(rows):
            node = left[node] + (flat.take(rows * n_features + feature[node]) > cut[node])
            keep = leads[node]
            rows, node = rows[keep], node[keep]
    if len(rows):
        used, s = np.unique(slot[node], return_inverse=True)
        weight, base, place = drawn.take(rows).astype(np.float64), rows * n_features, s * cells
        wanted = np.ascontiguousarray(subset[used].T.astype(np.int64))
        for j in range(k):
            out[used, j] = np.bincount(place + flat.take(base + wanted[j].take(s)), weights=weight, minlength=len(used) * cells).reshape(-1, cells)
    return out


def _small(c: np.ndarray) -> np.ndarray:
    """The same counts in the fewest bytes a count."""
    return c.astype(next(t for t in (np.uint8, np.uint16, np.uint32) if not c.size or c.max() <= np.iinfo(t).max))


def _bytes(col: pa.Array) -> np.ndarray:
    """The bytes of a binary column, row after row."""
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[at[0]:at[-1]].copy()


def _level(data: DataFrame, trees: list[Tree], subsets: list[np.ndarray], level: int, seed: int, weight: tuple[float, float],
           min_leaf: int, bins: int, n_features: int) -> dict[int, tuple]:
    """Best split of every open node: one scan, counts summed tree by tree."""
    sc = data.sparkSession.sparkContext
    shared = sc.broadcast((trees, subsets))
    cells = bins * 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("h").to_numpy(), b.column("y").to_numpy(), _bytes(b.column("b"))) for b in batches if b.num_rows]
        if not held:
            return
        h = np.concatenate([x[0] for x in held]).view(np.uint64)
        y = np.concatenate([x[1] for x in held]).astype(np.uint8)
        lines = np.concatenate([x[2] for x in held]).reshape(-1, n_features)
        del held
        lines *= 2
        lines += y[:, None]
        columns = np.ascontiguousarray(lines.T)
        grown, wanted = shared.value
        for t, (tree, subset) in enumerate(zip(grown, wanted)):
            if not len(tree.open):
                continue
            drawn = bagged(h, t, seed)
            if not drawn.any():
                continue
            out = _counts(columns, lines, drawn, tree, subset, level, cells)
            for lo in range(0, len(out), NODES_A_ROW):
                c = _small(out[lo:lo + NODES_A_ROW])
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([lo], pa.int32()), pa.array([c.itemsize], pa.int32()),
                                                  pa.array([c.tobytes()], pa.binary())], names=["t", "lo", "size", "c"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        k = next((s.shape[1] for s in shared.value[1] if len(s)), 1)
        for batch in batches:
            for t, lo, size, c in zip(*(batch.column(x).to_pylist() for x in ("t", "lo", "size")), batch.column("c")):
                got = np.frombuffer(c.as_buffer(), dtype=f"u{size}").reshape(-1, k, bins, 2)
                if (t, lo) in held:
                    held[t, lo] += got
                else:
                    held[t, lo] = got.astype(np.int64)
        for (t, lo), c in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([lo], pa.int32()),
                                              *[pa.array([a.tobytes()], pa.binary()) for a in best_splits(c, weight, min_leaf)]],
                                             names=["t", "lo", "j", "cut", "gain", "sides"])

    counted = data.mapInArrow(count, "t int, lo int, size int, c binary")
    blocks = sum(-(-len(t.open) // NODES_A_ROW) for t in trees)
    # bounded: a part sums few blocks of nodes, one copy from each task
    parts = max(1, min(blocks, max(sc.defaultParallelism, blocks // 4)))
    rows = counted.repartition(parts, "t", "lo").mapInArrow(choose, "t int, lo int, j binary, cut binary, gain binary, sides binary").collect()
    shared.destroy()
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["t"], r["lo"])):
        out.setdefault(r["t"], []).append((np.frombuffer(r["j"], np.int16), np.frombuffer(r["cut"], np.int16), np.frombuffer(r["gain"]),
                                           np.frombuffer(r["sides"], np.int64).reshape(-1, 2, 2)))
    return {t: tuple(np.concatenate([p[i] for p in parts]) for i in range(4)) for t, parts in out.items()}


def gini(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(impurity, total) of weighted counts in the last axis."""
    n = c.sum(axis=-1)
    p = np.divide(c, n[..., None], out=np.zeros_like(c), where=n[..., None] > 0)
    return 1.0 - (p * p).sum(axis=-1), n


def best_splits(c: np.ndarray, weight: tuple[float, float], min_leaf: int) -> tuple[np.ndarray, ...]:
    """Per node of ``c`` (node, feature, bin, label): feature's place, last bin on the left,
    gain (-1: none), and (left, right) counts by label."""
    left = np.cumsum(c, axis=2)
    total = left[:, :1, -1:, :]
    left, w = left[:, :, :-1], np.array(weight)
    right = total - left
    (gl, nl), (gr, nr), (g, n) = gini(left * w), gini(right * w), gini(total * w)
    gain = g - np.divide(gl * nl + gr * nr, n, out=np.zeros_like(gl), where=n > 0)
    gain[(left.sum(axis=-1) < min_leaf) | (right.sum(axis=-1) < min_leaf)] = -1.0
    flat = gain.reshape(len(c), -1)
    at = flat.argmax(axis=1)
    node = np.arange(len(c))
    j, cut = np.divmod(at, gain.shape[2])
    return (j.astype(np.int16), cut.astype(np.int16), flat[node, at],
            np.stack([left[node, j, cut], right[node, j, cut]], axis=1).astype(np.int64))


def grow(data: DataFrame, n_features: int, bins: int, num_trees: int, max_depth: int | list[int], weight: tuple[float, float],
         min_leaf: int, seed: int) -> list[Tree]:
    """Trees over ``binned`` rows, all trees one level deeper a scan; ``max_depth`` of all or of each."""
    depths = [max_depth] * num_trees if isinstance(max_depth, int) else max_depth
    trees = [Tree(np.zeros(1, np.int32), np.zeros(1, np.int16), np.full(1, -1, np.int32), np.full(1, -1.0), np.zeros((1, 2), np.int64),
                  np.zeros(1, np.int32)) for _ in range(num_trees)]
    k = math.ceil(math.sqrt(n_features))
    for level in range(max(1, *depths)):
        subsets = []
        for t, tree in enumerate(trees):
            rng = np.random.default_rng([seed & 0xFFFFFFFF, t, level])
            some = np.argpartition(rng.random((len(tree.open), n_features)), k - 1, axis=1)[:, :k] if len(tree.open) else np.zeros((0, k))
            subsets.append(some.astype(np.uint16))
        if not any(len(t.open) for t in trees):
            break
        found = _level(data, trees, subsets, level, seed, weight, min_leaf, bins, n_features)
        for t, tree in enumerate(trees):
            if t not in found:
                tree.open = tree.open[:0]
                continue
            j, cut, gain, sides = found[t]
            if level == 0:
                tree.counts[0] = sides[0].sum(axis=0)
            good = (gain > 0) & (depths[t] > 0)
            at, n, m = tree.open[good], int(good.sum()), len(tree.left)
            tree.feature[at] = subsets[t][np.flatnonzero(good), j[good]]
            tree.cut[at], tree.gain[at] = cut[good], gain[good]
            tree.left[at] = m + 2 * np.arange(n)
            new = sides[good].reshape(-1, 2)                     # left, right, left, right
            tree.feature = np.append(tree.feature, np.zeros(2 * n, np.int32))
            tree.cut = np.append(tree.cut, np.zeros(2 * n, np.int16))
            tree.left = np.append(tree.left, np.full(2 * n, -1, np.int32))
            tree.gain = np.append(tree.gain, np.full(2 * n, -1.0))
            tree.counts = np.concatenate((tree.counts, new))
            tree.open = (m + np.flatnonzero((new > 0).all(axis=1))).astype(np.int32)   # pure nodes are leaves
            if level + 1 >= depths[t]:
                tree.open = tree.open[:0]
    return trees


def cut_down(tree: Tree, max_depth: int) -> Tree:
    """The tree as it was when its nodes reached ``max_depth``: draws do not depend on how deep a tree gets."""
    depth = np.zeros(len(tree.left), dtype=np.int32)
    for n in np.flatnonzero(tree.left >= 0).tolist():
        depth[tree.left[n]:tree.left[n] + 2] = depth[n] + 1
    n = int((depth <= max_depth).sum())
    leaf = (depth[:n] == max_depth) | (tree.left[:n] < 0)
    return Tree(np.where(leaf, 0, tree.feature[:n]), np.where(leaf, 0, tree.cut[:n]).astype(np.int16), np.where(leaf, -1, tree.left[:n]),
                np.where(leaf, -1.0, tree.gain[:n]), tree.counts[:n], tree.open[:0])


# ---------------------------------------------------------------- as a Spark ML model

def as_model(spark: SparkSession, trees: list[Tree], cuts: list[np.ndarray], weight: tuple[float, float], params: dict) -> RandomForestClassificationModel:
    """The trees as Spark ML reads them from its own files."""
    at = scratch(spark, "forest")
    tables = []
    for t, tree in enumerate(trees):
        w = tree.counts * np.array(weight)
        inner = tree.left >= 0
        cut = [[float(cuts[f][c])] if i else [] for f, c, i in zip(tree.feature.tolist(), tree.cut.tolist(), inner.tolist())]
        split = pa.StructArray.from_arrays([pa.array(np.where(inner, tree.feature, -1).astype(np.int32)), pa.array(cut, pa.list_(pa.float64())),
                                            pa.array(np.full(len(cut), -1, np.int32))], names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
        node = pa.StructArray.from_arrays(
            [pa.array(np.arange(len(cut), dtype=np.int32)), pa.array((w[:, 1] > w[:, 0]).astype(float)), pa.array(gini(w)[0]),
             pa.array(w.tolist(), pa.list_(pa.float64())), pa.array(tree.counts.sum(axis=1)), pa.array(tree.gain), pa.array(tree.left),
             pa.array(np.where(inner, tree.left + 1, -1).astype(np.int32)), split],
            names=["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
        tables.append(pa.table({"treeID": pa.array(np.full(len(cut), t, np.int32)), "nodeData": node}))
    spark.createDataFrame(pa.concat_tables(tables)).write.parquet(f"{at}/data")

    def head(cls: str, prefix: str, more: dict, forest_only: tuple[str, ...] = ()) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.classification.{cls}", "timestamp": int(time.time() * 1000), "sparkVersion": pyspark.__version__,
                           "uid": f"{prefix}_{uuid.uuid4().hex[:12]}", "paramMap": {k: v for k, v in params.items() if k not in forest_only}, "defaultParamMap": {}, **more})

    spark.createDataFrame([(t, head("DecisionTreeClassificationModel", "dtc", {}, ("numTrees", "featureSubsetStrategy")), 1.0) for t in range(len(trees))],
                          "_1 int, _2 string, _3 double").write.parquet(f"{at}/treesMetadata")
    spark.createDataFrame([(head("RandomForestClassificationModel", "rfc", {"numFeatures": len(cuts), "numClasses": 2, "numTrees": len(trees)}),)],
                          "value string").coalesce(1).write.text(f"{at}/metadata")
    return RandomForestClassificationModel.load(at)


def fit_forests(train: DataFrame, sizes: list[tuple[int, int]], weight: tuple[float, float], seed: int, label_col: str = "label",
                min_leaf: int = 2, key: tuple[str, ...] = ("machine_id", "end_timestep")) -> list[RandomForestClassificationModel]:
    """Forests on ``features`` (array<double>), one for each (trees, depth) of ``sizes``; ``weight`` of a negative,
    of a positive. A tree is drawn alike in all of them and so grown once, as deep as one of them needs it."""
    spark = train.sparkSession
    h = F.xxhash64(*[F.col(c) for c in key if c in train.columns], F.col(label_col), F.col("features"))
    rows = train.select(h.alias("h"), F.col(label_col).cast("int").alias("y"), F.col("features").alias("x"))
    n = train.count()
    if not n:
        raise ValueError("no windows to fit a forest on")
    n_features = rows.select(F.size("x").alias("f")).first()["f"]
    cuts = thresholds(rows, n_features, min(MAX_BINS, n) - 1)
    tasks = max(-(-n // ROWS_A_TASK), min(spark.sparkContext.defaultParallelism, -(-n // 2000)))
    data = store(binned(rows, cuts).repartition(tasks))
    most = max(num_trees for num_trees, _ in sizes)
    depths = [max(depth for num_trees, depth in sizes if num_trees > t) for t in range(most)]
    trees = grow(data, n_features, MAX_BINS, most, depths, weight, min_leaf, seed)
    out = []
    for num_trees, max_depth in sizes:
        params = {"featuresCol": "x", "labelCol": label_col, "weightCol": "weight", "numTrees": num_trees, "maxDepth": max_depth,
                  "minInstancesPerNode": min_leaf, "maxBins": MAX_BINS, "impurity": "gini", "featureSubsetStrategy": "sqrt", "seed": seed}
        out.append(as_model(spark, [cut_down(tree, max_depth) for tree in trees[:num_trees]], cuts, weight, params))
    return out
