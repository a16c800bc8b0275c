"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length 1; cosine >= c is then distance <= eps with
eps^2 = 2 - 2c. An orthonormal turn to the leading principal axes never
lengthens a distance, so vectors further apart than eps on those axes can't
link. The vectors are sorted by label and by grid cells of side eps on these
axes (the epsilon grid order); consecutive vectors form blocks with bounding
boxes. Starting from one interval that spans the whole sequence, pairs of
intervals are split into pairs of their parts, and a pair whose boxes are
provably further apart than eps (or share no label) is dropped, until block
pairs remain. A task compares a block pair in double precision, again by
recursive halving with box checks.

Vectors of one length and label form a group; the sequence is sorted by group,
so vectors of one length always meet, whatever other lengths the table holds.
The ``LENGTHS`` most frequent lengths have principal axes; any others use their
first components (the result is the same for all orthonormal axes).

Equal vectors of a label are one class before the join (a frequent vector
costs one row), and a task returns link counts per vector and a spanning
forest, never pairs.

Defined results: a vector that is null, zero, or holds null or non-finite
components, or has a null label links with nothing (n_links 0, its own
component); vectors of different lengths never link. A row with null vec_id is
kept, with null component. Repeated rows link like any equal vectors; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, released, stored
from .components import components
from .simhash import forest

#: Vectors of a block; parts of an interval; leading axes of the grid.
BLOCK, PARTS, AXES = 1024, 8, 6
#: Vector lengths with principal axes of their own.
LENGTHS = 16
#: A pair is compared whole below this many vectors a side.
LEAF = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision (first by the largest component)."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    """Equal-length lists as a 2-D array."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their unit vectors) for each length of a column of lists."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, unit(matrix(column if len(at) == len(sizes) else column.take(pa.array(at))))


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Leading eigenvectors (dim, AXES) of the second moments of all vectors of each
    of the most frequent lengths: each task returns one dim x dim sum a length,
    Spark adds them, dim^2 numbers a length reach the driver."""
    frequent = classes.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()
    dims = [row["dim"] for row in frequent]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for dim, _, u in by_length(batch.column("v")):
                    total[dim] = total.get(dim, 0) + u.T @ u
        for dim, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim * dim, dim, np.int32)), pa.array(np.arange(dim * dim)),
                                              pa.array(x.ravel())], names=["dim", "at", "x"])

    sums = (classes.where(F.size("v").isin(dims)).select("v").mapInArrow(released(run), "dim int, at long, x double")
            .groupBy("dim", "at").agg(F.sum("x").alias("x")).collect())
    moments = {dim: np.zeros(dim * dim) for dim in dims}
    for row in sums:
        moments[row["dim"]][row["at"]] = row["x"]
    return {dim: np.linalg.eigh(m.reshape(dim, dim))[1][:, ::-1][:, :AXES] for dim, m in moments.items()}


def placed(u: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Unit vectors of one length on the axes of that length, zeros up to ``AXES``."""
    dim = u.shape[1]
    at = u @ axes[dim] if dim in axes else u[:, :AXES]
    return np.pad(at, ((0, 0), (0, AXES - at.shape[1])))


def grid_sorted(classes: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Classes with their cell (group first), in epsilon grid order over partitions."""
    names = [f"c{i}" for i in range(AXES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.empty((batch.num_rows, AXES), np.int32)
                for _, rows, u in by_length(batch.column("v")):
                    cells[rows] = np.floor(placed(u, axes) / eps)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(cells[:, i]) for i in range(AXES)]],
                                                 names=[*batch.schema.names, *names])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    celled = classes.mapInArrow(released(run), f"{fields}, " + ", ".join(f"{c} int" for c in names))
    order = ["label", *names, "node"]
    return celled.repartitionByRange(*order).sortWithinPartitions(*order)


def blocks(ordered: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """Consecutive vectors packed into blocks of one group with bounding boxes."""
    schema = "part int, seq int, label string, low array<double>, high array<double>, nodes array<long>, n array<long>, units binary"
    arrow = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("label", pa.string()), ("low", pa.list_(pa.float64())),
                       ("high", pa.list_(pa.float64())), ("nodes", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())),
                       ("units", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, rest = TaskContext.get().partitionId(), 0, None

        def row(t: pa.Table) -> pa.RecordBatch:
            u = unit(matrix(t.column("v").combine_chunks()))
            at = placed(u, axes)
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((
                part, seq, t.column("label")[0].as_py(), at.min(axis=0), at.max(axis=0),
                t.column("node").to_numpy(), t.column("n").to_numpy(), u.tobytes()), arrow)], schema=arrow)

        for batch in batches:
            now = pa.Table.from_batches([batch.select(["label", "node", "n", "v"])])
            rest = now if rest is None else pa.concat_tables([rest, now])
            while rest.num_rows:
                label = rest.column("label")[0].as_py()
                same = np.array(rest.column("label").to_pylist()) == label
                end = int(same.argmin()) if not same.all() else len(same)
                if end == len(same) and end < BLOCK:
                    break  # the block may go on in the next batch
                yield row(rest.slice(0, min(end, BLOCK)))
                seq += 1
                rest = rest.slice(min(end, BLOCK))
        if rest is not None and rest.num_rows:
            yield row(rest)

    return ordered.mapInArrow(released(run), schema)


def apart(prefix_a: str, prefix_b: str):
    """Squared distance of two bounding boxes (a lower bound for their vectors')."""
    gap = F.zip_with(F.zip_with(f"{prefix_a}low", f"{prefix_b}high", lambda x, y: x - y),
                     F.zip_with(f"{prefix_b}low", f"{prefix_a}high", lambda x, y: x - y),
                     lambda p, q: F.greatest(p, q, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)


def block_pairs(boxes: DataFrame, n_blocks: int, eps: float) -> DataFrame:
    """(i, j), i <= j: block pairs that the boxes don't rule out, by recursive
    splitting of pairs of sequence intervals from the whole sequence down."""
    n_axes = AXES
    levels = []
    now = boxes.select(F.col("no").alias("node"), F.col("label").alias("first"), F.col("label").alias("last"), "low", "high")
    levels.append(now)
    size = n_blocks
    while size > 1:
        size = -(-size // PARTS)
        now = now.withColumn("up", F.floor(F.col("node") / PARTS)).groupBy("up").agg(
            F.min("first").alias("first"), F.max("last").alias("last"),
            F.array(*[F.min(F.get("low", F.lit(i))) for i in range(n_axes)]).alias("low"),
            F.array(*[F.max(F.get("high", F.lit(i))) for i in range(n_axes)]).alias("high")).withColumnRenamed("up", "node")
        now = stored(now)
        levels.append(now)
    pairs = levels[-1].select(F.col("node").alias("i"), F.col("node").alias("j"))
    for level in reversed(levels[:-1]):
        up = F.floor(F.col("node") / PARTS)
        a = level.select(up.alias("i"), *[F.col(c).alias(f"a_{c}") for c in level.columns])
        b = level.select(up.alias("j"), *[F.col(c).alias(f"b_{c}") for c in level.columns])
        pairs = (pairs.join(a, "i").join(b, "j").where("a_node <= b_node AND a_first <= b_last AND b_first <= a_last")
                 .where((F.col("a_node") == F.col("b_node")) | (apart("a_", "b_") <= F.lit(eps * eps * (1 + 1e-9) + 1e-12)))
                 .select(F.col("a_node").alias("i"), F.col("b_node").alias("j")))
        pairs = stored(pairs)
    return pairs


def compare(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, same: bool, cosine: float,
            eps: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows with cosine >= the bound, by recursive halving."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a1 <= a0 or b1 <= b0 or (same and b1 <= a0):
            continue
        x, y = at_a[a0:a1], at_b[b0:b1]
        gap = np.maximum(np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)), 0)
        if (gap * gap).sum() > eps * eps * (1 + 1e-9) + 1e-12:
            continue
        if max(a1 - a0, b1 - b0) > LEAF:
            am, bm = (a0 + a1) // 2, (b0 + b1) // 2
            todo += [(a0, am, b0, bm), (a0, am, bm, b1), (am, a1, b0, bm), (am, a1, bm, b1)]
            continue
        i, j = np.nonzero(a[a0:a1] @ b[b0:b1].T >= cosine)
        i, j = i + a0, j + b0
        if same:
            i, j = i[i < j], j[i < j]
        found.append((i, j))
    return found


def embedding_groups(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                     label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; see the module text."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    src = pick(df, vec_id=id_col, v=vector_col, label=label_col).withColumn("label", F.col("label").cast("string"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    src = src.withColumn("usable", F.coalesce(F.col("label").isNotNull() & good, F.lit(False)))
    usable = F.col("usable")
    # one class per distinct vector of a label
    classes = (src.where(usable).groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
               .withColumn("node", F.monotonically_increasing_id()))
    classes = stored(classes)
    if not classes.isEmpty():
        # the length, at fixed width, before the label: one group a length and label
        group = F.concat(F.lpad(F.size("v").cast("string"), 10, "0"), F.lit(":"), "label").alias("label")
        found = stored(_found(classes.select(group, "node", "n", "v"), cosine, eps))
        counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("more"))
        roots = components(found.where("b IS NOT NULL").select("a", "b"))
    else:
        counts = df.sparkSession.createDataFrame([], "a long, more long")
        roots = df.sparkSession.createDataFrame([], "node long, root long")
    named = (classes.join(counts.withColumnRenamed("a", "node"), "node", "left").join(roots, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    named = stored(named)
    comp = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(comp, "root").select(
        "label", "v", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    linked = src.where(usable).join(known, ["label", "v"]).select(
        "vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = src.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _found(classes: DataFrame, cosine: float, eps: float) -> DataFrame:
    """(a, b, n): spanning links a-b between classes, and rows (a, null, n) with
    the number of vectors of other classes that a links with, in parts."""
    axes = principal_axes(classes)
    packed = stored(blocks(grid_sorted(classes, axes, eps), axes))
    # number the blocks along the sequence: offsets from one count per partition
    offset = (packed.groupBy("part").agg(F.count("*").alias("size"))
              .withColumn("off", F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
              .select("part", F.coalesce("off", F.lit(0)).alias("off")))
    table = packed.join(offset, "part").withColumn("no", F.col("off") + F.col("seq")).drop("part", "seq", "off")
    boxes = stored(table.select("no", "label", "low", "high"))
    pairs = block_pairs(boxes, boxes.count(), eps)
    sides = [table.select(F.col("no").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("nodes", "n", "units")]) for k in "ij"]
    met = pairs.join(sides[0], "i").join(sides[1], "j")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = {f: batch.column(f)[k].as_py() for f in batch.schema.names}
                same = one["i"] == one["j"]
                a, b = (np.frombuffer(one[f"{s}_units"]).reshape(len(one[f"{s}_nodes"]), -1) for s in "ij")
                node_a, node_b = np.array(one["i_nodes"]), np.array(one["j_nodes"])
                n_a, n_b = np.array(one["i_n"]), np.array(one["j_n"])
                got = compare(a, b, placed(a, axes), placed(b, axes), same, cosine, eps)
                i = np.concatenate([g[0] for g in got] or [np.zeros(0, np.int64)])
                j = np.concatenate([g[1] for g in got] or [np.zeros(0, np.int64)])
                if not len(i):
                    continue
                more_a = np.bincount(i, weights=n_b[j], minlength=len(a)).astype(np.int64)
                more_b = np.bincount(j, weights=n_a[i], minlength=len(b)).astype(np.int64)
                nodes = node_a if same else np.concatenate((node_a, node_b))
                more = more_a + more_b if same else np.concatenate((more_a, more_b))
                root = forest(len(nodes), i, j if same else j + len(a))
                moved, some = np.flatnonzero(root != np.arange(len(nodes))), np.flatnonzero(more)
                links, counts = len(moved), len(some)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((nodes[moved], nodes[some])), pa.int64()),
                    pa.array(nodes[root[moved]].tolist() + [None] * counts, pa.int64()),
                    pa.array([0] * links + more[some].tolist(), pa.int64())], schema=schema)

    return met.mapInArrow(released(run), "a long, b long, n long")
