"""Hard-negative mining with segment summaries.

Every vector is stored with the mean and the deviation of its segments (16
stretches of its components; the deviation is the length of what is left after
the mean). For two vectors the inner product over a segment of s components is
s * mean * mean, plus or minus the product of the deviations at most. A task
holds a block of anchors and a block of rows and refines hierarchically: the
bounds over one segment drop what cannot reach an anchor's band or its worst
hit so far, then those over 4, then 16 segments; exact scores are computed for
what is left.

Two passes over the rows in blocks, each a join of anchors and rows on
(group, anchor part, row part), so neither side is ever whole in one place:

1. positives: rows of the anchor's own label; the best ``positives`` others;
2. negatives: rows of other labels, for each positive the best ``negatives``
   within ``low`` to ``high`` per cent of the positive's score.

A task hands on at most the best few rows of an anchor and band. A label that
holds a third of all rows is cut into row parts like any other; parts have at
most ``ROWS`` rows and ``ANCHORS`` anchors, and the sizes change nothing but
the number of tasks.

Scores are exact integers: products of components ``floor(scale * x)`` in
double precision while sums stay below 2^53, else in Python integers; a score
beyond 64 bits is cut to them.

Defined results: rows with null label, null vector, null or non-finite
components, or a null id take no part; vectors of different lengths never
meet (an empty vector scores 0 with its like); "other" means another id;
repeated rows count each, and a repeated anchor gives its rows again; ties go
to the smaller id; anchors without a positive, or positives without a negative
in the band, give no rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, released, stored

#: Segments at the finest level, and those of the levels, coarse to fine.
SEGMENTS, LEVELS = 16, (1, 4, 16)
#: Rows and anchors that meet in one task at most; those compared at once.
ROWS, ANCHORS = 65_536, 16_384
ROW_SLICE, ANCHOR_SLICE = 2048, 512
#: Bounds are widened by this share of their size (rounding of doubles).
SLACK = 1e-9
NO_HIT = -np.inf
EXACT = float(1 << 53)


def edges(dim: int, segments: int) -> np.ndarray:
    """Borders of the segments; coarse ones are unions of fine ones."""
    fine = np.linspace(0, dim, SEGMENTS + 1).astype(np.int64)
    return fine[::SEGMENTS // segments]


def summaries(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation (rows, SEGMENTS) of the segments of quantised vectors."""
    cut = edges(q.shape[1], SEGMENTS)
    mean, dev = np.zeros((len(q), SEGMENTS)), np.zeros((len(q), SEGMENTS))
    for s, (a, b) in enumerate(zip(cut, cut[1:])):
        if b > a:
            mean[:, s] = q[:, a:b].mean(axis=1)
            dev[:, s] = np.sqrt(((q[:, a:b] - mean[:, s:s + 1]) ** 2).sum(axis=1))
    return mean, dev


def level(mean: np.ndarray, dev: np.ndarray, dim: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means (times the root of the segment's size) and deviations of a coarser level."""
    size = np.diff(edges(dim, SEGMENTS)).astype(np.float64)
    if segments == SEGMENTS:
        return mean * np.sqrt(size), dev
    by = SEGMENTS // segments
    size_of, total = size.reshape(segments, by), size.reshape(segments, by).sum(axis=1)
    parts = mean.reshape(len(mean), segments, by)
    up = (parts * size_of).sum(axis=2) / np.maximum(total, 1)
    spread = dev.reshape(len(dev), segments, by) ** 2 + size_of * (parts - up[:, :, None]) ** 2
    return up * np.sqrt(total), np.sqrt(spread.sum(axis=2))


class Side:
    """Vectors of one length with ids, labels and the levels of their summaries."""

    def __init__(self, node: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, mean: np.ndarray, dev: np.ndarray):
        self.node, self.ids, self.labels, self.q = node, ids, labels, q
        self.levels = [level(mean, dev, q.shape[1], s) for s in LEVELS]
        self.most = float(np.abs(q).max(initial=0))

    @classmethod
    def read(cls, t: pa.Table) -> "Side":
        n = t.num_rows
        dim = t.column("dim")[0].as_py() if n else 0

        def doubles(name: str, width: int, kind: str = "<f8") -> np.ndarray:
            return np.frombuffer(b"".join(t.column(name).to_pylist()), dtype=kind).reshape(n, width).astype(np.float64)

        return cls(*[t.column(c).to_numpy() for c in ("node", "id", "label")], doubles("q", dim),
                   doubles("mean", SEGMENTS), doubles("dev", SEGMENTS))

    def part(self, at) -> "Side":
        out = object.__new__(Side)
        out.node, out.ids, out.labels, out.q, out.most = self.node[at], self.ids[at], self.labels[at], self.q[at], self.most
        out.levels = [(m[at], d[at]) for m, d in self.levels]
        return out


def exact_scores(a: Side, rows: np.ndarray, b: Side, cols: np.ndarray, kind) -> np.ndarray:
    """Integer inner products, as doubles or as Python integers."""
    x, y = a.q[rows], b.q[cols]
    if kind is np.float64:
        return x @ y.T
    whole = [np.array([[int(v) for v in r] for r in m.tolist()], dtype=object).reshape(m.shape) for m in (x, y)]
    return whole[0] @ whole[1].T if x.shape[1] else np.zeros((len(x), len(y)), dtype=object)


def clipped(score) -> int:
    return int(max(-(1 << 63), min((1 << 63) - 1, int(score))))


class Best:
    """The best hits of each anchor and band: scores descending, then ids ascending."""

    def __init__(self, anchors: int, bands: int, size: int, kind):
        self.size, self.kind = size, kind
        self.score = np.full((anchors, bands, size), NO_HIT, dtype=object)
        self.id = np.zeros((anchors, bands, size), dtype=np.int64)
        self.worst = np.full((anchors, bands), NO_HIT, dtype=kind)

    def add(self, anchor: int, band: int, scores: list, ids: list) -> None:
        hits = [(-s, i) for s, i in zip(self.score[anchor, band], self.id[anchor, band]) if s != NO_HIT]
        hits = sorted(hits + [(-s, i) for s, i in zip(scores, ids)])[:self.size]
        for k, (s, i) in enumerate(hits):
            self.score[anchor, band, k], self.id[anchor, band, k] = -s, i
        if len(hits) == self.size:
            self.worst[anchor, band] = float(-hits[-1][0])


def meet(a: Side, low: np.ndarray, high: np.ndarray, b: Side, same_label: bool, best: Best, first: int) -> None:
    """Rows b against anchors a: hits within the bands (anchors, bands) go to ``best``
    at the anchors' places from ``first`` on. ``b`` is sorted by id."""
    here = slice(first, first + len(a.ids))
    alike = a.labels[:, None] == b.labels[None, :]
    ok = (alike if same_label else ~alike) & (a.ids[:, None] != b.ids[None, :])
    # a row must reach some band: its low end, and that band's worst hit once it is full
    need, most = (x.astype(np.float64) for x in (np.maximum(low, best.worst[here]).min(axis=1), high.max(axis=1)))
    rows, cols = np.arange(len(a.ids)), np.arange(len(b.ids))
    for (mean_a, dev_a), (mean_b, dev_b) in zip(a.levels, b.levels):
        keep_r, keep_c = ok.any(axis=1), ok.any(axis=0)
        ok, rows, cols = ok[np.ix_(keep_r, keep_c)], rows[keep_r], cols[keep_c]
        if not ok.size:
            return
        centre, spread = mean_a[rows] @ mean_b[cols].T, dev_a[rows] @ dev_b[cols].T
        spread = spread + SLACK * (np.abs(centre) + spread + 1)
        ok &= (centre + spread >= need[rows, None]) & (centre - spread <= most[rows, None])
    keep_r, keep_c = ok.any(axis=1), ok.any(axis=0)
    ok, rows, cols = ok[np.ix_(keep_r, keep_c)], rows[keep_r], cols[keep_c]
    if not ok.size:
        return
    score = exact_scores(a, rows, b, cols, best.kind)
    for band in range(low.shape[1]):
        cut = np.maximum(low[rows, band], best.worst[here][rows, band])
        hit = ok & (score >= cut[:, None]) & (score <= high[rows, band][:, None])
        for k in np.flatnonzero(hit.any(axis=1)):
            at = np.flatnonzero(hit[k])
            got = score[k, at]
            if len(at) > best.size:
                bar = sorted(got, reverse=True)[best.size - 1] if got.dtype == object else np.partition(got, -best.size)[-best.size]
                above, level_with = np.flatnonzero(got > bar), np.flatnonzero(got == bar)
                pick_ = np.concatenate((above, level_with[:best.size - len(above)]))  # ids ascend along the row
                at, got = at[pick_], got[pick_]
            best.add(first + int(rows[k]), band, got.tolist(), b.ids[cols[at]].tolist())


def quantised(df: DataFrame, id_col: str, vector_col: str, label_col: str, anchor: Column | None, scale: float) -> DataFrame:
    """(node, id, label, dim, anchor, q, mean, dev) of the rows that take part, stored.
    ``q`` holds the components ``floor(scale * x)`` as doubles."""
    is_anchor = F.coalesce(anchor, F.lit(False)) if anchor is not None else F.lit(True)
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"),
                    F.col(f"`{label_col}`").cast("long").alias("label"), is_anchor.alias("anchor"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    src = src.where(F.col("id").isNotNull() & F.col("label").isNotNull() & good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            begin = np.concatenate(([0], np.cumsum(sizes)))
            order, out = [], {"q": [], "mean": [], "dev": []}
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                q = np.floor(scale * flat[begin[at][:, None] + np.arange(dim)[None, :]]).reshape(len(at), dim)
                mean, dev = summaries(q)
                order += at.tolist()
                for name, m in (("q", q), ("mean", mean), ("dev", dev)):
                    out[name] += [r.tobytes() for r in m]
            take = pa.array(order, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in ("id", "label", "anchor")] + [pa.array(sizes[order].astype(np.int32))]
                + [pa.array(out[c], pa.binary()) for c in ("q", "mean", "dev")], names=["id", "label", "anchor", "dim", "q", "mean", "dev"])

    rows = src.mapInArrow(released(run), "id long, label long, anchor boolean, dim int, q binary, mean binary, dev binary")
    return stored(rows.withColumn("node", F.monotonically_increasing_id()))


def band_ends(bands: list[list], share: tuple[int, int] | None, kind) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score (anchors, places) of the bands ``share`` per cent of
    the given scores; all scores without ``share``, none where a place has no band."""
    places = max(map(len, bands))
    low, high = np.full((len(bands), places), np.inf, dtype=kind), np.full((len(bands), places), -np.inf, dtype=kind)
    for i, b in enumerate(bands):
        for j, p in enumerate(b):
            low[i, j], high[i, j] = (-(-p * share[0] // 100), p * share[1] // 100) if share else (-np.inf, np.inf)
    return low, high


def best_rows(anchors: DataFrame, rows: DataFrame, group: list[str], size: int, share: tuple[int, int] | None = None) -> DataFrame:
    """(node, band, id, score): the best ``size`` rows of each anchor and band, in
    parts per task. ``anchors`` has ``bands``, the scores that ``share`` refers to;
    without ``share`` rows of the anchor's label count, in one band without ends,
    with it those of other labels."""
    same_label = share is None
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = min(ROWS, max(ROW_SLICE, rows.count() // tasks + 1))
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n_rows")).join(anchors.groupBy(*group).agg(F.count("*").alias("n_anchors")), group)
    sizes = stored(sizes.select(*group, F.ceil(F.col("n_rows") / width).cast("int").alias("row_parts"),
                                F.ceil(F.col("n_anchors") / ANCHORS).cast("int").alias("anchor_parts")))

    def parted(df: DataFrame, mine: str, theirs: str) -> DataFrame:
        """A row goes to one part of its own side and meets all parts of the other."""
        return (df.join(sizes, group).withColumn(mine, F.pmod(F.xxhash64("node"), F.col(f"{mine}s")).cast("int"))
                .withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(f"{theirs}s") - 1)))
                .drop("row_parts", "anchor_parts"))

    keys = [*group, "anchor_part", "row_part"]
    left = parted(anchors, "anchor_part", "row_part").groupBy(*keys)
    right = parted(rows, "row_part", "anchor_part").groupBy(*keys)
    schema = pa.schema([("node", pa.int64()), ("band", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def run(anchor_table: pa.Table, row_table: pa.Table) -> pa.Table:
        if not anchor_table.num_rows or not row_table.num_rows:
            return schema.empty_table()
        a = Side.read(anchor_table)
        bands = anchor_table.column("bands").to_pylist()
        most = max(float(np.abs(np.frombuffer(x, dtype="<f8")).max(initial=0)) for x in row_table.column("q").to_pylist())
        kind = np.float64 if a.most * most * max(1, a.q.shape[1]) < EXACT else object  # integers where doubles are not exact
        low, high = band_ends(bands, share, kind)
        best = Best(len(a.ids), low.shape[1], size, kind)
        for lo in range(0, row_table.num_rows, ROW_SLICE):
            b = Side.read(row_table.slice(lo, ROW_SLICE))
            b = b.part(np.argsort(b.ids, kind="stable"))
            for at in range(0, len(a.ids), ANCHOR_SLICE):
                some = slice(at, at + ANCHOR_SLICE)
                meet(a.part(some), low[some], high[some], b, same_label, best, at)
        k, band, place = np.nonzero(best.score != NO_HIT)
        return pa.Table.from_arrays([pa.array(a.node[k]), pa.array(band.astype(np.int32)), pa.array(best.id[k, band, place]),
                                     pa.array([clipped(s) for s in best.score[k, band, place]], pa.int64())], schema=schema)

    return left.cogroup(right).applyInArrow(run, "node long, band int, id long, score long")


def ranked(found: DataFrame, size: int) -> DataFrame:
    """The best ``size`` of each (node, band) over all parts, with their rank from 1."""
    w = Window.partitionBy("node", "band").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   anchor: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score):
    for each anchor (rows where ``anchor`` holds; default all) and positive, the
    best negatives with ``low`` * positive <= 100 * negative <= ``high`` * positive."""
    rows = quantised(df, id_col, vector_col, label_col, anchor, scale)
    anchors = rows.where("anchor").select(*[F.col(c).alias(c) for c in rows.columns])  # columns of their own for the joins
    # 1. positives: the rows of the anchor's label, in one band without ends
    found = best_rows(anchors.withColumn("bands", F.array(F.lit(None).cast("long"))), rows, ["dim", "label"], positives)
    best = stored(ranked(found, positives).select("node", F.col("rank").alias("place"), F.col("id").alias("positive_id"),
                                                  F.col("score").alias("positive_score")))
    # 2. negatives: for each positive a band of scores
    bands = best.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))),
                                                 lambda x: x["positive_score"]).alias("bands"))
    banded = anchors.join(bands, "node")
    found = best_rows(banded, rows, ["dim"], negatives, (low, high))
    hits = ranked(found, negatives).select("node", (F.col("band") + 1).alias("place"), "rank", F.col("id").alias("negative_id"),
                                           F.col("score").alias("negative_score"))
    named = anchors.select("node", F.col("id").alias("anchor_id"))
    return hits.join(best, ["node", "place"]).join(named, "node").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
