"""Isotonic fit (pooled adjacent violators) over range partitions.

The fit is the lower convex hull of the cumulative diagram: after each distinct
score a point (rows so far, positives so far); the hull's edges are the pooled
blocks, their slopes the fitted values.

1. Distinct scores are range-partitioned; a task pools its own violators and
   keeps its block ends, a convex chain. Totals of the parts give offsets.
2. Merging the chains means to find where the hull goes over from one part to a
   later one. At a given slope the hull's point is the one of least
   ``positives - slope * rows``, an aggregate over all block ends; along rising
   slopes it moves right. Where it stays in one part between two slopes the
   hull there is that part's chain. So a grid of slopes, one scan, settles all
   but at most one slope interval per change of part.
3. Points that can still be on the hull in such an interval (their chain edges
   reach into it) are merged by one more pooling, a task an interval; intervals
   that hold more than ``SETTLE`` points are first cut by further slopes.

Nothing but slopes, their hull points and interval counts reaches the driver
(``SLOPES`` a scan, at most one interval a part). Slopes are dyadic numbers and
all comparisons are made in integers, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grids import count_le_sorted
from ..session import store
from .sequence import MARK, PART, join_parts, lay_out

#: Slopes of one scan; points of an interval that one task merges.
SLOPES, SETTLE = 512, 200_000
#: Slopes are multiples of 2^-BITS.
BITS = 60
UNIT = 1 << BITS
#: Up to so many blocks the fitted table is a literal of the plan.
LITERAL_BLOCKS = 256


def pooled(blocks: list[list], lo, hi, pos, n) -> list[list]:
    """``blocks`` [lo, hi, positives, rows] with strictly rising means, and further
    rows after them, pooled in integers (in place)."""
    for a, b, p, w in zip(lo, hi, pos, n):
        now = [a, b, p, w]
        while blocks and blocks[-1][2] * now[3] >= now[2] * blocks[-1][3]:
            last = blocks.pop()
            now = [last[0], now[1], last[2] + now[2], last[3] + now[3]]
        blocks.append(now)
    return blocks


def _chains(counts: DataFrame) -> DataFrame:
    """(part, idx, lo, hi, p, n, x, y, next_lo, next_p, next_n): the blocks of each range
    partition; x, y count rows and positives of the part up to the block's end."""
    ordered = counts.repartitionByRange("s").sortWithinPartitions("s")
    names = ("part", "idx", "lo", "hi", "p", "n", "x", "y", "next_lo", "next_p", "next_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        blocks: list[list] = []
        for batch in batches:
            pooled(blocks, *[batch.column(c).to_pylist() for c in ("s", "s", "pos", "n")])
        if not blocks:
            return
        lo, hi, p, n = (list(c) for c in zip(*blocks))
        size = len(lo)
        part = TaskContext.get().partitionId()
        x, y = np.cumsum(np.array(n, dtype=np.int64)), np.cumsum(np.array(p, dtype=np.int64))
        table = pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, part, np.int64)), pa.array(np.arange(size)), pa.array(lo, pa.float64()), pa.array(hi, pa.float64()),
             pa.array(p, pa.int64()), pa.array(n, pa.int64()), pa.array(x), pa.array(y), pa.array(lo[1:] + [None], pa.float64()),
             pa.array(p[1:] + [None], pa.int64()), pa.array(n[1:] + [None], pa.int64())], names=list(names))
        for at in range(0, size, 50_000):
            yield table.slice(at, 50_000)

    return ordered.mapInArrow(run, "part long, idx long, lo double, hi double, p long, n long, x long, y long, "
                                   "next_lo double, next_p long, next_n long")


@dataclass(frozen=True)
class Touch:
    """The hull's point at a slope (a multiple of 2^-BITS)."""
    slope: int
    part: int
    x: int
    y: int


def _touch(points: DataFrame, slopes: list[int]) -> list[Touch]:
    """The leftmost hull point at each slope: one scan, one row a slope and task."""
    ratio = np.array([s / UNIT for s in slopes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple | None] = [None] * len(slopes)
        for batch in batches:
            if not batch.num_rows:
                continue
            part, x, y, p, n = (batch.column(c).to_numpy() for c in ("part", "gx", "gy", "p", "n"))
            for lo, hi in _runs(part):  # a chain's piece: means rise along it
                mean = p[lo:hi] / n[lo:hi]
                at = np.searchsorted(mean[1:], ratio)  # right of every edge below the slope, up to rounding
                for k, i in enumerate(at.tolist()):
                    for j in range(max(i - 1, 0), min(i + 2, hi - lo)):
                        gx, gy = int(x[lo + j]), int(y[lo + j])
                        now = (gy * UNIT - slopes[k] * gx, gx, gy, int(part[lo + j]))
                        if best[k] is None or now[:2] < best[k][:2]:
                            best[k] = now
        rows = [(k, str(b[0]), b[1], b[2], b[3]) for k, b in enumerate(best) if b is not None]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
            (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["k", "v", "x", "y", "part"])

    got = points.mapInArrow(run, "k int, v string, x long, y long, part long")
    least = got.groupBy("k").agg(F.min(F.struct(F.col("v").cast("decimal(38,0)").alias("v"), "x", "y", "part")).alias("b"))
    out = []
    for row in least.collect():
        slope, b = slopes[row["k"]], row["b"]
        # the start of the diagram (0, 0) stands before the first part
        out.append(Touch(slope, b["part"], b["x"], b["y"]) if int(b["v"]) < 0 else Touch(slope, -1, 0, 0))
    return sorted(out, key=lambda t: t.slope)


def _runs(part: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(part[1:] != part[:-1]) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(part)]))


def _open(points: DataFrame, intervals: list[tuple[Touch, Touch]]) -> DataFrame:
    """Points that can lie on the hull strictly between two touches: right of the
    first, left of the second, with chain edges that reach into the slopes."""
    spark = points.sparkSession
    rows = [(i, a.x, b.x, a.slope / UNIT, b.slope / UNIT) for i, (a, b) in enumerate(intervals)]
    table = spark.createDataFrame(rows, "interval int, x0 long, x1 long, m0 double, m1 double")
    mean, after = F.col("p") / F.col("n"), F.col("next_p") / F.col("next_n")
    # doubles: widened by their rounding; a point too many is pooled away
    near = (mean <= F.col("m1") + 1e-12) & (after.isNull() | (after >= F.col("m0") - 1e-12))
    parts = [(p, i) for i, (a, b) in enumerate(intervals) for p in range(max(a.part, 0), b.part + 1)]  # at most parts + intervals
    at = spark.createDataFrame(parts, "part long, interval int")
    return (points.join(F.broadcast(at), "part").join(F.broadcast(table), "interval")
            .where((F.col("gx") > F.col("x0")) & (F.col("gx") < F.col("x1")) & near))


def _merged(found: DataFrame, intervals: list[tuple[Touch, Touch]]) -> DataFrame:
    """Hull points strictly between the touches of each interval, a task an interval."""
    ends = {i: (a, b) for i, (a, b) in enumerate(intervals)}

    def run(key: tuple, t: pa.Table) -> pa.Table:
        a, b = ends[key[0].as_py()]
        t = t.sort_by("gx")
        x, y = ([a.x] + t.column("gx").to_pylist() + [b.x]), ([a.y] + t.column("gy").to_pylist() + [b.y])
        blocks = pooled([], range(len(x) - 1), range(1, len(x)), np.diff(y).tolist(), np.diff(x).tolist())
        keep = [blk[1] - 1 for blk in blocks[:-1]]  # a block ends at its last point; the last one at b
        return t.take(pa.array(keep, pa.int64())).select(["part", "idx"])

    return found.select("interval", "part", "idx", "gx", "gy").groupBy("interval").applyInArrow(run, "part long, idx long")


def fit_blocks(preds: DataFrame, score: str = "y_score", label: str = "y_true") -> DataFrame:
    """(lo, hi, value, n) of the pooled blocks, stored. Rows with a null or NaN
    score or a null label take no part; no rows give no blocks."""
    s = F.col(score).cast("double")
    counts = preds.where(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull()).groupBy((s + F.lit(0.0)).alias("s")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    return fit_counts(counts)


def fit_counts(counts: DataFrame) -> DataFrame:
    """``fit_blocks`` on distinct scores ``s`` with ``pos`` positives among ``n`` rows."""
    chains = store(_chains(counts))
    parts = chains.groupBy("part").agg(F.sum("p").alias("py"), F.sum("n").alias("px"), F.min("lo").alias("first"))
    order = Window.partitionBy().orderBy("part")  # one row a part
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = store(parts.select(F.col("part"), F.coalesce(F.sum("px").over(earlier), F.lit(0)).alias("ox"),
                               F.coalesce(F.sum("py").over(earlier), F.lit(0)).alias("oy"), F.lead("first").over(order).alias("after")))
    points = chains.join(F.broadcast(parts), "part").select(
        "part", "idx", "lo", "hi", "p", "n", (F.col("x") + F.col("ox")).alias("gx"), (F.col("y") + F.col("oy")).alias("gy"),
        F.coalesce("next_lo", "after").alias("next_lo"), "next_p", "next_n")
    total = chains.agg(F.sum("n").alias("x"), F.sum("p").alias("y"), F.max("part").alias("part")).first()
    if total["x"] is None:
        return store(points.select("lo", "hi", F.lit(0.0).alias("value"), "n"))
    touches = [Touch(-1, -1, 0, 0), Touch(UNIT + 1, total["part"], total["x"], total["y"])]
    while True:
        intervals = [(a, b) for a, b in zip(touches, touches[1:]) if a.part != b.part]
        sizes = {r["interval"]: r for r in _open(points, intervals).groupBy("interval").agg(
            F.count(F.lit(1)).alias("size"), F.percentile_approx(F.col("p") / F.col("n"), [i / SLOPES for i in range(1, SLOPES)], 10 * SLOPES)
            .alias("cuts")).collect()} if intervals else {}
        large = [(i, r) for i, r in sizes.items() if r["size"] > SETTLE and intervals[i][1].slope - intervals[i][0].slope > 1]
        if not large:
            break
        step = max(1, (SLOPES * 8) // len(large))
        cuts = set()
        for i, r in large:
            a, b = intervals[i]
            inside = sorted({int(Fraction(m) * UNIT) for m in r["cuts"] if a.slope < int(Fraction(m) * UNIT) < b.slope})
            inside = inside or [(a.slope + b.slope) // 2]
            cuts |= set(inside[::max(1, len(inside) // step)])
        touches = sorted({t.slope: t for t in [*touches, *_touch(points, sorted(cuts))]}.values(), key=lambda t: t.slope)
    # what the touches settle: each part's chain from its first touch to its last
    span: dict[int, list[int]] = {}
    for t in touches:
        span.setdefault(t.part, [t.x, t.x])[1] = t.x
    spark = counts.sparkSession
    settled = spark.createDataFrame([(p, a, b) for p, (a, b) in span.items()], "part long, x0 long, x1 long")
    kept = points.join(F.broadcast(settled), "part").where(F.col("gx").between(F.col("x0"), F.col("x1"))).drop("x0", "x1")
    if sizes:
        more = _merged(_open(points, intervals), intervals)
        kept = kept.unionByName(points.join(more, ["part", "idx"]))
    kept = store(kept.select("part", "hi", "gx", "gy", "next_lo"))
    # a block runs from the hull point before it: in its part, or the last one of the parts before
    ends = kept.groupBy("part").agg(F.max(F.struct("gx", "gy", "next_lo")).alias("e"))
    carry = store(ends.select("part", F.last("e").over(earlier).alias("e0")))
    inside = Window.partitionBy("part").orderBy("gx")
    rows = kept.join(F.broadcast(carry), "part").withColumn("e", F.coalesce(F.lag(F.struct("gx", "gy", "next_lo")).over(inside), F.col("e0")))
    first_lo = chains.agg(F.min("lo")).first()[0]
    x0, y0 = F.coalesce(F.col("e.gx"), F.lit(0)), F.coalesce(F.col("e.gy"), F.lit(0))
    return store(rows.select(F.coalesce(F.col("e.next_lo"), F.lit(first_lo)).alias("lo"), "hi",
                             ((F.col("gy") - y0) / (F.col("gx") - x0)).alias("value"), (F.col("gx") - x0).alias("n")))


def calibrated(preds: DataFrame, blocks: DataFrame, score: str = "y_score") -> DataFrame:
    """``preds`` with ``score`` replaced by the fitted value: that of the score's block,
    between two blocks on the line between them, outside all blocks that of the
    nearest. Null and NaN scores stay as they are.

    Up to ``LITERAL_BLOCKS`` counted blocks the table is a literal and nothing is
    shuffled; beyond, scores and blocks are laid out together by score and every
    score takes the last block at or before it."""
    known = blocks.limit(LITERAL_BLOCKS + 1).count()
    s = F.col(score)
    real = s.isNotNull() & ~F.isnan(s)
    if known <= LITERAL_BLOCKS:
        rows = sorted((r["lo"], r["hi"], r["value"]) for r in blocks.collect())
        if not rows:
            return preds
        lo, hi, value = ([r[i] for r in rows] for i in range(3))
        i = count_le_sorted(s, lo)

        def item(values: list[float]) -> Column:
            return F.element_at(F.lit(values), F.greatest(i, F.lit(1)))

        b = {"hi": item(hi), "value": item(value), "next_lo": item(lo[1:] + [None]), "next_value": item(value[1:] + [None])}
        return preds.withColumn(score, F.when(real, _value(s, b, i > 0, F.lit(value[0]))).otherwise(s))
    laid = lay_out(blocks, [], ["lo"])
    after = Window.partitionBy(PART).orderBy(MARK)
    nexts = store(laid.groupBy(PART).agg(F.min(F.struct("lo", "value")).alias("f")).select(
        PART, F.lead("f").over(Window.partitionBy().orderBy(PART)).alias("f")))
    table = join_parts(laid, nexts, []).withColumn("nx", F.coalesce(F.lead(F.struct("lo", "value")).over(after), F.col("f")))
    block = F.struct("hi", "value", F.col("nx.lo").alias("next_lo"), F.col("nx.value").alias("next_value"))
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(preds.columns)])
    source = preds.where(real).select(F.col(score).cast("double").alias("__s"), F.lit(1).alias("__kind"), whole.alias("__row"))
    tag = table.select(F.col("lo").alias("__s"), F.lit(0).alias("__kind"), block.alias("__b"))
    both = source.withColumn("__b", F.lit(None).cast(tag.schema["__b"].dataType)).unionByName(
        tag.withColumn("__row", F.lit(None).cast(source.schema["__row"].dataType)))
    mixed = lay_out(both, [], ["__s", "__kind"])
    before = Window.partitionBy().orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    last = store(mixed.groupBy(PART).agg(F.max_by("__b", F.when(F.col("__kind") == 0, F.col(MARK))).alias("b")).select(
        PART, F.last("b", ignorenulls=True).over(before).alias("__carry")))
    run = F.last("__b", ignorenulls=True).over(Window.partitionBy(PART).orderBy(MARK).rowsBetween(Window.unboundedPreceding, 0))
    got = join_parts(mixed.withColumn("__here", run), last, []).where("__kind = 1").withColumn("__b", F.coalesce("__here", "__carry"))
    lowest = blocks.agg(F.min(F.struct("lo", "value"))["value"]).first()[0]
    fields = {c: F.col(f"__b.{c}") for c in ("hi", "value", "next_lo", "next_value")}
    fitted = _value(F.col("__s"), fields, F.col("__b").isNotNull(), F.lit(lowest))
    done = got.select(*[(fitted if c == score else F.col(f"__row.c{i}")).alias(c) for i, c in enumerate(preds.columns)])
    return done.unionByName(preds.where(~real))


def _value(s: Column, b: dict[str, Column], known: Column, lowest: Column) -> Column:
    share = (s - b["hi"]) / (b["next_lo"] - b["hi"])
    between = b["value"] + (b["next_value"] - b["value"]) * share
    return F.when(~known, lowest).when((s <= b["hi"]) | b["next_lo"].isNull(), b["value"]).otherwise(between)
