"""Exact quantiles by selection: four scans that move counts only.

A double's bits, with the sign folded, order like the numbers themselves. The
first scan counts the values of every (group, column) by the leading 16 of the
64 bits; the prefix that holds a wanted rank is known from those counts, and
each further scan counts the next 16 bits of the values under the wanted
prefixes. After four scans the prefix is the value. No row is shuffled, sorted
or stored: a task sends (group, column, prefix, next bits, count).

The driver holds a few ranks per group and column. Groups are counted in the
first scan; beyond ``MAX_GROUPS`` of them the ordered layout of ``quantiles``
is used instead, which has no such bound (same results).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .quantiles import exact_quantiles

#: Bits of one scan.
DIGIT = 16
SCANS = 64 // DIGIT
#: Groups whose ranks the driver keeps.
MAX_GROUPS = 4096
#: Counters a task holds before it hands them on.
HELD = 1 << 20


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """uint64 keys that order like the doubles (no NaN); -0.0 is 0.0."""
    bits = (x + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def from_bits(key: int) -> float:
    key = key & ((1 << 63) - 1) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([key], dtype=np.uint64).view(np.float64)[0])


def _counted(df: DataFrame, groups: list[str], columns: list[str], scan: int, wanted: dict[tuple, list[int]] | None) -> DataFrame:
    """(groups..., col, prefix, digit, n): counts by the digit of this scan, of all
    values in scan 0, else of those under the wanted prefixes of (group, column)."""
    src = df.select(*groups, *[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)])
    shift = np.uint64(64 - DIGIT * (scan + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        held: dict[tuple, dict[int, int]] = {}
        size = 0

        def handed() -> pa.RecordBatch:
            keys = [(g, c, d, n) for (g, c), counts in held.items() for d, n in counts.items()]
            held.clear()
            cols = [pa.array([k[0][i] for k in keys], kinds[i]) for i in range(len(groups))]
            digits = np.array([k[2] for k in keys], dtype=np.uint64)
            cols += [pa.array([k[1] for k in keys], pa.int32()), pa.array((digits >> np.uint64(DIGIT)).astype(np.int64)),
                     pa.array((digits & np.uint64((1 << DIGIT) - 1)).astype(np.int32)), pa.array([k[3] for k in keys], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=[*groups, "col", "prefix", "digit", "n"])

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(groups))]
            if not batch.num_rows:
                continue
            which = np.zeros(batch.num_rows, dtype=np.int64)
            for g in groups:
                codes = batch.column(g).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                which = np.unique(which * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
            order = np.argsort(which, kind="stable")
            cut = np.flatnonzero(np.diff(which[order])) + 1
            for at in np.split(order, cut):
                group = tuple(batch.column(g)[int(at[0])].as_py() for g in groups)
                for c in range(len(columns)):
                    prefixes = wanted.get((group, c)) if wanted is not None else None
                    if wanted is not None and not prefixes:
                        continue
                    x = batch.column(f"__v{c}").to_numpy(zero_copy_only=False)[at].astype(np.float64)
                    key = ordered_bits(x[~np.isnan(x)]) >> shift
                    if prefixes is not None:
                        key = key[np.isin(key >> np.uint64(DIGIT), np.array(prefixes, dtype=np.uint64))]
                    digits, n = np.unique(key, return_counts=True)
                    counts = held.setdefault((group, c), {})
                    size -= len(counts)
                    for d, m in zip(digits.tolist(), n.tolist()):
                        counts[d] = counts.get(d, 0) + m
                    size += len(counts)
            if size > HELD:
                yield handed()
                size = 0
        if held:
            yield handed()

    fields = "".join(f"`{g}` {src.schema[g].dataType.simpleString()}, " for g in groups)
    got = src.mapInArrow(run, f"{fields}col int, prefix long, digit int, n long")
    return got.groupBy(*groups, "col", "prefix", "digit").agg(F.sum("n").alias("n"))


def select_quantiles(df: DataFrame, group_cols: Sequence[str], columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(group..., sensor, q array<double>): ``q[i]`` is the ``probs[i]`` quantile of the
    non-missing values (NULL and NaN left out) of each column, as linear
    interpolation between the two nearest ranks; a (group, column) without a
    value gives no row."""
    g, columns = list(group_cols), list(columns)
    first = store(_counted(df, g, columns, 0, None))
    totals = first.groupBy(*g, "col").agg(F.sum("n").alias("n"))
    rows = totals.limit(MAX_GROUPS * len(columns) + 1).collect()
    if len(rows) > MAX_GROUPS * len(columns):
        out = None
        for c in columns:
            q = exact_quantiles(df, g, c, probs).select(*g, F.lit(c).alias("sensor"), "q")
            out = q if out is None else out.unionByName(q)
        return out
    # ranks (0-based) below and above each probability, and where they stand in their prefix
    places, ranks = {}, {}
    for r in rows:
        key = (tuple(r[c] for c in g), r["col"])
        places[key] = [(r["n"] - 1) * float(p) for p in probs]
        ranks[key] = sorted({int(f) for at in places[key] for f in (np.floor(at), np.ceil(at))})
    at = {(key, rank): (0, rank) for key, rs in ranks.items() for rank in rs}  # prefix so far, rank inside it
    for scan in range(SCANS):
        counts = first if scan == 0 else _counted(df, g, columns, scan, {
            key: sorted({at[key, rank][0] for rank in rs}) for key, rs in ranks.items()})
        at = _descended(counts, g, at)
    spark, fields = df.sparkSession, [df.schema[c] for c in g]
    done = []
    for key, ps in places.items():
        q = []
        for p in ps:
            a, b = (from_bits(at[key, int(f)][0]) for f in (np.floor(p), np.ceil(p)))
            q.append(float(a + (b - a) * (p - np.floor(p))) if a != b else a)
        done.append((*key[0], columns[key[1]], q))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "sensor string, q array<double>"
    return spark.createDataFrame(done, schema)


def _descended(counts: DataFrame, g: list[str], at: dict[tuple, tuple[int, int]]) -> dict[tuple, tuple[int, int]]:
    """The next prefix of every wanted rank and the rank inside it."""
    spark = counts.sparkSession
    fields = "".join(f"`{c}` {counts.schema[c].dataType.simpleString()}, " for c in g)
    wanted = spark.createDataFrame([(*key[0], key[1], prefix, rank, inside) for (key, rank), (prefix, inside) in at.items()],
                                   f"{fields}col int, prefix long, rank long, inside long")
    upto = F.sum("n").over(Window.partitionBy(*g, "col", "prefix").orderBy("digit"))  # at most 2^16 rows each
    run = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
    a, b = run.alias("a"), F.broadcast(wanted).alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*g, "col", "prefix"]]
    hit = a.join(b, on).where((F.col("b.inside") >= F.col("a.before")) & (F.col("b.inside") < F.col("a.upto")))
    out = {}
    for r in hit.select(*[F.col(f"a.{c}") for c in g], F.col("a.col"), F.col("a.prefix"), "digit", "rank", (F.col("inside") - F.col("before")).alias("i")).collect():
        key = (tuple(r[c] for c in g), r["col"])
        out[key, r["rank"]] = ((r["prefix"] << DIGIT) | r["digit"], r["i"])
    return out
