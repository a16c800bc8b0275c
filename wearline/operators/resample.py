"""Replicate metrics (bootstrap, paired permutation) over rows laid out by score.

Rows are shuffled once, into score order over range partitions. A task draws
all replicates of its rows as matrices and returns sums per replicate:

1. weights of positives and negatives per (part, replicate), and the confusion
   cells at the threshold; prefix sums over the small part table give every
   part the weight above it;
2. with those offsets, the ROC and PR terms of the scores inside the part. A
   part's first and last score may go on in the neighbouring part: they are
   returned apart and merged in a table of two rows per part.

A row may stand for many equal ones (same score and label; for a swap the same
two scores and label): its weight is then one draw of their sum, Poisson(count)
or Binomial(count, 1/2), so the work follows distinct scores, not rows.

Draws come from one md5 of the row's key: its halves a, b < 2^31 - 1 give
replicate r the number x = a + r*b, then twice x = x^2 + (a, b) modulo
2^31 - 1, as a share of the modulus. Any SQL engine can repeat them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .prepare import poisson_cdf
from .sequence import MARK, PART, before, inside, join_parts, lay_out, part_table

MODULUS = (1 << 31) - 1
#: Elements of a draw matrix (rows x replicates) held at once.
CELLS_AT_ONCE = 1 << 20
#: The same for draws that are used at once: they stay in a core's cache.
CELLS_IN_CACHE = 1 << 16
DRAWS_A_TASK = 1 << 28


def draw_key(*cols: Column, seed: int) -> list[Column]:
    """Columns ``__a``, ``__b``: two numbers below the modulus from the key's md5."""
    h = F.md5(F.concat_ws("-", *[c.cast("string") for c in cols], F.lit(str(seed))))
    return [(F.conv(F.substring(h, at, 8), 16, 10).cast("long") % MODULUS).alias(name) for name, at in (("__a", 1), ("__b", 9))]


def uniforms(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) draws in [0, 1) for replicates 1..n."""
    a, b = a[:, None], b[:, None]
    x = np.arange(1, n + 1, dtype=np.int64) * b
    x += a
    high = np.empty_like(x)

    def reduce() -> None:  # 2^31 = 1 modulo 2^31 - 1: two folds bring x below 2^31 + 2
        for _ in range(2):
            np.right_shift(x, 31, out=high)
            np.bitwise_and(x, MODULUS, out=x)
            np.add(x, high, out=x)

    reduce()
    for c in (a, b):
        np.multiply(x, x, out=x)
        np.add(x, c, out=x)
        reduce()
    np.subtract(x, MODULUS, out=x, where=x >= MODULUS)
    return x / MODULUS


@lru_cache(maxsize=4096)
def _cdf(kind: str, count: int) -> tuple[int, np.ndarray]:
    """(k0, P(X <= k) for k = k0, k0 + 1, ...) of Poisson(count), or of Binomial(count,
    1/2), over the stretch that holds all but 1e-30 of the mass."""
    if count == 1:
        return 0, np.array(poisson_cdf(1.0) if kind == "poisson" else [0.5, 1.0])
    mean, sd = (count, count ** 0.5) if kind == "poisson" else (count / 2, count ** 0.5 / 2)
    lo, hi = max(0, int(mean - 12 * sd - 20)), int(mean + 12 * sd + 20)
    k = np.arange(lo, (hi if kind == "poisson" else min(hi, count)) + 1)
    log_factorial = np.array([math.lgamma(i + 1.0) for i in k.tolist()])
    if kind == "poisson":
        log_p = -count + k * math.log(count) - log_factorial
    else:
        rest = np.array([math.lgamma(count - i + 1.0) for i in k.tolist()])
        log_p = math.lgamma(count + 1.0) - log_factorial - rest - count * math.log(2.0)
    return lo, np.cumsum(np.exp(log_p))


def quantiles(u: np.ndarray, count: np.ndarray, kind: str) -> np.ndarray:
    """Least k with P(X <= k) > u for each row's count (rows x draws)."""
    if kind == "swap" and (count == 1).all():
        return (u >= 0.5).astype(np.int32)
    out = np.empty(u.shape, dtype=np.int32)
    for c in np.unique(count).tolist():
        at = np.flatnonzero(count == c)
        lo, cdf = _cdf(kind, c)
        top = lo + len(cdf) - (kind == "swap")  # a binomial never exceeds its count
        out[at] = np.minimum(lo + np.searchsorted(cdf, u[at], side="right"), top)
    return out


def weights(a: np.ndarray, b: np.ndarray, other: np.ndarray, n: int, kind: str, count: np.ndarray | None = None) -> np.ndarray:
    """Weights of rows that stand for ``count`` equal ones (default 1), column 0
    observed. ``poisson``: n + 1 columns, the sum of ``count`` Poisson(1) draws.
    ``swap``: n + 1 columns of the first model's side, then n + 1 of the second's;
    each of the ``count`` windows changes sides with probability 1/2."""
    u = uniforms(a, b, n)
    count = np.ones(len(a), dtype=np.int32) if count is None else count.astype(np.int32)
    if kind == "poisson":
        return np.concatenate((count[:, None], quantiles(u, count, kind)), axis=1)
    moved = np.concatenate((np.zeros((len(a), 1), dtype=np.int32), count[:, None] - quantiles(u, count, kind)), axis=1)
    stay = count[:, None] - moved
    first = np.where(other[:, None], moved, stay)
    return np.concatenate((first, count[:, None] - first), axis=1)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one (group, part)."""
    gs, ps = batch.column("__g").to_numpy(), batch.column(PART).to_numpy()
    cut = np.flatnonzero((gs[1:] != gs[:-1]) | (ps[1:] != ps[:-1])) + 1
    for lo, hi in zip([0, *cut], [*cut, len(gs)]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _blocks(piece: pa.RecordBatch, n: int, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(score, y, weights) of blocks of rows with a bounded draw matrix."""
    step = max(1, CELLS_AT_ONCE // ((n + 1) * (2 if kind == "swap" else 1)))
    score, y, other, a, b, count = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("score", "y", "__other", "__a", "__b", "__n"))
    for i in range(0, len(score), step):
        at = slice(i, i + step)
        yield score[at], y[at], weights(a[at], b[at], other[at].astype(bool), n, kind, count[at])


def replicate_cells(preds: DataFrame, group_cols: list[str], n: int, kind: str, threshold: float) -> DataFrame:
    """(group..., rep, side, tp, fp, fn, tn, roc_auc, pr_auc) for replicates 0
    (observed) to n; ``preds`` has score, y, __other (second model of a pair),
    __a, __b, and __n, the equal rows that one stands for. side is 0, and 1 for the second model of a swap."""
    g = list(group_cols)
    groups = store(preds.select(*g).distinct().withColumn("__g", F.monotonically_increasing_id()))
    rows = preds.join(F.broadcast(groups), g).select("__g", "score", "y", "__other", "__a", "__b", "__n")  # models or pairs
    width = (n + 1) * (2 if kind == "swap" else 1)
    # tasks are sized by draws, not by bytes
    spread = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() * width // DRAWS_A_TASK)
    laid = lay_out(rows, "__g", [F.col("score").desc(), "__a"], spread)
    names = ("pos", "neg", "tp", "fp")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for piece in _pieces(batch):
                key = (piece.column("__g")[0].as_py(), piece.column(PART)[0].as_py())
                for score, y, w in _blocks(piece, n, kind):
                    hit = score >= threshold
                    tp, fp, fn, tn = (w[(y == v) & h].sum(axis=0, dtype=np.int64) for h in (hit, ~hit) for v in (1, 0))
                    held[key] = held.get(key, 0) + np.stack([tp + fn, fp + tn, tp, fp])
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in held], pa.int64()), pa.array([p for _, p in held], pa.int64()),
             *[pa.array([v[i].tolist() for v in held.values()], pa.list_(pa.int64())) for i in range(4)]],
            names=["__g", PART, *names])

    # a part is one scan range or several; sums over them are added here
    got = laid.mapInArrow(totals, f"__g long, {PART} long, " + ", ".join(f"{c} array<long>" for c in names))
    long = got.select("__g", PART, F.posexplode(F.arrays_zip(*names)).alias("col", "s")).groupBy("__g", PART, "col").agg(
        *[F.sum(f"s.{c}").alias(c) for c in names])
    long = store(long)
    above = Window.partitionBy("__g", "col").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = long.select("__g", PART, "col", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("pos", "neg")])

    def ordered(name: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("col", name))), lambda x: x[name]).alias(name)

    parts = store(offsets.groupBy("__g", PART).agg(ordered("pos_above"), ordered("neg_above")))
    # the last pass needs the rows of a part in order, in one place, after one row with the part's offsets
    nothing = F.lit(None).cast("array<long>")
    lead = parts.select("__g", F.lit(None).cast("double").alias("score"), F.lit(0).alias("y"), F.lit(False).alias("__other"),
                        *[F.lit(0).cast("long").alias(c) for c in ("__a", "__b", "__n")], F.lit(-1).cast("long").alias(MARK), PART,
                        "pos_above", "neg_above")
    body = laid.select("__g", "score", "y", "__other", "__a", "__b", "__n", MARK, PART,
                       nothing.alias("pos_above"), nothing.alias("neg_above"))
    joined = lead.unionByName(body).repartition(max(1, 4 * parts.count()), "__g", PART).sortWithinPartitions("__g", PART, MARK)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def done() -> pa.RecordBatch:
            now.close()
            return now.result()

        for batch in batches:
            for piece in _pieces(batch):
                key = (piece.column("__g")[0].as_py(), piece.column(PART)[0].as_py())
                if now is None or (now.group, now.part) != key:
                    if now is not None:
                        yield done()
                    now = _Terms(*key, *[np.array(piece.column(c)[0].as_py(), dtype=np.float64) for c in ("pos_above", "neg_above")])
                    piece = piece.slice(1)
                for score, y, w in _blocks(piece, n, kind):
                    now.add(score, y, w)
        if now is not None:
            yield done()

    # read several times below: drawn once and stored (a few rows a part)
    out = store(joined.mapInArrow(terms, "__g long, score double, auc array<double>, ap array<double>, pos array<double>, "
                                   "neg array<double>, pos_above array<double>, neg_above array<double>"))
    cols = ("auc", "ap", "pos", "neg", "pos_above", "neg_above")
    out = out.select("__g", "score", F.posexplode(F.arrays_zip(*cols)).alias("col", "s")).select(
        "__g", "score", "col", *[F.col(f"s.{c}").alias(c) for c in cols])
    # a score that stands at part borders: its pieces are one tie group
    tied = out.where("score IS NOT NULL").groupBy("__g", "score", "col").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min("pos_above").alias("pa"), F.min("neg_above").alias("na"))
    down = F.col("pa") + F.col("pos") + F.col("na") + F.col("neg")
    tied = tied.select("__g", "col", (F.col("neg") * (2 * F.col("pa") + F.col("pos"))).alias("auc"),
                       F.when(down > 0, F.col("pos") * (F.col("pa") + F.col("pos")) / down).otherwise(0.0).alias("ap"))
    ranks = out.where("score IS NULL").select("__g", "col", "auc", "ap").unionByName(tied).groupBy("__g", "col").agg(
        F.sum("auc").alias("auc"), F.sum("ap").alias("ap"))
    cells = long.groupBy("__g", "col").agg(*[F.sum(c).alias(c) for c in names])
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    rep = F.col("col") % (n + 1)
    return cells.join(ranks, ["__g", "col"]).join(F.broadcast(groups), "__g").select(
        *g, rep.cast("int").alias("rep"), F.floor(F.col("col") / (n + 1)).cast("int").alias("side"), "tp", "fp",
        (F.col("pos") - F.col("tp")).alias("fn"), (F.col("neg") - F.col("fp")).alias("tn"),
        F.when(both, F.col("auc") / (2.0 * F.col("pos") * F.col("neg"))).alias("roc_auc"),
        F.when(F.col("pos") > 0, F.col("ap") / F.col("pos")).alias("pr_auc"))


def swapped_auc(cells: DataFrame, group_cols: list[str], n: int, seed_cols: list[Column]) -> tuple[DataFrame, DataFrame]:
    """ROC AUC of both models of a pair and its difference in ``n`` swaps, without a ranking a replicate.

    ``cells`` has group..., sa, sb (scores of the first and second model), y and __n windows.
    Let s be 1 on a window that stays and -1 on one that is swapped. A positive and a
    negative window add ((s + s')(K_aa - K_bb) + (s - s')(K_ab - K_ba)) / 2 to the
    difference of the two rank sums (K: 1 above, 1/2 equal, 0 below), which is linear in
    the signs: a positive window counts s * (R(a) - R(b)) / 2, R the rank sum of a score
    against both models' negatives, and a negative one likewise against the positives. So
    scores are ranked once, and a replicate is one product of signs and coefficients
    (whole numbers: their sums do not depend on the order).

    Returns (group..., P, N, metric_a, metric_b) and (group..., rep, diff) for rep 1 to n.
    """
    g = list(group_cols)
    sides = F.explode(F.array(F.struct(F.col("sa").alias("score"), F.lit(0).alias("side")),
                              F.struct(F.col("sb").alias("score"), F.lit(1).alias("side")))).alias("x")
    ranked = cells.select(*g, "y", "__n", sides).groupBy(*g, F.col("x.score").alias("score")).agg(*[
        F.sum(F.when((F.col("y") == label) & (F.col("x.side") == side), F.col("__n")).otherwise(F.lit(0))).alias(name)
        for name, label, side in (("pos_a", 1, 0), ("pos_b", 1, 1), ("neg_a", 0, 0), ("neg_b", 0, 1))])
    laid = lay_out(ranked, g, [F.col("score").desc()])
    names = ("pos_a", "pos_b", "neg_a", "neg_b")
    parts = part_table(laid, g, {f"__s_{c}": F.sum(c) for c in names})
    whole = Window.partitionBy(*g)
    offsets = parts.select(*g, PART, *[F.coalesce(F.sum(f"__s_{c}").over(before(g)), F.lit(0)).alias(f"__o_{c}") for c in names],
                           F.sum(F.col("__s_neg_a") + F.col("__s_neg_b")).over(whole).alias("__negs"))
    run = inside(g).rowsBetween(Window.unboundedPreceding, 0)
    summed = join_parts(laid.select("*", *[F.sum(c).over(run).alias(f"__r_{c}") for c in names]), offsets, g)
    above = {c: F.col(f"__r_{c}") + F.col(f"__o_{c}") - F.col(c) for c in names}
    at_neg, at_pos = F.col("neg_a") + F.col("neg_b"), F.col("pos_a") + F.col("pos_b")
    ranks = store(summed.select(
        *g, "score", *names, *[above[c].alias(f"above_{c}") for c in ("pos_a", "pos_b")],
        (2 * (F.col("__negs") - above["neg_a"] - above["neg_b"]) - at_neg).alias("of_pos"),
        (2 * (above["pos_a"] + above["pos_b"]) + at_pos).alias("of_neg")))
    totals = ranks.groupBy(*g).agg(F.sum("pos_a").alias("P"), F.sum("neg_a").alias("N"), *[
        F.sum(F.col(f"neg_{m}") * (2 * F.col(f"above_pos_{m}") + F.col(f"pos_{m}"))).alias(f"__auc_{m}") for m in "ab"])
    both = (F.col("P") > 0) & (F.col("N") > 0)
    observed = store(totals.select(*g, "P", "N", *[
        F.when(both, F.col(f"__auc_{m}") / (2.0 * F.col("P") * F.col("N"))).alias(f"metric_{m}") for m in "ab"]))

    def placed(side: str) -> DataFrame:
        return ranks.select(*g, F.col("score").alias(f"s{side}"), F.col("of_pos").alias(f"pos_{side}"), F.col("of_neg").alias(f"neg_{side}"))

    groups = observed.select(*g, F.monotonically_increasing_id().alias("__g"))
    groups = store(groups)
    moves = cells.join(placed("a"), [*g, "sa"]).join(placed("b"), [*g, "sb"]).join(F.broadcast(groups), g)
    moves = store(moves.where("y IN (0, 1)").select("__g", "__n", *seed_cols, F.when(F.col("y") == 1, F.col("pos_a") - F.col("pos_b")).otherwise(
        F.col("neg_a") - F.col("neg_b")).alias("__c")))
    # tasks are sized by draws, not by bytes
    spread = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), moves.count() * n // DRAWS_A_TASK)

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        step = max(1, CELLS_IN_CACHE // max(1, n))
        for batch in batches:
            pair, count, a, b, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("__g", "__n", "__a", "__b", "__c"))
            for p in np.unique(pair).tolist():
                mine = np.flatnonzero(pair == p)
                total = sums.setdefault(p, np.zeros(n))
                for i in range(0, len(mine), step):
                    at = mine[i:i + step]
                    stay = quantiles(uniforms(a[at], b[at], n), count[at], "swap").astype(np.float64)
                    total += 2.0 * (c[at].astype(np.float64) @ stay) - float(c[at] @ count[at])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
                                         names=["__g", "sums"])

    got = moves.repartition(spread).mapInArrow(signs, "__g long, sums array<double>")
    got = got.select("__g", F.posexplode("sums").alias("rep", "s")).groupBy("__g", "rep").agg(F.sum("s").alias("s"))
    diffs = got.join(F.broadcast(groups), "__g").join(F.broadcast(observed), g).select(
        *g, (F.col("rep") + 1).alias("rep"), F.when(both, F.abs("s") / (4.0 * F.col("P") * F.col("N"))).alias("diff"))
    return observed, diffs


class _Terms:
    """ROC and PR terms of one part, fed with blocks of rows by descending score."""

    def __init__(self, group: int, part: int, pos_above: np.ndarray, neg_above: np.ndarray):
        self.group, self.part = group, part
        self.pos, self.neg = pos_above, neg_above          # weight above the open score
        self.auc, self.ap = np.zeros_like(pos_above), np.zeros_like(pos_above)
        self.open: tuple[float, np.ndarray, np.ndarray] | None = None
        self.border: list[tuple] = []                      # first and last score, with weight above
        self.seen = 0

    def add(self, score: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        new = np.concatenate(([0], np.flatnonzero(score[1:] != score[:-1]) + 1))
        w = w.astype(np.float64)
        pos = np.add.reduceat(w * (y == 1)[:, None], new, axis=0)
        neg = np.add.reduceat(w, new, axis=0) - pos
        scores = score[new]
        if self.open is not None and self.open[0] == scores[0]:
            pos[0] += self.open[1]
            neg[0] += self.open[2]
        elif self.open is not None:
            self._settle(self.open[1][None, :], self.open[2][None, :], [self.open[0]])
        self._settle(pos[:-1], neg[:-1], scores[:-1].tolist())
        self.open = (float(scores[-1]), pos[-1], neg[-1])

    def _settle(self, pos: np.ndarray, neg: np.ndarray, scores: list[float]) -> None:
        """Complete tie groups; the part's first one is kept apart."""
        if not len(pos):
            return
        if not self.seen:
            self.border.append((scores[0], pos[0], neg[0], self.pos, self.neg))
            self.pos, self.neg = self.pos + pos[0], self.neg + neg[0]
            pos, neg = pos[1:], neg[1:]
        self.seen += len(scores)
        if not len(pos):
            return
        cum_pos, cum_neg = self.pos + np.cumsum(pos, axis=0), self.neg + np.cumsum(neg, axis=0)
        self.auc += (neg * (2 * cum_pos - pos)).sum(axis=0)
        both = cum_pos + cum_neg
        self.ap += np.divide(pos * cum_pos, both, out=np.zeros_like(both), where=both > 0).sum(axis=0)
        self.pos, self.neg = cum_pos[-1], cum_neg[-1]

    def close(self) -> None:
        if self.open is not None:
            self.border.append((*self.open, self.pos, self.neg))

    def result(self) -> pa.RecordBatch:
        zero = np.zeros_like(self.auc)
        rows = [(None, self.auc, self.ap, zero, zero, zero, zero)] + [(s, zero, zero, p, q, a, b) for s, p, q, a, b in self.border]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.group] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.float64()),
             *[pa.array([r[i].tolist() for r in rows], pa.list_(pa.float64())) for i in range(1, 7)]],
            names=["__g", "score", "auc", "ap", "pos", "neg", "pos_above", "neg_above"])
