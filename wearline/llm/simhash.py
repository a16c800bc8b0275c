"""SimHash near-duplicates through pivot distance tables.

Reference fingerprints: zero, and one per pair of neighbouring bits (64 bits:
33 references). A table row holds a fingerprint's Hamming distances to all of
them. By the triangle inequality two fingerprints within ``max_bits`` differ
by at most ``max_bits`` in every coordinate, and, as the pairs of bits are
disjoint, in at most ``max_bits`` of the differences to the zero reference. So
when those differences are dealt into ``max_bits + 3`` groups, at least three
groups agree: every choice of three groups is a join key (10 keys for two
bits). Candidates with equal keys are discarded by the largest coordinate
difference and the survivors verified by the Hamming distance itself.

Equal fingerprints are one class before any of this. Large key groups are cut
into blocks that meet pairwise, and a task reports only a spanning forest of
the links it found, never all pairs of a group.

Defined results: null and empty texts have fingerprint zero and link like any
other; texts with fewer words than a shingle are one shingle; a component's
id is its least non-null doc_id (null if it has none); repeated rows share a
component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, pick, released, stored
from .components import components

#: Members of one block of a key group.
BLOCK = 1024
PAIRS_OF_BITS = np.array([3 << (2 * i) for i in range(32)], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a whole text (unsigned)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    h = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i:i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, **carried: str) -> DataFrame:
    """(doc_id, fp long) of every row; ``fp`` holds the 64 bits as a signed long.
    ``carried`` (role=column) stays beside them."""

    def run(cols: dict) -> dict:
        fp = np.array([fingerprint(t, shingle) for t in cols["text"]], dtype=np.uint64).view(np.int64)
        return {"doc_id": cols["doc_id"], "fp": fp, **{c: cols[c] for c in carried}}

    src = pick(df, doc_id=id_col, text=text_col, **carried)
    more = "".join(f", {c} {src.schema[c].dataType.simpleString()}" for c in carried)
    return map_rows(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long{more}")


def distance_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances (n, 33) to the references: zero, then each pair of bits."""
    return np.bitwise_count(fp[:, None] ^ np.concatenate(([np.uint64(0)], PAIRS_OF_BITS))[None, :])


def join_keys(table: np.ndarray, max_bits: int) -> np.ndarray:
    """Keys (n, choices) of each row: hashes of three groups of differences."""
    diff = (table[:, 1:].astype(np.int64) - table[:, :1]) + 2  # 2 - 2 * (bits set in the pair) + 2
    groups = np.array_split(np.arange(32), max_bits + 3)
    code = np.stack([(diff[:, g] * 5 ** np.arange(len(g))).sum(axis=1) for g in groups], axis=1).astype(np.uint64)
    keys = []
    for i, choice in enumerate(combinations(range(len(groups)), 3)):
        h = np.full(len(table), i, dtype=np.uint64)
        for g in choice:
            h = (h ^ code[:, g]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        keys.append(h.view(np.int64))
    return np.stack(keys, axis=1)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member reachable from each of n nodes along links a-b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return root


def candidates_linked(fp: np.ndarray, side: np.ndarray, group: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that are sorted by group. Rows of one group meet at every
    shift at once; where a group joins two blocks (sides 0 and 1) only rows of
    different blocks meet (side 2: a block meets itself)."""
    table = distance_table(fp)
    size = np.bincount(group)
    left = size[group] - (np.arange(len(group)) - (np.cumsum(size) - size)[group])  # rows of the group from here on
    found_a, found_b = [], []
    rows = np.arange(len(fp))
    for shift in range(1, int(size.max(initial=1))):
        rows = rows[left[rows] > shift]
        other = rows + shift
        near = (side[rows] == 2) | (side[rows] != side[other])
        a, b = rows[near], other[near]
        for j in (0, 1, 9, 17, 25):  # a few coordinates first, then all
            ok = np.abs(table[a, j].astype(np.int8) - table[b, j].astype(np.int8)) <= max_bits
            a, b = a[ok], b[ok]
        ok = np.abs(table[a].astype(np.int8) - table[b].astype(np.int8)).max(axis=1, initial=0) <= max_bits
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
        found_a.append(a[ok])
        found_b.append(b[ok])
    empty = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(found_a or empty), np.concatenate(found_b or empty)


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints within ``max_bits``."""

    def spread(cols: dict) -> dict:
        fp = np.array(cols["fp"], dtype=np.int64)
        keys = join_keys(distance_table(fp.view(np.uint64)), max_bits)
        return {"key": keys.ravel(), "fp": np.repeat(fp, keys.shape[1])}

    keyed = map_rows(fps.select("fp"), spread, "key long, fp long", text=None)
    sizes = (keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
             .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    met = keyed.join(sizes, "key").withColumn(
        "mine", F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks"))).cast("int"))
    # block i meets every block j: (min, max) names the meeting, side tells which of the two a row is
    met = met.select("key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", "fp", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"))
    met = met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: np.ndarray | None = None
        for batch in batches:
            now = np.stack([batch.column(c).to_numpy() for c in ("key", "lo", "hi", "fp", "side")], axis=1)
            rest = now if rest is None else np.concatenate((rest, now))
            if not len(rest):
                continue
            new = np.flatnonzero((rest[1:, :3] != rest[:-1, :3]).any(axis=1)) + 1
            if len(new) and len(rest) >= 20_000:
                yield settle(rest[:new[-1]])
                rest = rest[new[-1]:]
        if rest is not None and len(rest):
            yield settle(rest)

    def settle(rows: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([False], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))
        a, b = candidates_linked(rows[:, 3].astype(np.int64).view(np.uint64), rows[:, 4], np.cumsum(new), max_bits)
        # a fingerprint stands in many groups: number the distinct ones, report a forest
        ids, of = np.unique(rows[:, 3], return_inverse=True)
        root = forest(len(ids), of[a], of[b])
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved], pa.int64()), pa.array(ids[root[moved]], pa.int64())],
                                          schema=schema)

    return met.mapInArrow(released(verify), "a long, b long")


def grouped(df: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, **carried: str) -> DataFrame:
    """(doc_id, fp, root, component_id): root is the least fingerprint of the component."""
    docs = stored(fingerprints(df, id_col, text_col, shingle, **carried))
    classes = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes, max_bits))
    member = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = member.join(member.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return docs.join(named, "fp").select("doc_id", "fp", "root", "component_id", *carried)


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   max_bits: int = 2) -> DataFrame:
    """(doc_id, fp long, component_id) of every row; see the module text."""
    return grouped(df, id_col, text_col, shingle, max_bits).drop("root")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each component with all columns of ``df``: that of the least id
    (null where the component has no id; of repeated ids the least fingerprint,
    then the least hash of the row).

    Survivors are chosen over ids, fingerprints and row hashes; texts are
    fingerprinted once and travel once, to the join that keeps them. Only rows
    that are equal in every column need a second step."""
    names = df.columns
    src = df.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)])
    hashed = [f.name for f in src.schema if f.dataType.typeName() not in ("map", "variant")]
    src = src.withColumn("row", F.xxhash64(*hashed))
    at, key = f"in_{names.index(text_col)}", f"in_{names.index(id_col)}"
    rows = grouped(src, key, at, shingle, max_bits, row="row").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    alike = rows.groupBy("root", "fp", "row", "doc_id").agg(F.count("*").alias("n"))
    stay = stored(alike.groupBy("root").agg(F.min(F.struct("fp", "row", "doc_id", "n")).alias("s")).select(
        F.col("s.row").alias("stay_row"), F.col("s.doc_id").alias("stay_id"), F.col("s.n").alias("stay_n")))
    kept = src.join(stay, (src["row"] == stay["stay_row"]) & src[key].eqNullSafe(stay["stay_id"]))
    if not stay.where("stay_n > 1").isEmpty():
        kept = kept.where("stay_n = 1").unionByName(kept.where("stay_n > 1").dropDuplicates(["row", key]))
    return kept.select(*[F.col(f"in_{i}").alias(n) for i, n in enumerate(names)])
