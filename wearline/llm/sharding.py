"""Shards by a Feistel permutation over global row numbers.

Rows are numbered 0 to N - 1 in the order of id, text hash and size (range
partitions, offsets from one count per partition; no text moves). A keyed
Feistel network permutes these numbers: the row stands at position p of the
shuffled table, in shard ``p % shards`` and slot ``p // shards``. So every
shard holds ``N / shards`` rows, one more or less, slots have no gap, and the
shuffle depends on the rows and the key alone, not on files or partitions.

The network works on pairs (l, r) of l < a, r < b with a * b just above N: a
round turns (l, r) into (r, (l + f(r)) mod the side of l). Numbers of N and
above are walked on: the permutation is applied again until the result lies
below N (cycle walking), which keeps it one to one. ``place`` and ``row_at``
compute either direction for single rows, without a table.

The law is ``rows``. Shards are dealt by row number, so equal texts are not
held together: a group of copies may be larger than a shard, and counts at
most one apart would break.

Defined results: a null text has no bytes (size 16, crc32 0); null ids come
first, like any other value; repeated rows have numbers of their own; an empty
table gives no rows; extra columns are ignored by ``shard_rows`` and kept by
``write_shards``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.operators.sequence import MARK, number_within_key

from .common import pick

LAW = "rows"
#: Bytes that a row counts besides its text.
ROW_BYTES = 16
ROUNDS = 6
#: Round values are taken modulo this prime, so products stay below 2^62.
PRIME = (1 << 31) - 1
#: Rows that the sides of the network can hold: both stay below the prime.
MOST_ROWS = 1 << 60


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Two numbers below the prime per round, from the seed."""
    digest = b"".join(hashlib.sha256(f"shard-{seed}-{i}".encode()).digest()[:8] for i in range(ROUNDS))
    words = np.frombuffer(digest, dtype="<u4").astype(np.int64) % (PRIME - 1) + 1
    return [(int(a), int(b)) for a, b in words.reshape(-1, 2)]


def sides(n: int) -> tuple[int, int]:
    """Sides (a, b) of the pairs for n numbers: a * b >= n, less than one side over."""
    if n > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows")
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _mixed(r, key: tuple[int, int]):
    """Round value of the right side (numbers or int64 arrays), below the prime."""
    x = (r * key[0] + key[1]) % PRIME
    x = (x * x + r) % PRIME
    return (x * x + key[1]) % PRIME


def forward(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """One pass of the network over numbers below a * b."""
    a, b = sides(n)
    l, r = x // b, x % b
    for key in round_keys(seed):
        l, r, a, b = r, (l + _mixed(r, key)) % a, b, a
    return l * b + r


def backward(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The inverse of ``forward``."""
    a, b = sides(n)  # an even number of rounds ends with the sides in place
    l, r = x // b, x % b
    for key in reversed(round_keys(seed)):
        l, r, a, b = (r - _mixed(l, key)) % b, l, b, a
    return l * b + r


def walked(step, x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``step`` applied until every number lies below n again."""
    out = step(np.asarray(x, dtype=np.int64), n, seed)
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = step(out[far], n, seed)
    return out


def place(row: int, n: int, shards: int, seed: int = 42) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    p = int(walked(forward, np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 42) -> int:
    """The row number that stands in a slot of a shard."""
    return int(walked(backward, np.array([slot * shards + shard]), n, seed)[0])


def permuted(numbered: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows with ``row_no`` below n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = walked(forward, batch.column("row_no").to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)],
                                             names=[*batch.schema.names, "shard", "slot"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)
    return numbered.mapInArrow(run, f"{fields}, shard int, slot long")


def numbered(df: DataFrame, order: list) -> DataFrame:
    """``df`` with ``row_no`` 0, 1, ... in the order of ``order``; rows equal in all
    of it are told apart by where they were read, so none of them piles up."""
    src = df.withColumn("__all", F.lit(0)).withColumn("__tie", F.monotonically_increasing_id())
    return number_within_key(src, "__all", [*order, "__tie"], pos_col="row_no", total_col=None).drop("__all", "__tie", MARK)


def shard_rows(df: DataFrame, shards: int = 40, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, row_no) of every row."""
    src = pick(df, doc_id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    rows = src.select("doc_id", (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                      F.xxhash64(text).alias("h"))
    out = permuted(numbered(rows, ["doc_id", "h", "size"]).drop("h"), rows.count(), shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "row_no")


def write_shards(df: DataFrame, path: str, shards: int = 40, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
                 files_a_shard: int = 1) -> None:
    """All columns of ``df`` as Parquet under ``path/shard=k``, each file a run of
    slots in order. Rows travel in the layout of their numbers and once to their
    shard; a shard larger than one task should write has several files."""
    names = df.columns
    src = df.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)])
    key, text = f"in_{names.index(id_col)}", f"in_{names.index(text_col)}"
    n = src.count()
    out = permuted(numbered(src.withColumn("h", F.xxhash64(F.coalesce(text, F.lit("")))), [key, "h", F.octet_length(text)]).drop("h"),
                   n, shards, seed)
    run = F.floor(F.col("slot") * files_a_shard / F.lit(max(1, -(-n // shards)))).cast("int")
    out = out.select(*[F.col(f"in_{i}").alias(f"{c}_in" if c in ("shard", "slot") else c) for i, c in enumerate(names)], "shard", "slot")
    (out.withColumn("__run", run).repartition(shards * files_a_shard, "shard", "__run").sortWithinPartitions("shard", "slot").drop("__run")
        .write.partitionBy("shard").parquet(path))
