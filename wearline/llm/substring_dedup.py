"""Removal of repeated word passages with difference-cover anchors.

A window of ``window`` consecutive words is removed when its word sequence
also starts anywhere else. Anchors are shorter windows hashed only where the
position in the document, modulo a period, lies in a difference cover: for any
two starts some common shift below the period brings both onto the cover, so
two equal windows share an anchor at the same offset.

1. Documents are packed into chunks of about ``CHUNK_BYTES`` and stored once.
2. Each chunk sends the distinct hashes of its anchors to hash-range buckets;
   a bucket answers each chunk with one bit per hash: also sent by another
   chunk or not. (Repeats inside a chunk are seen there.) A hash reaches its
   bucket once per chunk, however often the passage occurs.
3. Anchors that repeat are extended: every window that holds one is hashed as
   a whole (96 bits) and sent through the same exchange.
4. Words covered by a repeated window are removed.

Only packed arrays move: no pair of occurrences is ever formed, and texts move
once per answer, compressed, by chunk. A chunk meets its answers in a cogroup,
so a task holds one chunk at a time, however many its partition has.

Defined results: null text has no words (n_words 0, kept text empty); a text
below ``window`` words is kept whole; a repeated row is a repeat of its twin;
null ids are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, release, released, slices, stored

#: Period -> a set whose differences give every residue (perfect difference sets).
COVERS = {1: (0,), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
CHUNK_BYTES = 1 << 20
#: Bytes of hashes in a bucket: the least, and the most it may grow to.
BUCKET_BYTES = (1 << 20, 64 << 20)
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, anchor length) for a window length."""
    period = max(p for p in COVERS if p == 1 or p <= 0.6 * window)
    return period, COVERS[period], window - period + 1


def pack(df: DataFrame) -> DataFrame:
    """Chunks: (chunk_id, doc_ids, n_words, body); body is the zstd-compressed
    words, one space between words, of the chunk's documents in order."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        base, made = TaskContext.get().partitionId() << 33, 0
        ids, counts, bodies, total = [], [], [], 0
        out = pa.schema([("chunk_id", pa.int64()), ("doc_ids", pa.list_(id_type[0])),
                         ("n_words", pa.list_(pa.int64())), ("body", pa.binary())]) if id_type else None

        def row() -> pa.RecordBatch:
            body = press.compress(b" ".join(b for b in bodies if b))
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(
                (base + made, ids, counts, body), out)], schema=out)

        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    words = (text or "").encode().split()
                    ids.append(doc)
                    counts.append(len(words))
                    bodies.append(b" ".join(words))
                    total += len(bodies[-1]) + 16
                    if total >= CHUNK_BYTES:
                        yield row()
                        made += 1
                        ids, counts, bodies, total = [], [], [], 0
        if ids:
            yield row()

    from pyspark.sql.pandas.types import to_arrow_type
    id_type = [to_arrow_type(df.schema["doc_id"].dataType)]
    return df.mapInArrow(released(run), f"chunk_id long, doc_ids array<{kind}>, n_words array<long>, body binary")


class Chunk:
    """Words of a chunk with rolling hashes of any window length."""

    def __init__(self, n_words: list[int], body: bytes):
        self.words = zstandard.ZstdDecompressor().decompress(body).split()
        self.lens = np.array(n_words, dtype=np.int64)
        n = len(self.words)
        self.start = np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        self.end = self.start + np.repeat(self.lens, self.lens)
        digest = xxhash.xxh3_128_digest
        lanes = np.frombuffer(b"".join(map(digest, self.words)), dtype="<u8").reshape(n, 2)
        self.sums, self.back = [], []
        for lane, factor in enumerate(FACTORS):
            power = np.ones(n + 1, dtype=np.uint64)
            power[1:] = factor
            power = np.cumprod(power)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(lanes[:, lane] * power[:-1], out=total[1:])
            inverse = np.ones(n + 1, dtype=np.uint64)
            inverse[1:] = np.uint64(pow(int(factor), -1, 1 << 64))
            self.sums.append(total)
            self.back.append(np.cumprod(inverse))

    def hashes(self, at: np.ndarray, length: int, lane: int) -> np.ndarray:
        total = self.sums[lane]
        h = (total[at + length] - total[at]) * self.back[lane][at]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def anchors(self, window: int) -> np.ndarray:
        period, cover, length = cover_for(window)
        on = np.zeros(period, dtype=bool)
        on[list(cover)] = True
        at = np.arange(len(self.words))
        # a document shorter than the window has no window, so needs no anchor
        return at[on[(at - self.start) % period] & (at + length <= self.end) & (self.end - self.start >= window)]

    def windows(self, anchors: np.ndarray, window: int) -> np.ndarray:
        """Starts of the windows that hold one of the anchors."""
        step = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.add.at(step, np.maximum(anchors - cover_for(window)[0] + 1, self.start[anchors]), 1)
        np.add.at(step, anchors + 1, -1)
        at = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        return at[at + window <= self.end[at]]


class Keys:
    """Distinct hash keys of positions, in order, with the positions' indices."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.ones(len(high), dtype=bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        group = np.cumsum(new) - 1
        self.high, self.low = high[new], low[new]
        self.many = np.bincount(group, minlength=len(self.high)) > 1
        self.of = np.empty(len(order), dtype=np.int64)
        self.of[order] = group

    def repeated(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """Per position: does its key occur elsewhere? ``answers`` by bucket."""
        bits = [np.unpackbits(np.frombuffer(b, dtype=np.uint8)) for _, b in sorted(answers)]
        sizes = [int(x[:32].dot(1 << np.arange(31, -1, -1))) for x in bits]
        got = np.concatenate([x[32:32 + n] for x, n in zip(bits, sizes)]).astype(bool) if bits else np.zeros(0, bool)
        if len(got) != len(self.high):
            raise ValueError("answers don't match the keys that were sent")
        return (got | self.many)[self.of]


def anchor_keys(chunk: Chunk, window: int) -> tuple[np.ndarray, Keys]:
    at = chunk.anchors(window)
    h = chunk.hashes(at, cover_for(window)[2], 0)
    return at, Keys(h, np.zeros(len(h), dtype=np.uint32))


def window_keys(chunk: Chunk, window: int, answers: list) -> tuple[np.ndarray, Keys]:
    at, keys = anchor_keys(chunk, window)
    starts = chunk.windows(at[keys.repeated(answers)], window)
    return starts, Keys(chunk.hashes(starts, window, 0), chunk.hashes(starts, window, 1).astype(np.uint32))


def exchange(sent: DataFrame) -> DataFrame:
    """(chunk_id, kind, bucket, bits): what a bucket knows of each chunk's keys.
    ``bits`` holds the number of keys (32 bits) and one bit for each."""

    def run(table: pa.Table) -> pa.Table:
        highs = [np.frombuffer(b, dtype="<u8") for b in table["high"].to_pylist()]
        lows = [np.frombuffer(b, dtype="<u4") if b else np.zeros(len(h), "<u4")
                for b, h in zip(table["low"].to_pylist(), highs)]
        high, low = np.concatenate(highs), np.concatenate(lows)
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        same = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
        hit = np.zeros(len(high), dtype=bool)
        hit[1:] |= same
        hit[:-1] |= same
        back = np.empty(len(high), dtype=np.uint8)
        back[order] = hit
        edges = np.cumsum([len(h) for h in highs])[:-1]
        bits = [len(x).to_bytes(4, "big") + np.packbits(x).tobytes() for x in np.split(back, edges)]
        return pa.table({"chunk_id": table["chunk_id"], "kind": table["kind"], "bucket": table["bucket"],
                         "bits": pa.array(bits, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "chunk_id long, kind int, bucket int, bits binary")


SENT = "chunk_id long, kind int, bucket int, high binary, low binary"


def messages(chunk_id: int, kind: int, keys: Keys, buckets: int) -> pa.RecordBatch:
    """The distinct keys of a chunk, a row per bucket: anchors (kind 0) or windows (kind 1)."""
    schema = pa.schema([("chunk_id", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()),
                        ("high", pa.binary()), ("low", pa.binary())])
    to = ((keys.high >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edges = np.searchsorted(to, np.arange(buckets + 1))
    used = np.flatnonzero(edges[1:] > edges[:-1])
    high, low = keys.high.astype("<u8"), keys.low.astype("<u4")
    spans = [(int(edges[b]), int(edges[b + 1])) for b in used]
    return pa.RecordBatch.from_arrays([
        pa.array([chunk_id] * len(used), pa.int64()), pa.array([kind] * len(used), pa.int32()),
        pa.array(used, pa.int32()), pa.array([high[a:b].tobytes() for a, b in spans], pa.binary()),
        pa.array([low[a:b].tobytes() if kind else None for a, b in spans], pa.binary())], schema=schema)


def send_anchors(chunks: DataFrame, window: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one chunk at a time: a batch may hold a whole partition
                row = batch.slice(i, 1).to_pylist()[0]
                yield messages(row["chunk_id"], 0, anchor_keys(Chunk(row["n_words"], row["body"]), window)[1], buckets)

    return chunks.mapInArrow(released(run), SENT)


def send_windows(chunks: DataFrame, anchors: DataFrame, window: int, buckets: int) -> DataFrame:
    def run(row: dict, answers: tuple[list, list]) -> pa.RecordBatch:
        _, keys = window_keys(Chunk(row["n_words"], row["body"]), window, answers[0])
        return messages(row["chunk_id"], 1, keys, buckets)

    return with_answers(chunks.drop("doc_ids"), anchors, run, SENT)


def with_answers(chunks: DataFrame, answers: DataFrame, fn: Callable[[dict, tuple[list, list]], pa.RecordBatch],
                 schema: str) -> DataFrame:
    """``fn`` of each chunk and the answers to its own keys (as many bits as keys
    sent), of anchors and of windows; a chunk without any key has none."""

    def run(mine: pa.Table, got: pa.Table) -> pa.Table:
        lists = ([], [])
        for kind, bucket, bits in zip(*(got[n].to_pylist() for n in ("kind", "bucket", "bits"))):
            lists[kind].append((bucket, bits))
        out = pa.Table.from_batches([fn(row, lists) for row in mine.to_pylist()])
        release()
        return out

    return chunks.groupBy("chunk_id").cogroup(answers.groupBy("chunk_id")).applyInArrow(run, schema)


def n_buckets(total_bytes: int) -> int:
    least, most = BUCKET_BYTES
    return max(1, -(-total_bytes // max(least, min(most, total_bytes // 4096))))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept string) of every row; see the module text."""
    src = pick(df, doc_id=id_col, text=text_col)
    chunks = stored(pack(src))
    n_words = chunks.select(F.sum(F.aggregate("n_words", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    period, cover, _ = cover_for(window)
    anchors = exchange(send_anchors(chunks, window, n_buckets(n_words * len(cover) * 8 // period)))
    anchors = stored(anchors.repartition("chunk_id"))  # few bits: as few files as they fill
    windows = exchange(send_windows(chunks, anchors, window, n_buckets(n_words * 12 // 3)))
    kind = src.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type
    schema = pa.schema([("doc_id", to_arrow_type(src.schema["doc_id"].dataType)), ("n_words", pa.int64()),
                        ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(row: dict, answers: tuple[list, list]) -> pa.RecordBatch:
        chunk = Chunk(row["n_words"], row["body"])
        starts, keys = window_keys(chunk, window, answers[0])
        starts = starts[keys.repeated(answers[1])]
        step = np.zeros(len(chunk.words) + 1, dtype=np.int64)
        step[starts] += 1
        np.add.at(step, starts + window, -1)
        keep = np.cumsum(step[:-1]) == 0
        removed, kept, at = [], [], 0
        for n in row["n_words"]:
            mine = keep[at:at + n]
            removed.append(n - int(mine.sum()))
            kept.append(b" ".join(compress(chunk.words[at:at + n], mine.tolist())).decode())
            at += n
        return pa.RecordBatch.from_arrays(
            [pa.array(v, type=f.type) for v, f in zip((row["doc_ids"], row["n_words"], removed, kept), schema)],
            schema=schema)

    return with_answers(chunks, anchors.unionByName(windows), run,
                        f"doc_id {kind}, n_words long, n_removed long, kept string")
