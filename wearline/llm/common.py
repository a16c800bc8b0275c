"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.session import ensure_checkpoint_dir

#: Separator bytes between words; ``bytes.split()`` uses exactly these six.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Project the named columns under fixed names (``role=column``), so extra
    columns of the input, whatever they are called, never reach an operator."""
    return df.select(*[F.col(f"`{c}`").alias(role) for role, c in names.items()])


def map_rows(df: DataFrame, fn: Callable[[dict], dict], schema: str,
             limit_bytes: int = 16 << 20, text: str | None = "text",
             after: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` over slices of a batch whose texts sum to ``limit_bytes``.

    ``fn`` takes and returns a dict of column lists (or numpy arrays); a slice
    holds at least one row, so memory is bounded by the longest text. ``after``
    runs in the worker at the end of each task.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit_bytes):
                out = fn({n: part.column(n).to_pylist() for n in part.schema.names})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(released(run, after), schema)


def released(run: Callable, after: Callable[[], None] | None = None) -> Callable:
    """``run`` for ``mapInArrow``; at the end of a task the worker, which lives on
    for the next one, hands free memory back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if after:
            after()
        release()

    return whole


def release() -> None:
    """Hand a worker's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, text: str | None, limit_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit_bytes`` of text each."""
    if text is None or batch.nbytes <= limit_bytes:
        if batch.num_rows:
            yield batch
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)
