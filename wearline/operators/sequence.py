"""Ordered layouts: positions and running sums inside a key without a hot task.

``row_number().over(partitionBy(key))`` sends every row of a key to one task.
Here the table is range-partitioned by (key, order columns), sorted, tagged
with ``monotonically_increasing_id`` (partition number and row number in it)
and written once to the shared checkpoint folder. Partitions hold about equal
numbers of rows, so a key with a third of all rows simply spans many of them;
nothing depends on how large a key is, NULL keys and NULL order values are
ordinary values (NULLs first, as Spark sorts them).

``(key, part)`` aggregates form a table of at most keys + partitions rows.
Prefix sums over it give every part its offset; it is broadcast only while its
counted size is at most ``MAX_BROADCAST_ROWS``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store

MARK = "__m"
PART = "__part"
MAX_BROADCAST_ROWS = 200_000


def _cols(cols: str | Column | Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in ([cols] if isinstance(cols, (str, Column)) else cols)]


def lay_out(df: DataFrame, key: str | Sequence[str], order_cols: Sequence[str | Column],
            partitions: int | None = None) -> DataFrame:
    """``df`` sorted by (key, order) over range partitions, stored, with the
    columns ``__m`` (increasing in that order) and ``__part``. ``partitions``
    fixes their number where rows are few but costly."""
    by = [*_cols(key), *_cols(order_cols)]
    laid = (df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)).sortWithinPartitions(*by)
    return store(laid.withColumn(MARK, F.monotonically_increasing_id())).withColumn(PART, F.shiftright(MARK, 33))


def part_table(laid: DataFrame, key: str | Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """One stored row per (key, part) with the given aggregates."""
    keys = [key] if isinstance(key, str) else list(key)
    return store(laid.groupBy(*keys, PART).agg(*[a.alias(n) for n, a in aggs.items()]))


def join_parts(laid: DataFrame, parts: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Columns of the part table attached to every row (NULL keys match)."""
    keys = [key] if isinstance(key, str) else list(key)
    small = parts.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    right = parts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(PART).alias("__k_part"),
                         *[c for c in parts.columns if c not in keys and c != PART])
    on = F.col(PART) == F.col("__k_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = laid.join(F.broadcast(right) if small else right, on)
    return joined.drop("__k_part", *[f"__k_{k}" for k in keys])


def before(key: str | Sequence[str]):
    """Window over the parts of a key that precede the current one."""
    return Window.partitionBy(*_cols(key)).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def inside(key: str | Sequence[str]):
    """Window over the rows of one (key, part), in order."""
    return Window.partitionBy(*_cols(key), PART).orderBy(MARK)


def number_within_key(df: DataFrame, key: str, order_cols: Sequence[str | Column], pos_col: str = "pos",
                      total_col: str | None = "n_rows", part_aggs: Mapping[str, Column] | None = None,
                      key_aggs: Mapping[str, Column] | None = None, key_table: DataFrame | None = None) -> DataFrame:
    """Attach a 0-based position (ordered by ``order_cols``) within ``key``.

    ``part_aggs`` are aggregated per (key, part) -- they may use ``__m``, which
    follows the order -- and ``key_aggs`` combine them per key. ``key_table``
    (key + attributes, one row per key) is inner-joined to the small part
    table, so per-key attributes reach the rows through the join that happens
    anyway; keys absent from it drop out. ``__m`` stays in the result.
    """
    laid = lay_out(df, key, order_cols)
    parts = part_table(laid, key, {"__first": F.min(MARK), "__n": F.count(F.lit(1)), **(part_aggs or {})})
    whole = Window.partitionBy(key)
    parts = parts.select(
        key, PART, "__first", F.coalesce(F.sum("__n").over(before(key)), F.lit(0)).alias("__off"),
        *([F.sum("__n").over(whole).alias(total_col)] if total_col else []),
        *[agg.over(whole).alias(name) for name, agg in (key_aggs or {}).items()])
    if key_table is not None:
        parts = parts.join(key_table, key)
    out = join_parts(laid, store(parts), key)
    return out.withColumn(pos_col, (F.col("__off") + F.col(MARK) - F.col("__first")).cast("long")).drop("__off", "__first", PART)
