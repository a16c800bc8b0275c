"""Literal grids and bin lookup, evaluated JVM-side.

Bin edges are produced once on the driver (NumPy ``linspace``) and shipped
as literal doubles; a row's bin is found by comparing against those
literals, never by recomputing the edge in SQL arithmetic (``width_bucket``
puts 0.3 into the wrong one of ten bins).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def linspace(start: float, stop: float, num: int) -> list[float]:
    return [float(v) for v in np.linspace(start, stop, num)]


def _lit_array(values: list[float]) -> Column:
    # one array literal (a single constant in generated code)
    return F.lit([float(v) for v in values])


def count_le(x: Column, edges: list[float]) -> Column:
    """Number of literal ``edges`` that are <= x (edges ascending, evenly spaced)."""
    g = len(edges)
    if g == 0:
        return F.lit(0)
    e0 = float(edges[0])
    h = (float(edges[-1]) - e0) / (g - 1) if g > 1 else 1.0
    return count_le_array(x, _lit_array(edges), F.lit(e0), F.lit(h if h > 0 else 1.0), g)


def count_le_array(x: Column, arr: Column, e0: Column, h: Column, g: int) -> Column:
    """Number of entries of the ascending, evenly spaced array ``arr`` (g
    entries, first e0, spacing h) that are <= x.

    An arithmetic guess k0 is off by at most one from the true count c (the
    edges are the rounded values ``i*h + e0``); one comparison on each side
    against the actual edge values makes it exact:
    c = k0 + [arr[k0] <= x] - [arr[k0-1] > x].
    """
    guess = F.floor((x - e0) / h).cast("long") + 1
    k0 = F.least(F.greatest(guess, F.lit(0)), F.lit(g)).cast("int")
    up = F.when((k0 < g) & (F.element_at(arr, F.least(k0 + 1, F.lit(g))) <= x), 1).otherwise(0)
    down = F.when((k0 > 0) & (F.element_at(arr, F.greatest(k0, F.lit(1))) > x), 1).otherwise(0)
    return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(k0 + up - down)


def count_le_sorted(x: Column, edges: list[float]) -> Column:
    """Number of literal ``edges`` (ascending, any spacing) that are <= x, as a
    balanced tree of comparisons; for up to some hundred edges."""
    def below(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x >= F.lit(float(edges[mid])), below(mid + 1, hi)).otherwise(below(lo, mid))

    return below(0, len(edges))


def linspace_array(lo: Column, hi: Column, num: int) -> Column:
    """Per-row ``np.linspace(lo, hi, num)`` as an array column (same IEEE steps:
    i*step + lo, last = hi)."""
    step = (hi - lo) / F.lit(float(num - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(num - 1)),
                       lambda i: F.when(i == num - 1, hi).otherwise(i.cast("double") * step + lo))


def histogram_bin(x: Column, edges: list[float]) -> Column:
    """NumPy ``histogram`` bin: [e_i, e_i+1), the last bin closed; NULL outside."""
    n_bins = len(edges) - 1
    c = count_le(x, edges)
    idx = F.when(x == F.lit(float(edges[-1])), F.lit(n_bins - 1)).otherwise(c - 1)
    return F.when((x >= F.lit(float(edges[0]))) & (x <= F.lit(float(edges[-1]))), idx)


def digitize_clipped(x: Column, edges: list[float]) -> Column:
    """``clip(digitize(x, edges) - 1, 0, n_bins - 1)``."""
    n_bins = len(edges) - 1
    return F.least(F.greatest(count_le(x, edges) - 1, F.lit(0)), F.lit(n_bins - 1))


def half_open_bin(x: Column, edges: list[float]) -> Column:
    """Bin i for e_i <= x < e_i+1; NULL for x outside [e_0, e_n) (so 1.0 drops)."""
    n_bins = len(edges) - 1
    idx = count_le(x, edges) - 1
    return F.when((idx >= 0) & (idx < n_bins), idx)


def grid_sql(start: float, stop: float, num: int, name: str = "t") -> str:
    """DuckDB/Spark SQL that yields the same doubles as ``np.linspace``."""
    step = f"((CAST({stop!r} AS DOUBLE) - CAST({start!r} AS DOUBLE)) / {num - 1}.0)"
    return (f"SELECT i AS grid_idx, CASE WHEN i = {num - 1} THEN CAST({stop!r} AS DOUBLE) "
            f"ELSE CAST(i AS DOUBLE) * {step} + CAST({start!r} AS DOUBLE) END AS {name} "
            f"FROM range({num}) r(i)")
