"""Special functions without a Spark SQL built-in (no erf/erfc, no normal quantile)."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this argument erfc is one minus a series, from it on a continued fraction.
SERIES_BELOW = 2.0
SERIES_TERMS, FRACTION_TERMS = 60, 120


def _erfc_of_square(x: Column) -> Column:
    """erfc(z) for x = z^2 >= 0, to about 1e-13 of its value, in column expressions.

    z < 2: 1 - 2/sqrt(pi) exp(-x) z * sum (2x)^n / (1*3*...*(2n+1)), all terms positive.
    z >= 2: exp(-x) / (z sqrt(pi)) / (1 + q/(1 + 2q/(1 + 3q/...))), q = 1/(2x), from the inside out.
    """
    z = F.sqrt(x)
    one = F.lit(1.0)
    start = F.struct(one.alias("term"), one.alias("total"))

    def add(s: Column, n: Column) -> Column:
        term = s["term"] * 2.0 * x / (2.0 * n.cast("double") + 1.0)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(SERIES_TERMS)), start, add, lambda s: s["total"])
    small = 1.0 - 2.0 / math.sqrt(math.pi) * F.exp(-x) * z * series
    q = one / (2.0 * F.greatest(x, one))
    fraction = F.aggregate(F.sequence(F.lit(FRACTION_TERMS), F.lit(1), F.lit(-1)), one, lambda f, n: one + n.cast("double") * q / f)
    large = F.exp(-x) / (F.greatest(z, one) * math.sqrt(math.pi)) / fraction
    return F.when(z < SERIES_BELOW, small).otherwise(large)


def chi2_df1_sf(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom, erfc(sqrt(x / 2)); 1 for
    x <= 0, null for null."""
    return F.when(x <= 0, F.lit(1.0)).otherwise(_erfc_of_square(x.cast("double") / 2.0))


def chi2_df1_sf_exact(x: float) -> float:
    return math.erfc(math.sqrt(x / 2.0)) if x > 0 else 1.0


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
