"""Exact quantiles (linear interpolation) without one task per group.

Values collapse to (group, value, count); the distinct values are laid out in
order over range partitions and prefix counts find the two values around each
requested rank. Nothing but those values is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import before, inside, join_parts, lay_out, part_table


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value: str, probs: Sequence[float],
                    weight: str | None = None) -> DataFrame:
    """(group..., q array<double>): ``q[i]`` is the ``probs[i]`` quantile of the
    non-missing values (NULL and NaN left out), as linear interpolation between
    the two nearest ranks; groups without a value give no row. ``weight`` counts
    a row that many times."""
    g = list(group_cols)
    v = F.col(value).cast("double")
    counts = (df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*g, v.alias("__v"))
                .agg(F.sum(F.col(weight) if weight else F.lit(1)).cast("long").alias("__c")))
    laid = lay_out(counts, g, ["__v"])
    parts = part_table(laid, g, {"__pc": F.sum("__c")})
    whole = Window.partitionBy(*g)
    parts = parts.select(*g, "__part", F.coalesce(F.sum("__pc").over(before(g)), F.lit(0)).alias("__off"),
                         F.sum("__pc").over(whole).alias("__n"))
    run = F.sum("__c").over(inside(g).rowsBetween(Window.unboundedPreceding, 0))
    rows = join_parts(laid.withColumn("__upto", run), parts, g)
    upto, last = F.col("__off") + F.col("__upto"), F.col("__n") - 1
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (last * F.lit(float(p))).alias("at")) for i, p in enumerate(probs)])
    rows = rows.select(*g, "__v", (upto - F.col("__c")).alias("__lo"), (upto - 1).alias("__hi"), F.explode(wanted).alias("w"))
    floor, ceil = F.floor("w.at"), F.ceil("w.at")
    rows = rows.where(((floor >= F.col("__lo")) & (floor <= F.col("__hi"))) | ((ceil >= F.col("__lo")) & (ceil <= F.col("__hi"))))
    got = rows.groupBy(*g, F.col("w.i").alias("i"), F.col("w.at").alias("at")).agg(
        F.min("__v").alias("a"), F.max("__v").alias("b"))
    value_at = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    return got.groupBy(*g).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value_at.alias("q")))), lambda x: x["q"]).alias("q"))
