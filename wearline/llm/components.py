"""Connected components of a link table, as Spark jobs.

Large-star / small-star rounds: every node learns the least node among its
neighbours (an aggregation with map-side combine), the links of a node with
very many of them meet it by a broadcast of bounded size, and the links are
rewired to it until nothing changes.
Each round is written to the checkpoint folder; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: Centres with more links than this are hot, and than this share of all links.
HOT, HOT_SHARE = 64, 5000


def _with_least(both: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """Each of ``n`` links with its centre's least neighbour. Hot centres hold more
    than ``n / HOT_SHARE`` links (and ``HOT``), so there are fewer than ``HOT_SHARE``
    of them: they are broadcast and their links stay where they are; the links of
    the others meet by a shuffle in which no key is large."""
    hot = F.broadcast(least.where(F.col("size") > F.lit(max(HOT, n // HOT_SHARE))).select("a", "m"))
    rest = both.join(hot.select("a"), "a", "left_anti").join(least.select("a", "m"), "a")
    return rest.unionByName(both.join(hot, "a"))


def _star(links: DataFrame, large: bool, n: int) -> DataFrame:
    """One star round over ``n`` links (a, b) with a > b."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("size"))
    joined = _with_least(both, least, 2 * n if large else n)
    if large:  # neighbours above the centre go to its least neighbour
        made = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # the centre and its lower neighbours go to the least of them
        made = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return made.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b; any order, loops
    and repeats allowed); root is the least node of the component. Nodes that
    are their own root are left out. An empty link table gives no rows."""
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while True:
        half = stored(_star(now, True, mark[0]))
        now = stored(_star(half, False, _mark(half)[0]))
        new = _mark(now)
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new


def _mark(links: DataFrame) -> tuple:
    """Equal before and after a round that changes nothing."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
