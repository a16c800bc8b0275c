"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic) by tokens. Target
marginals are tempered shares (tokens ** exponent, normalised) or given
shares. Raking multiplies the cell weights, marginal by marginal, until the
largest error of a marginal is below ``TOLERANCE``; targets that no weights meet
(a wanted category without tokens) end it when the error no longer falls. A
document's probability is its cell's raked weight per
token, scaled so that ``rate`` of all tokens is expected and capped at 1 (the
scale that keeps the expectation is found exactly over the ordered cells); it
is kept when a hash of its id, spread over [0, 1), falls below it.

Only the cells are raked, DataFrame windows over a table of
sources x languages x topics rows; documents are aggregated into it before any
shuffle. Cells reach documents by a broadcast join while their counted number
is at most ``MAX_BROADCAST_CELLS``, by a shuffle join beyond.

Defined results: null source or language is a category of its own; null text
has no tokens and topic ``general``; a document without tokens has its cell's
probability (0 where the cell holds no token); a null id draws like the empty
id; repeated rows share their draw; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline.operators.sequence import MARK, PART, lay_out

from .common import stored
from .quality_rules import words_of

# ---- fixed values: topic phrases, first match wins ----
TOPICS = (
    ("licensing", ("icensed under", "eleased under", "License", "All rights reserved")),
    ("credentials", ("password", "token =", "AKIA", "secret")),
    ("contact", ("@",)),
    ("markup", ("###", "%%%", " | ")),
)
OTHER = "general"
# -------------------------------------------------------
DIMS = ("source", "lang", "topic")
#: Rounds between two looks at the marginals; the error that counts as met.
ROUNDS_A_PLAN, TOLERANCE = 8, 1e-10
#: An error that falls by less than this share between two looks falls no longer.
STALLED = 1e-6
MAX_BROADCAST_CELLS = 50_000
NONE = "<null>"


def topic_of(text: Column) -> Column:
    out = F
    for name, phrases in TOPICS:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | text.contains(p)
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit(OTHER))


def draw_of(id_col: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def keys_of(df: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> list[Column]:
    return [F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NONE)).alias("__source"),
            F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NONE)).alias("__lang"),
            topic_of(F.col(f"`{text_col}`")).alias("__topic")]


def cells_of(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens) of documents with columns of ``DIMS`` and n_tokens."""
    return docs.groupBy(*DIMS).agg(F.sum("n_tokens").cast("double").alias("tokens")).where("tokens > 0")


def rake(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]]) -> DataFrame:
    """Adds ``weight``: cell shares whose marginals meet the targets."""
    total = Window.partitionBy()
    now = cells.withColumn("__all", F.sum("tokens").over(total))
    now = now.withColumn("weight", F.col("tokens") / F.col("__all"))
    for d in DIMS:
        target = targets[d]
        w = Window.partitionBy(d)
        if isinstance(target, Mapping):
            given = F.create_map(*[F.lit(x) for kv in target.items() for x in kv])
            raw = F.coalesce(F.element_at(given, F.col(d)), F.lit(0.0))
        else:
            raw = F.pow(F.sum("tokens").over(w) / F.col("__all"), F.lit(float(target)))
        now = now.withColumn("__raw", raw).withColumn("__n", F.count("*").over(w))
        # each category's raw share once: its cells carry 1/n of it
        now = now.withColumn(f"__t_{d}", F.col("__raw") / F.sum(F.col("__raw") / F.col("__n")).over(total)).drop("__raw", "__n")
    now = stored(now)
    error = float("inf")
    while True:
        for _ in range(ROUNDS_A_PLAN):
            for d in DIMS:
                have = F.sum("weight").over(Window.partitionBy(d))
                now = now.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"__t_{d}") / have).otherwise(0.0))
        now = stored(now)
        last, error = error, marginal_error(now)
        if error < TOLERANCE or error > (1 - STALLED) * last:
            return now.select(*DIMS, "tokens", "weight")


def marginal_error(cells: DataFrame) -> float:
    """The largest distance of a marginal share of ``weight`` from its target; one
    number to the driver (0 for no cells)."""
    off = [cells.groupBy(d).agg(F.abs(F.sum("weight") - F.max(f"__t_{d}")).alias("e")).select("e") for d in DIMS]
    return off[0].unionByName(off[1]).unionByName(off[2]).agg(F.max("e")).first()[0] or 0.0


def probabilities(raked: DataFrame, rate: float) -> DataFrame:
    """(source, lang, topic, probability): ratio of raked to present share, scaled
    to an expected ``rate`` of all tokens with a cap of 1."""
    whole = raked.agg(F.sum("tokens")).first()[0] or 0.0
    ratio = F.col("weight") * F.lit(whole) / F.col("tokens")
    # prefix sums over range partitions in falling order of the ratio: a table of parts gives the offsets
    laid = lay_out(raked.withColumn("ratio", ratio), [], [F.desc("ratio"), *DIMS])
    scaled = F.col("tokens") * F.col("ratio")
    parts = laid.groupBy(PART).agg(F.sum("tokens").alias("t"), F.sum(scaled).alias("s"))
    ahead = Window.orderBy(PART)  # one row a part
    parts = stored(parts.select(PART, F.coalesce(F.sum("t").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__above"),
                                F.coalesce(F.sum("s").over(ahead.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)).alias("__below")))
    here = Window.partitionBy(PART).orderBy(MARK)
    r = laid.join(F.broadcast(parts), PART)
    capped = F.col("__above") + F.coalesce(F.sum("tokens").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.col("__below") + F.sum(scaled).over(here.rowsBetween(0, Window.unboundedFollowing))
    r = r.withColumn("__scale", (F.lit(rate * whole) - capped) / rest)
    # cells before the first one whose scaled ratio stays below 1 are capped
    first = r.where(F.col("__scale") * F.col("ratio") <= 1).agg(F.min(F.struct(MARK, "__scale")).alias("f")).select("f.*").first()
    if first is None or first[0] is None:
        return laid.select(*DIMS, F.lit(1.0).alias("probability"))
    p = F.when(F.col(MARK) < first[0], F.lit(1.0)).otherwise(F.lit(first[1]) * F.col("ratio"))
    return laid.select(*DIMS, p.alias("probability"))


def sampling_table(df: DataFrame, targets: Mapping[str, float | Mapping[str, float]], rate: float, text_col: str = "text",
                   source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(__source, __lang, __topic, probability) of the cells of ``df``, stored."""
    docs = df.select(*keys_of(df, text_col, source_col, lang_col), F.size(words_of(F.col(f"`{text_col}`"))).alias("n_tokens"))
    cells = stored(cells_of(docs.select(*[F.col(f"__{d}").alias(d) for d in DIMS], "n_tokens")))
    table = stored(probabilities(rake(cells, targets), rate))
    return table.select(*[F.col(d).alias(f"__{d}") for d in DIMS], F.col("probability").alias("__p"))


def with_probability(df: DataFrame, table: DataFrame) -> DataFrame:
    """Joins cell probabilities to documents that carry the cell columns."""
    small = table.count() <= MAX_BROADCAST_CELLS
    return df.join(F.broadcast(table) if small else table, [f"__{d}" for d in DIMS], "left")


def mix(df: DataFrame, targets: Mapping[str, float | Mapping[str, float]], rate: float = 0.5, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, kept) of every row."""
    docs = stored(df.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{lang_col}`").alias("lang"),
        *keys_of(df, text_col, source_col, lang_col), F.size(words_of(F.col(f"`{text_col}`"))).cast("long").alias("n_tokens")))
    cells = stored(cells_of(docs.select(*[F.col(f"__{d}").alias(d) for d in DIMS], "n_tokens")))
    table = stored(probabilities(rake(cells, targets), rate)).select(
        *[F.col(d).alias(f"__{d}") for d in DIMS], F.col("probability").alias("__p"))
    out = with_probability(docs, table)
    p = F.coalesce("__p", F.lit(0.0))
    return out.select("doc_id", "source", "lang", F.col("__topic").alias("topic"), "n_tokens", p.alias("probability"),
                      (draw_of(F.col("doc_id")) < p).alias("kept"))


def sample(df: DataFrame, targets: Mapping[str, float | Mapping[str, float]], rate: float = 0.5, id_col: str = "doc_id",
           text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The kept rows of ``df`` with all their columns."""
    table = sampling_table(df, targets, rate, text_col, source_col, lang_col)
    rows = df.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(df.columns)], draw_of(F.col(f"`{id_col}`")).alias("__draw"),
                     *keys_of(df, text_col, source_col, lang_col))
    out = with_probability(rows, table).where(F.col("__draw") < F.coalesce("__p", F.lit(0.0)))
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(df.columns)])
