"""Spelling variants by permuterm rotations.

A word w is marked with a terminator, ``w$``, and rotated. Where two words
differ in one replaced code point, the rotations that end with that code point
agree in everything before it; where one word has a code point more, its
rotation that ends there starts with a whole rotation of the other. So every
rotation goes under the prefix that skips its last code point, and whole
rotations go under themselves; the rows are sorted by prefix, and the words
that stand together under one prefix are exactly the neighbours by an edit at
that place. A prefix holds at most one word a letter of the alphabet, however
frequent words are, and a scan reports one row a word: how many neighbours it
met there and the best of them, never pairs.

A pair of words is met once: a replacement at its place, an inserted or
deleted code point at the first place of its run of equal code points only.

Words are numbered in code-point order, so ties compare numbers; prefixes above
``LITERAL`` code points travel as two rolling hashes modulo 2^61 - 1 (a word of
a million letters has a million rotations, of 40 bytes instead of a megabyte).

Counting: maximal runs of ``A-Z a-z U+00C0-U+00FF``, A-Z lower-cased; the typo
model of the contract deletes a code point where 97 divides the crc32 of
``<doc_id>:<run>``. A word's form is its near word of largest count (ties:
smallest), if that is at least ``RATIO`` times its own; the root follows forms
to the last. Counts grow along forms, so there is no circle, and pointer
doubling needs as many rounds as the logarithm of the longest path.

Defined results: null text has no words; a null doc_id counts as an empty
string before the colon; repeated rows count again; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.operators.sequence import MARK, lay_out

from .common import pick, released, slices, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = {c: c + 32 for c in range(65, 91)}
#: One in so many (run, document) pairs loses a code point.
TYPO = 97
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Longest prefix that travels as it is.
LITERAL = 64
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
END = "$"
MODULUS = (1 << 61) - 1
BASES = (0x1F3D5B79A1C3E507 % MODULUS, 0x0B6D8F2A4C1E3957 % MODULUS)
#: What a row under a prefix is: the whole word; a word that skips the first, or a
#: later, code point of a run of equal ones.
WHOLE, FIRST, LATER = 0, 1, 2


def altered(doc_id, run: str) -> str:
    """A lower-cased run after the typo model."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % TYPO:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences."""
    src = pick(df, doc_id=id_col, text=text_col).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    for raw, n in Counter(RUN.findall(text)).items():
                        if len(raw) >= LEAST_LENGTH:
                            word = altered(doc, raw.lower() if raw.isascii() else raw.translate(FOLD))
                            if len(word) >= LEAST_LENGTH:
                                held[word] += n
                    if len(held) > HELD:
                        yield handed()
        if held:
            yield handed()

    counts = src.mapInArrow(released(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def rotations(word: str) -> Iterator[tuple[str, int]]:
    """(prefix, kind): the whole rotations of the marked word, and its rotations
    without their last code point."""
    n = len(word)
    kinds = [FIRST if not i or word[i] != word[i - 1] else LATER for i in range(n)]
    if n + 1 <= LITERAL:
        marked = word + END
        twice = marked + marked
        for i in range(n + 1):
            yield twice[i:i + n + 1], WHOLE
        for i in range(n):  # what follows the code point at i, the mark, what precedes it
            yield twice[i + 1:i + n + 1], kinds[i]
        return
    code = [ord(c) for c in word]
    hashes = []
    for base in BASES:
        power, head = [1], [0]
        for c in code:
            power.append(power[-1] * base % MODULUS)
            head.append((head[-1] * base + c) % MODULUS)
        hashes.append((power, head))

    def digest(tail_from: int, head_to: int) -> str:
        """Of word[tail_from:] + END + word[:head_to]."""
        out = []
        for (power, head), base in zip(hashes, BASES):
            tail = (head[n] - head[tail_from] * power[n - tail_from]) % MODULUS
            out.append(((tail * base + ord(END)) * power[head_to] + head[head_to]) % MODULUS)
        return f"#{n - tail_from + head_to}-{out[0]:x}-{out[1]:x}"

    for i in range(n + 1):
        yield digest(i, i), WHOLE
    for i in range(n):
        if n <= LITERAL:
            yield word[i + 1:] + END + word[:i], kinds[i]
        else:
            yield digest(i + 1, i), kinds[i]


def prefix_rows(words: DataFrame) -> DataFrame:
    """(prefix, kind, node, n) of all rotations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes, kinds, of = [], [], []
            for k, word in enumerate(batch.column("word").to_pylist()):
                for prefix, kind in rotations(word):
                    prefixes.append(prefix)
                    kinds.append(kind)
                    of.append(k)
                if len(prefixes) > 200_000 or k + 1 == batch.num_rows:
                    at = pa.array(of, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(prefixes, pa.string()), pa.array(kinds, pa.int32()), batch.column("node").take(at),
                                                      batch.column("n").take(at)], names=["prefix", "kind", "node", "n"])
                    prefixes, kinds, of = [], [], []

    return words.select("node", "word", "n").mapInArrow(released(run), "prefix string, kind int, node long, n long")


def scan(prefix: np.ndarray, kind: np.ndarray, node: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node, met, best_n, best) of the rows that meet a neighbour; rows sorted by
    prefix number. A whole word meets the rows of kind ``FIRST``, those meet every
    other row, ``LATER`` ones all others but the whole word."""
    rows = np.lexsort((node, -n, prefix))  # best first inside a prefix
    prefix, kind, node, n = prefix[rows], kind[rows], node[rows], n[rows]
    start = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
    group = np.cumsum(np.concatenate(([0], (prefix[1:] != prefix[:-1]).astype(np.int64))))
    size = np.diff(np.append(start, len(prefix)))
    many = len(start)

    def firsts(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the best and the second best of ``mask`` in each prefix, -1 for none."""
        at = np.flatnonzero(mask)
        one, two = np.full(many, -1), np.full(many, -1)
        if not len(at):
            return one, two
        g = group[at]
        new = np.concatenate(([True], g[1:] != g[:-1]))
        one[g[new]] = at[new]
        second = np.flatnonzero(new) + 1
        second = second[second < len(at)]
        second = second[g[second] == g[second - 1]]
        two[g[second]] = at[second]
        return one, two

    n_first = np.bincount(group, kind == FIRST, many).astype(np.int64)
    n_skip = np.bincount(group, kind != WHOLE, many).astype(np.int64)
    met = np.select([kind == WHOLE, kind == FIRST], [n_first[group], size[group] - 1], n_skip[group] - 1)
    here = np.arange(len(prefix))
    best = np.full(len(prefix), -1)
    for mine, others in ((WHOLE, kind == FIRST), (FIRST, np.ones(len(kind), dtype=bool)), (LATER, kind != WHOLE)):
        one, two = firsts(others)
        at = np.flatnonzero(kind == mine)
        best[at] = np.where(one[group[at]] == here[at], two[group[at]], one[group[at]])
    keep = np.flatnonzero(met > 0)
    return node[keep], met[keep], n[best[keep]], node[best[keep]]


def neighbours(rows: DataFrame) -> DataFrame:
    """(node, met, best_n, best) per prefix at which a word meets neighbours."""
    ordered = rows.repartition("prefix").sortWithinPartitions("prefix")
    schema = pa.schema([(c, pa.int64()) for c in ("node", "met", "best_n", "best")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(t: pa.Table) -> pa.RecordBatch:
            number = t.column("prefix").combine_chunks().dictionary_encode().indices.to_numpy()
            out = scan(number, *[t.column(c).to_numpy() for c in ("kind", "node", "n")])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
            if not rest.num_rows:
                continue
            last = rest.column("prefix")[rest.num_rows - 1].as_py()
            cut = rest.num_rows  # the last prefix may go on in the next batch
            while cut and rest.column("prefix")[cut - 1].as_py() == last:
                cut -= 1
            if cut:
                yield settled(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield settled(rest)

    return ordered.mapInArrow(released(run), "node long, met long, best_n long, best long")


def roots(forms: DataFrame) -> DataFrame:
    """(node, root) of the rows (node, form): pointer doubling until nothing moves."""
    now = stored(forms.select("node", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("node").alias("at"), F.col("root").alias("next"))
        new = stored(now.join(step, now["root"] == step["at"], "left").select(
            "node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            return now


def group_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n; distinct)."""
    table = stored(lay_out(words.select("word", "n"), [], ["word"]).select(F.col(MARK).alias("node"), "word", "n"))
    near = neighbours(prefix_rows(table)).groupBy("node").agg(
        F.sum("met").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("order"))).alias("b"))
    near = stored(near.select("node", "n_near", "b.best_n", (-F.col("b.order")).alias("best")))
    joined = table.join(near, "node", "left").select(
        "node", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best_n") >= RATIO * F.col("n"), F.col("best")).alias("form"),
        F.when(F.col("best_n") >= RATIO * F.col("n"), F.col("best_n")).alias("form_n"))
    joined = stored(joined)
    ends = roots(joined.where("form IS NOT NULL").select("node", "form"))
    named = table.select(F.col("node").alias("at"), F.col("word").alias("name"))
    linked = joined.where("form IS NOT NULL").join(ends, "node")
    linked = (linked.join(named.select(F.col("at").alias("form"), F.col("name").alias("form_word")), "form")
              .join(named.select(F.col("at").alias("root"), F.col("name").alias("root_word")), "root")
              .select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n"))
    alone = joined.where("form IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return linked.unionByName(alone)


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of a corpus with their forms and roots; see the module text."""
    return group_variants(count_words(df, id_col, text_col))
