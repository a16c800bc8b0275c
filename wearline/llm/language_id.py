"""Language ID by multilingual mixture inference.

Each learned language has a distribution over hashed character trigrams of
letters (lower-cased, blanks at word ends). For a document, expectation
maximisation estimates the proportions of the languages whose mixture best
explains its trigrams. Language sets compete by penalised likelihood: starting
from the best single language, the languages with the largest proportions are
added as long as each gains more than ``PENALTY * ln(n + 1)``. The prediction is
the set's largest proportion and the score is that proportion.

Learning sums trigram counts of all labelled rows that are not held out, in
Spark; one row of ``N_GRAMS`` numbers per language and task is shuffled and the
driver receives languages x N_GRAMS sums. The model holds at most ``MAX_LANGS``
languages, a bound of its size: those with the most trigrams (ties: first by
name). Rows of rarer languages are predicted like any others but don't teach.

Defined results: null text or text without a letter: ``und``, score 0; the
same where nothing was learned; rows with null lang are predicted but don't
teach; a null id counts as not held out; ties go to the first language by
name; repeated rows count as often as they stand; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, pick, released, slices

N_GRAMS, SMOOTH, MAX_LANGS = 4096, 0.5, 500
ROUNDS, PENALTY, SMALL = 12, 3.0, 0.03
#: Documents whose counts are held as one dense block.
BLOCK = 256
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams around each letter of a text, in order."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32)
    letter = letters()[c]
    c = np.where(letter, c, np.uint32(32))
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h[letter[1:-1]] >> np.uint32(16)) % np.uint32(N_GRAMS)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities) from the labelled rows not held out."""
    src = pick(df, doc_id=id_col, text=text_col, lang=lang_col)
    src = src.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def summed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()),
                                              pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["lang", "counts"])
            sums.clear()
            return out

        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    got = np.bincount(trigrams(text), minlength=N_GRAMS)
                    if lang in sums:
                        sums[lang] += got
                    else:
                        sums[lang] = got
                        if len(sums) > MAX_LANGS:  # many languages: what a task holds stays bounded
                            yield summed()
        yield summed()

    rows = (src.mapInArrow(released(run), "lang string, counts array<long>").select("lang", F.posexplode("counts").alias("gram", "n"))
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 0")
            .groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("gram", "n"))).alias("counts"), F.sum("n").alias("total"))
            .orderBy(F.desc("total"), "lang").limit(MAX_LANGS).collect())
    rows.sort(key=lambda r: r["lang"])
    counts = np.zeros((len(rows), N_GRAMS))
    for i, r in enumerate(rows):
        counts[i, list(r["counts"])] = list(r["counts"].values())
    smooth = counts + SMOOTH
    return [r["lang"] for r in rows], np.log(smooth / smooth.sum(axis=1, keepdims=True))


def mixture(counts: np.ndarray, prob: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM proportions (docs, languages) within ``allowed`` and their log likelihoods."""
    total = counts.sum(axis=1, keepdims=True)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        share = share * ((counts / (share @ prob)) @ prob.T) / total
    return share, (counts * np.log(share @ prob)).sum(axis=1)


def infer(counts: np.ndarray, log_prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language index, proportion) of documents with at least one trigram."""
    prob = np.exp(log_prob).astype(counts.dtype)
    n_lang = len(prob)
    single = counts @ log_prob.T.astype(counts.dtype)
    best = single.argmax(axis=1)
    score, like = np.ones(len(counts)), single.max(axis=1).astype(np.float64)
    if n_lang == 1:
        return best, score
    share, _ = mixture(counts, prob, np.ones((len(counts), n_lang), dtype=counts.dtype))
    order = np.argsort(-share, axis=1, kind="stable")
    cost = PENALTY * np.log(counts.sum(axis=1).astype(np.float64) + 1)
    live = np.flatnonzero(np.take_along_axis(share, order[:, 1:2], axis=1)[:, 0] >= SMALL)
    for k in range(2, n_lang + 1):
        if not len(live):
            break
        allowed = np.zeros((len(live), n_lang), dtype=counts.dtype)
        np.put_along_axis(allowed, order[live, :k], 1, axis=1)
        part, now = mixture(counts[live], prob, allowed)
        gain = now - like[live] > cost[live]
        live, part = live[gain], part[gain]
        like[live] = now[gain]
        best[live], score[live] = part.argmax(axis=1), part.max(axis=1)
    return best, score


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id",
            text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score); ``keep`` carries all input columns instead of
    the id (columns already named lang_pred or score are replaced)."""
    langs, log_prob = model

    def run(cols: dict) -> dict:
        n = len(cols["text"])
        pred, score = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
        for at in range(0, n if langs else 0, BLOCK):
            grams = [trigrams(t) for t in cols["text"][at:at + BLOCK]]
            some = [i for i, g in enumerate(grams) if len(g)]
            if some:
                counts = np.stack([np.bincount(grams[i], minlength=N_GRAMS) for i in some]).astype(np.float32)
                best, share = infer(counts, log_prob)
                where = at + np.array(some)
                pred[where] = np.array(langs, dtype=object)[best]
                score[where] = np.clip(share, 0.0, 1.0)
        out = {f"in_{i}": cols[f"in_{i}"] for i in range(len(carried))}
        return out | {"lang_pred": pred.tolist(), "score": score}

    carried = [c for c in df.columns if c not in ("lang_pred", "score")] if keep else [id_col]
    src = df.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(carried)], F.col(f"`{text_col}`").alias("text"))
    fields = ", ".join(f"in_{i} {src.schema[f'in_{i}'].dataType.simpleString()}" for i in range(len(carried)))
    out = map_rows(src, run, f"{fields}, lang_pred string, score double")
    names = carried if keep else ["doc_id"]
    return out.select(*[F.col(f"in_{i}").alias(n) for i, n in enumerate(names)], "lang_pred", "score")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; see the module text."""
    model = learn(df, id_col, text_col, lang_col)
    out = predict(df, model, id_col, text_col)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
