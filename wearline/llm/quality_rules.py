"""Line-first quality rules, in DataFrame functions alone.

Every line is judged by punctuation, navigation and boilerplate rules; failing
lines are removed; a document that loses more than ``max_lost`` of its words
is rejected, as is one that fails the base rules (too few words, or too many
words in repeated three-word windows).

Repeated windows are found inside the row: 64-bit hashes of the windows are
sorted with their positions, equal neighbours are the repeats. Nothing is
shuffled.

Defined results: null text has no words and no lines (all counts 0, base rules
failed, clean text empty); lines without a word are neither judged nor kept;
null ids are kept; repeated rows give repeated results; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK, pick

# ---- fixed values: the rules' characters and phrases ----
SYMBOLS = "#*$%&|<>"
TERMINAL = ".!?:;,)\"'…”»"
SEPARATORS = "|»›•"
BLANKS = " \t\n\x0b\x0c\r"
NAVIGATION = ("home", "log in", "login", "sign up", "sign in", "menu", "next", "previous", "contact", "about", "search",
              "share", "read more", "skip to", "back to")
BOILERPLATE = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "use cookies",
               "javascript", "lorem ipsum", "subscribe to", "newsletter", "licensed under", "released under",
               "click here")
# -----------------------------------------------------------
MIN_WORDS, SHORT_LINE, NAV_LINE = 50, 5, 8


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def count_chars(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def line_fails(line: Column) -> Column:
    """Does a line (struct text, n, low, last) break a rule?"""
    text, n, low, last = line["text"], line["n"], line["low"], line["last"]
    open_end = ~F.lit(TERMINAL).contains(last)
    punctuation = (open_end & (n < SHORT_LINE)) | (count_chars(text, SYMBOLS) * 10 > F.char_length(text)) | (count_chars(text, "!") > n)
    starts, holds = F.lit(False), F.lit(False)
    for phrase in NAVIGATION:
        starts = starts | low.startswith(phrase)
    for phrase in BOILERPLATE:
        holds = holds | low.contains(phrase)
    navigation = (count_chars(text, SEPARATORS) >= 2) | (open_end & (n <= NAV_LINE) & starts)
    return punctuation | navigation | holds


def repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from ``words``: words inside three-word windows that
    occur at least twice in the row."""
    last = F.size("words") - 3
    df = df.withColumn("windows", F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")))))
    df = df.withColumn("windows", F.when(
        F.size(F.array_distinct(F.transform("windows", lambda w: w["h"]))) < F.size("windows"), F.sort_array("windows")))
    at = F.filter("windows", lambda w, j: (F.get("windows", j - 1)["h"].eqNullSafe(w["h"])) | (F.get("windows", j + 1)["h"].eqNullSafe(w["h"])))
    df = df.withColumn("windows", F.sort_array(F.transform(at, lambda w: w["i"])))
    covered = F.aggregate("windows", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                          lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
                          lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("windows")


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lost_words, clean_text, kept) of every row."""
    out = pick(df, doc_id=id_col, text=text_col).withColumn("words", words_of(F.col("text")))
    out = repeated_words(out)
    blanks = BLANKS
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x, F.lit(blanks)) != "")
    out = out.withColumn("lines", F.transform(lines, lambda x: F.struct(
        x.alias("text"), F.size(words_of(x)).alias("n"), F.lower(F.trim(x, F.lit(blanks))).alias("low"),
        F.right(F.rtrim(x, F.lit(blanks)), F.lit(1)).alias("last"))))
    out = out.withColumn("judged", F.transform("lines", lambda x: F.struct(x["text"].alias("text"), x["n"].alias("n"), line_fails(x).alias("fails"))))
    lost = F.aggregate("judged", F.lit(0), lambda a, x: a + F.when(x["fails"], x["n"]).otherwise(0))
    out = out.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(count_chars(F.col("text"), SYMBOLS), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct(F.transform("lines", lambda x: x["text"])))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", lost.cast("long").alias("n_lost_words"),
        F.array_join(F.transform(F.filter("judged", lambda x: ~x["fails"]), lambda x: x["text"]), "\n").alias("clean_text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= F.lit(max_lost) * F.col("n_words")))
