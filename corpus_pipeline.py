"""Corpus preparation: five stages over ``documents``.

Every stage takes nulls in any column, empty and very long texts, ties, repeated
rows and tables without rows; what becomes of them stands in its own text.

1. language ID: documents without a recognisable language go;
2. SimHash near-duplicates: one document of each group stays;
3. secret scans: secrets are masked;
4. mixing: documents are sampled towards the target mix;
5. BPE: the texts are encoded, and decoded again from their ids.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``; extra columns of the input are left behind.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm import bpe_codec, language_id, mixing, secrets, simhash
from wearline.llm.common import pick, read
from wearline.llm.queries import MIX_RATE, MIX_TARGETS, WORD_MODEL, tokenizer_path
from wearline.session import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays when its main language has at least this share of it.
MIN_SHARE = 0.3


def _documents(docs: DataFrame) -> DataFrame:
    return pick(docs, **{c: c for c in COLUMNS})


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts with no learned language or none of at least ``MIN_SHARE``: null
    and empty texts and those without a letter go; of languages with equal shares
    the first by name counts; repeated rows stay or go together; with no labelled
    row nothing is learned and every document goes; no rows give none."""
    docs = _documents(docs)
    out = language_id.predict(docs, language_id.learn(docs), keep=True)
    return out.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SHARE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each SimHash group. Null and empty
    texts form one group; a group without an id keeps one of its rows; of rows that
    repeat an id the least fingerprint, then the least row hash stays, and one of
    rows equal in every column; no rows give none."""
    return simhash.keep_one(_documents(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; ``n_chars`` follows the new text where it was known. Every row
    stays, a null or empty text as it is; repeated rows are masked alike."""
    out = secrets.redact(_documents(docs))
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by the raked weights of their cells. Null source and
    language are categories; a text without words has its cell's probability;
    rows that repeat an id share their draw, null ids draw alike; no rows give none."""
    return mixing.sample(_documents(docs), MIX_TARGETS, MIX_RATE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the mixed corpus, a row a
    document; null and empty texts have no ids."""
    out = bpe_codec.encode_decode(_documents(docs), tokenizer_path(WORD_MODEL))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", identify_language), ("simhash", drop_near_duplicates), ("secrets", mask_secrets),
          ("mixing", mix_sources), ("bpe", encode)]

#: Learned models, SimHash and BPE have no SQL form; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; results between them lie in the checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
