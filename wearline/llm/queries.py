"""Registered queries of the training-data operators (``opN_<name>``).

Each applies its operator with production parameters to the whole table and
derives the digest columns of its result from the operator's real output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, sharding
from . import quality_rules as rules
from .bpe_codec import encode_decode
from .common import read
from .embedding_dedup import embedding_groups
from .hard_negatives import hard_negatives
from .html_extract import extract_pages
from .language_id import identify
from .secrets import scan_secrets
from .sharding import shard_rows
from .simhash import simhash_groups
from .spelling_variants import spelling_variants
from .substring_dedup import remove_repeats
from .token_counts import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


@register
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(read(spark, sf_dir, "documents")).drop("clean_text")


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(phrases: tuple[str, ...], form: str) -> str:
    return "(" + " OR ".join(form.format(sql_text(p)) for p in phrases) + ")"


SQL["op2_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM t),
r AS (SELECT doc_id, count(DISTINCT i + k.k) AS n_repeat_words FROM g, range(3) k(k) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, x, regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM
      (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d)),
m AS (SELECT doc_id, x, lower(t) AS low, right(t, 1) AS last,
             len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n FROM l WHERE t <> ''),
f AS (SELECT doc_id, x, n,
        (NOT contains({sql_text(rules.TERMINAL)}, last) AND n < {rules.SHORT_LINE})
        OR (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) * 10 > length(x)
        OR length(x) - length(replace(x, '!', '')) > n
        OR length(x) - length(regexp_replace(x, '[|»›•]', '', 'g')) >= 2
        OR (NOT contains({sql_text(rules.TERMINAL)}, last) AND n <= {rules.NAV_LINE} AND {_any(rules.NAVIGATION, "starts_with(low, {})")})
        OR {_any(rules.BOILERPLATE, "contains(low, {})")} AS fails FROM m),
s AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines, coalesce(sum(n) FILTER (fails), 0) AS n_lost_words FROM f GROUP BY doc_id),
o AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(s.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(s.n_lost_words, 0) AS BIGINT) AS n_lost_words
      FROM d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_lost_words <= 0.5 * n_words AS kept FROM o"""


@register
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read(spark, sf_dir, "embeddings"))


SQL["op3_embedding_dedup"] = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL
      AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r(vec_id, root) AS (
  SELECT vec_id, vec_id FROM e
  UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.vec_id = c.vec_id"""


@register
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op4_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
w AS (SELECT doc_id, u.i AS i, u.x AS x FROM (SELECT doc_id, unnest(list_transform(w, lambda x, i: {'i': i, 'x': x})) AS u FROM d)),
g AS (SELECT doc_id, i, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS s,
             count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS n FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(s)) AS c FROM g WHERE n = 35) WHERE c > 1),
c AS (SELECT w.doc_id, w.i, w.x,
             max(CASE WHEN r.i IS NOT NULL THEN 1 ELSE 0 END)
                 OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.i = w.i),
k AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""


@register
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


@register
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


#: Tempering exponents of the production mix, and the share of tokens to keep.
MIX_TARGETS = {"source": 0.7, "lang": 0.7, "topic": 0.7}
MIX_RATE = 0.5
SQL_ROUNDS = 60


@register
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents"), MIX_TARGETS, MIX_RATE)
    return out.withColumn("probability", F.round("probability", 6))


def mixing_sql() -> str:
    """Raking by recursion, with rounds to spare."""
    topic = "CASE " + " ".join(
        f"WHEN {' OR '.join(f'contains(text, {sql_text(p)})' for p in ps)} THEN {sql_text(t)}" for t, ps in mixing.TOPICS
    ) + f" ELSE {sql_text(mixing.OTHER)} END"
    at = "(SELECT * FROM r)"
    for d in mixing.DIMS:
        at = f"(SELECT * REPLACE (weight * t_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight) FROM {at})"
    shares = ", ".join(f"m_{d}.t AS t_{d}" for d in mixing.DIMS)
    joins = " ".join(f"JOIN m_{d} ON m_{d}.{d} = cells.{d}" for d in mixing.DIMS)
    margins = ", ".join(
        f"r_{d} AS (SELECT {d}, pow(sum(tokens) / (SELECT sum(tokens) FROM cells), {MIX_TARGETS[d]}) AS raw FROM cells GROUP BY {d}), "
        f"m_{d} AS (SELECT {d}, raw / sum(raw) OVER () AS t FROM r_{d})" for d in mixing.DIMS)
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source AS s0, lang AS l0, coalesce(source, '<null>') AS source, coalesce(lang, '<null>') AS lang, {topic} AS topic,
                  CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens
           FROM documents),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
{margins},
r AS (SELECT cells.*, tokens / sum(tokens) OVER () AS weight, {shares}, 0 AS round FROM cells {joins}
      UNION ALL (SELECT * REPLACE (round + 1 AS round) FROM {at} WHERE round < {SQL_ROUNDS})),
q AS (SELECT *, sum(tokens) OVER () AS total, weight * sum(tokens) OVER () / tokens AS ratio FROM r WHERE round = {SQL_ROUNDS}),
o AS (SELECT *, row_number() OVER w AS pos,
             ({MIX_RATE} * total - coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(tokens * ratio) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale
      FROM q WINDOW w AS (ORDER BY ratio DESC, source, lang, topic)),
k AS (SELECT min(pos) AS pos, arg_min(scale, pos) AS scale FROM o WHERE scale * ratio <= 1),
p AS (SELECT source, lang, topic, CASE WHEN k.pos IS NULL OR o.pos < k.pos THEN 1.0 ELSE k.scale * ratio END AS probability FROM o, k)
SELECT d.doc_id, d.s0 AS source, d.l0 AS lang, d.topic, d.n_tokens, round(coalesce(p.probability, 0.0), 6) AS probability,
       CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0
           < coalesce(p.probability, 0.0) AS kept
FROM d LEFT JOIN p ON p.source = d.source AND p.lang = d.lang AND p.topic = d.topic"""


SQL["op8_mixing"] = mixing_sql()


@register
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(read(spark, sf_dir, "documents"))

    def spelled(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(spelled(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"))


@register
def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(read(spark, sf_dir, "documents"), tokenizer_path(WORD_MODEL))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), anchor=F.col("vec_id") % 50 == 0)


SQL["op11_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL),
e AS (SELECT vec_id, label, list_transform(x, lambda c: floor(256 * c)) AS q FROM v
      WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id AS other_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score,
       s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.positive_score <= 100 * s.score
     AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 3"""


def crc32_sql(blob: str) -> str:
    """The unsigned crc32 of a blob in DuckDB, byte by byte over its hex digits."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    data = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda b: CAST('0x' || b AS BIGINT))"
    entries = "[" + ", ".join(map(str, table)) + "]::BIGINT[]"
    return (f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, list_extract({entries}, CAST(xor(c & 255, b) AS INTEGER) + 1)), "
            f"CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))")


@register
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


SQL["op12_spelling_variants"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
l AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS c FROM d GROUP BY ALL),
h AS (SELECT r, c, {crc32_sql("encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)")} AS h FROM l WHERE length(r) >= 5),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, c FROM h),
n AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM n)),
p AS (SELECT a.word AS a, b.word AS b, b.n AS bn FROM x a JOIN x b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
      UNION SELECT x.word, n.word, n.n FROM x JOIN n ON n.word = x.k
      UNION SELECT n.word, x.word, x.n FROM x JOIN n ON n.word = x.k),
g AS (SELECT a, count(*) AS n_near, min(b) FILTER (bn = m) AS best, max(m) AS m
      FROM (SELECT *, max(bn) OVER (PARTITION BY a) AS m FROM p) GROUP BY a),
f AS (SELECT n.word, n.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN g.m >= 2 * n.n THEN g.best END AS form,
             CASE WHEN g.m >= 2 * n.n THEN g.m END AS form_n FROM n LEFT JOIN g ON g.a = n.word),
s(word, cur, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT s.word, f.form, s.step + 1 FROM s JOIN f ON f.word = s.cur WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM f JOIN (SELECT word, arg_max(cur, step) AS root FROM s GROUP BY word) r ON r.word = f.word"""

SHARDS, SHARD_SEED = 40, 42


@register
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read(spark, sf_dir, "documents"), SHARDS, SHARD_SEED).drop("row_no")


def sharding_sql() -> str:
    """Row numbers by doc_id, the rounds as chained aliases, walks by recursion."""
    p = sharding.PRIME
    steps, side = ["x // b AS l0, x % b AS r0"], ["a", "b"]
    for i, (k1, k2) in enumerate(sharding.round_keys(SHARD_SEED)):
        steps.append(f"(r{i} * {k1} + {k2}) % {p} AS u{i}, (u{i} * u{i} + r{i}) % {p} AS v{i}, (v{i} * v{i} + {k2}) % {p} AS w{i}, "
                     f"r{i} AS l{i + 1}, (l{i} + w{i}) % {side[0]} AS r{i + 1}")
        side.reverse()
    end = sharding.ROUNDS
    network = f"SELECT row_no, n, a, b, l{end} * b + r{end} AS x FROM (SELECT *, {', '.join(steps)} FROM {{}})"
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS row_no,
                            count(*) OVER () AS n FROM documents),
z AS (SELECT row_no, n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a, (n + CAST(floor(sqrt(n - 1)) AS BIGINT)) // (CAST(floor(sqrt(n - 1)) AS BIGINT) + 1) AS b, row_no AS x FROM t),
w AS ({network.format('z')}
      UNION ALL ({network.format('(SELECT row_no, n, a, b, x FROM w WHERE x >= n)')})),
o AS (SELECT row_no, x FROM w WHERE x < n)
SELECT t.doc_id, CAST(octet_length(encode(t.text)) + {sharding.ROW_BYTES} AS BIGINT) AS size,
       CASE WHEN t.text = '' THEN 0 ELSE {crc32_sql('encode(t.text)')} END AS text_crc32, '{sharding.LAW}' AS law,
       CAST(o.x % {SHARDS} AS INTEGER) AS shard, CAST(o.x // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM t JOIN o ON o.row_no = t.row_no"""


SQL["op13_sharding"] = sharding_sql()
