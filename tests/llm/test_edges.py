"""Every operator over nulls, empty and long texts, ties, repeats, clashing columns, no rows."""
import sys

import pytest

import __spark_entry__ as E
import corpus_pipeline
from wearline.llm import (bpe_codec, embedding_dedup, html_extract, language_id, mixing, quality_rules, secrets, simhash,
                          substring_dedup, token_counts)
from wearline.llm.queries import MIX_TARGETS, PIECE_MODEL, WORD_MODEL, tokenizer_path

RUNS = {
    "quality": lambda d: quality_rules.quality(d),
    "substring": lambda d: substring_dedup.remove_repeats(d),
    "language": lambda d: language_id.identify(d),
    "simhash": lambda d: simhash.simhash_groups(d),
    "tokens": lambda d: token_counts.count_tokens(d, tokenizer_path(PIECE_MODEL)),
    "mixing": lambda d: mixing.mix(d, MIX_TARGETS),
    "secrets": lambda d: secrets.scan_secrets(d),
    "bpe": lambda d: bpe_codec.encode_decode(d, tokenizer_path(WORD_MODEL)),
    "redact": lambda d: secrets.redact(d),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_row_for_row(odd_docs, no_docs, name):
    out = RUNS[name](odd_docs).collect()
    ids = sorted([r["doc_id"] for r in odd_docs.select("doc_id").collect()], key=str)
    assert sorted([r["doc_id"] for r in out], key=str) == ids
    assert RUNS[name](no_docs).collect() == []


def by_id(rows, key):
    return [r for r in rows if r["doc_id"] == key]


def test_defined_results(odd_docs):
    q = RUNS["quality"](odd_docs).collect()
    assert by_id(q, 2)[0]["n_words"] == 0 and by_id(q, 2)[0]["base_failed"] and not by_id(q, 2)[0]["kept"]
    assert by_id(q, 5)[0]["n_words"] == 60_001 and by_id(q, 5)[0]["n_dup_lines"] == 0
    s = RUNS["substring"](odd_docs).collect()
    assert by_id(s, 1)[0]["n_removed"] == 120 and by_id(s, 1)[0]["kept"] == "" and by_id(s, 3)[0]["kept"] == ""
    lang = RUNS["language"](odd_docs).collect()
    assert all(by_id(lang, k)[0]["lang_pred"] == "und" and by_id(lang, k)[0]["score"] == 0 for k in (2, 3, 4, 6))
    h = RUNS["simhash"](odd_docs).collect()
    assert {r["component_id"] for r in by_id(h, 1) + by_id(h, 8)} == {1}
    assert {r["component_id"] for k in (2, 3, 4) for r in by_id(h, k)} == {2} and by_id(h, 2)[0]["fp"] == 0
    t = RUNS["tokens"](odd_docs).collect()
    assert by_id(t, 2)[0]["n_tokens"] == 0 and by_id(t, 5)[0]["over_limit"]
    m = RUNS["mixing"](odd_docs).collect()
    assert by_id(m, 2)[0]["n_tokens"] == 0 and by_id(m, 2)[0]["topic"] == "general"
    e = RUNS["bpe"](odd_docs).collect()
    assert by_id(e, 2)[0]["ids"] == b"" and by_id(e, 2)[0]["decoded"] == ""


def test_all_null_columns(spark):
    d = spark.createDataFrame([(None,) * 5] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    for name, run in RUNS.items():
        assert run(d).count() == 3, name
    assert simhash.keep_one(d).count() == 1
    v = spark.createDataFrame([(None, None, None)] * 2, "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.embedding_groups(v).count() == 2
    p = spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")
    assert html_extract.extract_pages(p).first()["text"] == ""


def test_pages_and_vectors_row_for_row(spark):
    """Empty tables, repeated rows and ids, extra columns with clashing names."""
    page = "<article><p>One, two.</p></article>"
    rows = [(1, "u", page, "x", 1), (1, "u", page, "x", 1), (1, "v", "", "y", 2), (None, None, None, None, None), (2, "w", "<p>" * 3000, "z", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract_pages(pages).collect()), key=str)
    assert out == sorted([(1, "u", "One, two.", 9)] * 2 + [(1, "v", "", 0), (None, None, "", 0), (2, "w", "", 0)], key=str)
    assert html_extract.extract_pages(pages.where("false")).collect() == []
    vecs = [(1, [1.0, 0.0], 0, 5, "a"), (1, [1.0, 0.0], 0, 5, "a"), (2, [1.0, 0.01], 0, 6, "b"), (3, [0.0, 0.0], 0, 7, None), (None, [1.0, 0.0], 0, 8, "c"),
            (4, None, 1, None, None), (5, [1.0], 0, 1, "d"), (6, [], 0, 1, "e")]
    vectors = spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int, node int, component_id string")
    out = embedding_dedup.embedding_groups(vectors).collect()
    assert sorted([r.vec_id for r in out], key=str) == sorted([v[0] for v in vecs], key=str)
    assert {(r.n_links, r.component_id) for r in out if r.vec_id in (1, 2)} == {(3, 1)}
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in out if r.vec_id in (3, 4, 5, 6))
    assert embedding_dedup.embedding_groups(vectors.where("false")).collect() == []


def test_pipeline_edges(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if name != "bpe":
                assert out.columns == list(corpus_pipeline.COLUMNS)
            out.count()


def test_one_of_rows_that_share_an_id(spark):
    """Equal ids with other texts, rows equal in all columns, rows that differ in one."""
    text = "some words that stand in both of the texts here"
    rows = [(1, text, "b"), (1, text, "a"), (1, text, "a"), (2, text, "c"), (1, "quite another text with other words in it", "d"),
            (None, "rows without an id stand alone as well", "e"), (None, "rows without an id stand alone as well", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = sorted((str(r.doc_id), r.text, r.source) for r in simhash.keep_one(df).collect())
    assert len(first) == 3 and {t for _, t, _ in first} == {t for _, t, _ in rows}
    for k in (2, 5):
        assert sorted((str(r.doc_id), r.text, r.source) for r in simhash.keep_one(df.repartition(k)).collect()) == first


def test_registered():
    names = E.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert not any(m.startswith("pandas") for m in vars(sys.modules["wearline.llm.quality_rules"]))
