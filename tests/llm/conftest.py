import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp long, words string, in_0 string, "
          "lang_pred string, chunk_id long, __source string, low double")


def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long_text = " ".join(f"w{i % 977}" for i in range(60_000)) + " " + "x" * 5000
    texts = [(1, "the cat sat on the mat. " * 20, "en", "a"), (1, "the cat sat on the mat. " * 20, "en", "a"),
             (2, None, "en", "a"), (3, "", None, None), (4, " \t\n\v\f\r ", "de", "b"), (None, "der hund und die katze " * 10, "de", "b"),
             (None, None, None, None), (5, long_text, "en", "a"), (6, "12345 67.8", "fr", "b"), (7, "le chat et la souris " * 12, "fr", "a"),
             (8, "the cat sat on the mat. " * 20, "en", "b"), (9, "a", "en", "a"), (10, "é́\U0001F600  x▁y", None, "a")]
    return [(i, t, lang, src, None if t is None else len(t), 7, "w", "z", "qq", 3, None, 0.5) for i, t, lang, src in texts]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
