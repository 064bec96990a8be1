import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id string, kept string, size string, score double, fp int, hash string, recipe string, row int, label int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with names the operators use."""
    long = "lorem ipsum dolor. " * 20_000
    texts = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, ""), (4, None), (None, None), (None, "solo text here"), (5, " \t\n "), (6, "Äpfel über ALLES 🙂 <|endoftext|> x"), (7, long), (8, "word"), (9, "two words")]
    rows = [(i, t, None if i == 3 else "en", ["s1", None, "s2"][k % 3], None, "x", None, "big", None, k, "h", None, k, None) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
