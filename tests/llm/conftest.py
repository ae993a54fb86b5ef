import pytest


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty, blank, repeated and long texts, and columns whose names clash with outputs."""
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "a b"), (4, "one two three four five"), (5, "one two three four five"), (6, "x" * 5000), (7, "wörter " * 900), (8, "é½ 's don't <|endoftext|> \x1c ok")]
    rows += [(9 + i, f"line {i}\nsame line here\nsame line here\n" * 9) for i in range(4)]
    return spark.createDataFrame([(k, t, "k", k, "s", 1.5) for k, t in rows], "doc_id long, text string, fingerprint string, size long, source string, score double")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
