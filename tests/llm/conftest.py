import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, a null id, repeated rows, ties, a long text and clashing names."""
    rows = [
        (1, "One two three four. Five six seven eight nine! Ten eleven twelve thirteen fourteen fifteen sixteen?", "a", 1),
        (1, "One two three four. Five six seven eight nine! Ten eleven twelve thirteen fourteen fifteen sixteen?", "a", 1),
        (2, None, None, None), (3, "", "a", 0), (4, "   \n\t ", "a", 6), (None, "no id here", "b", 10),
        (5, "word " * 30_000, "b", 150_000), (6, "x" * 40_000, "b", 40_000), (7, "Ünïcode <s> [INST] ▁ 日本語 😀", "c", 9),
        (8, "Ünïcode <s> [INST] ▁ 日本語 😀", None, 9),
    ]
    schema = "doc_id long, text string, source string, n_chars long, bits string, k_id string, row string, score string, ids string, `a.b` string"
    return spark.createDataFrame([(*r, "b", "k", "r", "s", "i", "dot") for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
