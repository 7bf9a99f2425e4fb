import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) pairs."""

    def make(rows):
        kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        rows = [(i, t, "en", None, None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(rows, kind)

    return make


#: Nulls, empty and very long texts, repeated rows, no id: every operator has to answer for each.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "one two three"), (5, "one two three"), (None, "lone row"),
    (6, "word " * 30_000), (7, "x" * 100_000), (8, "été 日本語 don't  stop\n\nnow"), (9, "1 " * 2_000 + "@" * 500),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
