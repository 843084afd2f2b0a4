import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, _h string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text) with columns beside whose names clash with inner ones."""

    def make(rows):
        return spark.createDataFrame([(d, t, None, "s", None if t is None else len(t), 7, "k", "h") for d, t in rows], SCHEMA)

    return make


#: Nulls, empty and odd texts, ties and repeated rows.
EDGES = [
    (None, "one two three four"),
    (1, None),
    (2, ""),
    (3, " \n\t \n"),
    (4, "Ünï çödé — “quotes” 漢字 é \U0001f600 ok"),
    (5, "same text here and there, same text here and there."),
    (5, "same text here and there, same text here and there."),
    (6, "same text here and there, same text here and there."),
    (7, "a" * 5000 + " b" * 5000),
    (8, "a  b\n\n\nc\r\n d\x0be\x0cf "),
]


@pytest.fixture(scope="session")
def edges():
    return EDGES


@pytest.fixture(scope="session")
def sample():
    """Real texts of the smallest table given to the tests, if it is there."""
    import os

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        return EDGES
    import pyarrow.parquet as pq

    read = pq.read_table(path, columns=["doc_id", "text"]).to_pydict()
    return list(zip(read["doc_id"], read["text"], strict=True))
