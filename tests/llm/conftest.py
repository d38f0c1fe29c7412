import os

import pytest

SMALL = "/root/testdata/sf0.001"

#: Null and empty texts, a text of white space, repeated rows, a null id, other alphabets.
EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "one"),
    (5, "a b c d"),
    (6, "a b c d"),
    (7, "The quick brown fox jumps over the lazy dog. " * 6),
    (7, "The quick brown fox jumps over the lazy dog. " * 6),
    (8, "Größe\u00a0und Maß\n\né ê 漢字 \U0001f600 end"),
    (None, "no id here at all"),
    (9, "x" * 5000),
]


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("the small tables are not there")
    return SMALL


@pytest.fixture(scope="session")
def edges(spark):
    """Edge rows, with columns whose names the operators use themselves."""
    rows = [(i, t, "q", 1, "w", 0.5) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, chunk string, n_words int, words string, score double").cache()


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


@pytest.fixture(scope="session")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]
