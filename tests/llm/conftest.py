import pytest

#: Rows that every operator must take: nulls, empty and odd texts, ties and repeated rows.
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (None, "no id here"), (None, None), (5, "word " * 6000), (6, "naïve Ünïcode 中文 😀 text."), (7, "\x00\x1c odd\x85marks"), (8, "the same words in a text of two"), (9, "the same words in a text of two")]


@pytest.fixture(scope="session")
def odd(spark):
    """ODD with extra columns, whose names operators use inside too."""
    rows = [(i, t, "en", f"src{k}", len(t) if t is not None else None, k, "x", 0.5) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, label string, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
