import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, label int, bucket int, n long, key string, id long, task int, x double, part int, at int, next string, sketch string"


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, empty and blank texts, ties, repeated rows, a very long text, marks and other scripts."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    return [
        (None, "a text without an id that is long enough to have shingles"), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, "a b c"),
        (7, "the same words in the same order once again"), (8, "The same words in the same order once again"), (8, "The same words in the same order once again"),
        (9, long), (10, long + " tail"), (11, "<|endoftext|> \\l <x> Ünïcode 日本語 x\x1cy café!! naïve?"), (12, "z" * 50_000), (None, None), (13, "a b c"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    rows = [(i, t, "en", None, len(t) if t else None, 1, 2, 3, "k", 4, 5, 0.5, 6, 7, "nx", "sk") for i, t in edge_rows]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def edge_labels(spark):
    rows = [(4, 1, 0), (4, 0, 0), (7, 0, 1), (8, None, None), (None, 1, 1), (9, 1, 0), (11, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
