import pytest

DOCS = "doc_id long, text string, `DOC.x` string, score double, n long, shard int, label string"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (doc_id, text) pairs, with further columns whose names clash."""

    def build(rows):
        return spark.createDataFrame([(i, t, "x", None, 1, 2, "l") for i, t in rows], DOCS)

    return build


@pytest.fixture(scope="session")
def small(spark):
    """The smallest given tables."""
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long text, repeated rows."""
    long = " ".join(f"w{i % 997}x" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "a b"), (5, "a b"), (None, "a b c d e"), (None, None), (6, "é ß 中国 \x00")]
