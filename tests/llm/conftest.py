import pytest


@pytest.fixture
def docs(spark):
    """Documents with nulls, empties, ties, repeats, a very long text and columns whose names may clash."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "x", 1, 2, "k", None) for i, t in rows],
            "doc_id long, text string, key string, n_words int, component int, node string, score double",
        )

    return make
