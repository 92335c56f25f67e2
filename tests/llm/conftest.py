import pytest

from tests.conftest import SF_DIR

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, length int, row long, host string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    prose = " ".join(f"word{i % 37} and{i % 11}" for i in range(60)) + "."
    long = " ".join(f"w{i}" for i in range(60_000)) + "."
    texts = [prose, prose.upper(), prose, None, "", " \t\n", long, "a b c", prose + " tail", "É " + prose, "x" * 5_000]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "k", 1, 2, "h") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, prose, None, None, None, None, None, None, None), (20, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def given_docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
