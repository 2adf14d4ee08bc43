import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _key string, part long, n long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (id, text[, source]) with extra columns whose names operators use inside."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", 0, "k", 7, 9) for r in rows]
        return spark.createDataFrame(full, COLUMNS)
    return make


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
