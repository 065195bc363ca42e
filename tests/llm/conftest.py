import pytest

TEXTS = [None, "", "   ", "one", "a b c", "x" * 3000, "wort " * 700, "Zeile\n" * 40]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, a null id, and columns whose names clash."""
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "src0", 7, "q") for i, t in enumerate(TEXTS)]
    rows += [(1, "", "en", "src0", 0, "q"), (100, "same words here to see", "en", "src1", 1, "q"), (100, "same words here to see", "en", "src1", 1, "q")]
    rows += [(None, "no id has this one", "en", "src1", 1, "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, score string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def some(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(some):
    return {r["doc_id"]: r["text"] for r in some.select("doc_id", "text").collect()}
