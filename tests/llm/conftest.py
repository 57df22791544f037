import pytest

from framelake.llm.scratch import ship

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, copies string, shard string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns whose names operators use inside."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
    rows = [
        (None, None, None, None, None), (None, "same text here again", "en", None, 3), (1, "", "en", "a", 0), (2, "   \t\n ", None, "a", 5), (3, "same text here again", "en", "a", 3), (4, "same text here again", "en", "b", 3),
        (4, "same text here again", "en", "b", 3), (5, "Same TEXT here\tagain", "en", "b", 3), (6, long, "en", "c", len(long)), (7, long + " tail", "en", None, 1), (8, "one", "en", "é", 1), (9, "two words", "en", "z", 1), (10, None, "en", "z", 1),
        (11, "Ünï çödé 中文 🤦 <|endoftext|> x", "fr", "z", 1),
    ]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
