import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, h long"
LONG = " ".join(f"word{i % 977}" for i in range(20_000))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with names that operators use inside."""
    texts = [
        (5, "The MIT License text here. Mail a@b.co now\nShared line of the site\nlast", "en", "a"), (5, "The MIT License text here. Mail a@b.co now\nShared line of the site\nlast", "en", "a"), (5, "other text, same id", "en", "b"), (7, None, None, None), (8, "", "en", "a"), (9, "   \n\t ", "de", "b"),
        (None, "no id at all \U0001f600 é", "fr", "c"), (11, LONG, "en", "c"), (12, "one", "en", "d"), (13, "one", "en", "e"), (14, "ONE", "en", "e"), (15, "Shared line of the site\nx +1 (212) 555-1234 1.2.3.4 4111 1111 1111 1111", "en", "b"),
        (16, "Shared line of the site\n<|endoftext|> ''s don't \\ ### </turn>", "en", "c"), (17, "Shared line of the site", "en", "d"), (18, "Shared line of the site\ntoken = \"0123456789abcdef0123456789abcdef01234567\"", "en", "e"), (19, "a" * 5000, "en", "f"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "w", 1) for i, t, lang, s in texts], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
