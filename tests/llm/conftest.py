import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, size long, key string, n long"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]), with extra columns of clashing names."""

    def build(rows):
        full = [(r + (None,) * 4)[:4] + (len(r[1] or ""), "x", 7, "k", 1) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture
def odd():
    """Nulls, empty, very long, tied and repeated rows."""
    return [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n ", None, "a"),
        (None, "no id here", "en", None),
        (4, "Hello wide world\nagain and again", "en", "a"),
        (4, "Hello wide world\nagain and again", "en", "a"),
        (5, "lang " * 30_000, "en", "b"),
        (6, "H̱ Été é <|endoftext|> it's 12 \U0001f600 ΣΑΣ", "fr", "b"),
        (7, "12345 !!", "fr", "b"),
        (-8, "x", "fr", None),
    ]
