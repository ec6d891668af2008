import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text, source), with columns that clash with names the operators use inside."""

    def build(rows):
        full = [(i, text, "en", source, len(text or ""), "clash", 1.5, [1]) for i, text, source in rows]
        return spark.createDataFrame(full, DOC + ", key string, score double, hashes array<int>")

    return build


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls, empty and long texts, ties and repeated rows."""
    words = " ".join(f"word{i % 97}x{i % 31}" for i in range(30_000))
    rows = [
        (1, None, "a"), (2, "", None), (None, "one two three four five six", "a"), (4, "same text here now again ok", "b"),
        (5, "same text here now again ok", "b"), (5, "same text here now again ok", "b"), (6, words, None),
        (7, words + " end", "a"), (None, None, None), (8, " \t\n ", "c"),
    ]
    return docs_of(rows)
