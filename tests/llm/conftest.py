import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, key string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text, source), with further columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, t, "en", s, len(t) if t is not None else None, "own", "own") for i, t, s in rows]
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls, empty and blank texts, repeated rows and ids, ties, one very long text."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(40_000))
    text = "The quick brown fox jumps over the lazy dog while twelve other animals watch it quietly from the hill."
    return docs_of([
        (1, text, "a"), (2, text.replace(" ", "  "), "b"), (3, text, "a"), (3, text, "a"), (None, text, None), (None, None, None),
        (5, "", "b"), (6, " \n\t ", "c"), (7, "one", "c"), (8, "One", "c"), (9, long, "a"), (10, long, "zé"), (11, long + " end", "a"),
        (12, "short text of four", "a"), (12, "other text under the same id", "b"), (13, "日本語の文章です。", "a")])


@pytest.fixture(scope="session")
def no_docs(docs_of):
    return docs_of([])
