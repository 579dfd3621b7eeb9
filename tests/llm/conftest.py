import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string, _key string, ids string"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table of given texts, with columns whose names clash with
    those that the operators use inside."""

    def make(rows, lang="en"):
        return spark.createDataFrame(
            [(i, t, lang, None, None if t is None else len(t), "x", "y", "z") for i, t in rows], DOC
        )

    return make


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "Hello hello HELLO, World!"), (5, "Hello hello HELLO, World!"),
    (6, "  two  spaces\n\n and\ttabs  "), (7, "naïve Ünïcode 日本語 😀 ΑΣ"), (None, "no id"), (8, "x" * 50_000),
    (9, "word " * 20_000), (10, "a<|endoftext|>b <|startoftext|> c"), (11, "▁ \x00 \x85 ﬁ"),
]


@pytest.fixture(scope="session")
def odd(documents):
    """Null, empty, very long, repeated and strange texts."""
    return documents(ODD)
