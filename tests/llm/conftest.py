import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row long, n long, kept boolean, "
    "score double, shard int, key string, run int, part int, node long, spans string, m string"
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text, source) rows, with columns whose names clash."""

    def make(rows, parts=3):
        full = [(i, t, "en", s, None if t is None else len(t), 1, 2, True, 0.5, 3, "k", 4, 5, 6, "x", "y") for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


PROSE = "The quick brown fox and the lazy dog of this house walked to the river, where it was calm and cold for a long while"


@pytest.fixture(scope="session")
def awkward(docs_of):
    """Nulls, empty, blank, very long and repeated texts, repeated rows, null and repeated ids."""
    long = " ".join(f"word{i % 977} of the{i % 13}" for i in range(20_000))
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n\r", None), (4, PROSE, "b"), (5, PROSE + " ", "b"), (6, PROSE.replace(" ", "\n"), None),
        (7, long, "a"), (7, long, "a"), (None, "a null id", "c"), (None, None, None), (8, "x", "é"), (9, "x", "é"), (9, "x", "é"),
        (10, "one\ntwo\none\ntwo\n", "b"), (11, "\x00 odd ​ ﬁ 😀 text", "z"), (12, "TO TO TO TO TO TO TO TO TO TO TO TO TO TO TO TO", "z"),
    ]
    return docs_of(rows)


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([(1, "x", "a")]).where("doc_id < 0")
