import random

import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "_text string, score double, shard int, topic string, n_words int, own string, label int, block int, trusted int, curve int")


def document(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), "x", 0.5, 3, "t", 1, "o", 2, 4, 0, 9)


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows and clashing column names."""
    base = prose(1, 120, 10_000)
    long = prose(2, 30_000)
    near = base.split()
    near[60] = "changed"
    return [document(1, base), document(2, base), document(2, base), document(3, " ".join(near)), document(4, None), document(5, ""), document(6, " \t\n"),
            document(7, long), document(8, "One TWO"), document(9, "one two"), document(10, "é" * 5000), document(11, base, None, None),
            document(None, base), document(None, None), document(12, prose(3, 50), "de", "hot"), document(13, prose(4, 50), "de", "hot"), document(14, "123 !!! 456")]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
