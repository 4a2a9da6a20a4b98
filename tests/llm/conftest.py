"""Small fixtures: documents with nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("ba", "de", "ki", "lo", "mu", "ra", "so", "tu") for b in ("n", "rel", "sti", "vom", "x", "zen", "pa", "")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edge_rows():
    return [
        (900, None, None, None, None),
        (901, "", "en", "s1", 0),
        (902, " \t\n ", "en", "s1", 4),
        (903, "one", "en", None, 3),
        (904, "one", "en", "s2", 3),
        (904, "one", "en", "s2", 3),
        (905, "x " * 30_000, "en", "s2", 60_000),
        (906, "y" * 60_000, "de", "s2", 60_000),
        (None, "no id here but words enough", "en", "s1", 27),
        (907, "ÄÖÜ é ñ ﬁ İstanbul ΟΔΟΣ     é ²³ 中文字 🙂", "de", "s3", 40),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def corpus(spark):
    """300 documents in two made-up languages, with exact and near copies and shared lines."""
    rng = random.Random(11)
    rows = []
    for i in range(200):
        text = "\n".join(prose(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 6)))
        rows.append((i, text, "en", f"s{i % 5}" if i % 3 else "hot", len(text)))
    for i in range(200, 300):
        words = rows[rng.randrange(40)][1].split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed"
        text = " ".join(words)
        rows.append((i, text, "en", "hot", len(text)))
    return spark.createDataFrame(rows, DOCS)
