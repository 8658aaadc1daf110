import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, spans string, part int, kind string, score string"


def row(doc_id, text, lang="en"):
    """A row of documents with extra columns whose names operators use inside."""
    return (doc_id, text, lang, "src", len(text or ""), "x", "x", 1, "x", "x")


@pytest.fixture(scope="session")
def prose():
    """Invented texts, the same in every run."""
    rng = random.Random(5)
    parts = ["the", "of", "and", "ti", "on", "er", "ha", "ed", "re", "is", "in", "le", "é", "ch", "ou"]

    def text(n):
        return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))

    return text


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls, empty and long texts, ties, repeated rows, copies and near copies."""
    base = prose(60)
    near = base.split(" ")
    near[30] = "changed"
    long = prose(9000)
    rows = [
        row(1, base), row(2, base.upper()), row(3, " ".join(near)), row(4, None), row(5, ""), row(6, "   \n\t "), row(7, "one"), row(8, "One"), row(9, "two words"),
        row(10, long), row(11, long + " end"), row(None, base), row(12, prose(30)), row(12, prose(30)), row(13, "12 34 ..."), row(14, "ÉTÉ à la 日本語 😀 mail a@b.co"), row(15, base), row(15, base),
        row(16, "x" * 5000), row(17, "x" * 300_000), row(18, "\x00 　   z"), row(19, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
