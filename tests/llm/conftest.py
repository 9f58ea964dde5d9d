import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash long, sha string, shard int, node long, kept boolean, mix_p double, topic string, own string"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), 1, "x", 2, 3, True, 0.5, "t", "o")


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and very long texts, repeated texts and rows, near copies, ties, odd characters."""
    rng = random.Random(5)
    base = words(rng, 150)
    near = base.split()
    near[70] = "changed"
    long = words(rng, 30_000)
    passage = words(rng, 90)
    return [
        row(0, None), row(1, ""), row(2, " \n\t "), row(3, "one two"), row(4, "one two"), row(5, base), row(6, " ".join(near)), row(7, base),
        row(8, long), row(9, passage + "\n" + words(rng, 80)), row(10, words(rng, 60) + " " + passage), row(11, "éèê 日本語 🙂 " + words(rng, 40)),
        row(12, base.upper()), row(13, None, None, None), row(14, "12345 67890 !!"), row(15, words(rng, 200, "xyz"), None), row(16, "A" * 2000),
        row(5, base), (17, words(rng, 50), None, None, None, None, None, None, None, None, None, None, None),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
