import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    """A maker of reproducible words."""
    import random

    def make(seed, n):
        r = random.Random(seed)
        return ["".join(r.choice("abcdefghijé") for _ in range(r.randrange(1, 7))) for _ in range(n)]

    return make


@pytest.fixture(scope="session")
def corpus(spark, words):
    """Texts with nulls, empty and long texts, copies, near copies, ties and a null id."""
    base = " ".join(words(1, 120))
    long = " ".join(words(2, 6000))
    shared = " ".join(words(3, 90))
    rows = [
        (5, base), (2, base), (7, base + " tail"), (3, None), (4, ""), (6, " \n\t "), (8, long), (9, long[:2000] + " " + shared + " " + " ".join(words(4, 50))),
        (10, " ".join(words(5, 40)) + "\n" + shared), (11, "one"), (11, "one two"), (12, "x " * 300), (None, "no id " + shared), (5, base), (13, "é" * 900), (14, "token = '0123456789abcdef01'"),
    ]
    return spark.createDataFrame([(d, t, "en" if (d or 0) % 2 else None, "s", len(t or "")) for d, t in rows], SCHEMA).repartition(3)
