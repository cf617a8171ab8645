"""Similar names: the index finds every pair that brute force finds, from few candidates."""

import random

import pytest
from pyspark.sql import functions as F

from priorwise.operators import resolve, similar


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def alike(a, b):
    return 1 - edits(a, b) / max(len(a), len(b))


def frame(spark, names, column):
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


@pytest.fixture(scope="module")
def people():
    """Names of random letters, damaged by up to four edits, short ones, nulls and empty ones."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randrange(3, 10)))
    known = [f"{word()} {word()}" for _ in range(250)] + ["a", "ab", "abc", "abcd", "abcde", "ba", "aaaa", "aaaaaa"]

    def damaged(name):
        for _ in range(r.randrange(5)):
            at = r.randrange(len(name))
            name = name[:at] + r.choice(("", "x", "qz")) + name[at + 1 :]
        return name

    names = [damaged(r.choice(known[:250])) for _ in range(120)] + ["b", "abd", "acb", "aaa", "", None, known[0], known[0], "abcdx"]
    return names, known


@pytest.mark.parametrize("cutoff", [0.4, 0.6, 0.75, 1.0])
def test_pairs_are_complete(spark, people, cutoff):
    names, known = people
    want = {(a, b): alike(a, b) for a in set(names) - {None, ""} for b in known if alike(a, b) >= cutoff - 1e-12}
    got = similar.similar_pairs(frame(spark, names, "name"), frame(spark, [*known, None, ""], "match"), cutoff).collect()
    assert len(got) == len(want) and {(r.name, r.match): pytest.approx(r.score) for r in got} == want


def test_few_candidates(spark, people):
    names, known = (set(x) - {None, ""} for x in people)
    index = similar.NameIndex(frame(spark, names, "name"), frame(spark, known, "match"))
    assert similar.candidates(index, 0.6).count() < 0.01 * len(names) * len(known)
    assert similar.candidates(index, 0.85).count() < 0.004 * len(names) * len(known)


@pytest.mark.parametrize("cutoff", [0.4, 0.65])
def test_most_similar(spark, people, cutoff):
    names, known = people
    want = []
    for a in set(names) - {None, ""}:
        best = sorted((-alike(a, b), b) for b in known if alike(a, b) >= cutoff - 1e-12)[:3]
        want += [(a, b, pytest.approx(-s), k) for k, (s, b) in enumerate(best, 1)]
    got = resolve.suggestions(frame(spark, names, "name"), frame(spark, known, "name"), cutoff, 3)
    assert sorted(map(tuple, got.collect())) == sorted(want, key=lambda x: (x[0], x[1]))


def test_no_names(spark, people):
    known = frame(spark, people[1], "name")
    assert resolve.suggestions(known.limit(0), known).count() == 0
    assert resolve.suggestions(known, known.limit(0)).count() == 0
    with pytest.raises(ValueError):
        similar.similar_pairs(known, known.select(F.col("name").alias("match")), 0.0)
