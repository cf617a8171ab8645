"""Centroid clusters and hard negatives against brute force in plain Python."""

import hashlib
import math

import numpy as np
import pytest

from priorwise.llm import centroid_clusters, hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, score string, shard int"


def bad(v):
    return v is None or any(x is None or not math.isfinite(x) for x in v)


@pytest.fixture(scope="module")
def vectors():
    """Vectors in groups, with ties, copies, odd and missing ones, repeated rows and clashing columns."""
    g = np.random.default_rng(5)
    centres = g.normal(size=(12, 64))
    x = [(centres[k % 12] + g.normal(size=64) * 0.4).round(3) / 8 for k in range(700)]
    rows = [(k, [float(c) for c in v], k % 10 if k % 23 else 1) for k, v in enumerate(x)]
    rows += [(700 + k, rows[300 + k % 3][1], k % 4) for k in range(60)]  # copies of three vectors
    rows += [(800, None, 1), (801, [0.0] * 64, 2), (900, [0.0] * 64, 2), (802, [1.0] * 63, 2), (803, [1.0] * 62 + [None, 1.0], 3), (804, [math.nan] * 64, 3)]
    rows += [(805, [math.inf] + [0.0] * 63, 3), (1000, rows[5][1], None), (806, [-5.5] * 64, 4), (1100, [1.0] * 63, 2), (807, [2.0] * 63, 5), (808, [], 1), (1200, [], 1), (809, [], 2)]
    return [(*r, "c", "s", 1) for r in [*rows, rows[7], rows[7]]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, vectors):
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(vectors, SCHEMA).repartition(5).write.parquet(f"{path}/embeddings.parquet")
    return path


def clusters(rows, k=8, rounds=10):
    kept = [(r[0], [math.floor(1024 * x) for x in r[1]]) for r in rows if not bad(r[1]) and len(r[1]) == 64]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in first]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for at in range(rounds + 1):
        near = [min((square(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
        if at < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, m) in zip(kept, near) if m == n]
                if own:
                    centroids[n] = [sum(c) // len(own) for c in zip(*own)]
    inertia = [sum(d for d, m in near if m == n) for n in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, n, d, inertia[n], sum(inertia), digest[n]) for (i, _), (d, n) in zip(kept, near))


def test_clusters(spark, folder, vectors):
    got = queries.QUERIES["op11_centroid_clusters"](spark, folder)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert sorted(tuple(r) for r in got.collect()) == clusters(vectors)


def test_few_and_no_vectors(spark, vectors):
    few = spark.createDataFrame(vectors[:3] + [(None, [0.5] * 64, 1, "c", "s", 1)], SCHEMA)
    got = centroid_clusters.cluster_vectors(few)
    assert sorted(r.vec_id for r in got.collect() if r.vec_id is not None) == [0, 1, 2]
    assert {r.distance for r in got.collect()} == {0} and len({r.cluster for r in got.collect()}) == 4
    assert got.first().centroid_sha256 == hashlib.sha256(",".join(map(str, got.first().centroid)).encode()).hexdigest()
    assert centroid_clusters.cluster_vectors(few.limit(0)).count() == 0
    with pytest.raises(Exception, match="not below"):
        centroid_clusters.cluster_vectors(spark.createDataFrame([(1, [1e9] * 64, 1, "c", "s", 1)], SCHEMA)).count()


def negatives(rows):
    kept = [(i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label, *_ in rows if label is not None and not bad(v)]
    out = []
    for a, v, label in kept:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, m) for b, w, m in kept if b != a and len(w) == len(v))
        for s, b, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(t, n) for t, n, m in scored if m != label and 80 * s >= 100 * t >= 100 * s][:5]
            out += [(a, b, rank, n, -s, -t) for rank, (t, n) in enumerate(fit, 1)]
    return sorted(out)


def test_negatives(spark, folder, vectors):
    got = queries.QUERIES["op13_hard_negatives"](spark, folder)
    assert got.dtypes[2] == ("rank", "int")
    want = negatives(vectors)
    assert len(want) > 60
    assert sorted(tuple(r) for r in got.collect()) == want


def test_many_blocks_and_clusters(spark, folder, vectors, monkeypatch):
    """Small blocks, shards and clusters give the same rows, so that bounds end walks where they may."""
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 90)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "MEMBERS", 1)
    got = queries.QUERIES["op13_hard_negatives"](spark, folder)
    assert sorted(tuple(r) for r in got.collect()) == negatives(vectors)


def test_walk_ends_early():
    """A walk stops at its bound: with one group of near rows it never scores the others."""
    g = np.random.default_rng(1)
    near, far = g.normal(size=(300, 16)) * 20 + 1000, -g.normal(size=(5000, 16)) * 20 - 1000
    x = np.concatenate([near, far]).astype(np.int64)
    shard = hard_negatives._Shard(np.arange(len(x)), np.zeros(len(x), np.int64), x)
    asked = []
    barred = lambda a, r: asked.extend(r) or np.zeros((len(a), len(r)), bool)
    owner = np.arange(4)
    q, row, score = hard_negatives._walk(shard, x[:4], owner, np.full(4, 1 << 62), np.full(4, -(1 << 62)), barred, 5)
    assert len(asked) < 800
    want = np.sort(x[:4] @ x.T, axis=1)[:, ::-1][:, :5]
    assert score.reshape(4, 5).tolist() == want.tolist()


def test_no_anchors(spark, vectors):
    table = spark.createDataFrame(vectors, SCHEMA)
    run = lambda t: hard_negatives.hard_negatives(t, t.vec_id % 100 == 0)
    assert run(table.where("vec_id % 100 <> 0")).count() == 0
    assert run(table.limit(0)).count() == 0
    assert run(spark.createDataFrame([(None, [1.0], 1, "c", "s", 1), (100, [1.0], 1, "c", "s", 1)], SCHEMA)).count() == 0
