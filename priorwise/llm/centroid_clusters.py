"""Clusters of integer vectors around centroids, by dot products that follow the centroids' changes.

Every vector keeps its exact dot product with each centroid. A round changes
them by the components in which a centroid has moved, times the vector's: a
centroid at rest costs nothing, and no distance is computed anew. From them
follows the nearest centroid, as |v|^2 is the same for all of them. Vectors and
products are a table in the shared folder, written once a round by the pass that
also sums the vectors of each cluster; of the sums only clusters x components
reach the driver. A lost executor's tasks read the last round's table again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorwise.llm.shared import shared_folder
from priorwise.operators.lineage import removed

#: integers from here on could make a squared distance too long for a long
TOO_LARGE = 1 << 27


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; an integer of 2^27 or more stops the query."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(scaled, lambda x: F.abs(x) < TOO_LARGE)
    return F.when(fits, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component times {scale} is not below 2^27")))


def _pass(moves: list[tuple[np.ndarray, np.ndarray]], squares: np.ndarray, dims: int):
    """Rows of vectors with their products after ``moves``, and at the end of a task a row of sums for each cluster."""
    k = len(moves)
    lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.int64()), x.shape[1]).cast(pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, inertia, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        names, id_type = [], pa.int64()
        for batch in batches:
            names, id_type = batch.schema.names, batch.schema.field("vec_id").type
            n = batch.num_rows
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, dims).astype(np.int64)
            dots = batch.column("dots").flatten().to_numpy(zero_copy_only=False).reshape(n, k).astype(np.int64)
            for c, (where, by) in enumerate(moves):
                if len(where):
                    dots[:, c] += x[:, where] @ by
            gaps = squares - 2 * dots
            cluster = gaps.argmin(axis=1)  # the first of equal ones
            distance = batch.column("norm").to_numpy() + gaps[np.arange(n), cluster]
            for c in np.unique(cluster):
                mine = cluster == c
                count[c] += mine.sum()
                inertia[c] += distance[mine].sum()
                sums[c] += x[mine].sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"), batch.column("norm"), lists(dots), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))],
                [*names, "cluster", "distance", "n", "sums"],
            )
        some = np.flatnonzero(count)
        if len(some):
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, id_type), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.array(some, pa.int32()), pa.array(inertia[some], pa.int64()), pa.array(count[some], pa.int64()), lists(sums[some])],
                [*names, "cluster", "distance", "n", "sums"],
            )

    return run


def _totals(state: DataFrame) -> tuple[dict[int, tuple[int, int]], dict[int, dict[int, int]]]:
    """By cluster (vectors, inertia) and the sums of components, from the sums of the tasks."""
    parts = state.where("n IS NOT NULL")
    whole = "decimal(38,0)"
    sizes = parts.groupBy("cluster").agg(F.sum(F.col("n").cast(whole)).alias("n"), F.sum(F.col("distance").cast(whole)).alias("inertia"))
    sums = parts.select("cluster", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum(F.col("x").cast(whole)).alias("x"))
    found: dict[int, dict[int, int]] = {}
    for r in sums.collect():  # clusters x components
        found.setdefault(r.cluster, {})[r.i] = int(r.x)
    return {r.cluster: (int(r.n), int(r.inertia)) for r in sizes.collect()}, found


def cluster_vectors(vectors: DataFrame, clusters: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: int = 3, vector: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256`` for each vector kept.

    Kept are vectors of exactly ``dims`` components, none null or non-finite;
    their integers are floor(scale * x), and one of 2^27 or more stops the query
    with an error. The centroids start as the ``clusters`` kept vectors with the
    smallest sha256 of ``seed:vec_id`` (all, if fewer; rows of one vec_id by
    their components, a null vec_id last). A round assigns every vector to the
    nearest centroid, of equally near ones the smaller number, and replaces each
    centroid that has vectors by floor(sum / count) of each component. After the
    rounds all are assigned once more; rounds that would change nothing are left
    out. Repeated rows count as often as they occur; no vectors give no rows.
    """
    spark = vectors.sparkSession
    given = F.col(vector)
    rows = vectors.where((F.size(given) == dims) & finite(given)).select("vec_id", integers(given, scale).alias("vector"))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select("vector", rank.alias("rank")).orderBy(F.col("rank").asc_nulls_last(), "vector").limit(clusters).collect()
    k = len(first)
    centroids = np.array([r.vector for r in first], np.int64).reshape(k, dims)
    norm = F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    state = rows.select("vec_id", "vector", norm.alias("norm"), F.array_repeat(F.lit(0).cast("long"), k).alias("dots"))
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, vector array<int>, norm long, dots array<long>, cluster int, distance long, n long, sums array<long>"
    folder, before = f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}", None
    moved, totals = centroids, {}
    for at in range(rounds + 1):
        moves = [(np.flatnonzero(m), m[np.flatnonzero(m)]) for m in moved]
        squares = (centroids * centroids).sum(axis=1)
        path = f"{folder}/{at}"
        held = state.where("n IS NULL") if at else state
        held.select("vec_id", "vector", "norm", "dots").mapInArrow(_pass(moves, squares, dims), schema).write.parquet(path)
        state = spark.read.schema(schema).parquet(path)
        if before:
            removed(spark, before)
        before = path
        totals, sums = _totals(state)
        if at == rounds:
            break
        moved = np.zeros_like(centroids)
        for c, total in sums.items():
            moved[c] = [total[i] // totals[c][0] for i in range(dims)] - centroids[c]
        if not moved.any():
            break
        centroids = centroids + moved
    return _described(state, centroids, totals)


def _described(state: DataFrame, centroids: np.ndarray, totals: dict[int, tuple[int, int]]) -> DataFrame:
    """The vectors' rows with what their cluster has; the lists hold one item for each cluster."""
    texts = [",".join(map(str, c)) for c in centroids.tolist()]
    own = [totals.get(c, (0, 0))[1] for c in range(len(texts))]
    of = lambda items, kind: F.element_at(F.array(*map(F.lit, items)).cast(f"array<{kind}>"), F.col("cluster") + 1)
    return state.where("n IS NULL").select(
        "vec_id",
        "cluster",
        "distance",
        of(own, "bigint").alias("cluster_inertia"),
        F.lit(sum(own)).cast("long").alias("inertia"),
        F.split(of(texts, "string"), ",").cast("array<int>").alias("centroid"),
        of([hashlib.sha256(t.encode()).hexdigest() for t in texts], "string").alias("centroid_sha256"),
    )
