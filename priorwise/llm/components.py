"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorwise.llm.shared import checkpointed

#: links that a task contracts by itself
TASK_LINKS = 1 << 16


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of each node with the least that the others of its run of links reach."""

    def solve(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j, root = at[: len(a)], at[len(a) :], np.arange(len(names))
        while not np.array_equal(p := root[i], q := root[j]):
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while not np.array_equal(up := root[root], root):
                root = up
        k = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[k]), pa.array(names[root[k]])], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("u", "v")])
        n += batch.num_rows
        if n >= 2 * TASK_LINKS:
            yield solve(*(np.concatenate(x) for x in zip(*held)))
            held, n = [], 0
    if n:
        yield solve(*(np.concatenate(x) for x in zip(*held)))


def components(links: DataFrame, a: str, b: str, rows: int | None = None) -> DataFrame:
    """``node, component`` for each node that has a link to another node.

    ``component`` is the smallest node that links reach. Links with a null end,
    repeated links and links of a node with itself say nothing. Each round
    contracts every star at once, so the number of rounds grows with the
    logarithm of the longest chain; every round is a checkpoint in the shared
    folder. It ends when every larger node has one link, to a node that has none
    to a smaller one. Node values must have an order (longs or strings).

    With ``rows``, the number of links, between longs, each run of about
    ``TASK_LINKS`` of them is first contracted inside a task; so few links as one
    task contracts need no exchange and no round.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    parts = None if rows is None else max(1, -(-rows // TASK_LINKS))
    if parts:
        edges = edges.coalesce(parts).mapInArrow(_stars, "u long, v long")
    edges = checkpointed(edges if parts == 1 else edges.distinct())
    while parts != 1 and not _flat(edges):
        edges = checkpointed(_small_star(_large_star(edges)))
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _flat(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or is the smaller neighbour of one node and the larger of another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()
