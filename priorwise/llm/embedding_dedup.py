"""Near-duplicate vectors by small-world graphs over shards of the table.

Equal vectors are one representative. Representatives are dealt into shards; a
task builds the graph of its shard and widens the search beam until the links
of an audited sample, found by brute force, are recalled. Then every
representative queries every shard, in blocks; a sample of each block is
audited too (of every block at first, then of blocks 1, 2, 4, 8, ...), and the
block is asked again with wider beams until it passes.
Candidates count only if their cosine in double precision reaches the
threshold. Pairs never leave a task: it sums the links of each query, and emits
only links that join two classes of what it has seen of its shard, from which
components come. Graphs travel as rows, so a lost executor's work is simply
redone.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorwise.llm.components import components
from priorwise.llm.hnsw import Hnsw
from priorwise.llm.shared import checkpointed, small

#: vectors that one graph holds at most, and graphs at least
SHARD_VECTORS = 200_000
LEAST_SHARDS = 8
#: queries that travel as one row
QUERY_BLOCK = 1024
#: queries of an audited block that are audited
AUDITED = 32
#: real links and queries, one of which a shard's audits reach before only blocks 1, 2, 4, 8, ... are audited
AUDIT_LINKS = 1000
AUDIT_QUERIES = 4096
#: audited recall below which the operator stops
LEAST_RECALL = 0.9
_SLACK = 1e-4  # single-precision search, double-precision check


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null, no non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _save(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as held:
        return {k: held[k] for k in held.files}


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # the squares of very large or small numbers don't fit
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _build(least: float, recall: float, links: int):
    """One row for each shard from rows (shard, node, copies, vector) that are sorted by shard."""

    def graph(shard: int, nodes: list[pa.Array], counts: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.array(pa.concat_arrays(nodes).to_pylist(), "S32")
        order = np.argsort(ids)
        ids, copies, unit = ids[order], np.concatenate(counts)[order], _unit(np.concatenate(parts)[order])
        seeds = np.array([int(i[:16], 16) for i in ids], np.uint64)
        index = Hnsw(unit, seeds, links)
        width = index.fitting_beam(least - _SLACK, np.argsort(seeds, kind="stable"), recall)
        layers = {f"g{k}": g for k, g in enumerate(index.graph)}
        blob = _save(ids=ids, copies=copies, unit=unit, level=index.level, order=index.order, width=np.array(width), **layers)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], ["shard", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, counts, parts = None, [], [], []
        for batch in batches:
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if e == s:
                    continue
                if shard[s] != at and nodes:
                    yield graph(at, nodes, counts, parts)
                    nodes, counts, parts = [], [], []
                at = int(shard[s])
                some = batch.slice(s, e - s)
                nodes.append(some.column("node"))
                counts.append(some.column("copies").to_numpy())
                parts.append(_matrix(some.column("vector")))
        if nodes:
            yield graph(at, nodes, counts, parts)

    return run


class _Shard:
    """A graph with its vectors, and the classes of its nodes by the links found so far."""

    def __init__(self, data: bytes) -> None:
        held = _load(data)
        index = Hnsw.__new__(Hnsw)
        index.x = held["unit"].astype(np.float32)
        index.level, index.order = held["level"], held["order"]
        index.tops = [index.order[index.level[index.order] >= k] for k in range(int(index.level.max(initial=0)) + 1)]
        index.graph = [held[f"g{k}"] for k in range(len(index.tops))]
        self.ids, self.copies, self.unit, self.index, self.width = held["ids"], held["copies"], held["unit"], index, int(held["width"])
        self.parent = np.arange(len(self.ids))
        self.blocks = self.audited = self.known = 0

    def ask(self, unit: np.ndarray, least: float, recall: float) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(query, node) pairs of at least that cosine; real links of the audited queries, and how many were found.

        The beam, also that of later blocks, doubles until the audited queries
        of the block find their links. Every block is audited until the audits
        have met enough links or queries, then each whose number is a power of two.
        """
        q32 = unit.astype(np.float32)
        self.blocks += 1
        due = (self.known < AUDIT_LINKS and self.audited < AUDIT_QUERIES) or not self.blocks & (self.blocks - 1)
        sample = np.arange(0, len(unit), max(1, len(unit) // AUDITED)) if due else np.zeros(0, np.int64)
        truth = [np.zeros((2, 0), np.int64)]
        for at in range(0, len(self.ids) if due else 0, 1 << 15):
            rows, cols = np.nonzero(q32[sample] @ self.index.x[at : at + (1 << 15)].T >= least - _SLACK)
            truth.append(np.stack([sample[rows], cols + at]))
        rows, cols = np.concatenate(truth, axis=1)
        exact = np.einsum("ij,ij->i", unit[rows], self.unit[cols]) >= least
        real = set(zip(rows[exact].tolist(), cols[exact].tolist()))
        self.audited, self.known = self.audited + len(sample), self.known + len(real)
        while True:
            q, node = self.index.within(q32, least - _SLACK, self.width)
            exact = np.einsum("ij,ij->i", unit[q], self.unit[node]) >= least
            q, node = q[exact], node[exact]
            audited = np.isin(q, sample)
            found = len(real & set(zip(q[audited].tolist(), node[audited].tolist())))
            if found >= recall * len(real) or self.width >= len(self.ids):
                return q, node, len(real), found
            self.width *= 2

    def _root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    def joining(self, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Indices of pairs, sorted by query, that join what was apart; every query gets one link at least."""
        edges = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        kept, step = [], 1
        at = 0
        while at < len(edges):
            # queries in growing batches: after the first ones most nodes of a group have one root
            stop = edges[at + step] if at + step < len(edges) else len(q)
            low = edges[at]
            while not np.array_equal(up := self.parent[self.parent], self.parent):
                self.parent = up
            some = np.stack([q[low:stop], self.parent[node[low:stop]]], axis=1)
            _, first = np.unique(some, axis=0, return_index=True)
            before, root = -1, 0
            for k in (first + low).tolist():
                r = self._root(int(node[k]))
                if q[k] != before:
                    before, root = q[k], r
                    kept.append(k)
                elif r != root:
                    self.parent[r] = root
                    kept.append(k)
            at, step = at + step, min(64, 4 * step)
        return np.array(kept, np.int64)


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of representatives with vectors of one size."""
    for batch in batches:
        sizes = batch.column("dims").to_numpy(zero_copy_only=False)
        for dims in np.unique(sizes):
            rows = np.flatnonzero(sizes == dims)
            for k in range(0, len(rows), QUERY_BLOCK):
                some = batch.take(pa.array(rows[k : k + QUERY_BLOCK]))
                blob = _save(ids=np.array(some.column("node").to_pylist(), "S32"), unit=_unit(_matrix(some.column("vector"))))
                yield pa.RecordBatch.from_arrays([pa.array([int(dims)], pa.int32()), pa.array([blob], pa.binary())], ["dims", "payload"])


_FOUND = "a string, b string, others long, real long, found long"


def _search(least: float, recall: float):
    """Rows ``_FOUND`` from rows (unit, kind, payload): a graph, then the queries put to it.

    Links (a, b) that join classes; the copies (``others``) that a query ``a`` is
    linked with in the shard; and for each block its audit (``real``, ``found``).
    """

    def row(a: np.ndarray, b: np.ndarray | None = None, others: np.ndarray | None = None, audit: tuple[int, int] | None = None) -> pa.RecordBatch:
        text = lambda x: pa.array(x.astype("U32"), pa.string())
        empty = pa.nulls(len(a), pa.int64())
        counts = [empty, empty] if audit is None else [pa.array([x], pa.int64()) for x in audit]
        first = text(a) if audit is None else pa.nulls(1, pa.string())
        return pa.RecordBatch.from_arrays(
            [first, pa.nulls(len(a), pa.string()) if b is None else text(b), empty if others is None else pa.array(others, pa.int64()), *counts], ["a", "b", "others", "real", "found"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload")):
                if kind == 0:
                    shard = _Shard(payload.as_py())
                    continue
                asked = _load(payload.as_py())
                q, node, *audit = shard.ask(asked["unit"], least, recall)
                apart = asked["ids"][q] != shard.ids[node]
                q, node = q[apart], node[apart]
                order = np.argsort(q, kind="stable")
                q, node = q[order], node[order]
                others = np.bincount(q, shard.copies[node], len(asked["ids"])).astype(np.int64)
                linked = np.flatnonzero(others)
                keep = shard.joining(q, node)
                yield row(asked["ids"][q[keep]], shard.ids[node[keep]])
                yield row(asked["ids"][linked], None, others[linked])
                yield row(asked["ids"][:1], None, None, tuple(audit))

    return run


def representatives(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, node) and representatives (node, copies, vector, dims); unusable vectors have a null node."""
    rows = vectors.select("vec_id", F.col(vector).alias("vector"), usable(F.col(vector)).alias("ok"))
    node = F.when(F.col("ok"), F.md5(F.encode(F.concat_ws(",", F.col("vector").cast("array<string>")), "UTF-8")))
    rows = rows.select("vec_id", node.alias("node"), "vector")
    reps = rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.first("vector").alias("vector"))
    return rows.select("vec_id", "node"), reps.withColumn("dims", F.size("vector"))


def near_links(reps: DataFrame, least: float = 0.9, recall: float = 0.999, links: int = 12) -> DataFrame:
    """Rows ``_FOUND`` of representatives (node, copies, vector, dims) with a cosine of at least ``least``."""
    spark = reps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = {r.dims: r.n for r in reps.groupBy("dims").agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors
    base, plan = 0, []
    for dims, n in sorted(sizes.items()):
        shards = max(min(LEAST_SHARDS, n // 64 + 1), -(-n // SHARD_VECTORS))
        plan.append((dims, base, shards))
        base += shards
    if not plan:
        return reps.sparkSession.createDataFrame([], _FOUND)
    slices = max(1, parts // base)
    shard = F.lit(None).cast("int")
    units = F.lit(None).cast("array<int>")
    for dims, first, shards in plan:
        shard = F.when(F.col("dims") == dims, F.lit(first) + F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")).otherwise(shard)
        own = F.transform(F.sequence(F.lit(first), F.lit(first + shards - 1)), lambda s: (s * slices + F.pmod(F.xxhash64("payload"), F.lit(slices))).cast("int"))
        units = F.when(F.col("dims") == dims, own).otherwise(units)
    dealt = reps.select(shard.alias("shard"), "node", "copies", "vector").repartition(base, "shard").sortWithinPartitions("shard")
    graphs = checkpointed(dealt.mapInArrow(_build(least, recall, links), "shard int, payload binary"))
    held = graphs.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda k: F.col("shard") * slices + k)).alias("unit"), F.lit(0).alias("kind"), "payload")
    asked = reps.select("node", "vector", "dims").mapInArrow(_pack_queries, "dims int, payload binary")
    asked = asked.select(F.explode(units).alias("unit"), F.lit(1).alias("kind"), "payload")
    work = held.unionByName(asked).repartition(base * slices, "unit").sortWithinPartitions("unit", "kind")
    return work.mapInArrow(_search(least, recall), _FOUND)


def near_duplicates(vectors: DataFrame, least: float = 0.9, vector: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (vec_id and the vector).

    ``n_links`` counts the other rows linked directly, copies included;
    ``component_id`` is the smallest vec_id that links reach. Vectors that are
    null, empty or zero, or hold null or non-finite components, link with
    nothing, as do vectors of different lengths. Repeated rows count as often
    as they occur. A null vec_id is never the smallest and never kept.
    """
    rows, reps = representatives(vectors, vector)
    rows, reps = checkpointed(rows), checkpointed(reps)
    found = checkpointed(near_links(reps, least))
    audit = found.agg(F.sum("real").alias("real"), F.sum("found").alias("found")).first()
    if audit.real and audit.found < LEAST_RECALL * audit.real:
        raise RuntimeError(f"audits found {audit.found} of {audit.real} links")
    others = found.where("others IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others"))
    labels = components(found.where("b IS NOT NULL").select("a", "b"), "a", "b")
    least_id = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("least"))
    nodes = reps.select("node", "copies").join(least_id, "node").join(others, "node", "left").join(labels, "node", "left")
    nodes = checkpointed(nodes.select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component", "least"))
    # a representative without links is its own component
    smallest = nodes.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("reached"))
    named = nodes.join(small(checkpointed(smallest)), "component", "left").select("node", "n_links", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("reached")).alias("component_id"))
    out = rows.join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
