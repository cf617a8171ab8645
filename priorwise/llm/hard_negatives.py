"""Hard negatives of anchor vectors, by lists that the anchors of a cluster share.

Anchors and rows are dealt into blocks and shards of bounded size, and every
block meets every shard of its group once. A task clusters the anchors of its
block by direction. For a cluster whose anchors lie within an angle s of its
centre, a row v at the angle t from the centre scores at most
|anchor| |v| cos(max(0, t - s)). The shard is sorted by this bound (without
|anchor|, so that one list serves all members), and each member walks the list
until the bound of what follows is below what it already holds or can use. All
scores are exact integers, so the result is that of comparing all rows.

Positives are searched among the rows of the anchor's label, then negatives
among all others, below the scores of the positives. A shard sends its best few
for each search; Spark keeps the best of all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorwise.llm.centroid_clusters import finite, integers
from priorwise.llm.shared import checkpointed, small, stored

#: rows of a shard and anchors of a block at most, about
SHARD_ROWS = 50_000
BLOCK_ANCHORS = 2_000
#: shards that a group has at least, if it has enough rows
LEAST_SHARDS = 8
LEAST_ROWS = 512
#: anchors of a cluster, on average at most
MEMBERS = 64
#: squared norms from here on could make five scores too long for a long
TOO_LONG = float(1 << 60)
_UNIT = ["dims", "grp", "block", "shard"]
_FOUND = "anchor_id long, key long, place int, positive_id long, positive_score long, found_id long, score long"


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1.0)[:, None], norm


def _clusters(unit: np.ndarray, rounds: int = 5) -> np.ndarray:
    """A number for each anchor; near directions share one."""
    k = -(-len(unit) // MEMBERS)
    centres = unit[:: max(1, len(unit) // k)][:k]
    near = np.zeros(len(unit), np.int64)
    for _ in range(rounds if k > 1 else 0):
        near = (unit @ centres.T).argmax(axis=1)
        centres = np.stack([unit[near == c].sum(axis=0) if (near == c).any() else centres[c] for c in range(k)])
        centres = _directions(centres)[0]
    return near


class _Shard:
    """The rows of a shard, and products with them that are exact."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.labels, self.x = ids, labels, x
        self.unit, self.norm = _directions(x.astype(np.float64))
        self.longest = self.norm.max(initial=0.0)

    def typed(self, longest: float) -> np.ndarray:
        """The vectors in the fastest type whose sums of products are exact with anchors that long."""
        product = self.longest * longest * (1 + 1e-9)
        return self.x.astype(np.float32 if product < 1 << 24 else np.float64 if product < 1 << 53 else np.int64)

    def order(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows by falling bound for anchors in the directions ``members``, and the bounds."""
        centre = _directions(members.sum(axis=0)[None])[0][0]
        spread = np.arccos(np.clip((members @ centre).min(), -1, 1))
        angle = np.arccos(np.clip(self.unit @ centre, -1, 1))
        bound = self.norm * np.cos(np.maximum(0, angle - spread)) + 1e-6 * self.longest  # the angles are rounded
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]


def _walk(shard: _Shard, x: np.ndarray, owner: np.ndarray, cap: np.ndarray, floor: np.ndarray, barred, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(search, row, score): each search's best ``top`` rows with a score from ``floor`` to ``cap``, equal ones by smaller id.

    ``owner`` is the anchor of a search; ``barred(anchors, rows)`` are the pairs that don't count.
    """
    unit, norm = _directions(x.astype(np.float64))
    rows_x = shard.typed(norm.max(initial=0.0))
    anchors_x = x.astype(rows_x.dtype)
    need = floor.copy()
    hold = [np.zeros(0, np.int64)] * 3
    cluster = _clusters(unit)
    for c in np.unique(cluster):
        members = np.flatnonzero(cluster == c)
        order, bound = shard.order(unit[members])
        live = np.flatnonzero(cluster[owner] == c)
        at, step = 0, 256
        while at < len(order) and len(live):
            live = live[norm[owner[live]] * bound[at] >= need[live]]
            if not len(live):
                break
            some = order[at : at + step]
            who, back = np.unique(owner[live], return_inverse=True)
            score = (anchors_x[who] @ rows_x[some].T).astype(np.int64)
            low = np.full(len(who), np.iinfo(np.int64).max)
            np.minimum.at(low, back, need[live])
            a, r = np.nonzero((score >= low[:, None]) & ~barred(who, some))
            # pairs that count for some search of the anchor, then for which
            first, size = np.searchsorted(back[by := np.argsort(back, kind="stable")], np.arange(len(who))), np.bincount(back, minlength=len(who))
            times = size[a]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            q = live[by[np.repeat(first[a], times) + nth]]
            a, r = np.repeat(a, times), np.repeat(r, times)
            s = score[a, r]
            ok = (s >= need[q]) & (s <= cap[q])
            hold = _best([np.concatenate(p) for p in zip(hold, (q[ok], some[r[ok]], s[ok]))], shard.ids, top)
            full = np.flatnonzero(np.bincount(hold[0], minlength=len(owner)) >= top)
            last = np.searchsorted(hold[0], full, side="right") - 1
            need[full] = np.maximum(need[full], hold[2][last])
            at, step = at + step, min(2 * step, 8192)
    return tuple(hold)


def _best(found: list[np.ndarray], ids: np.ndarray, top: int) -> list[np.ndarray]:
    q, row, score = found
    order = np.lexsort((ids[row], -score, q))
    q, row, score = q[order], row[order], score[order]
    first = np.searchsorted(q, q, side="left")
    keep = np.arange(len(q)) - first < top
    return [q[keep], row[keep], score[keep]]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit, from rows sorted by unit."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _UNIT], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for s, e in zip(edges[:-1], edges[1:]):
            if e == s:
                continue
            part = batch.slice(s, e - s)
            if held and any(held[-1].column(c)[0] != part.column(c)[0] for c in _UNIT):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(table.num_rows, dims)


def _search(top: int, low: int, high: int, same: bool):
    """Rows ``_FOUND`` of units: rows of kind 0, then anchors of kind 1 with the positives found so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            kind = unit.column("kind").to_numpy()
            dims = unit.column("dims")[0].as_py()
            rows, anchors = unit.slice(0, int((kind == 0).sum())), unit.slice(int((kind == 0).sum()))
            if not rows.num_rows or not anchors.num_rows:
                continue
            shard = _Shard(rows.column("id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows, dims))
            ids, labels = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
            if same:
                owner = np.arange(len(ids))
                cap, floor = np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), -(1 << 62))
                place, positive, reached = owner * 0, owner * 0, owner * 0
                barred = lambda a, r: ids[a][:, None] == shard.ids[r]
            else:
                lists = anchors.column("positives").combine_chunks()
                sizes = np.diff(lists.offsets.to_numpy())
                owner = np.repeat(np.arange(len(ids)), sizes)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                flat = lists.flatten()
                positive, reached = flat.field("id").to_numpy(), flat.field("score").to_numpy()
                # low * positive <= 100 * score <= high * positive, in exact integers
                cap, floor = (high * reached.astype(object) // 100).astype(np.int64), (-(-low * reached.astype(object) // 100)).astype(np.int64)
                barred = lambda a, r: labels[a][:, None] == shard.labels[r]
            q, row, score = _walk(shard, _matrix(anchors, dims), owner, cap, floor, barred, top)
            a = owner[q]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[a]), anchors.column("key").combine_chunks().take(pa.array(a)), pa.array(place[q], pa.int32()), pa.array(positive[q], pa.int64()), pa.array(reached[q], pa.int64()), pa.array(shard.ids[row]), pa.array(score)],
                [c.split()[0] for c in _FOUND.split(", ")],
            )

    return run


def _met(anchors: DataFrame, rows: DataFrame, task, *carried: str) -> DataFrame:
    """``task`` over every block of the anchors of a group (dims, grp) with every shard of its rows."""
    n = rows.groupBy("dims", "grp").agg(F.count("*").alias("n"))
    m = anchors.groupBy("dims", "grp").agg(F.count("*").alias("m"))
    shards = F.greatest(F.least(F.lit(LEAST_SHARDS), F.floor(F.col("n") / LEAST_ROWS) + 1), F.ceil(F.col("n") / SHARD_ROWS))
    sizes = small(checkpointed(n.join(m, ["dims", "grp"]).select("dims", "grp", shards.cast("int").alias("shards"), F.ceil(F.col("m") / BLOCK_ANCHORS).cast("int").alias("blocks"))))
    dealt = lambda n: F.pmod(F.xxhash64("id", "vector"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shared = ["dims", "grp", "id", "label", "vector"]
    left = rows.join(sizes, ["dims", "grp"]).select(*shared, dealt("shards").alias("shard"), each("blocks").alias("block"), F.lit(0).alias("kind"))
    right = anchors.join(sizes, ["dims", "grp"]).select(*shared, *carried, dealt("blocks").alias("block"), each("shards").alias("shard"), F.lit(1).alias("kind"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = left.unionByName(right, allowMissingColumns=True).repartition(parts, *_UNIT).sortWithinPartitions(*_UNIT, "kind")
    return work.mapInArrow(task, _FOUND)


def _first(found: DataFrame, top: int, *of: str) -> DataFrame:
    """The best ``top`` rows of all shards with their rank; Spark cuts each task's rows before the exchange too."""
    by = Window.partitionBy(*of).orderBy(F.col("score").desc(), "found_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchor`` holds.

    A score is the inner product of the integers floor(scale * x); higher ones
    come first, equal ones by smaller vec_id. An anchor's positives are its first
    rows with its label and another vec_id. For each of them the result has the
    first rows with another label and low * positive_score <= 100 *
    negative_score <= high * positive_score.

    Rows without vec_id, label or vector, or with a null or non-finite
    component, take no part; vectors of different lengths have no score. A
    squared norm of 2^60, or an integer of 2^27 or more, stops the query. Rows
    that occur repeatedly count as often as they occur, but a repeated anchor
    (equal vec_id, label and vector) is one. An anchor without positives, or a
    positive without negatives, has no rows; neither has an empty table.
    """
    held = F.col(vector)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col(label).isNotNull() & finite(held)).select(
        F.col("vec_id").cast("long").alias("id"), F.col(label).cast("long").alias("label"), integers(held, scale).alias("vector"), anchor.alias("is_anchor")
    )
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    whole = F.when(square < TOO_LONG, F.col("vector")).otherwise(F.raise_error(F.lit("a squared norm is not below 2^60")))
    rows = rows.select("id", "label", whole.alias("vector"), F.size("vector").alias("dims"), "is_anchor")
    anchors = checkpointed(rows.where("is_anchor").drop("is_anchor").dropDuplicates(["id", "label", "vector"]).withColumn("key", F.xxhash64("label", "vector")))
    rows = rows.drop("is_anchor")
    near = _met(anchors.withColumn("grp", F.col("label")), rows.withColumn("grp", F.col("label")), _search(positives, low, high, True), "key")
    best = _first(near, positives, "anchor_id", "key")
    lists = best.groupBy("anchor_id", "key").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("found_id").alias("id"), "score"))).alias("positives"))
    lists = lists.select(F.col("anchor_id").alias("id"), "key", F.transform("positives", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("positives"))
    asking = stored(anchors.join(lists, ["id", "key"]).withColumn("grp", F.lit(0).cast("long")))
    far = _met(asking, rows.withColumn("grp", F.lit(0).cast("long")), _search(negatives, low, high, False), "key", "positives")
    return _first(far, negatives, "anchor_id", "key", "place").select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
