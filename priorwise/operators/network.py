"""Opponents that both sides of a pairing have met.

Entities are dealt to groups by ranges of their names, and the contests of two
groups are a cell. To it go the results of those entities of the two groups that
have a contest in it, packed, so a history is sent once for each group that the
entity meets, and not once for each contest. Cells are worked on side by side.

Only where pairs meet again and again is time cut into blocks, each with several
times as many contests as there are pairs. For each block and entity that is
active in it there is then a snapshot, the latest result against each opponent
before the block, in place of the histories that led to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorwise.operators.lineage import checkpointed
from priorwise.operators.sized import small

#: sides of contests that a block of time holds at least
BLOCK_SIDES = 40_000
#: and for each pair that meets
BLOCK_PAIRS = 4
#: results that a cell holds, about
CELL_ROWS = 1_000_000
#: rows that a task packs at once
DEAL_ROWS = 200_000
#: opponents of contests that a task looks up at once, and entries of its table of opponents
LOOKUPS = 250_000
TABLE = 1 << 20


def _blocks(ledger: DataFrame, rank: str, sides: int) -> DataFrame:
    """The block of each rank, so that a block has about ``sides`` rows; a rank is never split. Works on distinct ranks."""
    sizes = ledger.where(F.col(rank).isNotNull()).groupBy(F.col(rank).alias("__r")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__r")) - F.col("__n")
    return small(checkpointed(sizes.select("__r", F.floor(before / sides).cast("int").alias("__b"))))


def _snapshots(results: DataFrame, sides: DataFrame) -> DataFrame:
    """``block`` and the latest result before it of every entity active in it, against each opponent.

    An entity's active blocks are numbered; a result that is an entity's last
    against an opponent in its block holds from the next number to that of the
    block with the next such result.
    """
    active = sides.select("who", "__b").distinct()
    active = active.withColumn("i", F.row_number().over(Window.partitionBy("who").orderBy("__b")))
    ends = active.groupBy("who").agg(F.max("i").alias("end"))
    last = results.groupBy("who", "met", "__b").agg(F.max_by(F.struct("__r", "__c", "won", "weight"), F.struct("__r", "__c")).alias("s"))
    numbered = last.join(active, ["who", "__b"]).withColumn("until", F.lead("i").over(Window.partitionBy("who", "met").orderBy("i")))
    held = numbered.join(ends, "who").withColumn("until", F.coalesce("until", "end")).where("until > i")
    held = held.select("who", "met", "s", F.explode(F.sequence(F.col("i") + 1, F.col("until"))).alias("i"))
    return held.join(active, ["who", "i"]).select("__b", "who", "met", "s.*")


def _codes(*columns: pa.ChunkedArray) -> tuple[list[np.ndarray], int]:
    """Numbers for the values of columns of one type, equal ones for equal values."""
    coded = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks().dictionary_encode()
    flat, out, at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), [], 0
    for column in columns:
        out.append(flat[at : at + len(column)])
        at += len(column)
    return out, len(coded.dictionary)


class _Results:
    """Results (entity, opponent, step of time, tie), the latest of each step, of which those before a step are looked up."""

    def __init__(self, who: np.ndarray, met: np.ndarray, step: np.ndarray, tie: np.ndarray, n: int, steps: int) -> None:
        order = np.lexsort((tie, step, met, who))
        pair, step = who[order] * n + met[order], step[order]
        last = np.append((pair[1:] != pair[:-1]) | (step[1:] != step[:-1]), True)
        self.row, pair, step = order[last], pair[last], step[last]
        new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        self.steps, self.first, self.count = steps, new, np.diff(np.append(new, len(pair)))
        self.place = np.repeat(np.arange(len(new)), self.count) * steps + step
        self.who, self.met, self.since = pair[new] // n, pair[new] % n, step[new]
        self.start = np.searchsorted(self.who, np.arange(n + 1))
        # pairs of an entity in the order of their first results
        self.by_time = np.lexsort((self.since, self.who))
        self.times = self.who[self.by_time] * steps + self.since[self.by_time]

    def width(self, who: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Opponents met before each step."""
        return np.searchsorted(self.times, who * self.steps + now) - self.start[who]

    def latest(self, pair: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Row of the latest result of pairs that have met before each step."""
        at = self.first[pair]
        often = np.flatnonzero(self.count[pair] > 1)
        at[often] = np.searchsorted(self.place, pair[often] * self.steps + now[often]) - 1
        return self.row[at]


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of places whose sizes sum to about ``most``; one place at least."""
    ends = np.cumsum(sizes)
    s = 0
    while s < len(ends):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most, "right")))
        yield s, e
        s = e


def _common(held: _Results, x: np.ndarray, y: np.ndarray, now: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, row of x, row of y) of every opponent that x and y have both met before a step; places are sorted by x."""
    size = held.width(y, now)
    new = np.append(True, x[1:] != x[:-1])
    nth, entity = np.cumsum(new) - 1, x[new]
    edges = np.append(np.flatnonzero(new), len(x))
    rows = max(1, TABLE // n)
    table = np.full(rows * n, -1, np.int32)
    for k in range(0, len(entity), rows):
        own = entity[k : k + rows]
        width = held.start[own + 1] - held.start[own]
        line = np.repeat(np.arange(len(own)) * n, width)
        pair = np.arange(len(line)) + np.repeat(held.start[own] - np.cumsum(width) + width, width)
        table[line + held.met[pair]] = pair
        low, high = edges[k], edges[min(k + rows, len(entity))]
        for s, e in _runs(size[low:high], LOOKUPS):
            some = slice(low + s, low + e)
            width = size[some]
            at = np.repeat(np.arange(low + s, low + e), width)
            q = held.by_time[np.arange(len(at)) + np.repeat(held.start[y[some]] - np.cumsum(width) + width, width)]
            p = table[(nth[at] - k) * n + held.met[q]]
            keep = np.flatnonzero(p >= 0)
            mine = p[keep]
            keep = keep[(held.since[mine] < now[at[keep]]) & (held.met[mine] != x[at[keep]]) & (held.met[mine] != y[at[keep]])]
            at, p, q = at[keep], p[keep].astype(np.int64), q[keep]
            yield at, held.latest(p, now[at]), held.latest(q, now[at])
        table[line + held.met[pair]] = -1


def _advantages(cell: pa.Table, half_life: float, lost: float) -> pa.Table:
    """Advantage and number of common opponents of each ledger row of a cell that is a side there."""
    side = np.flatnonzero(cell.column("side").to_numpy())
    known = np.flatnonzero(pc.is_valid(cell.column("won")).to_numpy())
    names = [cell.column(c).take(pa.array(side)) for c in ("__c", "who")]
    (who, met), n = _codes(cell.column("who"), cell.column("met"))
    # of one rank the largest contest is the latest
    tie = pc.rank(cell.column("__c"), tiebreaker="dense").to_numpy().astype(np.int64)[known]
    ranks, step = np.unique(cell.column("__r").to_numpy(), return_inverse=True)
    won, weight = (cell.column(c).to_numpy()[known] for c in ("won", "weight"))
    del cell
    # both rows of a contest have one answer, with opposite signs
    a, b = who[side], met[side]
    pairs, code = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_inverse=True)
    once, row = np.unique(code * len(ranks) + step[side], return_inverse=True)
    code, now = once // len(ranks), once % len(ranks)
    low, high = pairs[code] // n, pairs[code] % n
    advantage, common = np.zeros(len(once)), np.zeros(len(once), np.int64)
    if len(known) and len(side):
        time = ranks[step[known]]
        held = _Results(who[known], met[known], step[known], tie, n, len(ranks))
        swap = held.width(low, now) < held.width(high, now)  # the side with fewer opponents is looked through
        x, y = np.where(swap, high, low), np.where(swap, low, high)
        order = np.argsort(x, kind="stable")
        x, y, now, sign = x[order], y[order], now[order], np.where(swap, -1.0, 1.0)[order]
        pull = weight * np.where(won > 0, 1.0, lost)
        at_rank = ranks[now]
        for at, p, q in _common(held, x, y, now, n):
            if not len(at):
                continue
            recent = (0.5 ** ((at_rank[at] - time[p]) / half_life) + 0.5 ** ((at_rank[at] - time[q]) / half_life)) / 2
            w = (pull[p] + pull[q]) / 2 * recent
            s, e = int(at[0]), int(at[-1]) + 1
            total, by = np.bincount(at - s, w * (won[p] - won[q]), e - s), np.bincount(at - s, w, e - s)
            common[order[s:e]] = np.bincount(at - s, minlength=e - s)
            advantage[order[s:e]] = np.divide(total * sign[s:e], by, out=np.zeros(e - s), where=by > 0)
    return pa.table([*names, pa.array(np.where(a <= b, 1.0, -1.0) * advantage[row] + 0.0), pa.array(common[row])], ["contest_id", "entity", "advantage", "n_common"])


# ---------------------------------------------------------------- cells

_PACKED = ("__c", "who", "met", "__r", "won", "weight")


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows of each cell from rows with the group of their entity, that of their opponent (null in snapshots) and all groups that the entity meets."""

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).sort_by([("__b", "ascending"), ("who", "ascending"), ("met", "ascending")]).combine_chunks()
        others = rows.column("others").combine_chunks()
        at = np.repeat(np.arange(rows.num_rows), pc.list_value_length(others).to_numpy(zero_copy_only=False))
        other = others.flatten().to_numpy()
        block, own, rival = (pc.fill_null(rows.column(c), -1).to_numpy() for c in ("__b", "g", "h"))
        side = other == rival[at]
        keep = np.flatnonzero(side | pc.is_valid(rows.column("won")).to_numpy()[at])
        at, other, side = at[keep], other[keep], side[keep]
        keys = np.stack([block[at], np.minimum(own[at], other), np.maximum(own[at], other)], axis=1)
        order = np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))
        keys, at, side = keys[order], at[order], side[order]
        edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]]).tolist()
        rows, payloads = rows.select(_PACKED), []
        for s, e in zip(edges, edges[1:]):
            some = rows.take(pa.array(at[s:e])).append_column("side", pa.array(side[s:e])).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(some)
            payloads.append(sink.getvalue().to_pybytes())
        first = keys[edges[:-1]].astype(np.int32)
        return pa.RecordBatch.from_arrays([*(pa.array(first[:, k]) for k in range(3)), pa.array(payloads, pa.binary())], ["b", "x", "y", "payload"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= DEAL_ROWS:
            yield emit(held)
            held, n = [], 0
    if held:
        yield emit(held)


def _by_cell(half_life: float, lost: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for *key, payload in zip(*(batch.column(c).to_pylist() for c in ("b", "x", "y")), batch.column("payload")):
                if held and key != cell:
                    yield from _advantages(pa.concat_tables(held), half_life, lost).to_batches()
                    held = []
                cell = key
                held.append(pa.ipc.open_stream(payload.as_buffer()).read_all())
        if held:
            yield from _advantages(pa.concat_tables(held), half_life, lost).to_batches()

    return run


def _cells(sides: DataFrame, state: DataFrame | None, n_groups: int) -> DataFrame:
    """Packed rows (b, x, y, payload) of the cells: sides (also results, where won is not null), and earlier results of ``state``."""
    names = sides.select(F.explode(F.array("who", "met")).alias("who")).distinct()
    groups = small(checkpointed(names.repartitionByRange(n_groups, "who").withColumn("g", F.spark_partition_id())))
    placed = sides.join(groups.select(F.col("who").alias("met"), F.col("g").alias("h")), "met")
    meets = placed.groupBy("__b", "who").agg(F.collect_set("h").alias("others")).join(groups, "who")
    meets = small(checkpointed(meets))
    columns = ["__b", *_PACKED, "h"]
    rows = placed.select(*columns)
    if state is not None:
        rows = rows.unionByName(state.withColumn("h", F.lit(None).cast("int")).select(*columns))
    return rows.join(meets, ["__b", "who"]).select("__b", *_PACKED, "g", "h", "others").mapInArrow(_deal, "b int, x int, y int, payload binary")


def common_opponents(
    ledger: DataFrame, rank: str = "event_rank", method_weight: Column | None = None, half_life: float = 50.0, lost_factor: float = 0.8, block_sides: int | None = None
) -> DataFrame:
    """For each contest and side: advantage over common opponents, and their number.

    ``ledger`` has contest_id, entity, opponent, won and the integer ``rank``. Of
    each side's results before the contest's rank the latest against each
    opponent counts (of one rank that of the largest contest_id). A common
    opponent adds the difference of the two results, weighted by the mean method
    weight (less if lost) and the mean recency 0.5 ** (ranks / half_life). A
    task holds one cell: the contests of two groups of entities, within a block
    of time of ``block_sides`` rows if there are more of them (by default several
    times the pairs that meet), and the results of these contests' entities. A
    row without rank, entity or opponent has no common opponents.
    """
    weight = method_weight if method_weight is not None else F.lit(1.0)
    rows = checkpointed(
        ledger.select(
            F.col("contest_id").alias("__c"), F.col("entity").alias("who"), F.col("opponent").alias("met"), F.col(rank).cast("long").alias("__r"), F.col("won").cast("double").alias("won"), weight.cast("double").alias("weight")
        )
    )
    whole = F.col("who").isNotNull() & F.col("met").isNotNull() & F.col("__r").isNotNull()
    sides = rows.where(whole)
    n, pairs = sides.agg(F.count("*"), F.approx_count_distinct(F.struct("who", "met"))).first()
    block = block_sides or max(BLOCK_SIDES, BLOCK_PAIRS * pairs)
    if n > block:
        sides = checkpointed(sides.join(_blocks(sides, "__r", block), "__r"))
        state, most = _snapshots(sides.where("won IS NOT NULL"), sides), block + pairs
    else:
        sides, state, most = sides.withColumn("__b", F.lit(0)), None, n
    n_groups = max(-(-2 * most // CELL_ROWS), 4 if most > BLOCK_SIDES else 1)
    parts = 4 * int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(rows.dtypes)
    schema = f"contest_id {kind['__c']}, entity {kind['who']}, advantage double, n_common long"
    work = _cells(sides, state, n_groups).repartition(parts, "b", "x", "y").sortWithinPartitions("b", "x", "y")
    found = work.mapInArrow(_by_cell(half_life, lost_factor), schema)
    odd = rows.where(~whole).select(F.col("__c").alias("contest_id"), F.col("who").alias("entity"), F.lit(0.0).alias("advantage"), F.lit(0).cast("long").alias("n_common"))
    return found.unionByName(odd)
