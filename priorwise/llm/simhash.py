"""SimHash fingerprints and their Hamming neighbours by the generalised pigeonhole principle.

If the 64 bits are split into m parts with thresholds t_i and the sum of
(t_i + 1) is at least r + 1, two fingerprints within r differing bits differ in
at most t_i bits in some part i. Bits are grouped into parts by correlation,
thresholds may be unequal (-1 leaves a part out), and dynamic programming picks
them by estimated cost: keys written and candidates compared. Fingerprints
that share a part's value up to t_i masked bits form a bucket; buckets are
compared block by block inside tasks, and only links that join two classes of a
block pair leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorwise.llm.components import components
from priorwise.llm.shared import checkpointed, in_small_batches, joined_by_spread_key, nested, small, unnested
from priorwise.llm.text_blocks import LOWER, NOT_SPACE, blocks, ragged, word_spans

SEED = 42
#: fingerprints of a bucket that are compared with one another at once
BUCKET_BLOCK = 2048
#: columns of documents whose others are nested
MARKED = ("row", "doc_id", "text")
_U = np.uint64


# ---------------------------------------------------------------- fingerprints


def shingle_fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """SimHash of each row: a bit is 1 if set in over half of the XXH64 of the row's shingles."""
    return majority(*shingle_hashes(data, offsets, shingle))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of all rows, and how many each row has."""
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    words = np.diff(first)
    # all words, one space after each
    sizes = ends - starts
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    flat = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    flat[ragged(begin, sizes)] = LOWER[data[ragged(starts, sizes)]]
    stop = begin + sizes
    n = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    at = ragged(first[:-1], n)
    last = np.minimum(at + np.repeat(np.minimum(words, shingle), n) - 1, len(starts) - 1)
    text, digest = flat.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(text[a:b], SEED) for a, b in zip(begin[at].tolist(), stop[last].tolist())), _U, len(at)), n


def majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of n 64-bit hashes."""
    out = np.zeros(len(n), _U)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    edge = np.cumsum(n[full]) - n[full]
    half = n[full].astype(np.int64)
    for bit in range(64):
        ones = np.add.reduceat(((h >> _U(bit)) & _U(1)).astype(np.int64), edge)
        out[full] |= (2 * ones > half).astype(_U) << _U(bit)
    return out


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, "text"):
            fp = shingle_fingerprints(data, offsets, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return run


def _fingerprint_column(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, "text"):
            fp = shingle_fingerprints(data, offsets, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in MARKED), pa.array(fp)], [*MARKED, "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (64 bits as a signed long) of every row; null or empty texts have 0."""
    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprint_batches(shingle), "doc_id long, fp long")


# ---------------------------------------------------------------- plan of the parts


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have both bits i and j set (64 x 64), over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64))
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(_U)
            for k in range(0, len(fp), 1 << 16):
                bits = np.unpackbits(fp[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
            n += len(fp)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([both.ravel().tolist()], pa.list_(pa.float64()))], ["n", "both"])

    parts = prints.select("fp").mapInArrow(count, "n long, both array<double>")
    cells = parts.select("n", F.posexplode("both").alias("k", "x")).groupBy("k").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    both = np.zeros(64 * 64)
    for row in cells:  # 4096 rows, whatever the corpus
        both[row.k] = row.x
    return (cells[0].n if cells else 0), both.reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of even width; each group collects the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left = set(range(64))
    widths = [64 // parts + (k < 64 % parts) for k in range(parts)]
    out = []
    for width in widths:
        seed = max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < width:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def estimate(n: int, both: np.ndarray, bits: list[int], threshold: int) -> float:
    """Estimated cost of a part: keys written, and pairs within ``threshold`` differing bits of it."""
    if threshold < 0:
        return 0.0
    if threshold > len(bits):
        return float("inf")
    p = np.diag(both)[bits] / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    # distribution of the number of differing bits of a random pair
    exact = np.zeros(threshold + 1)
    exact[0] = 1.0
    for a in agree:
        exact[1:] = exact[1:] * a + exact[:-1] * (1 - a)
        exact[0] *= a
    keys = comb(len(bits), threshold)
    # a pair at distance d of the part shares this many masked keys
    shared = sum(exact[d] * comb(len(bits) - d, threshold - d) for d in range(threshold + 1))
    return 40.0 * n * keys + n * (n - 1) / 2 * shared


def plan_parts(n: int, both: np.ndarray, radius: int, choices: tuple[int, ...] = (1, 2, 3, 4, 5, 6)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts with the least estimated cost; thresholds sum as the principle asks."""
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in choices:
        groups = group_bits(n, both, m)
        # table[s]: least cost of the parts so far whose (t + 1) sum to s
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (cost, chosen) in table.items():
                for t in range(-1, radius + 1 - s):
                    total = cost + estimate(n, both, bits, t)
                    if s + t + 1 not in step or total < step[s + t + 1][0]:
                        step[s + t + 1] = (total, [*chosen, t])
            table = step
        if radius + 1 in table and table[radius + 1][0] < best[0]:
            best = (table[radius + 1][0], [(g, t) for g, t in zip(groups, table[radius + 1][1]) if t >= 0])
    return best[1]


# ---------------------------------------------------------------- probing


def _key_batches(plan: list[tuple[list[int], int]]):
    """Keys of every fingerprint: for each part, its value under each mask of t bits, hashed with part and mask."""
    masks = []
    for part, (bits, t) in enumerate(plan):
        whole = sum(1 << b for b in bits)
        for k, off in enumerate(combinations(bits, t)):
            masks.append((whole & ~sum(1 << b for b in off), part << 32 | k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from priorwise.llm.text_blocks import mix

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(_U)
            for k in range(0, len(fp), 4096):
                some = fp[k : k + 4096]
                for mask, tag in masks:
                    key = mix((some & _U(mask)) ^ mix(np.array([tag], _U)))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(some.view(np.int64))], ["key", "fp"])

    return run


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a and b within ``radius`` differing bits."""
    found = [np.zeros((2, 0), np.int64)]
    step = max(1, (1 << 20) // max(len(b), 1))
    for k in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[k : k + step, None] ^ b[None, :]) <= radius)
        found.append(np.stack([i + k, j]))
    i, j = np.concatenate(found, axis=1)
    return i, j


def spanning_links(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Indices of pairs (i, j) that join n nodes as all of them do."""
    parent = list(range(n))
    kept = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[y] = x
            kept.append(k)
    return np.array(kept, np.int64)


def _compare(radius: int):
    """Links within runs of rows (key, block, other, side, fp) that are sorted by the first four."""

    def links(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        both = a if b is None else np.concatenate([a, b])
        i, j = near_pairs(a, a if b is None else b, radius)
        if b is None:
            i, j = i[i < j], j[i < j]
        else:
            j = j + len(a)
        keep = spanning_links(len(both), i, j)
        return both[i[keep]], both[j[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)], axis=1)
            rows = np.concatenate([*held, rows]) if held else rows
            new = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            cut = int(new[-1]) if len(new) else 0
            held = [rows[cut:]]
            if cut:
                yield from solve(rows[:cut])
        if held and len(held[0]):
            yield from solve(held[0])

    def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.concatenate([[0], np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1, [len(rows)]])
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if e - s < 2:
                continue
            fp = rows[s:e, 4].view(_U)
            split = int(np.searchsorted(rows[s:e, 3], 1))
            if rows[s, 1] == rows[s, 2]:
                out.append(links(fp, None))
            elif 0 < split < e - s:
                out.append(links(fp[:split], fp[split:]))
        if out:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def near_links(prints: DataFrame, radius: int = 3, block: int = BUCKET_BLOCK) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints within ``radius`` bits, directly or through others.

    ``prints`` holds distinct fingerprints in the column ``fp``. Buckets with
    more than ``block`` members are split by a hash of the fingerprint, and each
    pair of the splits is dealt as a task unit of its own.
    """
    n, both = bit_statistics(prints)
    if n < 2:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    plan = plan_parts(n, both, radius)
    keys = prints.select("fp").mapInArrow(_key_batches(plan), "key long, fp long")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = checkpointed(sizes)
    large = sizes.where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("splits"))
    small = sizes.where(F.col("n") <= block).select("key")
    zero = F.lit(0)
    plain = keys.join(small, "key", "left_semi").select("key", zero.alias("block"), zero.alias("other"), zero.alias("side"), "fp")
    mine = F.pmod(F.xxhash64("fp"), F.col("splits")).cast("int")
    dealt = (
        keys.join(large, "key")
        .select("key", "fp", mine.alias("mine"), F.explode(F.sequence(zero, F.col("splits") - 1)).alias("k"))
        .select("key", F.least("mine", "k").alias("block"), F.greatest("mine", "k").alias("other"), (F.col("mine") > F.col("k")).cast("int").alias("side"), "fp")
    )
    units = plain.unionByName(dealt)
    units = units.repartition("key", "block", "other").sortWithinPartitions("key", "block", "other", "side")
    return units.mapInArrow(_compare(radius), "a long, b long").distinct()


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """``fp, component_id, component, n_rows``: the smallest doc_id and fingerprint that links reach from each fingerprint, and how many rows have it."""
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows")))
    found = components(near_links(classes, radius), "a", "b").select(F.col("node").alias("fp"), "component")
    grouped = classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return grouped.join(smallest, "component").select("fp", "component_id", "component", "n_rows")


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id among the rows that links between
    fingerprints reach. Rows with equal fingerprints, also those of empty or
    null texts, are linked. Repeated rows stay; a null doc_id is never the
    smallest, and a group without any other has a null component.
    """
    prints = checkpointed(fingerprints(docs, shingle))
    classes = checkpointed(_classes(prints, radius).drop("component"))
    return joined_by_spread_key(prints, classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of each group of ``simhash_groups``, with the columns of ``docs``.

    It is the row with the smallest doc_id. Where doc_ids are null or occur
    more than once, the text's hash decides between rows with the same one, and
    rows with an id come before rows without.
    """
    prints = checkpointed(fingerprints(docs, shingle))
    return one_of_each(docs, prints, _classes(prints, radius), "fp", _fingerprint_column(shingle))


def one_of_each(docs: DataFrame, prints: DataFrame, classes: DataFrame, key: str, with_key) -> DataFrame:
    """One row of each component of ``classes`` (key, component_id, component).

    ``with_key`` adds the key, a long, to batches of the columns ``MARKED`` of ``docs``.
    """
    unclear = prints.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count() > 0
    if not unclear:
        first = small(checkpointed(classes.select(F.col("component_id").alias("doc_id")).distinct()))
        return docs.join(first, "doc_id", "left_semi").select(*docs.columns)
    rows = nested(docs, "doc_id", "text").select(*MARKED)
    marked = rows.mapInArrow(with_key, T.StructType([*rows.schema.fields, T.StructField(key, T.LongType())])).join(classes.select(key, "component"), key)
    # the least of each component in two steps, so that a large component is never one group of rows
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("h"), F.col(key).alias("key"))
    marked = marked.withColumn("at", order)
    least = marked.groupBy("component").agg(F.min("at").alias("least"))
    kept = marked.join(small(checkpointed(least)), "component").where(F.col("at").eqNullSafe(F.col("least")))
    # rows with the same id and text are copies, any of which may stay
    one = kept.groupBy("component").agg(F.min_by(F.struct("row", "doc_id", "text"), F.lit(0)).alias("kept")).select("kept.*")
    return unnested(one, docs.columns, "doc_id", "text")
