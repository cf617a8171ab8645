"""Benchmark phrases in training documents, found by an FM-index for each shard of documents.

A task indexes shards of its documents. Words that no phrase holds become
separators, and runs between separators that are shorter than every phrase are
left out: no phrase can occur there, so the index covers every place where one
can. Phrases are searched backwards through wavelet ranks, occurrences located
through sampled suffix positions, and overlapping ones merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorwise.llm.fm_index import FMIndex
from priorwise.llm.shared import in_small_batches
from priorwise.llm.text_blocks import LOWER, WORD_BYTES, blocks, column_bytes, covered, ragged, word_hashes, word_spans

#: bytes of text that one index covers
SHARD_BYTES = 8 << 20
#: bytes of benchmark text that one pass holds in every task
PHRASE_BYTES = 16 << 20
_ADDED = ("n_words", "hit_starts", "hit_ends", "hit_items")


@dataclass
class Phrases:
    """Distinct windows of the items by length, in symbols of their words: sorted hashes ``known`` and a second hash of each."""

    known: np.ndarray
    second: np.ndarray
    groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # windows, offsets into the items, items
    least: int


def build_phrases(ids: list[int | None], texts: list[str | None], window: int) -> Phrases:
    """Windows of ``window`` words of each item; an item with fewer words is one window, one without words none."""
    data, offsets = column_bytes(pa.array(texts, pa.string()))
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, WORD_BYTES)
    codes = word_hashes(data, starts, ends)
    known, at = np.unique(codes, return_index=True)
    second = word_hashes(data, starts[at], ends[at], 1)
    symbols = np.searchsorted(known, codes) + 1
    by_length: dict[int, dict[tuple, set]] = {}
    for k, item in enumerate(ids):
        words = symbols[first[k] : first[k + 1]].tolist()
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).add(item)
    groups = []
    for windows in by_length.values():
        items = [sorted(x for x in s if x is not None) for s in windows.values()]
        counts = np.array([len(x) for x in items], np.int64)
        groups.append((np.array(list(windows), np.int64), np.append(0, np.cumsum(counts)), np.array([x for s in items for x in s], np.int64)))
    return Phrases(known, second, groups, min(by_length, default=window))


def _symbols(phrases: Phrases, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbol of each word, 0 where no phrase holds it: both of its hashes must agree."""
    out = np.zeros(len(starts), np.int64)
    if not len(starts) or not len(phrases.known):
        return out
    codes = word_hashes(data, starts, ends)
    at = np.minimum(np.searchsorted(phrases.known, codes), len(phrases.known) - 1)
    some = np.flatnonzero(phrases.known[at] == codes)
    some = some[word_hashes(data, starts[some], ends[some], 1) == phrases.second[at[some]]]
    out[some] = at[some] + 1
    return out


def _find(phrases: Phrases, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hit words, and (document, item) of all occurrences in a shard of words given by their symbols."""
    none = np.zeros(0, np.int64)
    hit = np.zeros(len(symbols), bool)
    if not len(symbols) or not len(phrases.known):
        return hit, none, none
    inside = symbols > 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = first[1:-1]
    edge = edge[(edge > 0) & (edge < len(symbols))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    run_start, run_end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = run_end - run_start >= phrases.least
    run_start, run_end = run_start[long], run_end[long]
    if not len(run_start):
        return hit, none, none
    sizes = run_end - run_start
    place = ragged(run_start, sizes + 1)  # the word after a run stands for its separator
    text = np.append(symbols, 0)[place]
    text[np.cumsum(sizes + 1) - 1] = 0
    index = FMIndex(text, len(phrases.known))
    docs, items = [none], [none]
    starts, lengths = [none], [none]
    for windows, offsets, owners in phrases.groups:
        low, high = index.search(windows)
        n = high - low
        found = np.repeat(np.arange(len(windows)), n)
        where = place[index.locate(ragged(low, n))]
        starts.append(where)
        lengths.append(np.full(len(where), windows.shape[1]))
        doc = np.searchsorted(first, where, "right") - 1
        pair = np.unique(np.stack([doc, found], axis=1), axis=0)
        count = (offsets[1:] - offsets[:-1])[pair[:, 1]]
        docs.append(np.repeat(pair[:, 0], count))
        items.append(owners[ragged(offsets[pair[:, 1]], count)])
    hit = covered(len(symbols), np.concatenate(starts), np.concatenate(lengths))
    return hit, np.concatenate(docs), np.concatenate(items)


def _lists(rows: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """List column with ``values`` of rising ``rows``."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _without(texts: pa.Array, data: np.ndarray, offsets: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts, whose bytes and offsets are given, without the spans of bytes."""
    gone = np.zeros(len(data), bool)
    gone[ragged(begins, ends - begins)] = True
    left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
    flat = data[~gone].tobytes()
    column = pa.array([flat[i:j].decode("utf-8", "replace") for i, j in zip(left[:-1].tolist(), left[1:].tolist())], pa.string())
    return pc.if_else(texts.is_valid(), column, pa.scalar(None, pa.string()))


def _scan(phrases: Phrases, kept: list[str], cut: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, "text", SHARD_BYTES):
            # words are found in smaller blocks of whole rows, the index covers all of them
            symbols, first, places = [], [np.zeros(1, np.int64)], []
            n = size_before = 0
            for _, part, at in blocks(iter([rows.select(["text"])]), "text"):
                part = LOWER[part]
                s, e, f = word_spans(part, at, WORD_BYTES)
                symbols.append(_symbols(phrases, part, s, e))
                first.append(f[1:] + n)
                n += len(s)
                if cut:
                    places.append((s + size_before, e + size_before))
                    size_before += len(part)
            first = np.concatenate(first)
            hit, docs, items = _find(phrases, np.concatenate(symbols) if symbols else np.zeros(0, np.int64), first)
            if "hit_starts" in rows.schema.names:  # what another part of the phrases has found
                begin, end = rows.column("hit_starts"), rows.column("hit_ends")
                base = np.repeat(first[:-1], pc.list_value_length(begin).to_numpy(zero_copy_only=False))
                a = begin.flatten().to_numpy(zero_copy_only=False) + base
                b = end.flatten().to_numpy(zero_copy_only=False) + base
                hit[ragged(a, b - a)] = True
                held = rows.column("hit_items")
                docs = np.concatenate([docs, np.repeat(np.arange(rows.num_rows), pc.list_value_length(held).to_numpy(zero_copy_only=False))])
                items = np.concatenate([items, held.flatten().to_numpy(zero_copy_only=False)])
            begins, ends = hit.copy(), hit.copy()
            begins[1:] &= ~hit[:-1]
            ends[:-1] &= ~hit[1:]
            full = np.diff(first) > 0
            heads, tails = first[:-1][full], first[1:][full] - 1
            begins[heads], ends[tails] = hit[heads], hit[tails]
            a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            doc = np.searchsorted(first, a, "right") - 1
            base = first[doc]
            pairs = np.unique(np.stack([docs, items], axis=1), axis=0)
            size = rows.num_rows
            columns = [rows.column(c) for c in kept]
            if cut:
                starts, stops = (np.concatenate(x) for x in zip(*places))
                columns[kept.index("text")] = _without(rows.column("text"), data, offsets, starts[a], stops[b - 1])
            yield pa.RecordBatch.from_arrays(
                columns
                + [
                    pa.array(np.diff(first), pa.int64()),
                    _lists(doc, a - base, size, pa.int32()),
                    _lists(doc, b - base, size, pa.int32()),
                    _lists(pairs[:, 0], pairs[:, 1], size, pa.int64()),
                ],
                [*kept, *_ADDED],
            )

    return run


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, phrase_bytes: int = PHRASE_BYTES, cut: bool = False) -> DataFrame:
    """``docs`` with ``n_words, hit_starts, hit_ends, hit_items``.

    Words are runs of digits, letters a-z and characters above U+007F, with A-Z
    lower-cased. ``hit_starts`` and ``hit_ends`` (exclusive) are the maximal runs
    of words inside occurrences of benchmark windows, ``hit_items`` the sorted
    distinct item_ids with windows that occur. Columns of ``docs`` with these
    names are replaced, all others kept. Null texts have no words; an item
    without id counts for hits but is not listed; repeated items count once.
    A benchmark beyond ``phrase_bytes`` is searched in several parts, one after
    another within the same tasks. With ``cut`` each run of hit words, and what
    stands between them, is cut from ``text``, in the pass that ends the search.
    """
    kept = [c for c in docs.columns if c not in _ADDED]
    docs = in_small_batches(docs).select(*kept)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // phrase_bytes))
    added = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("hit_starts", T.ArrayType(T.IntegerType())),
            T.StructField("hit_ends", T.ArrayType(T.IntegerType())),
            T.StructField("hit_items", T.ArrayType(T.LongType())),
        ]
    )
    schema = T.StructType(docs.schema.fields + added.fields)
    for k in range(parts):
        some = items if parts == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k)
        rows = some.collect()  # bounded by phrase_bytes
        docs = docs.mapInArrow(_scan(build_phrases([r.item_id for r in rows], [r.text for r in rows], window), kept, cut and k == parts - 1), schema)
    return docs


def hit_words(starts: str = "hit_starts", ends: str = "hit_ends"):
    """Number of hit words, as a column."""
    spans = F.zip_with(ends, starts, lambda b, a: b - a)
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x)
