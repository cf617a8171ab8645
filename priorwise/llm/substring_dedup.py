"""Removal of repeated word windows by Rabin-Karp hashes.

Tasks hash every window of ``window`` words of their documents and deal them
out by ranges of a second hash as packed arrays. A task sends each hash once for
a run of documents, with the earliest window that has it; the run's other
windows with this hash are repeats already and travel straight to their
documents. So a window that a third of the documents share reaches its range
once for each run, not once for each document. Each range is sorted once: all
windows of a hash but the earliest are repeats. The answers travel back as
packed arrays of window starts and meet the documents, where windows merge into
maximal intervals of removed words.

Words are hashed to 64 bits that keep no structure of the word, and windows by
two polynomials of these. Two windows count as equal if one 64-bit hash and the
range's part of the other agree; for n windows in k ranges the expected number
of false matches is n * n / (k * 2**65). The number of ranges and of groups of
documents follows the bytes of text, so that neither grows with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from priorwise.llm.doc_keys import by_group, keyed, keys_of, ranks
from priorwise.llm.packed import pack, unpack
from priorwise.llm.text_blocks import NOT_SPACE, blocks, covered, poly_hashes, ragged, word_hashes, word_spans

SCHEMA = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string, kept string"
#: bytes of text whose windows a task gathers before it deals them out
RUN_BYTES = 8 << 20
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_U = np.uint64

_WINDOWS = {"counts": np.uint32, "starts": np.uint32, "hashes": np.uint64, "again": np.uint32, "again_starts": np.uint32}
_ANSWER = {"counts": np.uint32, "starts": np.uint32}


def _earliest(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each item has the least key of its hash."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    least = np.minimum.reduceat(keys[order], edge)
    out = np.empty(len(h), bool)
    out[order] = keys[order] == np.repeat(least, np.diff(np.append(edge, len(h))))
    return out


def _windows(window: int, ranges: int, dtype: np.dtype):
    def emit(run: list[tuple]) -> Iterator[pa.RecordBatch]:
        at, parts = 0, []
        for keys, doc, start, h, r in run:
            parts.append((keys, doc + at, start, h, r))
            at += len(keys)
        keys, doc, start, h, r = (np.concatenate(x) for x in zip(*parts))
        if not len(h):
            return
        place = ranks(keys)[doc] << 32 | start
        order = np.argsort(r, kind="stable")
        edges = np.searchsorted(r[order], np.arange(ranges + 1))
        first = np.empty(len(h), bool)
        for k in range(ranges):
            mine = order[edges[k] : edges[k + 1]]
            if len(mine):
                first[mine] = _earliest(h[mine], place[mine])
        # repeats within the run need no match: they are dealt evenly, by document
        part = np.where(first, r, (keys["id"][doc] % ranges).astype(np.int32))
        order = np.lexsort((start, doc, part))
        edges = np.searchsorted(part[order], np.arange(ranges + 1))
        for k in range(ranges):
            mine = order[edges[k] : edges[k + 1]]
            if not len(mine):
                continue
            new, old = mine[first[mine]], mine[~first[mine]]
            docs, counts = np.unique(doc[new], return_counts=True)
            extra, again = np.unique(doc[old], return_inverse=True)
            payload = pack(
                docs=keys[np.concatenate([docs, extra])],
                counts=counts.astype(np.uint32),
                starts=start[new].astype(np.uint32),
                hashes=h[new],
                again=(again + len(docs)).astype(np.uint32),
                again_starts=start[old].astype(np.uint32),
            )
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([payload], pa.binary())], ["part", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows, data, offsets in blocks(batches, "text"):
            starts, ends, first = word_spans(data, offsets, NOT_SPACE)
            codes = word_hashes(data, starts, ends)
            n = np.maximum(np.diff(first) - window + 1, 0)
            at = ragged(first[:-1], n)
            doc = np.repeat(np.arange(rows.num_rows), n)
            h = poly_hashes(codes, at, at + window, _BASES[0])
            part = (poly_hashes(codes, at, at + window, _BASES[1]) % _U(ranges)).astype(np.int32)
            held.append((keys_of(rows, dtype), doc, at - first[:-1][doc], h, part))
            size += len(data)
            if size >= RUN_BYTES:
                yield from emit(held)
                held, size = [], 0
        if held:
            yield from emit(held)

    return run


def _repeats(dtype: np.dtype):
    """Answers of each range of hashes, by groups of documents."""

    def solve(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, doc, start, h, again, again_starts = [], [], [], [], [], []
        at = 0
        for payload in payloads:
            x = unpack(payload, docs=dtype, **_WINDOWS)
            keys.append(x["docs"])
            doc.append(np.repeat(np.arange(len(x["counts"])), x["counts"]) + at)
            start.append(x["starts"].astype(np.int64))
            h.append(x["hashes"])
            again.append(x["again"].astype(np.int64) + at)
            again_starts.append(x["again_starts"].astype(np.int64))
            at += len(x["docs"])
        keys, doc, start, h = (np.concatenate(x) for x in (keys, doc, start, h))
        late = np.zeros(0, bool) if not len(h) else ~_earliest(h, ranks(keys)[doc] << 32 | start)
        doc = np.concatenate([doc[late], *again])
        start = np.concatenate([start[late], *again_starts])
        yield from by_group(keys[doc], start, {"starts": start.astype(np.uint32)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, payloads = None, []
        for batch in batches:
            for k, payload in zip(batch.column("part").to_pylist(), batch.column("payload")):
                if k != part and payloads:
                    yield from solve(payloads)
                    payloads = []
                part = k
                payloads.append(payload.as_py())
        if payloads:
            yield from solve(payloads)

    return run


def keep_words(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Kept words of each row joined by one space, as bytes with row offsets."""
    words = np.flatnonzero(kept)
    sizes = ends[words] - starts[words]
    rows = np.searchsorted(words, first, "left")
    last = np.zeros(len(words), bool)
    stop = rows[1:][np.diff(rows) > 0]
    last[stop - 1] = True
    room = sizes + ~last
    begin = np.cumsum(room) - room
    flat = np.full(int(room.sum()), 0x20, np.uint8)
    flat[ragged(begin, sizes)] = data[ragged(starts[words], sizes)]
    edge = np.append(begin, len(flat))
    return flat.tobytes(), edge[rows]


def _finish(window: int, with_text: bool, dtype: np.dtype):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        repeated: dict[tuple, list[np.ndarray]] = {}
        for payload in answers.column("payload"):
            x = unpack(payload.as_py(), docs=dtype, **_ANSWER)
            for key, s in zip(x["docs"].tolist(), np.split(x["starts"], np.cumsum(x["counts"].astype(np.int64))[:-1])):
                repeated.setdefault(key, []).append(s)
        out = []
        for rows, data, offsets in blocks(iter(docs.combine_chunks().to_batches()), "text"):
            starts, ends, first = word_spans(data, offsets, NOT_SPACE)
            found = [s.astype(np.int64) + first[k] for k, key in enumerate(keys_of(rows, dtype).tolist()) for s in repeated.get(key, ())]
            gone = covered(len(starts), np.concatenate(found) if found else np.zeros(0, np.int64), window)
            text, edge = keep_words(data, offsets, starts, ends, first, ~gone)
            total = np.concatenate([[0], np.cumsum(gone)])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            heads = first[:-1][np.diff(first) > 0]
            begins[heads] = gone[heads]
            runs = np.concatenate([[0], np.cumsum(begins)])
            pieces = [text[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            out.append(
                pa.table(
                    {
                        "doc_id": rows.column("doc_id").cast(pa.int64()),
                        "n_words": np.diff(first),
                        "n_removed": total[first[1:]] - total[first[:-1]],
                        "n_spans": runs[first[1:]] - runs[first[:-1]],
                        "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string()),
                        "kept": pa.array([p.decode("utf-8", "replace") if with_text else None for p in pieces], pa.string()),
                    }
                )
            )
        return pa.concat_tables(out)

    return run


def remove_repeats(docs: DataFrame, window: int = 20, with_text: bool = True) -> DataFrame:
    """``SCHEMA`` for every row of ``docs`` (doc_id, text), other columns not carried.

    A word goes if a window of ``window`` words covers it whose words also start
    earlier: in a smaller doc_id, or before it in the same document. Windows are
    judged on the input. ``n_spans`` counts the maximal removed runs, ``kept`` is
    the text that stays (null unless ``with_text``). A null text has no words. A
    null doc_id sorts before all others. Rows that repeat a doc_id and a text
    are one document and have equal results; rows with the same doc_id and
    different texts are ordered by hashes of the text (128 bits).
    """
    k = keyed(docs)
    dealt = k.source.mapInArrow(_windows(window, k.parts, k.dtype), "part int, payload binary")
    answers = dealt.repartition(k.parts, "part").sortWithinPartitions("part").mapInArrow(_repeats(k.dtype), "grp int, payload binary")
    return k.source.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_finish(window, with_text, k.dtype), SCHEMA)
