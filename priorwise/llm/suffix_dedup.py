"""Removal of repeated byte strings by a distributed merge of sorted suffix runs.

Only suffixes that matter are sorted. Of the ``gram``-byte strings in a window
of ``length`` bytes, the one with the least hash is the window's anchor; equal
windows have equal anchors at equal offsets. (1) Tasks deal out the hashes of
their anchors, and anchors that occur once drop out: no window of theirs can
repeat. (2) For the others, tasks sort the suffixes at the anchors, front-code
the sorted runs (shared prefix with the suffix before, and the rest) and
exchange them by anchor. (3) A loser tree merges the runs; it knows how many
bytes each contender shares with the last winner and never compares those
again, and the merge yields the common prefix of neighbours. The texts before
the anchors are sorted the same way, read backwards. A window that starts
``a`` bytes before its anchor repeats if another anchor shares ``a`` bytes
before and ``length - a`` bytes after it: both are classes of neighbours in the
two orders. (4) Repeated starts travel back to the documents and merge into
maximal removed runs.

Equal surroundings of an anchor within a group of documents travel once, with
the places that have them. The numbers of parts and of groups follow the bytes
of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from priorwise.llm.doc_keys import by_group, keyed, keys_of
from priorwise.llm.packed import pack, unpack
from priorwise.llm.text_blocks import BYTE_CODES, blocks, poly_hashes, ragged

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
RUN_BYTES = 8 << 20
_PIECE = 1 << 21
_BASE = 0x8CB92BA72F3D8DD7
_U = np.uint64

_ANCHORS = {"hashes": np.uint64, "doc": np.uint32, "pos": np.uint32, "low": np.uint16, "high": np.uint16, "known": np.uint8}
_PLACES = {"counts": np.uint32, "pos": np.uint32, "low": np.uint16, "high": np.uint16, "hashes": np.uint64}
_RUNS = {
    "doc": np.uint32, "pos": np.uint32, "copies": np.uint32, "low": np.uint16, "high": np.uint16, "shared": np.uint16, "rest": np.uint16,
    "text": np.uint8, "back_order": np.uint32, "back_shared": np.uint16, "back_rest": np.uint16, "back": np.uint8,
}
_STARTS = {"counts": np.uint32, "first": np.uint32, "more": np.uint16}


# ---------------------------------------------------------------- anchors


def _window_minima(key: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, from minima of fixed blocks forwards and backwards."""
    n = len(key)
    size = -(-n // width) * width
    full = np.full(size, np.iinfo(np.uint64).max, _U)
    full[:n] = key
    grid = full.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - width + 1
    return np.minimum(behind[:last], ahead[width - 1 : width - 1 + last])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of the rows: hash, position in ``data``, first and last window start."""
    out: list[tuple[np.ndarray, ...]] = []
    n = len(data)
    for at in range(0, max(n - length + 1, 0), _PIECE):
        piece = data[at : at + _PIECE + length - 1]
        grams = np.arange(len(piece) - gram + 1)
        h = poly_hashes(BYTE_CODES[piece], grams, grams + gram, _BASE)
        # position breaks ties to the left; it lies below 2**24
        best = _window_minima(h & ~_U(0xFFFFFF) | grams.astype(_U), length - gram + 1) & _U(0xFFFFFF)
        best = best.astype(np.int64)
        start = np.arange(len(best)) + at
        doc = np.searchsorted(offsets, start, "right") - 1
        inside = start + length <= offsets[doc + 1]
        start, best, doc = start[inside], best[inside], doc[inside]
        if not len(start):
            continue
        new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])]))
        last = np.append(new[1:], len(start)) - 1
        out.append((h[best[new]], best[new] + at, start[new], start[last]))
    if not out:
        none = np.zeros(0, np.int64)
        return none.astype(_U), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def _deal_anchors(length: int, gram: int, ranges: int, dtype: np.dtype):
    def emit(run: list[tuple]) -> Iterator[pa.RecordBatch]:
        at, parts = 0, []
        for keys, doc, *rest in run:
            parts.append((keys, doc + at, *rest))
            at += len(keys)
        keys, doc, h, pos, low, high = (np.concatenate(x) for x in zip(*parts))
        if not len(h):
            return
        _, first, back, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        lead = np.zeros(len(h), bool)
        lead[first] = True
        known = counts[back] > 1
        # one anchor of each hash is matched with other runs, its copies only travel on
        part = np.where(lead, (h % _U(ranges)).astype(np.int64), keys["id"][doc] % ranges)
        order = np.lexsort((pos, doc, ~lead, part))
        edges = np.searchsorted(part[order], np.arange(ranges + 1))
        for k in range(ranges):
            mine = order[edges[k] : edges[k + 1]]
            if not len(mine):
                continue
            docs, which = np.unique(doc[mine], return_inverse=True)
            # copies of a known anchor carry no match of their own
            state = np.where(lead[mine], known[mine], 2).astype(np.uint8)
            payload = pack(docs=keys[docs], hashes=h[mine], doc=which.astype(np.uint32), pos=pos[mine].astype(np.uint32), low=low[mine].astype(np.uint16), high=high[mine].astype(np.uint16), known=state)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([payload], pa.binary())], ["part", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows, data, offsets in blocks(batches, "text"):
            h, pos, first, last = anchors(data, offsets, length, gram)
            doc = np.searchsorted(offsets, pos, "right") - 1
            held.append((keys_of(rows, dtype), doc, h, pos - offsets[doc], pos - last, pos - first))
            size += len(data)
            if size >= RUN_BYTES:
                yield from emit(held)
                held, size = [], 0
        if held:
            yield from emit(held)

    return run


def _by_part(solve):
    """Apply ``solve`` to the payloads of each part in turn; rows are sorted by part."""

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


def _repeated_anchors(dtype: np.dtype):
    def solve(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        found = []
        for payload in payloads:
            x = unpack(payload, docs=dtype, **_ANCHORS)
            found.append((x["docs"][x["doc"]], x["hashes"], x["pos"], x["low"], x["high"], x["known"]))
        keys, h, pos, low, high, state = (np.concatenate(x) for x in zip(*found))
        match = np.flatnonzero(state < 2)
        _, back, counts = np.unique(h[match], return_inverse=True, return_counts=True)
        repeated = state > 0
        repeated[match] |= counts[back] > 1
        k = np.flatnonzero(repeated)
        yield from by_group(keys[k], pos[k], {"pos": pos[k], "low": low[k], "high": high[k], "hashes": h[k]})

    return _by_part(solve)


# ---------------------------------------------------------------- suffix runs


def common_prefix(a: bytes, b: bytes, skip: int = 0) -> int:
    """Length of the common prefix of two strings that share ``skip`` bytes."""
    n = min(len(a), len(b))
    x, y = a[skip:n], b[skip:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


def front_code(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes that each text shares with the one before, number of the others, and those."""
    shared = [0] * len(texts)
    for k in range(1, len(texts)):
        shared[k] = common_prefix(texts[k - 1], texts[k])
    rest = [t[s:] for t, s in zip(texts, shared)]
    return np.array(shared, np.uint16), np.array([len(r) for r in rest], np.uint16), np.frombuffer(b"".join(rest), np.uint8)


def front_decode(shared: list[int], rest: list[int], text: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for s, r in zip(shared, rest):
        before = before[:s] + text[at : at + r]
        at += r
        out.append(before)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Order (run, index) of the texts of sorted runs, and the prefix that each shares with the one before.

    ``runs`` are texts with the prefix that each shares with its predecessor. A
    loser tree holds for each run the length that its next text shares with
    the last winner. Of two contenders the one that shares more is smaller;
    only if both share equally much are further bytes compared, and the loser
    then remembers what it shares with the new winner.
    """
    k = len(runs)
    at = [0] * k
    shares = [0 if run[0] else -1 for run in runs]  # -1: the run is over
    heads = [run[0][0] if run[0] else b"" for run in runs]
    size = 1 << max(k - 1, 0).bit_length()
    losers = [-1] * size

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser."""
        if i < 0:
            return j, i
        if j < 0:
            return i, j
        a, b = shares[i], shares[j]
        if a != b:
            return (i, j) if a > b else (j, i)
        if a < 0:
            return i, j
        x, y = heads[i], heads[j]
        both = common_prefix(x, y, a)
        if x[both : both + 1] <= y[both : both + 1]:
            shares[j] = both
            return i, j
        shares[i] = both
        return j, i

    def first(node: int) -> int:
        if node >= size:
            return node - size if node - size < k else -1
        winner, losers[node] = play(first(2 * node), first(2 * node + 1))
        return winner

    order: list[tuple[int, int]] = []
    prefix: list[int] = []
    winner = first(1) if size > 1 else 0
    while k and shares[winner] >= 0:
        order.append((winner, at[winner]))
        prefix.append(shares[winner])
        at[winner] += 1
        texts, own = runs[winner]
        if at[winner] < len(texts):
            heads[winner], shares[winner] = texts[at[winner]], own[at[winner]]
        else:
            shares[winner] = -1
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
    return order, prefix


def _suffix_runs(length: int, ranges: int, dtype: np.dtype):
    """Sorted, front-coded runs of the suffixes at repeated anchors, and of the texts before them, dealt by anchor hash."""

    def coded(part: int, around: dict[tuple, list[tuple]]) -> bytes:
        # surroundings (after, before backwards, low, high) in the order of the texts after the anchors, with their places
        rows = sorted(around)
        places = [p for r in rows for p in around[r]]
        keys = list(dict.fromkeys(p[0] for p in places))
        number = {key: k for k, key in enumerate(keys)}
        shared, rest, text = front_code([r[0] for r in rows])
        back_order = sorted(range(len(rows)), key=lambda k: rows[k][1])
        back_shared, back_rest, back = front_code([rows[k][1] for k in back_order])
        return pack(
            docs=np.array(keys, dtype), doc=np.array([number[p[0]] for p in places], np.uint32), pos=np.array([p[1] for p in places], np.uint32),
            copies=np.array([len(around[r]) for r in rows], np.uint32), low=np.array([r[2] for r in rows], np.uint16), high=np.array([r[3] for r in rows], np.uint16),
            shared=shared, rest=rest, text=text, back_order=np.array(back_order, np.uint32), back_shared=back_shared, back_rest=back_rest, back=back,
        )

    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        found: dict[tuple, list[tuple]] = {}
        for payload in places.column("payload"):
            x = unpack(payload.as_py(), docs=dtype, **_PLACES)
            edge = [0, *np.cumsum(x["counts"].astype(np.int64)).tolist()]
            rows = list(zip(x["pos"].tolist(), x["low"].tolist(), x["high"].tolist(), (x["hashes"] % _U(ranges)).tolist()))
            for k, key in enumerate(x["docs"].tolist()):
                found.setdefault(key, []).extend(rows[edge[k] : edge[k + 1]])
        dealt: dict[int, dict[tuple, list[tuple]]] = {}
        for batch in docs.combine_chunks().to_batches():
            for key, value in zip(keys_of(batch, dtype).tolist(), batch.column("text")):
                text = value.as_py().encode("utf-8") if key in found and value.is_valid else b""
                for pos, low, high, part in set(found.get(key, ())) if text else ():
                    # a window may start up to ``high`` bytes before the anchor and ends ``length - low`` after it
                    around = (text[pos : pos + length - low], text[pos - high : pos][::-1], low, high)
                    dealt.setdefault(part, {}).setdefault(around, []).append((key, pos))
        return pa.table({"part": pa.array(list(dealt), pa.int32()), "payload": pa.array([coded(k, rows) for k, rows in dealt.items()], pa.binary())})

    return run


def repeated_runs(
    right: np.ndarray, right_prefix: np.ndarray, left: np.ndarray, left_prefix: np.ndarray, low: np.ndarray, high: np.ndarray, copied: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of offsets a (row, first, last) for which the window that starts a bytes before the row's anchor repeats.

    ``right`` and ``left`` are the orders of the texts after and, backwards,
    before the anchors; the prefixes are what each text shares with the one
    before it in its order. All windows of a ``copied`` row repeat.
    """
    n = len(low)
    after, before = np.empty(n, np.int64), np.empty(n, np.int64)
    open_, since = np.zeros(n, bool), np.zeros(n, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(int(high.max()) + 2 if n else 0):
        hit = copied & (low <= a) & (a <= high)
        active = np.flatnonzero((low <= a) & (a <= high))
        if len(active) > 1:
            after[right] = np.cumsum(right_prefix < length - a)
            before[left] = np.cumsum(left_prefix < a)
            both = after[active] * (n + 1) + before[active]
            order = np.argsort(both, kind="stable")
            same = both[order][1:] == both[order][:-1]
            hit[active[order[1:][same]]] = True
            hit[active[order[:-1][same]]] = True
        ended = np.flatnonzero(open_ & ~hit)
        out.append((ended, since[ended], np.full(len(ended), a - 1)))
        since[hit & ~open_] = a
        open_ = hit
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def _merge(length: int, dtype: np.dtype):
    def solve(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        runs, backs, held = [], [], []
        for payload in payloads:
            x = unpack(payload, docs=dtype, **_RUNS)
            for into, kind in ((runs, ""), (backs, "back_")):
                shared = x[f"{kind}shared"].tolist()
                into.append((front_decode(shared, x[f"{kind}rest"].tolist(), x["back" if kind else "text"].tobytes()), shared))
            held.append((x["docs"][x["doc"]], x["pos"].astype(np.int64), x["copies"].astype(np.int64), x["low"], x["high"], x["back_order"]))
        base = np.cumsum([0, *(len(r[0]) for r in runs)])
        order, prefix = merge_runs(runs)
        right = np.array([base[r] + i for r, i in order], np.int64)
        back_orders = [h[-1] for h in held]
        order, left_prefix = merge_runs(backs)
        left = np.array([base[r] + back_orders[r][i] for r, i in order], np.int64)
        keys, pos, copies, low, high = (np.concatenate(x) for x in zip(*(h[:-1] for h in held)))
        row, first, last = repeated_runs(
            right, np.array(prefix, np.int64), left, np.array(left_prefix, np.int64), low.astype(np.int64), high.astype(np.int64), copies > 1, length
        )
        # every place of the row has its runs of offsets, which are runs of window starts
        place = ragged((np.cumsum(copies) - copies)[row], copies[row])
        first, last = np.repeat(first, copies[row]), np.repeat(last, copies[row])
        start = pos[place] - last
        yield from by_group(keys[place], start, {"first": start.astype(np.uint32), "more": (last - first).astype(np.uint16)})

    return _by_part(solve)


# ---------------------------------------------------------------- answers


def _finish(length: int, with_text: bool, dtype: np.dtype):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        repeated: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        for payload in answers.column("payload"):
            x = unpack(payload.as_py(), docs=dtype, **_STARTS)
            cut = np.cumsum(x["counts"].astype(np.int64))[:-1]
            for key, f, more in zip(x["docs"].tolist(), np.split(x["first"].astype(np.int64), cut), np.split(x["more"].astype(np.int64), cut)):
                repeated.setdefault(key, []).append((f, f + more + length))
        out = []
        for rows, data, offsets in blocks(iter(docs.combine_chunks().to_batches()), "text"):
            keys = keys_of(rows, dtype).tolist()
            spans = [(a + offsets[k], b + offsets[k]) for k, key in enumerate(keys) for a, b in repeated.get(key, ())]
            edge = np.zeros(len(data) + 1, np.int64)
            if spans:
                begins, ends = (np.concatenate(x) for x in zip(*spans))
                edge = np.bincount(begins, minlength=len(data) + 1) - np.bincount(ends, minlength=len(data) + 1)
            gone = np.cumsum(edge[: len(data)]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            heads = gone.copy()
            heads[1:] &= ~gone[:-1]
            at = offsets[:-1][np.diff(offsets) > 0]
            heads[at] = gone[at]
            runs = np.concatenate([[0], np.cumsum(heads)])
            left = data[~gone].tobytes()
            where = offsets - total[offsets]
            pieces = [left[a:b] for a, b in zip(where[:-1].tolist(), where[1:].tolist())]
            out.append(
                pa.table(
                    {
                        "doc_id": rows.column("doc_id").cast(pa.int64()),
                        "n_bytes": np.diff(offsets),
                        "n_removed": total[offsets[1:]] - total[offsets[:-1]],
                        "n_spans": runs[offsets[1:]] - runs[offsets[:-1]],
                        "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string()),
                        "kept": pa.array([p if with_text else None for p in pieces], pa.binary()),
                    }
                )
            )
        return pa.concat_tables(out)

    return run


def remove_repeated_strings(docs: DataFrame, length: int = 400, gram: int = 64, with_text: bool = True) -> DataFrame:
    """``SCHEMA`` for every row of ``docs`` (doc_id, text), other columns not carried.

    A byte of the UTF-8 text goes if a string of ``length`` bytes covers it that
    also starts anywhere else, in the same document or another; matches never
    cross documents and are judged on the input. ``n_spans`` counts the maximal
    removed runs, ``kept`` holds the remaining bytes (null unless
    ``with_text``). Null texts are empty. Repeated rows are copies of each
    other, so all of their strings of ``length`` bytes repeat. Doc_ids may be
    null or occur more than once.
    """
    k = keyed(docs)
    grouped = k.source.groupBy("grp")
    deal = lambda df, n: df.repartition(n, "part").sortWithinPartitions("part")
    rows, answer = "part int, payload binary", "grp int, payload binary"
    places = deal(k.source.mapInArrow(_deal_anchors(length, gram, k.parts, k.dtype), rows), k.parts).mapInArrow(_repeated_anchors(k.dtype), answer)
    ranges = 4 * k.parts
    runs = grouped.cogroup(places.groupBy("grp")).applyInArrow(_suffix_runs(length, ranges, k.dtype), rows)
    starts = deal(runs, k.parts).mapInArrow(_merge(length, k.dtype), answer)
    return grouped.cogroup(starts.groupBy("grp")).applyInArrow(_finish(length, with_text, k.dtype), SCHEMA)
