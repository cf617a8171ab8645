"""Packing token streams into fixed windows by order-preserving dynamic programming.

The documents of a partition form one stream of token ids in their order. Cuts
may fall on document ends, sentence ends and, at a coarser spacing, word ends
within a sentence; a cut has a penalty in tokens (none, ``sentence_cost``,
``word_cost``), a window costs its padding. With cut positions x and dp[j] the
least cost of a stream that ends at cut j,

    dp[j] = penalty[j] + size - x[j] + min(dp[i] + x[i])   over x[j] - x[i] <= size

whose minimum a monotone queue yields in constant time. Blocks of the stream
are solved one after another; what follows the last chosen cut is carried over.
The rest of a partition is cut into powers of two, which need no padding.
Nothing is shuffled: partitions are packed on their own.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from priorwise.llm.text_blocks import blocks, ragged

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])
#: bytes of text that are cut at once
PACK_BYTES = 2 << 20
#: words whose ids a worker keeps between tasks, at about 200 bytes each
CACHED_WORDS = 1_000_000
_SENTENCE_ENDS = (".", "!", "?")
#: marks that can be a word piece of their own after letters; the apostrophe, which begins contractions, is not
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class PackRule:
    """Window size, penalties in tokens, and the spacing in tokens of cuts within sentences."""

    size: int = 2048
    sentence_cost: int = 1
    word_cost: int = 3
    word_spacing: int = 8


def best_cuts(x: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Positions of the cheapest cuts; ``x`` rises from 0 in steps of at most ``size``.

    With least[j] = dp[j] + x[j], least[j] is penalty[j] + size + the minimum of
    least over the cuts within ``size`` before j. The monotone queue of that
    minimum advances a stretch of ``size`` at a time: as a stretch begins, the
    queue is the suffix minima of the stretch before, whose head moves on with j.
    A new cut enters its tail, and as it exceeds the head by ``size`` or more,
    only the running minimum of what entered can come to the head before the
    stretch ends. The last cut lies less than ``size`` before the end of the
    stream; of equal costs the later cut wins.
    """
    n, end = len(x), int(x[-1])
    top = np.iinfo(np.int64).max // 2
    least = np.zeros(n, np.int64)
    cost = penalty + size
    edges = np.searchsorted(x, np.arange(0, end + size, size), "right").tolist()
    begin, queue = 0, np.array([0, top], np.int64)
    for start, stop in zip(edges, edges[1:]):
        if start == stop:
            begin, queue = start, np.array([top], np.int64)
            continue
        own = cost[start:stop]
        head = queue[np.searchsorted(x[begin:start], x[start:stop] - size)]
        entered = np.minimum.accumulate(own + head)
        least[start] = own[0] + head[0]
        least[start + 1 : stop] = own[1:] + np.minimum(head[1:], entered[:-1])
        begin = start
        queue = np.append(np.minimum.accumulate(least[start:stop][::-1])[::-1], top)

    def last_least(values: np.ndarray) -> int:
        return len(values) - 1 - int(np.argmin(values[::-1]))

    low = max(int(np.searchsorted(x, end - size, "right")), 1)
    if low == 1 and end < size:
        return []
    best = low + last_least((least - x)[low:])
    chosen = []
    while best:
        chosen.append(int(x[best]))
        low = int(np.searchsorted(x, x[best] - size))
        best = low + last_least(least[low:best])
    return chosen[::-1]


class _Slots(dict):
    def __missing__(self, word: str) -> int:
        return -1


class WordTokenizer:
    """Token ids of texts through a table of words.

    Only for tokenizers that drop white space and never join characters across
    it, so that words between spaces can be encoded one by one. Words of a block
    are numbered by Arrow; only its distinct words are looked up, and ids are
    gathered from one flat array.
    """

    def __init__(self, path: str, most_words: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_words = most_words
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        #: ids that close a sentence
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for token, i in vocabulary.items() if token.removesuffix(suffix or "").endswith(_SENTENCE_ENDS)]] = True
        self.piece_ends = None
        if suffix:
            self.piece_ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.piece_ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        #: whether a tail of marks is encoded by itself after letters
        self.tails: dict[str, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.slots = _Slots()
        # slot 0 is the id that closes a text
        self.ids, self.first, self.size = np.array([1], "<u4"), np.zeros(1, np.int64), np.ones(1, np.int64)

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.first)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, ids.astype("<u4", copy=False)])
        self.slots.update(zip(words, range(at, at + len(words))))

    def _slots(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))

    def _of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.size[slots]
        return self.ids[ragged(self.first[slots], sizes)], sizes

    def look_up(self, words: pa.Array) -> np.ndarray:
        """Slot of each of the distinct words; where the table is full only these words stay in it."""
        listed = words.to_pylist()
        slots = self._slots(listed)
        new = np.flatnonzero(slots < 0)
        if not len(new):
            return slots
        before = len(self.slots)
        if before + len(new) > self.most_words and before:
            known = np.flatnonzero(slots >= 0)
            ids, sizes = self._of(slots[known])
            self._forget()
            self._add([listed[k] for k in known.tolist()], ids, sizes)
        self.learn(words.take(pa.array(new)))
        if len(self.slots) < before + len(new):  # the table was full
            return self._slots(listed)
        slots[new] = self._slots([listed[k] for k in new.tolist()])
        return slots

    def learn(self, new: pa.Array) -> None:
        """Add words: letters alone, letters with a tail of marks (two pieces), and others."""
        stems = pc.utf8_rtrim(new, _MARKS)
        letters = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False)
        whole = pc.equal(stems, new).to_numpy(zero_copy_only=False)
        rest = new.filter(pa.array(~letters)).to_pylist()
        if self.piece_ends is None:
            self._encode(new.to_pylist())
            return
        plain = new.filter(pa.array(letters & whole)).to_pylist()
        both, parts = (x.filter(pa.array(letters & ~whole)).to_pylist() for x in (new, stems))
        # A-Z and a-z are alike to a tokenizer that says so; other letters are left as they are
        lowered = [w.lower() if w.isascii() and self.tokenizer_lowers else w for w in plain + parts]
        unknown = [w for w in dict.fromkeys(lowered) if w not in self.slots]
        rest += self._joined(unknown)
        tails = [w[len(s) :] for w, s in zip(both, parts)]
        for tail in set(tails) - self.tails.keys():
            apart = all(self._plain(s + tail) == self._plain(s) + self._plain(tail) for s in ("a", "Zz", "\u00e9\u00df"))
            self.tails[tail] = apart
            if apart and tail not in self.slots:
                rest.append(tail)
        rest += [w for w, t in zip(both, tails) if not self.tails[t]]
        self._encode(list(dict.fromkeys(w for w in rest if w not in self.slots)))
        # words that are others in lower case, or two known pieces
        alias = [(w, s) for w, s in zip(plain, lowered) if w not in self.slots]
        ids, sizes = self._of(self._slots([s for _, s in alias]))
        self._add([w for w, _ in alias], ids, sizes)
        two = [(w, s, t) for w, s, t in zip(both, lowered[len(plain) :], tails) if w not in self.slots]
        pairs = np.stack([self._slots([s for _, s, _ in two]), self._slots([t for *_, t in two])], axis=1).ravel()
        ids, sizes = self._of(pairs)
        self._add([w for w, *_ in two], ids, sizes.reshape(-1, 2).sum(axis=1))

    @cached_property
    def tokenizer_lowers(self) -> bool:
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return all(self._plain(w) == self._plain(w.lower()) for w in (*letters, letters, letters[::-1], letters.title()))

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._add(part, np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum())), sizes)

    def _joined(self, words: list[str]) -> list[str]:
        """Learn words of letters, many in one text; returns those still to learn.

        The last id of a piece marks its end. A text with more pieces than words
        (letters that normalise to something else) is left.
        """
        left = []
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.piece_ends[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                left += part
                continue
            self._add(part, ids, np.diff(stops, prepend=0))
        return left

    def stream(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by id 1; ends of words, whether a sentence ends there, ends of texts."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        slots = self.look_up(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        last = np.cumsum(counts + 1) - 1
        all_slots = np.zeros(len(slots) + len(counts), np.int64)
        is_word = np.ones(len(all_slots), bool)
        is_word[last] = False
        all_slots[is_word] = slots
        sizes = self.size[all_slots]
        ends = np.cumsum(sizes)
        ids = self.ids[ragged(self.first[all_slots], sizes)]
        closes = self.closing[ids[np.maximum(ends - 1, 0)]]
        return ids, ends, closes, ends[last]


_TOKENIZERS: dict[tuple[str, int], WordTokenizer] = {}


def _tokenizer(path: str, most_words: int) -> WordTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, most_words) not in _TOKENIZERS:
        _TOKENIZERS[path, most_words] = WordTokenizer(path, most_words)
    return _TOKENIZERS[path, most_words]


def _cut_points(ends: np.ndarray, closes: np.ndarray, text_ends: np.ndarray, total: int, rule: PackRule) -> tuple[np.ndarray, np.ndarray]:
    """Candidate cuts and their penalties, 0 first and the stream's end last."""
    cost = np.full(total + 1, -1, dtype=np.int16)
    cost[:: rule.size // 2] = rule.size // 4  # a last resort within very long words
    words = ends[np.flatnonzero(np.diff(ends // rule.word_spacing, prepend=-1))]
    cost[words] = rule.word_cost
    cost[ends[closes]] = rule.sentence_cost
    cost[text_ends] = 0
    cost[0] = cost[total] = 0
    x = np.flatnonzero(cost >= 0)
    return x, cost[x].astype(np.int64)


class _Pieces:
    """Pieces of the stream, numbered by sequence."""

    def __init__(self, first_sequence: int) -> None:
        self.sequence = first_sequence
        self.rows: list[tuple] = []

    def cut(self, ids: np.ndarray, cuts: list[int], docs: list, bounds: np.ndarray) -> None:
        """One sequence between each two cuts; ``docs`` lie between ``bounds`` of the stream."""
        begin, d = 0, 0
        for end in cuts:
            at = begin
            while at < end:
                while bounds[d + 1] <= at:
                    d += 1
                stop = min(end, int(bounds[d + 1]))
                doc_id, skipped, tokens = docs[d]
                self.rows.append((doc_id, at - int(bounds[d]) + skipped, stop - at, zlib.crc32(ids[at:stop].tobytes()), tokens, self.sequence, at - begin))
                at = stop
            self.sequence += 1
            begin = end

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(_FIELDS)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_FIELDS)


def _powers_of_two(n: int) -> list[int]:
    at, out = 0, []
    for bit in range(n.bit_length() - 1, -1, -1):
        if n >> bit & 1:
            at += 1 << bit
            out.append(at)
    return out


def _packer(path: str, rule: PackRule, most_words: int = CACHED_WORDS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, most_words)
        pieces = _Pieces(TaskContext.get().partitionId() << 33)
        ids, docs, bounds = np.zeros(0, "<u4"), [], np.zeros(1, np.int64)
        for rows, _, _ in blocks(batches, "text", PACK_BYTES):
            new, ends, closes, text_ends = tokenizer.stream(rows.column("text"))
            held = len(ids)
            ids = np.concatenate([ids, new])
            sizes = np.diff(text_ends, prepend=0)
            docs += [(d, 0, int(n)) for d, n in zip(rows.column("doc_id").to_pylist(), sizes)]
            bounds = np.concatenate([bounds, text_ends + held])
            x, penalty = _cut_points(ends + held, closes, bounds[1:], len(ids), rule)
            cuts = best_cuts(x, penalty, rule.size)
            if cuts:
                pieces.cut(ids, cuts, docs, bounds)
                last = cuts[-1]
                d = int(np.searchsorted(bounds, last, "right")) - 1
                ids, docs, start = ids[last:], docs[d:], int(bounds[d])
                if docs:
                    docs[0] = (docs[0][0], docs[0][1] + last - start, docs[0][2])
                bounds = np.concatenate([[0], bounds[d + 1 :] - last]).astype(np.int64)
            if len(pieces.rows) > 5000:
                yield pieces.take()
        whole = list(range(rule.size, len(ids) + 1, rule.size))
        held = whole[-1] if whole else 0
        pieces.cut(ids, whole + [held + p for p in _powers_of_two(len(ids) - held)], docs, bounds)
        if pieces.rows:
            yield pieces.take()

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, rule: PackRule = PackRule(), most_words: int = CACHED_WORDS) -> DataFrame:
    """One row for each piece of a document in a sequence (see ``SCHEMA``).

    ``docs`` needs ``doc_id`` and ``text``; other columns are not carried. A null
    or empty text is the closing id alone. Repeated rows are packed as often as
    they occur; a null doc_id stays null. ``most_words`` bounds the cache of
    word ids in each worker and changes no result. Sequences are numbered upwards within
    each partition and no two partitions share a number.
    """
    return docs.select("doc_id", "text").mapInArrow(_packer(tokenizer_path, rule, most_words), SCHEMA)
