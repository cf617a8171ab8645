"""Dedup, decontamination and packing against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorwise.llm import decontamination, packing, simhash, substring_dedup, suffix_dedup
from priorwise.llm.components import components
from priorwise.llm.fm_index import FMIndex, WaveletMatrix, suffix_array

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unique(corpus):
    return corpus.where("doc_id is not null").dropDuplicates(["doc_id"])


def test_substring_dedup(spark, corpus):
    docs = unique(corpus)
    seen, want = set(), {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        w = SPACE.findall(r.text or "")
        gone = [False] * len(w)
        for i in range(len(w) - 7):
            k = tuple(w[i : i + 8])
            if k in seen:
                gone[i : i + 8] = [True] * 8
            seen.add(k)
        want[r.doc_id] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs, 8).collect()}
    assert got == want and any(x[1] for x in want.values())


def test_substring_dedup_repeated_ids(corpus):
    rows = substring_dedup.remove_repeats(corpus.withColumn("mark", F.lit("clash")), 8).collect()
    assert len(rows) == 16
    fives = [r for r in rows if r.doc_id == 5]
    assert len(fives) == 2 and fives[0] == fives[1] and fives[0].n_removed == 120
    null = next(r for r in rows if r.doc_id is None)
    assert null.n_removed == 0  # a null id comes first


def test_suffix_dedup(corpus):
    rows = corpus.collect()
    size = 100
    count = collections.Counter(b[i : i + size] for r in rows for b in [(r.text or "").encode()] for i in range(len(b) - size + 1))
    want = collections.Counter()
    for r in rows:
        b = (r.text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[(r.doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())] += 1
    out = suffix_dedup.remove_repeated_strings(corpus, size, 24).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == want


def test_loser_tree_merges_with_prefixes():
    r = random.Random(3)
    for k in (1, 2, 5, 8):
        runs, texts = [], []
        for _ in range(k):
            run = sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(0, 9))) for _ in range(r.randrange(0, 12)))
            runs.append((run, [0, *(suffix_dedup.common_prefix(a, b) for a, b in zip(run, run[1:]))][: len(run)]))
            texts += run
        order, prefix = suffix_dedup.merge_runs(runs)
        merged = [runs[i][0][j] for i, j in order]
        assert merged == sorted(texts)
        assert prefix == [0, *(suffix_dedup.common_prefix(a, b) for a, b in zip(merged, merged[1:]))][: len(merged)]


def test_front_coding_round_trip():
    texts = sorted([b"", b"abc", b"abcd", b"abd", b"abd"])
    shared, rest, text = suffix_dedup.front_code(texts)
    assert suffix_dedup.front_decode(shared.tolist(), rest.tolist(), text.tobytes()) == texts


def test_fm_index():
    r = np.random.default_rng(1)
    text = np.concatenate([np.append(r.integers(1, 4, n), 0) for n in (5, 40, 0, 200)])
    index = FMIndex(text, 3)
    for n in (1, 3, 6):
        patterns = np.unique(np.stack([r.integers(1, 4, 20) for _ in range(n)], 1), axis=0)
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
    order = suffix_array(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    w = WaveletMatrix(text, 2)
    assert (w.access(np.arange(len(text))) == text).all()


def test_decontamination(spark, corpus, words):
    items = [(1, " ".join(words(3, 30)).upper()), (2, "one"), (3, None), (4, ""), (None, "no id"), (5, " ".join(words(9, 30)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)

    def expect(t):
        w = WORD.findall((t or "").translate(LOW))
        hit, found = [0] * len(w), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = [1] * n
                    found |= windows[tuple(w[k : k + n])]
        return len(w), sum(hit), sorted(x for x in found if x is not None)

    docs = corpus.withColumn("n_words", F.lit("clash"))
    for size in (1 << 20, 200):  # in one part, and in several
        got = decontamination.find_benchmark(docs, bench, 10, size).withColumn("n_hit", decontamination.hit_words()).collect()
        assert len(got) == 16 and all((r.n_words, r.n_hit, r.hit_items) == expect(r.text) for r in got)
    clean = decontamination.find_benchmark(corpus, bench, cut=True).collect()
    assert all(r.text is None or expect(r.text)[1] == 0 or r.text for r in clean) and sum(r.text is None for r in clean) == 1


def fingerprint(text):
    import xxhash

    w = SPACE.findall((text or "").translate(LOW))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def test_simhash(corpus):
    rows = [(r.doc_id, fingerprint(r.text)) for r in corpus.collect()]
    got = collections.Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in simhash.simhash_groups(corpus).collect())
    assert got == collections.Counter(rows)
    kept = simhash.keep_first(corpus)
    assert kept.columns == corpus.columns and kept.where("doc_id = 2").count() == 1 and kept.where("doc_id = 5").count() == 0


@pytest.mark.parametrize("block", [4, 2048])
def test_near_links_connect_what_brute_force_connects(spark, block):
    r = random.Random(2)
    fps = set()
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(r.randrange(1, 9)):
            fps.add(x)
            for _ in range(r.randrange(1, 5)):
                x ^= 1 << r.randrange(64)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, block)
    got = {r.node: r.component for r in components(links, "a", "b").collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(signed):
        for y in signed[:i]:
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= 3:
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    assert all(got.get(x, x) == find(x) for x in signed)


def test_thresholds_satisfy_the_principle():
    r = np.random.default_rng(0)
    bits = np.unpackbits(r.integers(0, 256, (500, 8), dtype=np.uint8), axis=1).astype(float)
    for n in (500, 10**7):
        plan = simhash.plan_parts(n, bits.T @ bits * n / 500, 3)
        assert sum(t + 1 for _, t in plan) == 4 and len({b for g, _ in plan for b in g}) == sum(len(g) for g, _ in plan)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 50), (7, 7), (None, 3), (60, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[60] == got[50] == 50 and len(got) == 44


def test_packing(corpus):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    docs = unique(corpus)
    out = packing.pack_documents(docs, path).toPandas()
    for r in docs.collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in out[out.doc_id == r.doc_id].sort_values("start").itertuples():
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    sizes = out.groupby("sequence_id").length.sum()
    assert sizes.max() <= 2048 and packing.pack_documents(docs.limit(0), path).count() == 0


def test_cuts_are_the_cheapest():
    r = random.Random(4)
    for _ in range(50):
        x = [0]
        while len(x) < 12:
            x.append(x[-1] + r.randrange(1, 6))
        cost = [0] + [r.randrange(0, 4) for _ in x[1:]]
        size = 10
        best = [0.0] + [float("inf")] * 11
        for j in range(1, 12):
            best[j] = min(best[i] + cost[j] + size - (x[j] - x[i]) for i in range(j) if x[j] - x[i] <= size)
        cuts = packing.best_cuts(np.array(x), np.array(cost), size)
        ends = [0, *cuts]
        total = sum(cost[x.index(b)] + size - (b - a) for a, b in zip(ends, ends[1:]))
        low = min(best[j] for j in range(12) if x[-1] - x[j] < size)
        assert total == low


def test_empty_tables(spark, corpus):
    none = corpus.limit(0)
    assert substring_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeated_strings(none).count() == 0
    assert simhash.simhash_groups(none).count() == 0
    assert decontamination.find_benchmark(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
