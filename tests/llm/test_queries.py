"""The registered queries against brute force in plain Python over a small data set."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from priorwise.llm import queries, substring_dedup, suffix_dedup
from tests.llm.test_text_operators import SPACE, WORD, LOW, fingerprint


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, words):
    """Documents with copies, near copies, shared passages, long and odd texts, and vectors in groups."""
    path = str(tmp_path_factory.mktemp("data"))
    r = random.Random(11)
    pool = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 12))) for _ in range(2000)]
    text = lambda n: " ".join(r.choice(pool) for _ in range(n))
    passage, phrase = text(80), text(25)
    texts = [text(r.randrange(1, 200)) for _ in range(60)]
    texts += [texts[3]] * 5 + [texts[4] + " x", texts[4].upper()] + [text(20) + " " + passage + " " + text(20) for _ in range(12)]
    texts += [text(5) + " " + phrase.upper() + ", " + text(5), text(9000), None, "", " \n", "one", "one two", "é" * 500, "x " * 400]
    rows = [(k, t) for k, t in enumerate(texts)]
    r.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7, phrase), (12, "one"), (30, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    g = np.random.default_rng(3)
    centres = g.normal(size=(250, 24))
    vectors = [*centres, *(centres[k // 40] + g.normal(size=24) * 0.12 for k in range(200)), *(centres[100 + k] + g.normal(size=24) * 0.1 for k in range(60))]
    table = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)] + [(1000, None), (1001, [0.0] * 24)]
    spark.createDataFrame(table, "vec_id long, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    return path, dict(rows), vectors


def run(spark, folder, name, key="doc_id"):
    rows = queries.QUERIES[name](spark, folder[0]).collect()
    return {r[key]: r for r in rows}, rows


def test_op1(spark, folder):
    got, rows = run(spark, folder, "op1_substring_dedup")
    seen = set()
    assert len(rows) == len(folder[1])
    for k in sorted(folder[1]):
        w = SPACE.findall(folder[1][k] or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_op2(spark, folder):
    got, rows = run(spark, folder, "op2_embedding_dedup", "vec_id")
    unit = np.array(folder[2]) / np.linalg.norm(folder[2], axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    first = np.arange(len(unit))
    while True:
        new = np.array([first[row].min() for row in linked])
        if (new == first).all():
            break
        first = new
    missed = sum(linked[k].sum() - 1 - got[k].n_links for k in range(len(unit)))
    assert len(rows) == len(unit) + 2 and all(got[k].n_links <= linked[k].sum() - 1 for k in range(len(unit)))
    assert missed <= 0.02 * (linked.sum() - len(unit))
    assert sum(got[k].component_id == first[k] for k in range(len(unit))) >= 0.99 * len(unit)
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in (1000, 1001))


def test_op6(spark, folder):
    got, rows = run(spark, folder, "op6_suffix_dedup")
    size = 400
    count = collections.Counter(b[i : i + size] for t in folder[1].values() for b in [(t or "").encode()] for i in range(len(b) - size + 1))
    assert len(rows) == len(folder[1])
    for k, t in folder[1].items():
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(b), int(gone.sum()), spans, kept)


def test_op8(spark, folder):
    got, rows = run(spark, folder, "op8_decontamination")
    items = {r.item_id: WORD.findall((r.text or "").translate(LOW)) for r in spark.read.parquet(f"{folder[0]}/benchmark.parquet").collect()}
    windows = collections.defaultdict(set)
    for item, w in items.items():
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(item)
    assert len(rows) == len(folder[1])
    for k, t in folder[1].items():
        w = WORD.findall((t or "").translate(LOW))
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = [1] * n
                    found |= windows[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (got[k].n_words, got[k].n_hit, got[k].n_items, got[k].items_sha256, got[k].contaminated) == (len(w), sum(hit), len(found), digest, any(hit))


def test_op9(spark, folder):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    _, rows = run(spark, folder, "op9_packing")
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in rows:
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert pieces.keys() == folder[1].keys()
    for k, text in folder[1].items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[k], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes())) and p.length > 0
            at += p.length
        assert at == len(ids)
    sizes = []
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        sizes.append(at)
    padded = [n if n & (n - 1) == 0 else 2048 for n in sizes]
    assert sum(padded) - sum(sizes) <= 0.02 * sum(padded)


def test_op10(spark, folder):
    got, rows = run(spark, folder, "op10_simhash")
    prints = {k: fingerprint(t) for k, t in folder[1].items()}
    first = {k: k for k in prints}
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                low, high = sorted((first[a], first[b]))
                first = {k: low if v == high else v for k, v in first.items()}
    assert len(rows) == len(prints) and all((got[k].fingerprint, got[k].component_id) == (f"{prints[k]:016x}", first[k]) for k in prints)


def morse(n, swap=False):
    s = [0]
    while len(s) < n:
        s += [1 - x for x in s]
    return "".join("ab"[x ^ swap] for x in s[:n])


@pytest.mark.parametrize("size", [1024, 64])
def test_long_words_that_polynomials_confuse(spark, tmp_path, size):
    w = [f"w{k}" for k in range(19)]
    a, b = morse(size), morse(size, True)
    rows = [(1, " ".join([*w, a])), (2, " ".join([*w, b]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join([*w[:9], a]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.n_removed for r in queries.QUERIES["op1_substring_dedup"](spark, str(tmp_path)).collect()] == [0, 0]
    spark.createDataFrame([(1, " ".join([*w[10:], b]))], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    hit = {r.doc_id: r.n_hit for r in queries.decontamination.find_benchmark(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{tmp_path}/b/benchmark.parquet")).withColumn("n_hit", queries.decontamination.hit_words()).collect()}
    assert hit == {1: 0, 2: 10}


def test_many_rows_without_an_id(spark):
    """Texts of rows without id are told apart, and regular ids do not gather in one group."""
    r = random.Random(4)
    tail = " ".join(f"t{k}" for k in range(25))
    rows = [(None, f"only{k} " + " ".join(str(r.random()) for _ in range(3)) + (f" {tail}" if k % 50 == 0 else "")) for k in range(20_000)] + [(512 * k, f"even {k}") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = substring_dedup.remove_repeats(docs, 20).select("doc_id", "n_removed", "n_words").collect()
    assert len(out) == len(rows) and sum(x.n_removed for x in out) == 25 * 399 and all(x.n_removed in (0, 25) for x in out)
    bytes_out = suffix_dedup.remove_repeated_strings(docs, 60, 24).select("n_removed").collect()
    assert len(bytes_out) == len(rows) and sum(x.n_removed > 0 for x in bytes_out) == 400
    groups = substring_dedup.keyed(docs).source.groupBy("grp").count().collect()
    assert max(g["count"] for g in groups) < 20_500 * 0.6
