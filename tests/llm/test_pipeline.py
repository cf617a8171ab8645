"""The pipeline against the same steps in plain Python; only the classifier's verdicts are taken from its own query."""

import random
import re

import pytest

import corpus_pipeline
from priorwise.llm import queries, quality
from tests.llm.test_near_dedup_stage import shingles
from tests.llm.test_text_operators import LOW, WORD

TOKEN = re.compile("token = '[0-9a-f]{18}")


def without_phrases(text, windows):
    """Text without the runs of words inside ten-word windows."""
    low = text.translate(LOW)
    spans = [m.span() for m in WORD.finditer(low)]
    words = [low[a:b] for a, b in spans]
    hit = [False] * len(words)
    for i in range(len(words) - 9):
        if tuple(words[i : i + 10]) in windows:
            hit[i : i + 10] = [True] * 10
    out, at, i = "", 0, 0
    while i < len(words):
        if hit[i]:
            j = i
            while j + 1 < len(words) and hit[j + 1]:
                j += 1
            out += text[at : spans[i][0]]
            at = spans[j][1]
            i = j
        i += 1
    return out + text[at:]


def test_pipeline(spark, tmp_path, words):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    pool = words(7, 60)
    r = random.Random(5)
    phrase = " ".join(r.choice(pool) for _ in range(25))
    texts = {k: " ".join(r.choice(pool) for _ in range(80)) for k in range(160)}
    texts |= {200: texts[3], 201: texts[4] + " x", 202: "zqxw " * 60, 203: None, 204: ""}
    texts[20] += " token = '0123456789abcdef01' end"  # trusted, so it is kept
    texts[21] = " ".join(r.choice(pool) for _ in range(40)) + ". " + phrase.upper() + "! " + " ".join(r.choice(pool) for _ in range(40))
    folder = str(tmp_path)
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(140)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, phrase), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    verdicts = quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {v.doc_id for v in verdicts.collect() if v.keep}
    assert 202 not in kept and len(kept) > 150
    prints = {k: shingles(texts[k]) for k in sorted(kept)}
    first: dict = {k: k for k in prints}
    for a in prints:
        for b in prints:
            if a < b and len(prints[a] & prints[b]) >= 0.8 * len(prints[a] | prints[b]):
                low, high = sorted((first[a], first[b]))
                first = {k: low if v == high else v for k, v in first.items()}
    left = [k for k in prints if first[k] == k]
    w = WORD.findall(phrase.translate(LOW))
    windows = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    want = {k: TOKEN.sub("[SECRET]", without_phrases(texts[k] or "", windows)) for k in left}
    tokenizer = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    sizes = {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in want.items()}

    out = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id: p.doc_tokens for p in out} == sizes
    total = {}
    for p in out:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == sizes and 200 not in total and {20, 21} <= set(total)


def test_the_query_is_registered():
    assert len(corpus_pipeline.STAGES) == 5 and {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}
