"""Every stage keeps columns of any name and takes odd rows and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from priorwise.llm import embedding_dedup, packing, secret_scan, simhash, stages, substring_dedup, suffix_dedup, warc

#: names that operators use for columns of their own
NAMES = (
    "loss", "chars", "centre", "spread", "keep", "limit", "log_perplexity", "block", "row", "secret_spans", "__base", "__assign", "__entropy", "n_words", "hit_starts", "hit_ends", "hit_items",
    "fp", "__fp", "__group", "__rank", "node", "component", "component_id", "least", "at", "kept", "hi", "lo", "nats", "mark", "grp", "m1", "__lang", "_", "a b",
)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, words):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words(3, 30))), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage(spark, corpus, tables, k):
    name, stage = corpus_pipeline.STAGES[k]
    wide = corpus.select("*", *(F.lit(f"mine {n}").alias(n) for n in NAMES))
    out = stage(spark, wide, tables)
    if k == len(corpus_pipeline.STAGES) - 1:
        assert out.groupBy("doc_id").count().count() == corpus.select("doc_id").distinct().count()
    else:
        assert out.columns == wide.columns
        rows = out.collect()
        assert all(r[n] == f"mine {n}" for r in rows for n in NAMES) and 0 < len(rows) <= 16
        assert {(r.doc_id, r.lang, r.source) for r in rows} <= {(r.doc_id, r.lang, r.source) for r in corpus.collect()}
        assert k != 1 or sorted(r.doc_id or 0 for r in rows) == [0, 2, 3, 8, 9, 10, 11, 11, 12, 13, 14]
        assert k in (0, 1) or all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert stage(spark, corpus.limit(0), tables).count() == 0


def test_secrets_keep_a_null_text(spark, corpus, tables):
    got = {r.doc_id: r.text for r in stages.redact_secrets(spark, corpus, tables).collect()}
    assert got[3] is None and got[14] == "[SECRET]'"


WIDE = {
    "substring": lambda d: substring_dedup.remove_repeats(d, 8),
    "suffix": lambda d: suffix_dedup.remove_repeated_strings(d, 100, 24),
    "simhash": simhash.simhash_groups,
    "first": simhash.keep_first,
    "secrets": secret_scan.find_secrets,
    "packing": lambda d: packing.pack_documents(d, pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")),
}


@pytest.mark.parametrize("name", WIDE)
def test_operators_take_further_columns_and_empty_tables(spark, corpus, name):
    wide = corpus.select("*", *(F.lit(f"mine {n}").alias(n) for n in NAMES if n != "secret_spans"))
    plain, got = WIDE[name](corpus), WIDE[name](wide)
    same = [c for c in plain.columns if not c.startswith("__")]
    rows = lambda df: sorted(map(str, df.select(*same).collect()))
    assert rows(got) == rows(plain) and WIDE[name](wide.limit(0)).count() == 0


def test_vectors_and_pages_of_odd_tables(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [1.0, 0.01], "x"), (2, [1.0, 0.01], "x")], "vec_id long, embedding array<double>, node string").withColumn("copies", F.lit("y"))
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(vectors).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (2, 2, 1)] and embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.plan_records(pages), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0
