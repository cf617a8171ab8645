"""The numbered queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.llm import centroid_clusters, decontamination, embedding_dedup, hard_negatives, html_text, packing, quality, secret_scan, simhash, substring_dedup, suffix_dedup, url_filters, warc
from priorwise.llm.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda x: x["kind"] != "entropy")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex", "entropy")),
        F.sha2(F.encode(secret_scan.span_list(base), "UTF-8"), 256).alias("base_sha256"),
        secret_scan.span_list(spans).alias("spans"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages")), path)
    records = warc.read_archives(spark, path)
    full = F.col("payload").isNotNull()
    return records.select(
        warc.page_number("record_id").alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        warc.page_number("refers_to").alias("refers_to"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", F.col("chars").alias("scored_chars"), F.exp("log_perplexity").alias("perplexity"), F.exp("limit").alias("limit"), "keep")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_strings(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(
        "SELECT * FROM VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), "
        "('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS rules(host, path, action)"
    )
    return url_filters.match_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        decontamination.hit_words().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("items_sha256"),
        (F.size("hit_starts") > 0).alias("contaminated"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid_clusters.cluster_vectors(table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, scale=1024, dims=64, seed=3)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100, scale=256)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_html_text": op12_html_text,
    "op13_hard_negatives": op13_hard_negatives,
}

#: kind, rank, pattern, group whose length counts, least length, as in ``secret_scan``
_SECRETS = (
    ("assign", 0, r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", 1, "AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", 2, "[0-9a-f]{16,}", 0, 16),
    ("entropy", 3, "[A-Za-z0-9][A-Za-z0-9+_-]{19,}", 0, 20),
)
_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, {r} AS rank, {n} AS least, regexp_extract_all(x, '{p}') AS w, regexp_extract_all(x, '{p}', {g}) AS c, string_split_regex(x, '{p}') AS g FROM t"
    for k, r, p, g, n in _SECRETS
)



def _cluster_rounds(rounds: int = 10) -> str:
    """SQL of op11: rounds of assignment and exact floors of means, then the last assignment."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, q, k, d FROM (SELECT vec_id, q, k, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r})
                QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT k, i, sum(q[i])::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT k, q, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY 1, 2) GROUP BY 1),
                c{r + 1} AS MATERIALIZED (SELECT c{r}.k AS k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.k = m{r}.k)"""
            )
    return f"""
        WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
                                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, q AS c FROM (SELECT q, sha256('3:' || vec_id) AS h FROM v) ORDER BY h LIMIT 8),
        {", ".join(steps)},
        f AS (SELECT k, sum(d)::BIGINT AS own FROM a{rounds} GROUP BY 1)
        SELECT vec_id, a.k::INTEGER AS cluster, d AS distance, own AS cluster_inertia, (SELECT sum(own) FROM f)::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN f ON a.k = f.k JOIN c{rounds} c ON a.k = c.k"""


ORACLE_SQL = {
    "op11_centroid_clusters": _cluster_rounds(),
    "op13_hard_negatives": """
        WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
                                FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
                           FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        n AS (SELECT p.anchor_id AS anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
              FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
        SELECT * FROM n WHERE rank <= 5""",
    "op3_secret_scan": rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
        m AS ({_MATCHES}),
        u AS (SELECT doc_id, kind, rank, least, i, w[i] AS value, length(c[i]) AS n, sum(length(g[i]) + length(w[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop
              FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m)),
        p AS (SELECT doc_id, kind, rank, value, (stop - length(value))::BIGINT AS start, stop::BIGINT AS stop FROM u WHERE n >= least),
        base AS (SELECT * FROM p WHERE rank < 3),
        cand AS (SELECT *, CASE WHEN regexp_matches(value, '^([0-9a-f-]+|[0-9A-F-]+)$') THEN 2.9 WHEN regexp_matches(value, '^([0-9a-z_-]+|[0-9A-Z_-]+)$') THEN 3.5 ELSE 3.7 END AS bits FROM p
                 WHERE rank = 3 AND NOT regexp_matches(value, '^[^0-9]+$|^[0-9-]+$|(?i:example|sample|placeholder|changeme|dummy|your[-_])|0{{7}}|1{{7}}|x{{7}}|X{{7}}')
                   AND NOT regexp_matches(value, '^(?i:[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}})$')),
        ch AS (SELECT value, o, l, count(*) AS c FROM (SELECT value, o, unnest(string_split(substr(value, o, 20), '')) AS l FROM (SELECT DISTINCT value, unnest(range(1, length(value) - 18)) AS o FROM cand)) GROUP BY ALL),
        h AS (SELECT value, max(e) AS e FROM (SELECT value, o, log2(20) - sum(c * log2(c)) / 20 AS e FROM ch GROUP BY 1, 2) GROUP BY 1),
        extra AS (SELECT c.doc_id, kind, rank, start, stop FROM cand c JOIN h USING (value) WHERE e >= bits - 1e-9
                  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.start <= c.start AND b.stop >= c.stop)),
        every AS (SELECT doc_id, kind, rank, start, stop FROM base UNION ALL SELECT * FROM extra),
        s AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, count(*) FILTER (rank = 3) AS n_entropy,
                     string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS b, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM every GROUP BY 1)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM t LEFT JOIN s USING (doc_id)""",
    "op6_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        part AS (SELECT doc_id, o, n, substr(h, 2 * o + 1, 2 * 2399) AS h FROM (SELECT *, unnest(range(0, greatest(n - 399, 0), 2000)) AS o FROM d)),
        s AS (SELECT doc_id, o + i AS i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT *, unnest(range(0, least(2000, n - 399 - o))) AS i FROM part)),
        again AS (SELECT k FROM s GROUP BY 1 HAVING count(*) > 1),
        r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM s SEMI JOIN again USING (k)),
        g AS (SELECT doc_id, i, sum(CASE WHEN i <= p + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM r),
        x AS (SELECT doc_id, g, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY 1, 2),
        gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM x
                 UNION ALL SELECT doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN x USING (doc_id) GROUP BY 1),
        kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM gaps JOIN d USING (doc_id) GROUP BY 1),
        runs AS (SELECT doc_id, sum(b - a)::BIGINT AS removed, count(*) AS spans FROM x GROUP BY 1)
        SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
        FROM d JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id)""",
    "op1_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w),
        k AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS k FROM win),
        late AS (SELECT doc_id, i FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
        gone AS (SELECT DISTINCT doc_id, i + d AS i FROM late, (SELECT unnest(range(20)) AS d)),
        runs AS (SELECT doc_id, count(*) AS n, count(*) FILTER (fresh) AS spans
                 FROM (SELECT doc_id, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) <> i - 1, true) AS fresh FROM gone) GROUP BY 1),
        words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
        SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
        r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1),
        n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op8_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        s AS (SELECT item_id, ws, least(len(ws), 10) AS size FROM b WHERE len(ws) > 0),
        k AS (SELECT DISTINCT item_id, size, array_to_string(ws[i : i + size - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM s)),
        win AS (SELECT doc_id, size, i, array_to_string(ws[i : i + size - 1], ' ') AS k
                FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM s))),
        hit AS (SELECT doc_id, i, win.size AS size, item_id FROM win JOIN k ON win.k = k.k AND win.size = k.size),
        n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
        SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
        FROM m""",
    "op7_url_filters": r"""
        WITH parts AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        fits AS (
            SELECT *,
                   (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') AS r1,
                   (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') AS r2,
                   (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') AS r3,
                   (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') AS r4
            FROM parts)
        SELECT page_id, host, path,
               CASE WHEN r2 THEN 'example.net/en/' WHEN r3 THEN 'example.com/de/'
                    WHEN r4 THEN 'org/fr/' WHEN r1 THEN 'net/' END AS rule,
               CASE WHEN r2 THEN 'allow' WHEN r3 THEN 'block' WHEN r4 THEN 'allow'
                    WHEN r1 THEN 'block' ELSE 'allow' END AS verdict
        FROM fits""",
}
