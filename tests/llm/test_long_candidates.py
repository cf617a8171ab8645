"""Secret scans of candidates of any length: the same windows as by hand, in time that follows the length."""

import math
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from priorwise.llm import secret_scan


def hottest(value, window=20):
    entropy = lambda w: math.log2(window) - sum(c * math.log2(c) for c in Counter(w).values()) / window
    return max((entropy(value[i : i + window]) for i in range(len(value) - window + 1)), default=0.0)


def test_windows_across_pieces(spark):
    """Pieces share what a window needs, so no window is lost where one piece ends."""
    r = random.Random(2)
    texts = ["".join(r.choice("ab1") for _ in range(n)) for n in (19, 20, 21, 255, 256, 257, 275, 276, 300, 700)]
    for at in (230, 236, 240, 250, 255):
        flat = ["ab"[k % 2] for k in range(600)]
        flat[at : at + 20] = "0123456789cdefghijkl"
        texts.append("".join(flat))
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for bits in (1.3, 1.5, 4.3):
        got = {x.t: x.hot for x in rows.select("t", secret_scan.reaches_entropy(F.col("t"), 20, F.lit(bits)).alias("hot")).collect()}
        assert got == {t: len(t) >= 20 and hottest(t) >= bits - 1e-9 for t in texts}
    found = rows.select("t", secret_scan.window_entropy(F.col("t"), 20).alias("e")).collect()
    assert all(abs(x.e - hottest(x.t)) < 1e-9 for x in found)


def test_a_megabyte_without_a_break(spark):
    r = random.Random(5)
    key = "".join(r.choice("abcdefghijkmnpqrstuvwxyz23456789ABCDEFGH") for _ in range(40))
    cold = "zb1" * 350_000
    start = time.time()
    rows = spark.createDataFrame([(1, cold), (2, cold + key), (3, "see " + cold + key + "; end")], "doc_id long, text string")
    got = {x.doc_id: [(s.start, s.end) for s in x.secret_spans if s.kind == "entropy"] for x in secret_scan.find_secrets(rows).collect()}
    n = len(cold)
    assert got == {1: [], 2: [(0, n + 40)], 3: [(4, n + 44)]}
    assert time.time() - start < 120
