"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, one for each language: texts are lower-cased,
white space is one space, digits are alike. Tasks count the n-grams of their
trusted documents; Spark sums the counts, derives the continuation counts of
the lower orders from them, and joins n-grams with their contexts and suffixes
by hash partitions to get probabilities. Documents are dealt to blocks of
bounded size. The distinct n-grams of each block are joined with the sharded
tables, come back to their block with their probabilities, and meet its
documents there; no table is held as a whole anywhere. A hash keeps a part of
the trusted documents out of the training.

A document goes if its log-perplexity is above centre + spread / sqrt(n) for
its n characters. Centre and spread are quantiles over the held-out trusted
documents of its language: the median, and a high quantile of (log-perplexity -
centre) * sqrt(n), so that short texts are not rejected for being short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorwise.llm.shared import checkpointed, in_small_batches, nested, small, unnested
from priorwise.llm.text_blocks import blocks, ragged

#: bytes of text whose n-grams travel together, and bytes that are taken apart at once
BLOCK_BYTES = 32 << 20
SCORE_BYTES = 1 << 19
#: characters of a key column, and the most in both
_WIDTH, MOST_ORDER = 3, 6
_BITS = 21
#: one in so many trusted documents sets the limits instead of training the model
HELD_OUT = 3
NO_LANGUAGE = "und"

_U = np.uint64
_CODES = np.arange(1 << 16, dtype=_U)
_CODES[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x2028, 0x2029]] = 32
_CODES[0x30:0x3A] = 0x30


# ---------------------------------------------------------------- n-grams of texts


def ngram_keys(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (high, low) of the n-grams that end at each character, and the characters of each text.

    The last three characters are in ``low``, 21 bits each, those before in ``high``.
    """
    lowered = [(t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    raw = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.where(raw < 1 << 16, _CODES[np.minimum(raw, 0xFFFF)], raw.astype(_U))
    blank = code == 32
    again = blank.copy()
    again[1:] &= blank[:-1]
    again[:1] = False
    heads = np.cumsum(sizes)[:-1]
    again[heads[heads < len(code)]] = False
    kept = ~again
    n = np.diff(np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(sizes)])])
    begin = np.cumsum(n + order - 1) - (n + order - 1)
    flat = np.full(int((n + order - 1).sum()), 32, _U)
    at = ragged(begin, n)
    flat[at + order - 1] = code[kept]
    high, low = np.zeros(len(at), _U), np.zeros(len(at), _U)
    for k in range(order):
        if k < order - _WIDTH:
            high = high << _U(_BITS) | flat[at + k]
        else:
            low = low << _U(_BITS) | flat[at + k]
    return high, low, n


def distinct(high: np.ndarray, low: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the number of each (or sum of its weights), and the place of every item among them."""
    if not high.any():
        low, back = np.unique(low, return_inverse=True)
        high = np.zeros(len(low), _U)
    else:
        order = np.lexsort((low, high))
        h, lo = high[order], low[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
        back = np.empty(len(h), np.int64)
        back[order] = np.cumsum(new) - 1
        high, low = h[new], lo[new]
    return high, low, np.bincount(back, weight, len(low)).astype(np.int64), back


def _by_language(column: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    codes = pc.fill_null(column, NO_LANGUAGE).dictionary_encode()
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    which = codes.indices.to_numpy(zero_copy_only=False)
    for k, lang in enumerate(codes.dictionary.to_pylist()):
        yield lang, np.flatnonzero(which == k)


class _Grams:
    """Distinct n-grams of each language with their numbers."""

    def __init__(self, order: int) -> None:
        self.order = order
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def add(self, rows: pa.RecordBatch) -> None:
        texts = rows.column("text").to_pylist()
        for lang, which in _by_language(rows.column("lang")):
            high, low, count, _ = distinct(*ngram_keys([texts[i] for i in which], self.order)[:2])
            parts = self.held.setdefault(lang, [])
            parts.append((high, low, count))
            if len(parts) >= 16:
                self.held[lang] = [self._merged(parts)]

    @staticmethod
    def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        high, low, count = (np.concatenate(x) for x in zip(*parts))
        return distinct(high, low, count)[:3]

    def __len__(self) -> int:
        return sum(len(p[0]) for parts in self.held.values() for p in parts)

    def take(self) -> tuple[list[pa.Array], list[str]]:
        langs, highs, lows, counts = [], [], [], []
        for lang, parts in self.held.items():
            high, low, count = self._merged(parts)
            langs.append(np.full(len(low), lang, object))
            highs.append(high), lows.append(low), counts.append(count)
        self.held = {}
        join = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.zeros(0, kind)
        lang = pa.array(np.concatenate(langs) if langs else [], pa.string())
        return [lang, pa.array(join(highs, _U).view(np.int64)), pa.array(join(lows, _U).view(np.int64)), pa.array(join(counts, np.int64))], ["lang", "hi", "lo", "c"]


def _count(order: int, flush: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams(order)
        for rows, _, _ in blocks(batches, "text", SCORE_BYTES):
            grams.add(rows)
            if len(grams) > 4 * flush:
                yield pa.RecordBatch.from_arrays(*grams.take())
        yield pa.RecordBatch.from_arrays(*grams.take())

    return run


# ---------------------------------------------------------------- the model


def _last(n: int) -> tuple[Column, Column]:
    """Key of the last n characters."""
    mask = lambda k: F.lit((1 << _BITS * k) - 1)
    zero = F.lit(0).cast("long")
    return (F.col("hi").bitwiseAND(mask(n - _WIDTH)), F.col("lo")) if n > _WIDTH else (zero, F.col("lo").bitwiseAND(mask(n)))


def _without_last(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Key of all characters but the last."""
    carried = F.shiftleft(hi.bitwiseAND((1 << _BITS) - 1), _BITS * (_WIDTH - 1))
    return F.shiftrightunsigned(hi, _BITS), F.shiftrightunsigned(lo, _BITS).bitwiseOR(carried)


def _discounts(grams: DataFrame) -> DataFrame:
    """Discounts d1, d2, d3 of each language from how many n-grams occur once to four times."""
    n = grams.groupBy("lang").agg(*(F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)))
    at_least = lambda c: F.greatest(F.col(c), F.lit(1.0))
    y = at_least("n1") / (at_least("n1") + 2 * at_least("n2"))
    raw = [k - (k + 1) * y * at_least(f"n{k + 1}") / at_least(f"n{k}") for k in (1, 2, 3)]
    # small samples can give values outside what a count can lose
    return n.select("lang", *(F.greatest(F.lit(0.1), F.least(d, F.lit(k - 0.1))).alias(f"d{k}") for k, d in enumerate(raw, 1)))


def train(trusted: DataFrame, order: int = 3) -> list[tuple[DataFrame, DataFrame]]:
    """Model of ``trusted`` (lang, text): for each order n from 1 a pair of tables.

    ``lang, hi, lo, p``: probability of the last character of each seen n-gram
    after the others. ``lang, hi, lo, gamma``: weight of the next lower order
    after each seen context (of n - 1 characters), with the uniform share folded
    in at n = 1. Null and empty texts hold no n-grams.
    """
    if not 1 <= order <= MOST_ORDER:
        raise ValueError(f"order must be 1 to {MOST_ORDER}")
    counted = in_small_batches(trusted).select("lang", "text").mapInArrow(_count(order), "lang string, hi long, lo long, c long")
    levels = {order: checkpointed(counted.groupBy("lang", "hi", "lo").agg(F.sum("c").alias("c")))}
    for n in range(order - 1, 0, -1):
        hi, lo = _last(n)
        levels[n] = checkpointed(levels[n + 1].groupBy("lang", hi.alias("hi"), lo.alias("lo")).agg(F.count("*").alias("c")))
    out: list[tuple[DataFrame, DataFrame]] = []
    for n in range(1, order + 1):
        d = small(_discounts(levels[n]))
        lost = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        hi, lo = _without_last(F.col("hi"), F.col("lo"))
        g = levels[n].join(d, "lang").select("lang", "hi", "lo", "c", lost.alias("lost"), hi.alias("chi"), lo.alias("clo"))
        sums = g.groupBy("lang", "chi", "clo").agg(F.sum("c").alias("total"), F.sum("lost").alias("mass"), F.count("*").alias("kinds"))
        gamma = F.col("mass") / F.col("total")
        g = g.join(sums, ["lang", "chi", "clo"])
        own = F.greatest(F.col("c") - F.col("lost"), F.lit(0.0)) / F.col("total")
        if n == 1:
            # characters that were never seen share the weight of one more kind
            p, weight = own + gamma / (F.col("kinds") + 1), gamma / (F.col("kinds") + 1)
        else:
            shi, slo = _last(n - 1)
            lower = out[-1][0].select("lang", F.col("hi").alias("shi"), F.col("lo").alias("slo"), F.col("p").alias("q"))
            g = g.withColumns({"shi": shi, "slo": slo}).join(lower, ["lang", "shi", "slo"])
            p, weight = own + gamma * F.col("q"), gamma
        probs = checkpointed(g.select("lang", "hi", "lo", p.alias("p")))
        out.append((probs, checkpointed(sums.select("lang", F.col("chi").alias("hi"), F.col("clo").alias("lo"), weight.alias("gamma")))))
    return out


def gram_probabilities(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``lang, hi, lo, nats`` (and ``least``) of distinct n-grams: minus the logarithm of the last character's probability.

    Each order's tables are joined by the n-gram's suffix and its context; an
    n-gram that was not seen has the context's weight times the lower order's
    probability. Languages without a model have null.
    """
    p: Column = F.lit(1.0)
    for n, (probs, backs) in enumerate(model, 1):
        hi, lo = _last(n)
        chi, clo = _without_last(hi, lo)
        own = probs.select("lang", F.col("hi").alias(f"h{n}"), F.col("lo").alias(f"l{n}"), F.col("p").alias(f"p{n}"))
        back = backs.select("lang", F.col("hi").alias(f"ch{n}"), F.col("lo").alias(f"cl{n}"), F.col("gamma").alias(f"g{n}"))
        keyed = grams.withColumns({f"h{n}": hi, f"l{n}": lo, f"ch{n}": chi, f"cl{n}": clo})
        grams = keyed.join(own, ["lang", f"h{n}", f"l{n}"], "left").join(back, ["lang", f"ch{n}", f"cl{n}"], "left")
        p = F.coalesce(f"p{n}", F.coalesce(f"g{n}", F.lit(1.0 if n > 1 else None)) * p)
    kept = [c for c in ("least",) if c in grams.columns]
    return grams.select("lang", "hi", "lo", *kept, (-F.log(p)).alias("nats"))


# ---------------------------------------------------------------- scores


def _block_grams(order: int):
    def run(docs: pa.Table) -> pa.Table:
        grams = _Grams(order)
        for rows, _, _ in blocks(iter(docs.select(["text", "lang"]).combine_chunks().to_batches()), "text", SCORE_BYTES):
            grams.add(rows)
        (lang, hi, lo, _), _ = grams.take()
        block = pa.repeat(docs.column("block")[0], len(lang))
        return pa.table({"block": block, "lang": lang, "hi": hi, "lo": lo})

    return run


def _score_block(order: int):
    def run(docs: pa.Table, grams: pa.Table) -> pa.Table:
        known = {}
        high, low = (grams.column(c).to_numpy().view(_U) for c in ("hi", "lo"))
        nats = grams.column("nats").to_numpy()
        for lang, which in _by_language(grams.column("lang")):
            which = which[np.lexsort((low[which], high[which]))]
            known[lang] = (high[which], low[which], nats[which])
        out = []
        for rows, _, _ in blocks(iter(docs.combine_chunks().to_batches()), "text", SCORE_BYTES):
            texts = rows.column("text").to_pylist()
            loss, size = np.full(rows.num_rows, np.nan), np.zeros(rows.num_rows, np.int64)
            for lang, which in _by_language(rows.column("lang")):
                high, low, n = ngram_keys([texts[i] for i in which], order)
                size[which] = n
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                high, low, _, back = distinct(high, low)
                h, lo, value = known[lang]
                # both are sorted and every n-gram of a document is among those of its block
                at = np.flatnonzero(_among(high, low, h, lo))
                if len(at) != len(low):
                    raise RuntimeError("a block met n-grams of other documents")
                loss[which[full]] = np.add.reduceat(value[at][back], (np.cumsum(n) - n)[full])
            columns = [rows.column(c) for c in ("row", "text", "lang")]
            out.append(pa.table([*columns, pa.array(loss, from_pandas=True), pa.array(size)], ["row", "text", "lang", "loss", "chars"]))
        return pa.concat_tables(out)

    return run


def _among(high: np.ndarray, low: np.ndarray, all_high: np.ndarray, all_low: np.ndarray) -> np.ndarray:
    """Which of the distinct keys ``all`` are among the others; both are sorted."""
    if not high.any() and not all_high.any():
        return np.isin(all_low, low, assume_unique=True)
    both_high, both_low = np.concatenate([all_high, high]), np.concatenate([all_low, low])
    order = np.lexsort((both_low, both_high))
    h, lo = both_high[order], both_low[order]
    twice = np.flatnonzero((h[1:] == h[:-1]) & (lo[1:] == lo[:-1]))
    out = np.zeros(len(both_low), bool)
    out[order[twice]] = out[order[twice + 1]] = True
    return out[: len(all_low)]


def score(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``row, text, lang, loss, chars`` of every row of ``docs`` (text, lang, any others).

    ``row`` holds the other columns, so that no name clashes; ``loss`` is in nats,
    null without a model of the language or without characters. Rows are dealt
    to blocks by a hash of doc_id (if there is one), text and partition, which is
    the same when a lost task is run again in another order; copies with ids of
    their own never gather in a block, repeated rows only those of a partition.
    """
    docs = in_small_batches(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    marks = [F.col("row").getField(c) for c in ("doc_id",) if c in docs.columns]
    block = F.pmod(F.xxhash64(*marks, F.col("text"), F.spark_partition_id()), F.lit(max(1, -(-size // BLOCK_BYTES))))
    rows = nested(docs, "text", "lang").select("row", "text", F.col("lang").cast("string").alias("lang"), block.alias("block"))
    dealt = rows.groupBy("block")
    order = len(model)
    # one exchange of the n-grams and one of the documents serve both of their readers
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grams = dealt.applyInArrow(_block_grams(order), "block long, lang string, hi long, lo long").repartition(parts, "lang", "hi", "lo")
    # the least block is read so that both need the same columns of the exchange
    nats = gram_probabilities(grams.groupBy("lang", "hi", "lo").agg(F.min("block").alias("least")), model)
    asked = grams.join(nats, ["lang", "hi", "lo"]).where("block >= least").select("block", "lang", "hi", "lo", "nats")
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("loss", T.DoubleType()), T.StructField("chars", T.LongType())])
    return dealt.cogroup(asked.groupBy("block")).applyInArrow(_score_block(order), schema)


def _language() -> Column:
    return F.coalesce("lang", F.lit(NO_LANGUAGE))


def _quantile(values: DataFrame, q: float, steps: int) -> DataFrame:
    """``lang, at, n``: of each language's values x the least that q of its n values don't exceed, to 1 / steps.

    Values are counted on a fixed grid, so the order in which tasks end has no
    part in it. The quantile's run of 4096 cells is found from the counts of
    runs, then its cell within: what a window orders is bounded by the range of
    values, however many there are.
    """
    cells = values.groupBy("lang", F.floor(F.col("x") * steps).alias("cell")).agg(F.count("*").alias("c"), F.max("x").alias("x"))
    cells = checkpointed(cells.withColumn("run", F.shiftright("cell", 12)))
    whole = Window.partitionBy("lang")
    upto = lambda c: F.sum("c").over(whole.orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = cells.groupBy("lang", "run").agg(F.sum("c").alias("c")).select("lang", "run", "c", upto("run").alias("upto"), F.sum("c").over(whole).alias("n"))
    reached = runs.where(F.col("upto") >= q * F.col("n")).groupBy("lang", "n").agg(F.min_by(F.struct("run", (F.col("upto") - F.col("c")).alias("below")), "run").alias("of"))
    own = cells.join(small(checkpointed(reached.select("lang", "n", "of.*"))), ["lang", "run"])
    counted = own.select("lang", "n", "x", (F.col("below") + upto("cell")).alias("upto"))
    return counted.where(F.col("upto") >= q * F.col("n")).groupBy("lang", "n").agg(F.min("x").alias("at"))


def language_limits(scored: DataFrame, quantile: float = 0.98, least_docs: int = 10) -> DataFrame:
    """``lang, centre, spread`` from scored trusted documents; languages with fewer than ``least_docs`` have none."""
    scored = scored.where("chars > 0 AND loss IS NOT NULL").select(_language().alias("lang"), (F.col("loss") / F.col("chars")).alias("x"), "chars")
    centre = _quantile(scored, 0.5, 1 << 20).where(F.col("n") >= least_docs).select("lang", F.col("at").alias("centre"))
    excess = scored.join(small(centre), "lang").select("lang", "centre", ((F.col("x") - F.col("centre")) * F.sqrt("chars")).alias("x"))
    spread = _quantile(excess.select("lang", "x"), quantile, 1 << 16).select("lang", F.col("at").alias("spread"))
    return centre.join(spread, "lang")


def judge(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """Scored rows with ``log_perplexity, limit, keep``; rows without a score or a limit are kept."""
    mean = F.col("loss") / F.when(F.col("chars") > 0, F.col("chars"))
    limit = F.when(F.col("chars") > 0, F.col("centre") + F.col("spread") / F.sqrt("chars"))
    named = small(limits).withColumnRenamed("lang", "__lang")
    out = scored.join(named, _language() == F.col("__lang"), "left").withColumns({"log_perplexity": mean, "limit": limit})
    return out.withColumn("keep", F.coalesce(F.col("log_perplexity") <= F.col("limit"), F.lit(True))).drop("centre", "spread", "loss", "__lang")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents labelled good and not toxic, once each."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return good.where((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("doc_id").isNotNull()).select("doc_id")


def fit(docs: DataFrame, labels: DataFrame, order: int = 3, quantile: float = 0.98, held_out: int = HELD_OUT) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Model of the trusted documents (doc_id, lang, text), and limits from one in ``held_out`` of them, which it has not seen.

    Which are held out is decided by a hash of the text, so copies stay together.
    """
    trusted = docs.select("doc_id", _language().alias("lang"), "text").join(small(checkpointed(trusted_ids(labels))), "doc_id", "left_semi")
    held = F.pmod(F.xxhash64("text"), F.lit(held_out)) == 0
    model = train(trusted.where(~held).select("lang", "text"), order)
    return model, checkpointed(language_limits(score(trusted.where(held).select("doc_id", "lang", "text"), model), quantile))


def classify(docs: DataFrame, labels: DataFrame, order: int = 3, quantile: float = 0.98) -> DataFrame:
    """``doc_id, lang, chars, log_perplexity, limit, keep`` for every row of ``docs``.

    ``docs`` needs doc_id, lang and text, ``labels`` doc_id, quality and toxic;
    other columns are not carried. A null lang is the language ``und``. Empty and
    null texts, and languages with too few trusted documents, are kept.
    Documents with contradicting labels are not trusted. Repeated rows are each
    counted and judged; equal losses and limits are kept.
    """
    model, limits = fit(docs, labels, order, quantile)
    judged = judge(score(docs.select("doc_id", "lang", "text"), model), limits)
    return judged.select(F.col("row.doc_id").alias("doc_id"), _language().alias("lang"), "chars", "log_perplexity", "limit", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, order: int = 3, quantile: float = 0.98) -> DataFrame:
    """Rows of ``docs`` that ``classify`` keeps, with their columns unchanged whatever their names."""
    model, limits = fit(docs, labels, order, quantile)
    judged = judge(score(docs, model), limits).where("keep")
    return unnested(judged, docs.columns, "text", "lang")
