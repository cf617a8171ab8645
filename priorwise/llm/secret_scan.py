"""Secrets in text: fixed patterns and sliding-window entropy, in SQL functions.

Spans are (start, end) in code points, end exclusive. The base kinds are
patterns; the kind ``entropy`` comes from long runs of key-like characters,
which end at ``=`` and ``/`` so that a name or a path before a key is not judged
with it. Over each such candidate, cut into pieces that share a window's length,
a window slides; one step changes the counts of two characters, and with them
the sum of c * log2(c), from which the Shannon entropy of the window follows. If
a window reaches the threshold of the candidate's character class, the whole
candidate is a span. Candidates that fit the allow list give none, nor do spans
inside a base span.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed patterns: kind, expression, group whose length counts, least length
BASE_KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: a cheaper test that every text with a counted match passes
_HINTS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
}
#: the same spans, skipping what is too short anyway
_SEARCH = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
_HIT = "struct<start:int,end:int,value:string>"
#: characters of the pieces in which windows slide, and of the stretches that are cut into pieces
_PIECE, _STRETCH = 256, 16_384
#: hits that are gathered before they join the others, so that lists are not copied at every hit
_CHUNK = 64


@dataclass(frozen=True)
class EntropyRule:
    """Window and thresholds of the entropy search.

    ``candidate`` finds runs of key-like characters; ``classes`` are tried in
    order as (expression that the whole candidate fits, least entropy in bits):
    about what nineteen of twenty random strings of the class reach in a window
    of twenty characters. ``allow`` are expressions that suppress a candidate.
    """

    window: int = 20
    candidate: str = r"[A-Za-z0-9][A-Za-z0-9+_-]{19,}"
    classes: tuple[tuple[str, float], ...] = (
        (r"^(?:[0-9a-f-]+|[0-9A-F-]+)$", 2.9),
        (r"^(?:[0-9a-z_-]+|[0-9A-Z_-]+)$", 3.5),
        (r"^[A-Za-z0-9+_-]+$", 3.7),
    )
    allow: tuple[str, ...] = (
        r"^[^0-9]+$|^[0-9-]+$",
        r"(?i:example|sample|placeholder|changeme|dummy|your[-_])",
        r"^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$",
        r"0{7}|1{7}|x{7}|X{7}",
    )


def _found(text: Column, pattern: str, group: int, least: int) -> Column:
    """Spans of the leftmost non-overlapping matches, as array<struct<start,end,value>>."""
    quoted = F.lit(pattern)
    whole = F.regexp_extract_all(text, quoted, F.lit(0))
    counted = F.regexp_extract_all(text, quoted, F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), counted.alias("counted"))

    empty = F.array().cast(f"array<{_HIT}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["whole"])
        hit = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), x["whole"].alias("value"))
        is_hit = F.coalesce(F.length(x["counted"]) >= least, F.lit(False))
        open_ = F.when(is_hit, F.concat(acc["open"], F.array(hit))).otherwise(acc["open"])
        full = is_hit & (F.size(acc["open"]) >= _CHUNK - 1)
        return F.struct(
            F.coalesce(end, start).cast("int").alias("at"),
            F.when(full, F.concat(acc["done"], F.array(open_))).otherwise(acc["done"]).alias("done"),
            F.when(full, empty).otherwise(open_).alias("open"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_HIT}>>").alias("done"), empty.alias("open"))
    return F.aggregate(steps, start, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["open"]))


def _if_hinted(text: Column, hint: str, found: Column) -> Column:
    empty = F.array().cast(f"array<{_HIT}>")
    return F.when(F.length(text) == 0, empty).when(text.rlike(hint), found).otherwise(empty)


def window_entropy(value: Column, window: int) -> Column:
    """Largest Shannon entropy in bits of the windows of ``value``, by counts that change with the window; 0 if it is shorter.

    The state is S, the sum of c * log2(c) over the counts c of the window's
    characters: taking a character out or in moves one count by one, and the
    entropy is log2(window) - S / window.
    """
    gain = F.array(*(F.lit((c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0)) for c in range(window)))

    def among(first: Column, n: Column, letter: Column) -> Column:
        part = F.substring(value, first, n)
        return n - F.length(F.replace(part, letter, F.lit("")))

    def step(acc: Column, i: Column) -> Column:
        # the window before without its first character, once it is full
        first = F.greatest(i - window + 1, F.lit(1))
        kept = i - first
        old = F.when(i > window, F.get(gain, among(first, kept, F.substring(value, i - window, F.lit(1))))).otherwise(F.lit(0.0))
        new = F.get(gain, among(first, kept, F.substring(value, i, F.lit(1))))
        total = acc["total"] - old + new
        # the entropy is largest where the sum is least
        return F.struct(total.alias("total"), F.when(i >= window, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

    none = window * math.log2(window)
    start = F.struct(F.lit(0.0).alias("total"), F.lit(none).alias("least"))
    return F.aggregate(F.sequence(F.lit(1), F.length(value)), start, step, lambda acc: F.lit(math.log2(window)) - acc["least"] / window)


def _cut(value: Column, size: int, window: int) -> Column:
    """Pieces of ``value`` that hold each of its windows; all but the last have ``size`` characters."""
    step = size - window + 1
    starts = F.sequence(F.lit(0), F.greatest(F.length(value) - window, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda i: F.substring(value, i + 1, F.lit(size)))


def reaches_entropy(value: Column, window: int, bits: Column) -> Column:
    """Whether a window of ``value`` has that entropy; the search ends with the first one.

    Windows slide within pieces of bounded size, so that the time is in
    proportion to the length.
    """
    found = lambda part: F.exists(_cut(part, _PIECE, window), lambda p: window_entropy(p, window) >= bits - 1e-9)
    return F.coalesce(F.exists(_cut(value, _STRETCH, window), found), F.lit(False))


def entropy_spans(text: Column, rule: EntropyRule) -> Column:
    """Spans (start, end) of candidates with a window of high entropy."""
    found = _if_hinted(text, rule.candidate, _found(text, rule.candidate, 0, rule.window))
    if rule.allow:
        known = "|".join(f"(?:{p})" for p in rule.allow)
        found = F.filter(found, lambda x: ~x["value"].rlike(known))

    def judged(x: Column) -> Column:
        threshold = F.lit(None).cast("double")
        for pattern, bits in reversed(rule.classes):
            threshold = F.when(x["value"].rlike(pattern), F.lit(bits)).otherwise(threshold)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), threshold.alias("bits"))

    # thresholds first, as they read the whole candidate
    hot = F.filter(F.transform(found, judged), lambda x: reaches_entropy(x["value"], rule.window, x["bits"]))
    return F.transform(hot, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def find_secrets(docs: DataFrame, text: str = "text", rule: EntropyRule = EntropyRule()) -> DataFrame:
    """``docs`` with ``secret_spans``: array<struct<start,rank,end,kind>> by start, then kind.

    The kinds rank as assign, access, hex, entropy. A null or empty text has no
    spans; all other columns are kept, and a column named ``secret_spans`` is
    replaced. Repeated rows each keep their spans; very long texts are searched
    as a whole.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    columns = {kind: _if_hinted(body, _HINTS[kind], _found(body, _SEARCH.get(kind, pattern), group, least)) for kind, pattern, group, least in BASE_KINDS}
    kept = [c for c in docs.columns if c != "secret_spans"]
    own = "_" * (1 + max(map(len, docs.columns)))  # begins no name of the input
    named = lambda kind: own + kind
    found = docs.select(*kept, *(c.alias(named(k)) for k, c in columns.items()), entropy_spans(body, rule).alias(named("entropy")))

    def tagged(kind: str, rank: int) -> Column:
        return F.transform(
            F.col(named(kind)),
            lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")),
        )

    found = found.select(*kept, named("entropy"), F.concat(*(tagged(k, i) for i, (k, *_) in enumerate(BASE_KINDS))).alias(named("base")))
    extra = F.filter(
        tagged("entropy", len(BASE_KINDS)),
        lambda x: ~F.exists(F.col(named("base")), lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"])),
    )
    return found.select(*kept, F.array_sort(F.concat(named("base"), extra)).alias("secret_spans"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", rule: EntropyRule = EntropyRule()) -> DataFrame:
    """``docs`` with every span of ``find_secrets`` replaced by ``mask``; overlapping spans give one mask."""
    found = find_secrets(docs, text, rule)
    body = F.col(text)

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        gap = F.substring(body, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(acc["parts"], F.array(gap, F.lit(mask)))).otherwise(acc["parts"]).alias("parts"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    end = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(body, acc["at"] + 1, F.length(body)))
    clean = F.when(F.size("secret_spans") > 0, F.aggregate("secret_spans", zero, step, end)).otherwise(body)
    return found.withColumn(text, clean).drop("secret_spans")
