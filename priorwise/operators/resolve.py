"""Joins that resolve entities, states and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorwise.functions.names import similarity
from priorwise.operators.lineage import counted
from priorwise.operators.similar import most_similar, similar_pairs
from priorwise.operators.sized import small


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """``left`` with the values of the last right row of its key at or before its time (of ties any right row precedes).

    The two tables are stacked and swept by one window, so no pair of rows is ever formed.
    """
    state = F.struct(*(F.col(v) for v in values))
    a = left.select("*", F.lit(None).cast(right.select(state.alias("s")).schema["s"].dataType).alias("__s"), F.lit(1).alias("__side"))
    b = right.select(*by, time, state.alias("__s"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*by).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__last", F.last("__s", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*left.columns, *(F.col(f"__last.{v}").alias(f"asof_{v}") for v in values))


def within_days(left: DataFrame, right: DataFrame, key: str, a: str, b: str, days: int = 1) -> DataFrame:
    """Pairs with the same key whose dates differ by at most ``days``: right rows are dealt to the days they can match."""
    near = right.withColumn("__day", F.explode(F.sequence(F.date_sub(b, days), F.date_add(b, days))))
    return left.withColumn("__day", F.col(a)).join(near, [key, "__day"]).drop("__day")


def inherit_by_code(rows: DataFrame, entity: str, code: str, order: Sequence[str]) -> DataFrame:
    """Rows without an entity take it from the first row with the same code that has one."""
    known = rows.where(F.col(entity).isNotNull()).groupBy(code).agg(F.min_by(entity, F.struct(*order)).alias("__e"))
    joined = rows.join(known, code, "left")
    return joined.select(*(F.coalesce(entity, "__e").alias(c) if c == entity else F.col(c) for c in rows.columns), (F.col(entity).isNull() & F.col("__e").isNotNull()).alias("inherited"))


def _same_person(a: Column, b: Column) -> Column:
    """Whether two names can be one: the last token of one is a token of the other; if both end in it, the first tokens agree.

    First tokens agree if one begins with the other (an initial begins a name); a
    name of one token agrees with any. Last tokens have three letters at least.
    """
    x, y = F.split(a, " "), F.split(b, " ")
    last, other = F.element_at(x, -1), F.element_at(y, -1)
    first = F.startswith(x[0], y[0]) | F.startswith(y[0], x[0]) | (F.size(x) < 2) | (F.size(y) < 2)
    return (F.length(last) >= 3) & (F.length(other) >= 3) & F.when(last == other, first).otherwise(F.array_contains(x, other) | F.array_contains(y, last))


def _by_token(names: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of a name and a known one that can be the same person, once each."""
    last = lambda c: F.element_at(F.split(c, " "), -1)
    tokens = lambda c: F.explode(F.array_distinct(F.split(c, " ")))
    a = names.select("name", tokens("name").alias("__t")).join(known.select("match", last("match").alias("__t")), "__t")
    b = names.select("name", last("name").alias("__t")).join(known.select("match", tokens("match").alias("__t")), "__t")
    pairs = a.select("name", "match").unionByName(b.select("name", "match"))
    return pairs.where(_same_person(F.col("name"), F.col("match"))).distinct()


def resolve_names(names: DataFrame, known: DataFrame, overrides: DataFrame | None = None, cutoff: float = 0.85) -> DataFrame:
    """``name, match, how, score`` for distinct names against known names.

    Override, then equality, then the known name that can be the same person by
    whole tokens if there is only one (see ``_same_person``), then the most
    similar one of all from the cutoff on (ties: the smaller); else unresolved,
    with null match and score. Tokens are separated by one space.
    """
    names = names.select("name").distinct()
    known = known.select(F.col("name").alias("match")).distinct()
    step = lambda df, rank: df.select("name", "match", F.lit(rank).alias("__rank"), "score")
    exact = names.join(known, F.col("name") == F.col("match")).withColumn("score", F.lit(1.0))
    open_ = names.join(known, F.col("name") == F.col("match"), "left_anti")
    token = _by_token(open_, known).groupBy("name").agg(F.count("*").alias("__n"), F.min("match").alias("match")).where("__n = 1")
    token = token.withColumn("score", similarity(F.col("name"), F.col("match")))
    cand = step(exact, 1).unionByName(step(token, 2)).unionByName(step(similar_pairs(open_, known, cutoff), 3))
    if overrides is not None:
        cand = cand.unionByName(step(overrides.withColumn("score", F.lit(1.0)), 0))
    best = cand.groupBy("name").agg(F.min(F.struct("__rank", (-F.col("score")).alias("s"), "match")).alias("b"))
    # the label comes from the joined side itself, so that a name without candidates has none
    label = F.element_at(F.array(*(F.lit(x) for x in ("override", "exact", "surname", "similar"))), F.col("b.__rank") + 1)
    best = best.select("name", "b.match", label.alias("how"), (-F.col("b.s")).alias("score"))
    return names.join(best, "name", "left").select("name", "match", F.coalesce("how", F.lit("unresolved")).alias("how"), "score")


def suggestions(names: DataFrame, known: DataFrame, cutoff: float = 0.4, most: int = 5) -> DataFrame:
    """``name, match, score, k`` of the ``most`` most similar known names of each name, from the cutoff on."""
    return most_similar(names.select("name"), known.select(F.col("name").alias("match")), cutoff, most)


def nearest_active(candidates: DataFrame, activity: DataFrame, key: str, entity: str, date: str, active: str, days: int = 5 * 365) -> DataFrame:
    """Of several entities for a key the one active nearest to the date; beyond ``days`` the smallest."""
    joined = candidates.join(activity.select(entity, active), entity, "left").withColumn("__d", F.abs(F.datediff(date, active)))
    gap = F.when(F.col("__d") <= days, F.col("__d")).otherwise(F.lit(1 << 30))
    return joined.groupBy(key).agg(F.min_by(entity, F.struct(gap.alias("g"), F.col(entity).alias("e"))).alias(entity))


def first_containing(text: Column, entries: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first entry whose part occurs in the text, in the order of the list."""
    out = F.lit(default).cast("string")
    for part, label in reversed(entries):
        out = F.when(F.lower(text).contains(part.lower()), label).otherwise(out)
    return out


def prefer_right(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Full join in which a non-empty value of the right side wins."""
    r = right.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    pick = lambda c: F.coalesce(F.when(F.col(f"__{c}") != "", F.col(f"__{c}")), F.col(c))
    return left.join(r, key, "full").select(key, *(pick(c).alias(c) for c in columns))


def split_flags(date: str, periods: dict[str, tuple[str, str]]) -> list[Column]:
    """A flag for each named period, both ends included."""
    return [F.coalesce(F.col(date).between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(False)).alias(f"in_{n}") for n, (a, b) in periods.items()]


def tail_holdout(df: DataFrame, date: str, key: str, months: int = 6, least: int = 30) -> DataFrame:
    """``df`` with ``is_holdout``: rows of the last months, or the newest ``least`` rows if those are fewer."""
    end = df.agg(F.add_months(F.max(date), -months).alias("__from"))
    rows = df.crossJoin(F.broadcast(end)).withColumn("__in", F.col(date) > F.col("__from"))  # one row
    n = rows.where("__in").limit(least).count()
    if n >= least:
        return rows.withColumn("is_holdout", F.col("__in")).drop("__in", "__from")
    newest = df.select(key).orderBy(F.desc(date), F.desc(key)).limit(least).withColumn("__k", F.lit(True))
    return df.join(F.broadcast(newest), key, "left").withColumn("is_holdout", F.coalesce("__k", F.lit(False))).drop("__k")


def within_bounds(df: DataFrame, bounds: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value lies in the bounds of their key; keys without bounds are kept."""
    joined = df.join(small(bounds), key, "left")
    ok = F.coalesce(F.col(value).between(F.col("low"), F.col("high")), F.lit(True))
    return joined.where(ok).select(*df.columns)


def tripwire(df: DataFrame, curated: DataFrame, key: str, text: str, words: Sequence[str]) -> DataFrame:
    """``df`` with ``flag`` (a curated value, else whether a keyword occurs) and ``is_uncurated``."""
    hit = F.lower(text).rlike("|".join(words))
    joined = df.join(curated.select(key, F.col("flag").alias("__f")), key, "left")
    return joined.select(*df.columns, F.coalesce("__f", hit, F.lit(False)).alias("flag"), (F.coalesce(hit, F.lit(False)) & F.col("__f").isNull()).alias("is_uncurated"))


def counted_tripwire(df: DataFrame, curated: DataFrame, key: str, text: str, words: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """``tripwire`` and its counts of flagged and of uncurated rows, which every run reports; ``df`` is computed once."""
    return counted(tripwire(df, curated, key, text, words), flagged=F.col("flag"), uncurated=F.col("is_uncurated"))


def matches_tokens(tokens: Column, wanted: dict[str, Sequence[str]]) -> Column:
    """Whether for each kind some wanted token (kind:value) occurs."""
    out = F.lit(True)
    for kind, values in wanted.items():
        out = out & F.arrays_overlap(tokens, F.array(*(F.lit(f"{kind}:{v}") for v in values)))
    return out


def unsuperseded(df: DataFrame, source: str, time: str, since: Column) -> DataFrame:
    """The newest row of each source, if not older than ``since``."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(F.desc(time)))
    return df.withColumn("__k", rank).where((F.col("__k") == 1) & (F.col(time) >= since)).drop("__k")


def dead_everywhere(importances: DataFrame, feature: str, value: str, eps: float = 1e-6) -> DataFrame:
    """Features whose importance is within eps of 0 in every table."""
    return importances.groupBy(feature).agg(F.max(F.abs(value)).alias("__m")).where(F.col("__m") <= eps).select(feature)
