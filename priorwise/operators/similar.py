"""Similar names by an inverted index of letter groups.

Similarity is 1 - edits / length of the longer name. Names within k edits share
many q-grams: of L letters in the longer one at least L - q + 1 - k * q. A name
therefore needs only its rarest grams in the index (its prefix), and two names
are candidates only if they meet there in several grams at once, which are one
key of an equi-join. Candidates must then share as many grams and letters as
their lengths demand, before edits are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorwise.functions.names import similarity
from priorwise.operators.lineage import checkpointed
from priorwise.operators.sized import small

#: similarities at which ``most_similar`` looks whether a name has enough, before its cutoff
LEVELS = (0.8, 0.6)


def _edits(length: Column, cutoff: float) -> Column:
    """Edits that leave a longer name of this length similar enough."""
    return F.floor((1 - cutoff) * length + 1e-9).cast("int")


def _shared(longer: Column, q: int, cutoff: float) -> Column:
    """Grams that two names share at least, by the longer one's length."""
    return longer - (q - 1) - q * _edits(longer, cutoff)


def _least_shared(length: Column, q: int, cutoff: float) -> Column:
    """The least that a name of this length shares with any partner of a possible length."""
    longest = F.floor(length / cutoff + 1e-9).cast("int")
    return F.array_min(F.transform(F.sequence(length, longest), lambda n: _shared(n, q, cutoff)))


def _grams(names: DataFrame) -> DataFrame:
    """``side, name, gram``: every letter and every pair of letters of each name, its occurrences numbered."""
    parts = lambda q: F.transform(F.sequence(F.lit(1), F.length("name") - (q - 1)), lambda i: F.substring(F.col("name"), i, F.lit(q)))
    both = F.concat(parts(1), F.when(F.length("name") >= 2, parts(2)).otherwise(F.array().cast("array<string>")))
    each = names.select("side", "name", F.explode(both).alias("__g")).groupBy("side", "name", "__g").agg(F.count("*").cast("int").alias("__n"))
    numbered = F.transform(F.sequence(F.lit(1), F.col("__n")), lambda i: F.concat_ws("#", "__g", i.cast("string")))
    return each.select("side", "name", F.length("__g").alias("q"), F.explode(numbered).alias("gram"))


class NameIndex:
    """Grams of names and of known names, the rarest of the known names first; made once for searches at several cutoffs."""

    def __init__(self, names: DataFrame, known: DataFrame) -> None:
        sides = names.select(F.lit(0).alias("side"), "name").unionByName(known.select(F.lit(1).alias("side"), F.col("match").alias("name")))
        grams = checkpointed(_grams(sides.where(F.length("name") > 0).distinct()))
        order = small(grams.where("side = 1").groupBy("gram").agg(F.count("*").alias("__f")))
        item = lambda q: F.when(F.col("q") == q, F.struct(F.coalesce("__f", F.lit(0)).alias("f"), "gram"))
        lists = grams.join(order, "gram", "left").groupBy("side", "name").agg(*(F.array_sort(F.collect_list(item(q))).alias(f"g{q}") for q in (1, 2)))
        self.table = checkpointed(lists.select("side", "name", *(F.transform(f"g{q}", lambda g: g["gram"]).alias(f"g{q}") for q in (1, 2))))

    def side(self, known: bool) -> DataFrame:
        return self.table.where(F.col("side") == int(known)).drop("side")


def _keys(side: DataFrame, cutoff: float, is_known: bool) -> DataFrame:
    """``name, g1, g2, key``: a row for each gram or pair of grams under which a name stands in the index or is sought.

    A name that shares two grams at least with every partner meets others of the
    kind in pairs of grams, and the rest in single ones. Where pairs of letters
    promise nothing to a short name, it meets all its partners by letters; longer
    ones meet each other by pairs of letters.
    """
    n = F.length("name")
    reach = max([1, *(x for x in range(1, 400) if _promise(x, 2, cutoff) < 1)])
    side = side.select("name", "g1", "g2", *(F.least(_least_shared(n, q, cutoff), F.size(f"g{q}")).alias(f"t{q}") for q in (1, 2)))
    side = side.withColumn("__short", F.col("t2") < 1).withColumn("__near", F.ceil(cutoff * n - 1e-9) <= reach)
    # a tag names what is met: the sought name's side first
    ordered = lambda mine, other: f"{other}{mine}" if is_known else f"{mine}{other}"
    tags = lambda kinds, sizes: F.array(*(F.lit(k + s) for k in kinds for s in sizes))
    letters = lambda sizes: F.when(F.col("__short"), tags([ordered("s", "s"), ordered("s", "l")], sizes)).when(F.col("__near"), tags([ordered("l", "s")], sizes))
    pairs = lambda sizes: F.when(~F.col("__short"), tags(["ll"], sizes))
    keys = []
    for q, tagged in ((1, letters), (2, pairs)):
        t = F.col(f"t{q}")
        prefix = lambda size: F.slice(f"g{q}", F.lit(1), F.greatest(F.size(f"g{q}") - t + size, F.lit(0)))  # noqa: B023, E731
        single = F.when(t >= 2, tagged([ordered("2", "1")])).otherwise(tagged([ordered("1", "1"), ordered("1", "2")]))
        double = F.when(t >= 2, tagged([ordered("2", "2")]))
        keys += [_hashed(prefix(1), single), _hashed(_pairs(prefix(2)), double)]
    return side.select("name", "g1", "g2", F.explode(F.array_distinct(F.flatten(F.array(*keys)))).alias("key"))


def _promise(length: int, q: int, cutoff: float) -> int:
    """``_least_shared`` of a number."""
    return min(x - (q - 1) - q * int((1 - cutoff) * x + 1e-9) for x in range(length, int(length / cutoff + 1e-9) + 1))


def _pairs(items: Column) -> Column:
    """Both items of each pair of places, joined to one string."""
    rest = lambda i: F.slice(items, i + 2, F.size(items))
    return F.flatten(F.transform(items, lambda a, i: F.transform(rest(i), lambda b: F.concat_ws(" ", a, b))))


def _hashed(groups: Column, tags: Column) -> Column:
    """A key for each group under each tag; none where the tags are null."""
    keys = F.flatten(F.transform(tags, lambda t: F.transform(groups, lambda g: F.xxhash64(t, g))))
    return F.coalesce(keys, F.array().cast("array<bigint>"))


def candidates(index: NameIndex, cutoff: float, names: DataFrame | None = None) -> DataFrame:
    """``name, match`` once for each pair that may be similar enough; edits are not counted yet."""
    left, right = index.side(False), index.side(True)
    if names is not None:
        left = left.join(small(names.select("name")), "name", "left_semi")
    right = _keys(right, cutoff, True).withColumnsRenamed({"name": "match", "g1": "h1", "g2": "h2"})
    longer = F.greatest(F.length("name"), F.length("match"))
    near = F.least(F.length("name"), F.length("match")) >= longer - _edits(longer, cutoff)
    share = lambda q: F.size(F.array_intersect(f"g{q}", f"h{q}")) >= _shared(longer, q, cutoff)
    return _keys(left, cutoff, False).join(right, "key").where(near & share(1) & share(2)).select("name", "match").distinct()


def _scored(pairs: DataFrame, cutoff: float) -> DataFrame:
    return pairs.withColumn("score", similarity(F.col("name"), F.col("match"))).where(F.col("score") >= cutoff - 1e-12)


def similar_pairs(names: DataFrame, known: DataFrame, cutoff: float) -> DataFrame:
    """``name, match, score`` of all pairs of ``names`` (name) and ``known`` (match) at least that similar.

    Null and empty names have no pairs. From a cutoff of about 0.5 on bigrams
    find the pairs of names of six letters and more; below it letters alone do,
    which most pairs of names share, so that few pairs are left out.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("a cutoff is above 0 and at most 1")
    return _scored(candidates(NameIndex(names, known), cutoff), cutoff)


def most_similar(names: DataFrame, known: DataFrame, cutoff: float = 0.4, most: int = 5) -> DataFrame:
    """``name, match, score, k``: the ``most`` most similar known names of each name, from the cutoff on (ties: the smaller).

    Searches begin at a high similarity, where the index leaves few candidates.
    A name that has ``most`` matches there is done, as any other is less similar;
    only the others go on with a lower one, the last of them down to ``cutoff``.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("a cutoff is above 0 and at most 1")
    index = NameIndex(names, known)
    best = Window.partitionBy("name").orderBy(F.desc("score"), "match")
    open_, done = None, None
    for level in [x for x in LEVELS if x > cutoff] + [cutoff]:
        found = _scored(candidates(index, level, open_), level).withColumn("k", F.row_number().over(best)).where(F.col("k") <= most)
        found = checkpointed(found)
        full = found.where(F.col("k") == most).select("name")
        last = level == cutoff
        kept = found if last else found.join(small(full), "name", "left_semi")
        done = kept if done is None else done.unionByName(kept)
        if not last:
            open_ = checkpointed((index.side(False).select("name") if open_ is None else open_).join(small(full), "name", "left_anti"))
            if open_.isEmpty():
                break
    return done
