"""Contests as pairs of perspectives, and pairs as wide rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def perspectives(contests: DataFrame, sides: tuple[str, str] = ("a", "b"), measures: Sequence[str] = ("price", "quantity"), won: str = "won_a") -> DataFrame:
    """Two rows for each contest, one for each side, with the rival's measures beside the own.

    Side columns are named side_measure (``a_id``, ``a_price``). The label is
    turned round for the second side; other columns are kept.
    """
    a, b = sides
    sided = {f"{s}_{m}" for s in sides for m in ("id", *measures)} | {won}
    common = [c for c in contests.columns if c not in sided]

    def view(own: str, rival: str, label: Column) -> Column:
        parts = [F.col(f"{own}_id").alias("entity"), F.col(f"{rival}_id").alias("opponent"), label.alias("won")]
        parts += [F.col(f"{own}_{m}").alias(m) for m in measures] + [F.col(f"{rival}_{m}").alias(f"{m}_against") for m in measures]
        return F.struct(*parts)

    both = F.array(view(a, b, F.col(won)), view(b, a, 1 - F.col(won)))
    return contests.select(*common, F.explode(both).alias("v")).select(*common, "v.*")


def wide_pairs(long: DataFrame, contest: str, entity: str, features: Sequence[str], common: Sequence[str] = (), first: str | None = None) -> DataFrame:
    """One row for each contest with exactly two perspectives; features get ``_a`` and ``_b``.

    Side a is the entity in column ``first`` where that is given and one of
    the two, else the smaller one. One grouping does it, without a self-join.
    """
    side = F.struct(F.col(entity), *features)
    rows = long.groupBy(contest).agg(
        F.count("*").alias("__n"),
        F.min_by(side, entity).alias("__x"),
        F.max_by(side, entity).alias("__y"),
        *(F.first(c).alias(c) for c in common),
        *([F.first(first).alias("__first")] if first else []),
    )
    rows = rows.where("__n = 2")
    turned = F.coalesce(F.col("__first") == F.col(f"__y.{entity}"), F.lit(False)) if first else F.lit(False)
    a, b = F.when(turned, F.col("__y")).otherwise(F.col("__x")), F.when(turned, F.col("__x")).otherwise(F.col("__y"))
    rows = rows.select(contest, *common, a.alias("__a"), b.alias("__b"))
    return rows.select(contest, *common, *(F.col(f"__{s}.{c}").alias(f"{c}_{s}") for c in (entity, *features) for s in ("a", "b")))


def symmetrize(wide: DataFrame, label: str, signed: Sequence[str] = (), flag: str = "is_flipped") -> DataFrame:
    """The rows and their mirror images: ``_a`` and ``_b`` swapped, ``*_diff`` and signed columns negated, label turned."""
    names = set(wide.columns)

    def flipped(c: str) -> Column:
        if c == label:
            return (1 - F.col(c)).alias(c)
        if c.endswith("_a") and f"{c[:-2]}_b" in names:
            return F.col(f"{c[:-2]}_b").alias(c)
        if c.endswith("_b") and f"{c[:-2]}_a" in names:
            return F.col(f"{c[:-2]}_a").alias(c)
        if c.endswith("_diff") or c in signed:
            return (-F.col(c)).alias(c)
        return F.col(c)

    return wide.withColumn(flag, F.lit(False)).unionByName(wide.select(*map(flipped, wide.columns), F.lit(True).alias(flag)))


def perspective_average(scores: DataFrame, contest: str, p: str, flag: str = "is_flipped") -> DataFrame:
    """One probability for each contest: the mean of p and of 1 - p of the mirror image."""
    return scores.groupBy(contest).agg(F.avg(F.when(F.col(flag), 1 - F.col(p)).otherwise(F.col(p))).alias(p))


def gap(mu_a: Column, mu_b: Column, sigma_a: Column, sigma_b: Column) -> Column:
    """Difference of two ratings in units of their joint uncertainty."""
    s = F.sqrt(sigma_a * sigma_a + sigma_b * sigma_b)
    return F.when(s > 0, (mu_a - mu_b) / s)


def filled_difference(a: Column, b: Column, default: float) -> Column:
    return F.coalesce(a, F.lit(float(default))) - F.coalesce(b, F.lit(float(default)))


def pair_label(a: Column, b: Column) -> Column:
    return F.concat_ws("_", F.coalesce(a, F.lit("UNKNOWN")), F.coalesce(b, F.lit("UNKNOWN")))


def latest(states: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """Last row of each entity, by the order columns."""
    rest = [c for c in states.columns if c != entity]
    return states.groupBy(entity).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(entity, "s.*")


def pairings(pairs: DataFrame, states: DataFrame, entity: str, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """Feature rows of pairings that have not happened: the state of both sides, suffixed; unknown sides are null."""
    side = lambda s, key: states.select(F.col(entity).alias(key), *(F.col(c).alias(f"{c}_{s}") for c in states.columns if c != entity))
    return pairs.join(side("a", a), a, "left").join(side("b", b), b, "left")


def fill_from(df: DataFrame, source: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Nulls of the columns replaced by the source's value for the key (target -> source column)."""
    picked = source.groupBy(key).agg(*(F.first(c, ignorenulls=True).alias(f"__{t}") for t, c in columns.items()))
    joined = df.join(picked, key, "left")
    return joined.select(*(F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in df.columns))


def nearest_class(rows: DataFrame, value: str, classes: DataFrame, label: str, centre: str) -> DataFrame:
    """``label`` of the class with the nearest centre; of two equally near the smaller. ``classes`` is a small list."""
    held = F.array(*(F.struct(F.lit(float(c)).alias("centre"), F.lit(n).alias("label")) for c, n in sorted((r[centre], r[label]) for r in classes.select(centre, label).limit(1000).collect())))
    best = F.array_min(F.transform(held, lambda x: F.struct(F.abs(x["centre"] - F.col(value)).alias("d"), x["centre"].alias("centre"), x["label"].alias("label"))))
    return rows.withColumn(label, F.when(F.col(value).isNotNull(), best["label"]))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, for checks before a join."""
    return df.groupBy(*keys).count().where("count > 1")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key by the order columns."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__k", rank).where("__k = 1").drop("__k")
