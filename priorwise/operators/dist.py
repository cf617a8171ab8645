"""Stored forecast distributions: quantile grids, samples, mixtures and draws, read as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorwise.functions.maths import interp, once, running_max


def hurdle_cdf(x: Column, p_zero: Column, qs: Column, values: Column) -> Column:
    """F(x) of a count that is 0 with p_zero and else has the quantile grid (levels qs, rising values)."""
    inside = interp(x, values, qs)
    return F.when(x < 0, 0.0).when(x < 1, p_zero).otherwise(p_zero + (1 - p_zero) * inside)


def hurdle_over(line: Column, p_zero: Column, qs: Column, values: Column) -> Column:
    return 1 - hurdle_cdf(line, p_zero, qs, values)


def hurdle_quantile(q: Column, p_zero: Column, qs: Column, values: Column) -> Column:
    return F.when(q <= p_zero, F.lit(0.0)).otherwise(interp((q - p_zero) / (1 - p_zero), qs, values))


def sample_cdf(x: Column, samples: Column) -> Column:
    """Share of samples at or below x."""
    return F.size(F.filter(samples, lambda s: s <= x)) / F.size(samples)


def sample_over(line: Column, samples: Column, p_zero: Column) -> Column:
    """Probability above a line; below 1 it is that of not being zero."""
    return F.when(line < 1, 1 - p_zero).otherwise(1 - sample_cdf(line, samples))


def sample_quantile(q: Column, samples: Column) -> Column:
    """Linear between the sorted samples."""
    s = F.array_sort(samples)
    at = q * (F.size(samples) - 1)
    k = F.floor(at).cast("int")
    low, high = F.get(s, k), F.get(s, F.least(k + 1, F.size(samples) - 1))
    return low + (high - low) * (at - k)


def duration_cdf(t: Column, p_full: Column, qs: Column, values: Column, end: Column) -> Column:
    """F(t) of a duration that lasts to ``end`` with p_full and else ends by the quantile grid."""
    return F.when(t >= end, 1.0).when(t < 0, 0.0).otherwise((1 - p_full) * interp(t, values, qs))


def duration_quantile(q: Column, p_full: Column, qs: Column, values: Column, end: Column) -> Column:
    """Quantile of the same; from 1 - p_full on it is the end."""
    return F.when(q >= 1 - p_full, end).otherwise(F.least(interp(q / (1 - p_full), qs, values), end))


def duration_cdf_with_boundaries(t: Column, p_full: Column, qs: Column, values: Column, end: Column, mass: Column, boundaries: Column) -> Column:
    """``duration_cdf`` where the share ``mass`` of the early ends falls on the boundaries (rising, below the end), evenly."""
    n = F.size(boundaries)
    share = F.when(n > 0, mass).otherwise(F.lit(0.0))

    def law(t: Column) -> Column:
        passed = F.aggregate(boundaries, F.lit(0.0), lambda acc, b: acc + (b <= t).cast("double"))
        early = (1 - share) * interp(t, values, qs) + share * passed / F.greatest(n, F.lit(1))
        return F.when(t >= end, 1.0).when(t < 0, 0.0).otherwise((1 - p_full) * early)

    return once(t, law)


def duration_quantile_with_boundaries(q: Column, p_full: Column, qs: Column, values: Column, end: Column, mass: Column, boundaries: Column) -> Column:
    """The least t at which that law reaches q: on a boundary's atom, between two of them by the grid, or at the end.

    Between boundaries the atoms passed are constant, so the grid is inverted
    for what is left of q. The grid is read once at each edge.
    """
    n = F.size(boundaries)
    share = F.when(n > 0, mass).otherwise(F.lit(0.0))
    edges = F.concat(F.array(F.lit(0.0)), boundaries, F.array(end))

    def least(v: Column) -> Column:
        left = 1 - v["p"]

        def found(at: Column) -> Column:
            def within(low: Column, k: Column) -> Column:
                passed = v["share"] * k / F.greatest(n, F.lit(1))
                early = lambda k: left * ((1 - v["share"]) * F.get(at, k) + passed)
                reached = F.when(low >= end, 1.0).otherwise(early(k))  # just below the next edge it is early(k + 1)
                high = F.get(v["edges"], k + 1)
                inside = interp((v["q"] / left - passed) / (1 - v["share"]), qs, values)
                return F.when(k > n, F.lit(None)).when(reached >= v["q"], low).when(early(k + 1) >= v["q"], F.least(F.greatest(inside, low), high))

            return F.least(F.coalesce(F.array_min(F.transform(v["edges"], within)), end), end)

        return F.when(v["q"] > left, end).otherwise(once(F.transform(v["edges"], lambda e: interp(e, values, qs)), found))

    return once(F.struct(q.alias("q"), p_full.alias("p"), share.alias("share"), edges.alias("edges")), least)


def mixture(weights: Column, cdfs: Column) -> Column:
    """Weighted sum of component values."""
    return F.aggregate(F.zip_with(weights, cdfs, lambda w, f: w * f), F.lit(0.0), lambda acc, x: acc + x)


def inverse_on_grid(levels: Column, grid: Column, cdf: Column, ceiling: Column | None = None) -> Column:
    """Quantiles at the levels from a CDF on a grid, repaired to rise and scaled to end at one.

    With a ceiling the law is that of values at or below it: the CDF is scaled
    to reach one there.
    """
    capped = lambda x: x if ceiling is None else F.least(x, ceiling)

    def at_levels(law: Column) -> Column:
        top = F.array_max(law["up"]) if ceiling is None else interp(ceiling, law["grid"], law["up"])
        return once(top, lambda top: F.transform(levels, lambda q: capped(interp(q * top, law["up"], law["grid"]))))

    return once(F.struct(running_max(cdf).alias("up"), grid.alias("grid")), at_levels)


def curve(df: DataFrame, keys: Sequence[str], points: Column, cdf) -> DataFrame:
    """One row for each key and point with F(point); ``cdf`` maps a column to one."""
    rows = df.withColumn("x", F.explode(points))
    return rows.select(*keys, "x", cdf(F.col("x")).alias("cdf"))


def event_probability(draws: DataFrame, contest: str, conditions: dict[str, Column]) -> DataFrame:
    """Probability of each condition among the draws of a contest."""
    return draws.groupBy(contest).agg(*(F.avg(c.cast("double")).alias(n) for n, c in conditions.items()), F.count("*").alias("n_draws"))


def joint_legs(draws: DataFrame, contest: str, draw: str, legs: Sequence[Column], payout: float) -> DataFrame:
    """Joint hit rate of legs in shared draws, product of their own rates, expected value and stake share."""
    every = legs[0]
    for leg in legs[1:]:
        every = every & leg
    single = [F.avg(leg.cast("double")) for leg in legs]
    product = single[0]
    for s in single[1:]:
        product = product * s
    out = draws.groupBy(contest).agg(F.avg(every.cast("double")).alias("joint"), product.alias("product"))
    ev = F.col("joint") * payout - 1
    stake = F.greatest(ev / (payout - 1), F.lit(0.0))
    verdict = F.when(ev > 0.05, "PLAY").when(ev > 0, "LEAN").otherwise("PASS")
    return out.select(contest, "joint", "product", (F.col("joint") - F.col("product")).alias("adjustment"), ev.alias("ev"), F.lit(1 / payout).alias("break_even"), stake.alias("stake"), verdict.alias("verdict"))


def stratum_quantiles(train: DataFrame, strata: Sequence[str], value: str, levels: Sequence[float], weight: str | None = None) -> DataFrame:
    """Quantile grid of the training values of each stratum, with the levels; whole weights may repeat rows."""
    grid = F.percentile(value, list(levels), F.col(weight) if weight else F.lit(1))
    return train.groupBy(*strata).agg(F.array(*(F.lit(float(q)) for q in levels)).alias("qs"), grid.alias("qv"), F.count(value).alias("n"))
