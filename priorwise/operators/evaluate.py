"""Evaluation of probability forecasts: tables with p and y, as grouped aggregates.

``by`` names grouping columns and may be empty. Rows with a null p or y say
nothing and are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorwise.functions.maths import wilson
from priorwise.operators.sized import small

_EPS = 1e-15


#: fixed values: coefficients of the published rational Chebyshev fit of erfc, good to 1.2e-7 of its value
ERFC_FIT = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution; Spark SQL has no error function."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    fit = F.lit(0.0)
    for c in reversed(ERFC_FIT):
        fit = fit * t + c
    half = 0.5 * t * F.exp(-x * x + fit)
    return F.when(z >= 0, half).otherwise(1 - half)


def log_loss(p: Column, y: Column, eps: float = _EPS) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return -F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))


def winner_metrics(df: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    """n, accuracy at p > 1/2, log loss and Brier score."""
    P, Y = F.col(p), F.col(y)
    return df.where(P.isNotNull() & Y.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(((P > 0.5) == (Y == 1)).cast("double")).alias("accuracy"),
        F.avg(log_loss(P, Y)).alias("log_loss"),
        F.avg((P - Y) * (P - Y)).alias("brier"),
    )


def auroc(df: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    """Area under the ROC curve, ties count half; null if a class is missing. Rows are counted per score first."""
    scores = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, p).agg(F.sum(F.col(y)).cast("double").alias("pos"), F.count_if(F.col(y) == 0).cast("double").alias("neg"))
    w = Window.partitionBy(*by).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(w), F.lit(0.0))
    part = scores.withColumn("__u", F.col("pos") * (below + F.col("neg") / 2))
    return part.groupBy(*by).agg(F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), F.sum("__u") / F.sum("pos") / F.sum("neg")).alias("auroc"))


def bin_of(p: Column, bins: int, close_last: bool = True) -> Column:
    """Bin of a probability; p = 1 belongs to the last bin, or to none if it is left open."""
    k = F.floor(p * bins).cast("int")
    return F.when(p < 1, k).otherwise(F.lit(bins - 1) if close_last else F.lit(None).cast("int"))


def reliability(df: DataFrame, by: Sequence[str] = (), bins: int = 10, p: str = "p", y: str = "y", close_last: bool = True) -> DataFrame:
    """n, mean forecast and mean outcome of each bin that holds rows."""
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("bin", bin_of(F.col(p), bins, close_last))
    return rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def reliability_curve(df: DataFrame, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """Every bin with its centre; mean outcome is null where it is empty."""
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), ((F.col("id") + 0.5) / bins).alias("centre"))
    return grid.join(reliability(df, (), bins, p, y), "bin", "left").select("bin", "centre", F.coalesce("n", F.lit(0)).alias("n"), "mean_y")


def ece(df: DataFrame, by: Sequence[str] = (), bins: int = 10, p: str = "p", y: str = "y", close_last: bool = True) -> DataFrame:
    """Expected calibration error; rows outside all bins stay in n."""
    r = reliability(df, by, bins, p, y, close_last)
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y")))
    return r.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def murphy(df: DataFrame, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """Uncertainty, reliability and resolution, Brier score, skill, and what the three terms leave unexplained."""
    r = reliability(df, (), bins, p, y)
    base = winner_metrics(df, (), p, y).select("brier")
    rate = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).agg(F.avg(y).alias("rate"))
    rows = r.crossJoin(F.broadcast(rate))  # one row
    terms = rows.groupBy("rate").agg(
        (F.sum(F.col("n") * F.pow(F.col("mean_p") - F.col("mean_y"), 2)) / F.sum("n")).alias("reliability"),
        (F.sum(F.col("n") * F.pow(F.col("mean_y") - F.col("rate"), 2)) / F.sum("n")).alias("resolution"),
    )
    unc = F.col("rate") * (1 - F.col("rate"))
    return terms.crossJoin(base).select(
        unc.alias("uncertainty"), "reliability", "resolution", "brier", F.when(unc > 0, 1 - F.col("brier") / unc).alias("skill"),
        (F.col("brier") - unc - F.col("reliability") + F.col("resolution")).alias("residual"),
    )


def class_metrics(df: DataFrame, classes: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """One-vs-rest Brier score, calibration error and rate of each class; probabilities are columns named as the classes."""
    pairs = ", ".join(f"'{c}', {c}" for c in classes)
    long = df.select(F.col(label).alias("__label"), F.expr(f"stack({len(classes)}, {pairs}) as (cls, p)")).withColumn("y", (F.col("__label") == F.col("cls")).cast("int"))
    base = winner_metrics(long, ["cls"]).select("cls", "n", "brier")
    rate = long.groupBy("cls").agg(F.avg("y").alias("rate"))
    return base.join(ece(long, ["cls"], bins), "cls").join(rate, "cls")


def bootstrap(df: DataFrame, key: str, reps: int = 200, level: float = 0.95, seed: int = 7, p: str = "p", y: str = "y") -> DataFrame:
    """Percentile interval of the Brier score by Poisson weights from hashed keys, alike for any partitioning.

    Each row meets every replicate inside one aggregation with map-side sums.
    """
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(key, ((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("loss"))
    rep = rows.select("loss", key, F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    u = (F.pmod(F.xxhash64(key, "rep", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    cdf, term, weight = 0.0, math.exp(-1), F.lit(0)
    for k in range(12):
        cdf += term
        weight = weight + (u > cdf).cast("int")
        term /= k + 1
    scores = rep.withColumn("w", weight).groupBy("rep").agg((F.sum(F.col("w") * F.col("loss")) / F.sum("w")).alias("score"))
    tail = (1 - level) / 2
    return scores.agg(F.percentile("score", tail).alias("low"), F.percentile("score", 1 - tail).alias("high"), F.avg("score").alias("mean"))


def rare_pooled(df: DataFrame, label: str, least: int = 30, other: str = "Other") -> DataFrame:
    """``df`` with labels of fewer than ``least`` rows replaced; a null label stays null."""
    sizes = df.groupBy(label).agg((F.count("*") >= least).alias("__large"))
    joined = df.join(small(sizes), label, "left")
    return joined.withColumn(label, F.when(F.col("__large") | F.col(label).isNull(), F.col(label)).otherwise(F.lit(other))).select(*df.columns)


def slices(df: DataFrame, labels: Column, p: str = "p", y: str = "y", least: int = 50, worst: float = 0.255, z: float = 1.959963984540054) -> DataFrame:
    """Metrics of every slice a row belongs to (array of labels), with an interval of the Brier score.

    The interval is that of a mean, which a bootstrap of the rows tends to. Large
    slices with a score above ``worst`` are flagged; a flag is ``noise`` where
    the interval reaches down to ``worst``.
    """
    long = df.withColumn("slice", F.explode(labels))
    loss = (F.col(p) - F.col(y)) * (F.col(p) - F.col(y))
    half = long.where(loss.isNotNull()).groupBy("slice").agg((z * F.stddev_pop(loss) / F.sqrt(F.count(loss))).alias("__half"))
    out = winner_metrics(long, ["slice"], p, y).join(ece(long, ["slice"], 10, p, y), "slice").join(half, "slice")
    out = out.withColumns({"brier_low": F.col("brier") - F.col("__half"), "brier_high": F.col("brier") + F.col("__half"), "flagged": (F.col("n") >= least) & (F.col("brier") > worst)})
    return out.withColumn("noise", F.col("flagged") & (F.col("brier_low") <= worst)).drop("__half")


def pinball(q: Column, value: Column, y: Column) -> Column:
    return F.when(y >= value, q * (y - value)).otherwise((1 - q) * (value - y))


def crps_quantiles(qs: Column, values: Column, y: Column) -> Column:
    """Score of a quantile grid: twice the pinball losses weighted by the steps of the grid."""
    steps = F.sequence(F.lit(1), F.size(qs) - 1)
    part = lambda i: pinball(F.get(qs, i - 1), F.get(values, i - 1), y) * (F.get(qs, i) - F.get(qs, i - 1))
    return 2 * F.aggregate(F.transform(steps, part), F.lit(0.0), lambda acc, x: acc + x)


def crps_samples(samples: Column, y: Column) -> Column:
    """Energy form over all samples; the pair term comes from the sorted samples."""
    n = F.size(samples).cast("double")
    near = F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + F.abs(x - y)) / n
    ranked = F.transform(F.array_sort(samples), lambda x, i: x * (2 * (i + 1) - n - 1))
    return near - F.aggregate(ranked, F.lit(0.0), lambda acc, x: acc + x) / (n * n)


def hashed_uniform(key: Column, seed: int = 1) -> Column:
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def pit(low: Column, high: Column, key: Column | None = None, seed: int = 1) -> Column:
    """Probability integral transform between F(y-) and F(y); without a key the middle."""
    return low + (high - low) * (hashed_uniform(key, seed) if key is not None else F.lit(0.5))


def hurdle_pit(y: Column, p_zero: Column, cdf, u: Column, top: Column | None = None) -> Column:
    """Transform of a law with an atom at 0 and, with ``top``, one there; ``cdf`` maps a column to F, ``u`` is uniform.

    At 0 it is uniform below F(0), at or beyond the top uniform above F(top-),
    which is what the law's continuous part has reached; between them it is F(y).
    """
    inside = F.when(y <= 0, u * p_zero).otherwise(cdf(y))
    return inside if top is None else F.when(y >= top, cdf(top) + u * (1 - cdf(top))).otherwise(inside)


def discrete_pit(y: Column, cdf, u: Column) -> Column:
    """Transform of a sum of whole numbers whose smooth law is ``cdf``: uniform between F(y - 1/2) and F(y + 1/2)."""
    low, high = cdf(y - 0.5), cdf(y + 0.5)
    return low + u * (high - low)


def conditional_pit(value: Column, p_first: Column, is_first: Column) -> Column:
    """Transform of a two-part mixture within its part: first part below ``p_first``, the other above."""
    floor = F.lit(1e-6)
    inside = F.when(is_first, value / F.greatest(p_first, floor)).otherwise((value - p_first) / F.greatest(1 - p_first, floor))
    return F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0))


def ks_uniform(df: DataFrame, by: Sequence[str], u: str, least: int = 20) -> DataFrame:
    """Kolmogorov-Smirnov statistic against the uniform law for each group, and its asymptotic p-value."""
    values = df.where(F.col(u).isNotNull()).groupBy(*by, u).agg(F.count("*").alias("__k"))
    w = Window.partitionBy(*by)
    upto = F.sum("__k").over(w.orderBy(u))
    rows = values.withColumns({"__hi": upto, "__lo": upto - F.col("__k"), "n": F.sum("__k").over(w)})
    gap = F.greatest(F.col("__hi") / F.col("n") - F.col(u), F.col(u) - F.col("__lo") / F.col("n"))
    out = rows.groupBy(*by).agg(F.first("n").alias("n"), F.max(gap).alias("ks")).where(F.col("n") >= least)
    t = F.sqrt("n") * F.col("ks")
    tail = sum((2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * t * t) for k in range(1, 41)), F.lit(0.0))
    return out.withColumn("p_value", F.when(t < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0))))


def pit_histogram(df: DataFrame, u: str, bins: int = 20) -> DataFrame:
    return df.where(F.col(u).isNotNull()).groupBy(F.least(F.floor(F.col(u) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def threshold_grid(df: DataFrame, thresholds: Sequence[float], p: str, hit: str, price: str) -> DataFrame:
    """Bets, hits and flat return of rows whose forecast beats the price by each threshold."""
    grid = F.array(*(F.lit(float(t)) for t in thresholds))
    rows = df.select(p, hit, price, F.explode(F.filter(grid, lambda t: F.col(p) - F.col(price) >= t)).alias("threshold"))
    gain = F.when(F.col(hit) == 1, 1 / F.col(price) - 1).otherwise(F.lit(-1.0))
    return rows.groupBy("threshold").agg(F.count("*").alias("n"), F.avg(hit).alias("hit_rate"), F.avg(gain).alias("roi"))


def parlays(df: DataFrame, event: str, hit: str) -> DataFrame:
    """Number of pairs and triples of an event's rows, and of those all of which hit, in closed form."""
    g = df.groupBy(event).agg(F.count("*").alias("n"), F.sum(hit).cast("long").alias("k"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    three = lambda c: F.col(c) * (F.col(c) - 1) * (F.col(c) - 2) / 6
    return g.select(event, "n", "k", *(f(c).cast("long").alias(name) for f, c, name in ((two, "n", "pairs"), (two, "k", "pair_hits"), (three, "n", "triples"), (three, "k", "triple_hits"))))


def pick_record(df: DataFrame, by: Sequence[str], p: str, y: str, confident: float = 0.6, break_even: float = 0.5, least: int = 30, z: float = 1.959963984540054) -> DataFrame:
    """Picks of either side that are confident enough, their hit rate with its Wilson interval, and whether it is proven to pay.

    A pick is over where p reaches ``confident``, under where 1 - p does. It is
    proven with at least ``least`` picks whose interval lies above ``break_even``.
    """
    over, under = F.col(p) >= confident, 1 - F.col(p) >= confident
    won = F.when(over, F.col(y)).when(under, 1 - F.col(y))
    out = df.groupBy(*by).agg(F.count(won).alias("picks"), F.avg(won.cast("double")).alias("pick_rate"))
    band = F.when(F.col("picks") > 0, wilson(F.col("pick_rate"), F.col("picks"), z))
    return out.select(*by, "picks", "pick_rate", band["low"].alias("low"), band["high"].alias("high"), F.coalesce((F.col("picks") >= least) & (band["low"] > break_even), F.lit(False)).alias("proven"))


def scorecard(df: DataFrame, group: str, lines: Sequence[float], value: str, p: str, least: int = 30) -> DataFrame:
    """For each group and line: how p ranks and calibrates 'value is over the line', its picks, and a tier for the group's line."""
    long = df.withColumn("line", F.explode(F.array(*(F.lit(float(x)) for x in lines)))).withColumn("y", (F.col(value) > F.col("line")).cast("int"))
    keys = [group, "line"]
    base = winner_metrics(long, keys, p, "y").select(*keys, "n", "brier")
    rate = long.groupBy(*keys).agg(F.var_pop("y").alias("base"))
    out = base.join(auroc(long, keys, p, "y"), keys).join(ece(long, keys, 8, p, "y"), keys).join(rate, keys)
    skill = F.when(F.col("base") > 0, 1 - F.col("brier") / F.col("base"))
    tier = F.when((F.col("n") >= least) & (skill > 0) & (F.col("auroc") > 0.55), "TRUST").when(F.col("auroc") > 0.5, "WATCH").otherwise("CUT")
    out = out.join(pick_record(long, keys, p, "y", least=least), keys)
    return out.select(*keys, "n", "auroc", "ece", skill.alias("skill"), tier.alias("tier"), "picks", "pick_rate", "low", "high", "proven")


def calibration_z(df: DataFrame, by: Sequence[str], p: str = "p", y: str = "y", least: int = 25, with_p: bool = True) -> DataFrame:
    """z of the hits against a sum of independent trials; flagged only with enough rows."""
    var = F.sum(F.col(p) * (1 - F.col(p)))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(y).cast("double").alias("hits"), F.sum(p).alias("expected"), var.alias("__v"))
    out = out.withColumn("z", F.when(F.col("__v") > 0, (F.col("hits") - F.col("expected")) / F.sqrt("__v"))).drop("__v")
    if with_p:
        out = out.withColumn("p_value", 2 * normal_tail(F.abs("z"))).withColumn("flagged", (F.col("n") >= least) & (F.col("p_value") < 0.05))
    return out


def gates(metrics: DataFrame, thresholds: dict[str, tuple[str, float]]) -> DataFrame:
    """metric, value, passes and all_pass; thresholds are (at least or at most, bound) by metric name."""
    names = list(thresholds)
    stacked = metrics.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', cast({n} as double)" for n in names) + ") as (metric, value)"))
    test = F.lit(None).cast("boolean")
    for n, (kind, bound) in thresholds.items():
        test = F.when(F.col("metric") == n, F.col("value") >= bound if kind == "min" else F.col("value") <= bound).otherwise(test)
    out = stacked.withColumn("passes", F.coalesce(test, F.lit(False)))
    return out.withColumn("all_pass", F.bool_and("passes").over(Window.partitionBy(F.lit(0))))  # a row for each metric


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Number of rows that break each rule (a condition that is true for bad rows), with rules never broken as 0."""
    return df.agg(*(F.count_if(c).alias(n) for n, c in rules.items())).select(
        F.expr(f"stack({len(rules)}, " + ", ".join(f"'{n}', {n}" for n in rules) + ") as (rule, n)")
    )


def forecast_rules(probs: Column | None = None, quantiles: Column | None = None, tail: float = 1e-9) -> dict[str, Column]:
    """Rules for ``violations``: rows that don't sum to one, quantiles that fall, and tails without width.

    A row's probabilities sum to one within 1e-4. The ends of a quantile grid are
    degenerate if the outer step is no wider than ``tail`` while the grid has
    width. A null array, or one with a null, breaks the rule ``null_*`` alone.
    """
    rules: dict[str, Column] = {}
    whole = lambda a: a.isNotNull() & ~F.exists(a, lambda x: x.isNull() | F.isnan(x.cast("double")))
    if probs is not None:
        total = F.aggregate(probs, F.lit(0.0), lambda acc, x: acc + x)
        rules |= {"null_probs": ~F.coalesce(whole(probs), F.lit(False)), "row_sum": F.coalesce(whole(probs) & (F.abs(total - 1) > 1e-4), F.lit(False)), "out_of_range": F.coalesce(whole(probs) & F.exists(probs, lambda x: (x < 0) | (x > 1)), F.lit(False))}
    if quantiles is not None:
        n = F.size(quantiles)
        falls = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(quantiles, i) < F.get(quantiles, i - 1))
        at = lambda i: F.get(quantiles, i)
        flat = (at(n - 1) - at(F.lit(0)) > tail) & ((at(F.lit(1)) - at(F.lit(0)) <= tail) | (at(n - 1) - at(n - 2) <= tail))
        rules |= {"null_quantiles": ~F.coalesce(whole(quantiles), F.lit(False)), "falling": F.coalesce(whole(quantiles) & falls, F.lit(False)), "flat_tail": F.coalesce(whole(quantiles) & (n > 1) & flat, F.lit(False))}
    return rules


def differences(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys on one side only and the largest difference of values of two score tables."""
    both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key, "full")
    one = F.col("x").isNull() | F.col("y").isNull()
    return both.agg(F.count("*").alias("n"), F.count_if(one).alias("unmatched"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_difference"))


def walk_forward(df: DataFrame, date: str, cutoffs: Sequence[str], months: int, p: str = "p", y: str = "y") -> DataFrame:
    """Metrics of the rows in (cutoff, cutoff + months] for each cutoff, and of all together (null cutoff)."""
    grid = F.array(*(F.lit(c).cast("date") for c in cutoffs))
    rows = df.withColumn("cutoff", F.explode(F.filter(grid, lambda c: (F.col(date) > c) & (F.col(date) <= F.add_months(c, months)))))
    P, Y = F.col(p), F.col(y)
    return rows.rollup("cutoff").agg(F.count("*").alias("n"), F.avg(((P > 0.5) == (Y == 1)).cast("double")).alias("accuracy"), F.avg((P - Y) * (P - Y)).alias("brier"))
