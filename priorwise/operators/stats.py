"""Statistics fitted on training rows and applied to all, and grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_moments(df: DataFrame, group: str, value: str, train: Column) -> DataFrame:
    """``df`` with median, mean and deviation of the group's training rows; groups without any get the overall ones."""
    v = F.when(train, F.col(value))
    stats = [F.percentile(v, 0.5), F.avg(v), F.stddev_samp(v)]
    names = ("median", "mean", "std")
    by_group = df.groupBy(group).agg(*(s.alias(f"__{n}") for s, n in zip(stats, names)))
    overall = df.agg(*(s.alias(f"__all_{n}") for s, n in zip(stats, names)))
    joined = df.join(by_group, group, "left").crossJoin(F.broadcast(overall))  # one row
    return joined.select(*df.columns, *(F.coalesce(f"__{n}", f"__all_{n}").alias(f"{value}_{n}") for n in names))


def imputed(value: str) -> Column:
    return F.coalesce(value, f"{value}_median")


def z_score(value: str) -> Column:
    return F.when(F.col(f"{value}_std") > 0, (F.col(value) - F.col(f"{value}_mean")) / F.col(f"{value}_std"))


def quantile_tiers(df: DataFrame, value: str, train: Column, tiers: int = 4, name: str = "tier") -> DataFrame:
    """Bin 0..tiers-1 by quantiles of the training rows; a bin includes its right end."""
    cuts = df.agg(F.percentile(F.when(train, F.col(value)), [k / tiers for k in range(1, tiers)]).alias("__cuts"))
    tier = F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, F.when(F.col(value).isNotNull(), tier)).drop("__cuts")  # one row


def train_percentile(df: DataFrame, group: str, value: str, train: Column, name: str = "percentile") -> DataFrame:
    """Share of the group's training values below each value; one half without training rows or for null.

    Rows are counted per distinct value first, so a popular group is not sorted row by row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count_if(train).alias("__n"))
    w = Window.partitionBy(group).orderBy(value)
    below = F.sum("__n").over(w) - F.col("__n")
    share = counts.withColumn("__share", F.when(F.sum("__n").over(Window.partitionBy(group)) > 0, below / F.sum("__n").over(Window.partitionBy(group))))
    joined = df.join(share.drop("__n"), [group, value], "left")
    return joined.select(*df.columns, F.coalesce("__share", F.lit(0.5)).alias(name))


def late_early_ratio(df: DataFrame, keys: Sequence[str], position: str, value: str, early: Sequence[int] = (1, 2), late: Sequence[int] = (4, 5)) -> DataFrame:
    """Mean at late positions over the mean at early ones (at least 1), within [0, 3]."""
    mean = lambda ks: F.avg(F.when(F.col(position).isin(*ks), F.col(value)))
    ratio = mean(late) / F.greatest(mean(early), F.lit(1.0))
    return df.groupBy(*keys).agg(F.greatest(F.least(ratio, F.lit(3.0)), F.lit(0.0)).alias("late_early"))


def position_pivot(df: DataFrame, keys: Sequence[str], position: str, values: Sequence[str], positions: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Sums by position as columns value_position, null where absent, and the decline value_last / value_first."""
    sums = [F.sum(F.when(F.col(position) == p, F.col(v))).alias(f"{v}_{p}") for v in values for p in positions]
    out = df.groupBy(*keys).agg(*sums)
    decline = [F.when(F.col(f"{v}_{positions[0]}") > 0, F.col(f"{v}_{positions[2]}") / F.col(f"{v}_{positions[0]}")).alias(f"{v}_decline") for v in values]
    return out.select("*", *decline)


def shrunk_record(total: Column, wins: Column, seen_wins: Column, seen: Column, k: float = 5.0) -> Column:
    """Win rate before the observed contests: totals less what was observed, not below 0, shrunk to one half."""
    n = F.greatest(total - seen, F.lit(0))
    w = F.least(F.greatest(wins - seen_wins, F.lit(0)), n)
    return (w + k / 2) / (n + k)


def edges(value: Column, points: Sequence[float]) -> Column:
    """Label of the right-closed range between the points that holds a value; null outside."""
    out = F.lit(None).cast("string")
    for low, high in zip(points[:-1], points[1:]):
        out = F.when((value > low) & (value <= high), F.lit(f"({low:g},{high:g}]")).otherwise(out)
    return out


def origin_and_line(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares slope through the origin beside slope and intercept of the free line."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()) if group is not None else df
    return rows.groupBy(*group).agg(
        (F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("origin_slope"),
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.count("*").alias("n"),
    )


def boundary_share(seconds: Column, planned: Column, length: int = 300, within: int = 30) -> Column:
    """1 if a time lies near a boundary between rounds, else 0; averages give the share."""
    inner = F.when(planned > 1, F.sequence(F.lit(1), planned - 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(inner, lambda r: F.abs(seconds - r * length) <= within).cast("double")


def residuals_by_class(df: DataFrame, cls: str, size: str, residual: str, least: int = 5, least_class: int = 10) -> DataFrame:
    """Mean residual for each class and quartile of ``size``; thin cells fall back to the class, thin classes to 0."""
    cuts = df.agg(F.percentile(size, [0.25, 0.5, 0.75]).alias("__cuts"))
    rows = df.crossJoin(F.broadcast(cuts)).withColumn("quartile", F.size(F.filter("__cuts", lambda c: c < F.col(size))))  # one row
    cells = rows.groupBy(cls, "quartile").agg(F.avg(residual).alias("__r"), F.count(residual).alias("n"))
    classes = rows.groupBy(cls).agg(F.when(F.count(residual) >= least_class, F.avg(residual)).alias("__c"))
    return cells.join(classes, cls).select(cls, "quartile", "n", F.coalesce(F.when(F.col("n") >= least, F.col("__r")), "__c", F.lit(0.0)).alias("mean_residual"))


def log_odds_gap(df: DataFrame, cls: str, y: str, p: str) -> DataFrame:
    """Logit of the observed rate minus logit of the mean forecast."""
    rate, mean = F.avg(y), F.avg(p)
    lo = lambda q: F.log(q / (1 - q))
    return df.groupBy(cls).agg(F.when((rate > 0) & (rate < 1), lo(rate) - lo(mean)).alias("gap"), F.count("*").alias("n"))


def rolling_prior(df: DataFrame, label: str, date: str, months: int = 36, least: int = 50, least_class: int = 5) -> DataFrame:
    """Shares of the labels over the last months if there are enough, else over all time."""
    end = df.agg(F.max(date).alias("__end"))
    rows = df.crossJoin(F.broadcast(end)).withColumn("__new", F.col(date) > F.add_months("__end", -months))  # one row
    counts = rows.groupBy(label).agg(F.count_if("__new").alias("__recent"), F.count("*").alias("__ever"))
    whole = Window.partitionBy(F.lit(0))
    enough = (F.sum("__recent").over(whole) >= least) & (F.min("__recent").over(whole) >= least_class)
    share = F.when(enough, F.col("__recent") / F.sum("__recent").over(whole)).otherwise(F.col("__ever") / F.sum("__ever").over(whole))
    return counts.select(label, share.alias("prior"), enough.alias("is_recent"))


def contingency(df: DataFrame, cls: str, size: str, flag: str) -> DataFrame:
    """Rate of a flag for each class and quartile of ``size``, and for each class over all (quartile -1)."""
    cuts = df.agg(F.percentile(size, [0.25, 0.5, 0.75]).alias("__cuts"), F.min(size).alias("__low"), F.max(size).alias("__high"))
    width = (F.col("__high") - F.col("__low")) / 4
    even = F.least(F.floor((F.col(size) - F.col("__low")) / F.when(width > 0, width)), F.lit(3)).cast("int")
    distinct = F.size(F.array_distinct("__cuts")) == 3
    quartile = F.when(distinct, F.size(F.filter("__cuts", lambda c: c < F.col(size)))).otherwise(F.coalesce(even, F.lit(0)))
    rows = df.crossJoin(F.broadcast(cuts)).withColumn("quartile", quartile)  # one row
    out = rows.groupingSets([[F.col(cls), F.col("quartile")], [F.col(cls)]], cls, "quartile").agg(F.avg(flag).alias("rate"), F.count("*").alias("n"))
    return out.select(cls, F.coalesce("quartile", F.lit(-1)).alias("quartile"), "rate", "n")


def calibration_factor(df: DataFrame, group: Sequence[str], actual: str, predicted: str) -> DataFrame:
    return df.groupBy(*group).agg((F.avg(actual) / F.avg(predicted)).alias("factor"))


def depth_near(levels: Column, ask: Column, within: float = 0.03) -> Column:
    """Sum of quantity times price of the book levels priced near the ask; levels are (price of the other side, quantity)."""
    near = F.filter(levels, lambda x: F.abs((1 - x["price"]) - ask) <= within)
    return F.aggregate(near, F.lit(0.0), lambda acc, x: acc + x["quantity"] * (1 - x["price"]))
