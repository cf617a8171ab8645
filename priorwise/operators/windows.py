"""Features of a row from strictly earlier rows of its entity.

Rows of an entity are ordered by ``order`` (one or more columns, the last of
which must be unique within the entity). Nulls are skipped by every aggregate
and a row never sees itself. All functions return columns, so that many
features share one sort in one ``select``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from priorwise.operators.sized import small


_AGGREGATES = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
_DAY_ZERO = "1970-01-01"


@dataclass(frozen=True)
class History:
    """How rows of an entity follow each other: partition, order and, for windows in time, a date."""

    by: tuple[str, ...]
    order: tuple[str, ...]
    date: str | None = None

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    @property
    def prior(self) -> WindowSpec:
        """All earlier rows."""
        return self.ordered.rowsBetween(Window.unboundedPreceding, -1)

    def last(self, n: int) -> WindowSpec:
        """The last n earlier rows."""
        return self.ordered.rowsBetween(-n, -1)

    @property
    def day(self) -> Column:
        return F.datediff(F.col(self.date), F.lit(_DAY_ZERO))

    @property
    def by_day(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(self.day)

    @property
    def earlier_today(self) -> WindowSpec:
        return Window.partitionBy(*self.by, F.col(self.date).cast("date")).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)


def expanding(h: History, value: Column, agg: str = "mean", min_periods: int = 1) -> Column:
    """Aggregate of all earlier rows; null below ``min_periods`` values."""
    out = _AGGREGATES[agg](value).over(h.prior)
    return out if min_periods <= 1 else F.when(F.count(value).over(h.prior) >= min_periods, out)


def rolling(h: History, value: Column, n: int, agg: str = "mean") -> Column:
    """Aggregate of the last n earlier rows; rows without a value take a place."""
    return _AGGREGATES[agg](value).over(h.last(n))


def seen(h: History) -> Column:
    """Number of earlier rows."""
    return (F.row_number().over(h.ordered) - 1).cast("long")


def seen_values(h: History, value: Column) -> Column:
    """Number of earlier rows with a value."""
    return F.count(value).over(h.prior)


def date_window(h: History, value: Column, days: int, agg: str = "mean") -> Column:
    """Aggregate of earlier rows dated at most ``days`` days before this one.

    Earlier rows of the same day count, later ones do not. That is no single
    frame but two disjoint ones, earlier days within reach and earlier rows of
    the day, whose aggregates are put together. Nothing outside the window
    enters a sum, so old extremes and NaN leave no trace. Rows of one day share
    their frame of earlier days.
    """
    days_before, today = h.by_day.rangeBetween(-days, -1), h.earlier_today
    if agg in ("max", "min"):
        pick, both = (F.max, F.greatest) if agg == "max" else (F.min, F.least)
        return both(pick(value).over(days_before), pick(value).over(today))
    n = F.count(value).over(days_before) + F.count(value).over(today)
    if agg == "count":
        return n
    total = F.coalesce(F.sum(value).over(days_before), F.lit(0.0)) + F.coalesce(F.sum(value).over(today), F.lit(0.0))
    return F.when(n > 0, total / n if agg == "mean" else total)


#: half-lives of a block of days that share a reference date
_BLOCK = 400


def decayed(h: History, value: Column, half_life: float) -> Column:
    """Mean of earlier rows with weights that halve every ``half_life`` days.

    The factor that belongs to the current date cancels, so weights may be taken
    relative to any date. Days are cut into blocks of 400 half-lives, and
    weights are relative to the end of their block, which no double underflows.
    A row takes the running sums at the last earlier row with a value: those of
    its block and the total of the block before. Older blocks weigh less than
    2 ** -400 of that row. All sums are running ones, linear in the rows.
    """
    span = _BLOCK * half_life
    block = F.floor(h.day / F.lit(float(span)))
    weight = F.when(value.isNotNull(), F.pow(F.lit(0.5), ((block + 1) * span - h.day) / half_life))
    inside = Window.partitionBy(*h.by, block).orderBy(*h.order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*h.by).orderBy(block).rangeBetween(-1, -1)
    upto = lambda x: F.sum(x).over(inside) + F.coalesce(F.sum(x).over(before), F.lit(0.0)) * 2.0**-_BLOCK
    state = F.struct(upto(weight * value).alias("sum"), upto(weight).alias("weight"))
    last = F.last(F.when(value.isNotNull(), state), ignorenulls=True).over(h.prior)
    return last["sum"] / last["weight"]


def weighted_sum(weights: dict[str, float]) -> Column:
    """Sum of columns times their weights, a null counting as 0 (such as damage taken by part of the body)."""
    return sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))


def gap_days(h: History) -> Column:
    """Days since the row before, at least 0."""
    return F.greatest(F.datediff(F.col(h.date), F.lag(h.date).over(h.ordered)), F.lit(0))


def change(h: History, value: Column) -> Column:
    return value - F.lag(value).over(h.ordered)


def slope(h: History, value: Column, n: int = 3) -> Column:
    """Least-squares slope over the last n earlier rows; null unless all n have a value."""
    frame = h.last(n)
    k = F.count(value).over(frame)
    if n == 3:
        lag = lambda i: F.lag(value, i).over(h.ordered)
        return F.when(k == 3, (lag(1) - lag(3)) / 2)
    xs = [F.lag(value, i).over(h.ordered) for i in range(n, 0, -1)]
    mean = sum(xs[1:], xs[0]) / n
    top = sum(((i - (n - 1) / 2) * (x - mean) for i, x in enumerate(xs)), F.lit(0.0))
    return F.when(k == n, top / sum((i - (n - 1) / 2) ** 2 for i in range(n)))


def recent_flag(h: History, condition: Column, days: int = 180) -> Column:
    """1 if the condition held in an earlier row of the last ``days`` days, else 0."""
    return F.coalesce(date_window(h, condition.cast("int"), days, "max"), F.lit(0))


def flavors(h: History, metrics: Sequence[str], days: int = 720, half_life: float = 365.0) -> list[Column]:
    """Career, last 3, last 5, date-window and decayed mean of each metric."""
    out = []
    for m in metrics:
        v = F.col(m).cast("double")
        out += [
            expanding(h, v).alias(f"{m}_ctd"),
            rolling(h, v, 3).alias(f"{m}_l3"),
            rolling(h, v, 5).alias(f"{m}_l5"),
            date_window(h, v, days).alias(f"{m}_2y"),
            decayed(h, v, half_life).alias(f"{m}_decay"),
        ]
    return out


def with_flavors(df: DataFrame, h: History, metrics: Sequence[str], days: int = 720, half_life: float = 365.0, chunk: int = 15) -> DataFrame:
    """``df`` with all flavors; metrics are taken in chunks so that generated code stays below its size limit."""
    for k in range(0, len(metrics), chunk):
        df = df.select("*", *flavors(h, metrics[k : k + chunk], days, half_life))
    return df


def flavors_long(df: DataFrame, h: History, metrics: Sequence[str], keys: Sequence[str], days: int = 720, half_life: float = 365.0) -> DataFrame:
    """The same flavors for hundreds of metrics: one row for each key and metric, windows by (entity, metric)."""
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    columns = list(dict.fromkeys([*keys, *h.by, *h.order, *([h.date] if h.date else [])]))
    long = df.select(*columns, F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)"))
    by_metric = History((*h.by, "metric"), h.order, h.date)
    return long.select(*keys, "metric", *flavors(by_metric, ["value"], days, half_life))


def lagged_range_mean(daily: DataFrame, date: str, value: str, days: int, min_periods: int = 20, fallback: float | None = None) -> DataFrame:
    """A daily series with ``prior_mean``: the value lagged by one date, averaged over ``days`` days.

    Below ``min_periods`` observations the expanding mean of the lagged series
    stands in, then ``fallback``. ``daily`` has one row a date, so the single
    window partition is as small as the calendar.
    """
    all_days = Window.orderBy(date)
    lagged = daily.withColumn("__lag", F.lag(value).over(all_days)).withColumn("__day", F.datediff(date, F.lit(_DAY_ZERO)))
    frame = Window.orderBy("__day").rangeBetween(-(days - 1), 0)
    near = F.when(F.count("__lag").over(frame) >= min_periods, F.avg("__lag").over(frame))
    ever = F.avg("__lag").over(all_days.rowsBetween(Window.unboundedPreceding, 0))
    return lagged.withColumn("prior_mean", F.coalesce(near, ever, F.lit(fallback))).drop("__lag", "__day")


def class_share(contests: DataFrame, by: str, date: str, condition: Column, rows: int = 2000, min_periods: int = 20) -> DataFrame:
    """One row for each class and date: share of the condition among about ``rows`` contests of earlier dates.

    The frame ends before the date, so no contest of the same day counts.
    """
    daily = contests.groupBy(by, date).agg(F.count_if(condition).alias("hits"), F.count("*").alias("n"))
    total = Window.partitionBy(by).orderBy(date)
    daily = daily.withColumn("upto", F.sum("n").over(total.rowsBetween(Window.unboundedPreceding, -1)))
    # whole days that lie within the last ``rows`` contests
    frame = Window.partitionBy(by).orderBy(F.coalesce("upto", F.lit(0)).cast("long")).rangeBetween(-rows, -1)
    n, hits = F.sum("n").over(frame), F.sum("hits").over(frame)
    return daily.select(by, date, F.when(n >= min_periods, hits / n).alias("share"))


def conditional_rate(h: History, other: str, value: Column, default: float = 0.5) -> Column:
    """Rate of earlier rows against the same kind of opponent."""
    return F.coalesce(expanding(History((*h.by, other), h.order, h.date), value), F.lit(default))


def chronological_rank(df: DataFrame, date: str, name: str = "event_rank") -> DataFrame:
    """0-based dense rank of dates; ranks are made on the distinct dates and joined back."""
    dates = df.select(date).distinct().where(F.col(date).isNotNull())
    ranked = dates.withColumn(name, (F.dense_rank().over(Window.orderBy(date)) - 1).cast("long"))
    return df.join(small(ranked), date, "left").select(*df.columns, name)


def is_group_max(group: str, value: str) -> Column:
    return F.col(value) == F.max(value).over(Window.partitionBy(group))


def position(group: str, order: str) -> Column:
    return F.row_number().over(Window.partitionBy(group).orderBy(order))


def with_sentinels(df: DataFrame, entity: str, order: str, date: str, keep: Sequence[str] = (), flags: Sequence[str] = ()) -> DataFrame:
    """``df`` and one row for each entity a day after its last: facts null, ``flags`` false, ``is_sentinel`` true.

    Running a causal build over it gives each entity's state as of now.
    """
    last = df.groupBy(entity).agg(F.max_by(F.struct(order, date, *keep), F.struct(date, order)).alias("last"))
    end = df.agg(F.max(order).alias("top"))
    made = {order: (F.col("top") + 1).cast(df.schema[order].dataType), date: F.date_add(F.col(f"last.{date}"), 1).cast(df.schema[date].dataType), entity: F.col(entity)}
    columns = []
    for f in df.schema.fields:
        if f.name in made:
            c = made[f.name]
        elif f.name in keep:
            c = F.col(f"last.{f.name}")
        elif f.name in flags:
            c = F.lit(False)
        else:
            c = F.lit(None).cast(f.dataType)
        columns.append(c.alias(f.name))
    sentinels = last.crossJoin(F.broadcast(end)).select(*columns, F.lit(True).alias("is_sentinel"))  # one row with the highest order
    return df.withColumn("is_sentinel", F.lit(False)).unionByName(sentinels)


def track_record(daily: DataFrame, date: str, hits: str, n: str) -> DataFrame:
    """Running hits and totals of a series of one row a date."""
    frame = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(date, F.sum(hits).over(frame).alias("hits"), F.sum(n).over(frame).alias("n")).withColumn("rate", F.col("hits") / F.col("n"))
