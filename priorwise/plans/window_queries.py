"""Queries of strictly prior features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.functions.maths import wilson
from priorwise.operators import pairs
from priorwise.operators import windows as w
from priorwise.plans.views import BY_CUSTOMER, FORECASTS_SQL, PERSPECTIVES_SQL, contests, forecasts, rounded, table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")


def causal_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, v = BY_CUSTOMER, F.col("o_totalprice")
    return _orders(spark, sf_dir).select(
        "o_orderkey",
        rounded(w.expanding(h, v), 4).alias("mean_prior"),
        rounded(w.expanding(h, v, "sum"), 4).alias("sum_prior"),
        rounded(w.expanding(h, v, "max"), 4).alias("max_prior"),
        rounded(w.expanding(h, v, "min", 3), 4).alias("min_prior_3"),
        w.seen(h).alias("n_prior"),
        w.seen_values(h, F.when(F.col("o_orderstatus") == "F", v)).alias("n_prior_f"),
    )


def causal_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, v = BY_CUSTOMER, F.col("o_totalprice")
    return _orders(spark, sf_dir).select(
        "o_orderkey",
        rounded(w.rolling(h, v, 3), 4).alias("mean_3"),
        rounded(w.rolling(h, v, 5, "max"), 4).alias("max_5"),
        rounded(w.rolling(h, F.when(F.col("o_orderstatus") == "F", v), 5), 4).alias("mean_f_5"),
    )


def causal_date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, v = BY_CUSTOMER, F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return _orders(spark, sf_dir).select(
        "o_orderkey",
        rounded(w.date_window(h, v, 365), 3).alias("mean_365"),
        rounded(w.date_window(h, v, 720, "sum"), 3).alias("sum_720"),
        rounded(w.date_window(h, v, 720, "max"), 3).alias("max_720"),
        rounded(w.date_window(h, v, 720, "min"), 3).alias("min_720"),
        w.date_window(h, v, 365, "count").alias("n_365"),
    )


def causal_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", rounded(w.decayed(BY_CUSTOMER, F.col("o_totalprice"), 365.0), 3).alias("decayed"))


def window_flavors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = w.with_flavors(_orders(spark, sf_dir), BY_CUSTOMER, ["o_totalprice"])
    return df.select("o_orderkey", *(rounded(F.col(f"o_totalprice_{k}"), 3).alias(k) for k in ("ctd", "l3", "l5", "2y", "decay")))


def window_flavors_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _orders(spark, sf_dir).withColumn("halves", F.col("o_totalprice") / 2)
    long = w.flavors_long(df, BY_CUSTOMER, ["o_totalprice", "halves"], ["o_orderkey"])
    return long.select("o_orderkey", "metric", *(rounded(F.col(f"value_{k}"), 3).alias(k) for k in ("ctd", "l3", "l5", "2y", "decay")))


def layoff_change_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, v = BY_CUSTOMER, F.col("o_totalprice")
    return _orders(spark, sf_dir).select(
        "o_orderkey",
        F.lag("o_orderdate").over(h.ordered).cast("date").alias("previous"),
        w.gap_days(h).cast("long").alias("gap"),
        rounded(w.change(h, v), 4).alias("change"),
        rounded(w.slope(h, v, 3), 4).alias("slope_3"),
        rounded(w.slope(h, v, 5), 4).alias("slope_5"),
    )


def recent_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", w.recent_flag(BY_CUSTOMER, F.col("o_orderstatus") == "P").cast("long").alias("flag"))


def daily_lagged_range_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _orders(spark, sf_dir).groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.avg("o_totalprice").alias("v"))
    return w.lagged_range_mean(daily, "day", "v", 365).select("day", rounded(F.col("v"), 3).alias("v"), rounded(F.col("prior_mean"), 3).alias("prior_mean"))


def class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = w.class_share(contests(spark, sf_dir), "class", "day", F.col("won_a") == 1)
    return shares.select("class", "day", rounded(F.col("share")).alias("share"))


_BY_ENTITY = w.History(("entity",), ("day", "contest_id"), "day")


def conditional_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pairs.perspectives(contests(spark, sf_dir))
    rate = w.conditional_rate(_BY_ENTITY, "class", F.col("won").cast("double"))
    return df.select("contest_id", "entity", rounded(rate).alias("rate"))


def referee_tendency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contest-level rate of a pool over three years before each contest."""
    h = w.History(("pool",), ("day", "contest_id"), "day")
    return contests(spark, sf_dir).select("contest_id", rounded(w.date_window(h, F.col("won_a").cast("double"), 3 * 365), 5).alias("tendency"))


def chrono_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _orders(spark, sf_dir).withColumn("day", F.col("o_orderdate").cast("date"))
    return w.chronological_rank(df, "day").select("o_orderkey", "day", "event_rank")


def group_max_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select(
        "o_orderkey",
        w.is_group_max("o_orderdate", "o_orderkey").alias("is_main"),
        w.position("o_orderdate", "o_orderkey").cast("long").alias("slot"),
    )


def sentinel_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    h = BY_CUSTOMER
    v = F.col("o_totalprice")
    return (
        w.with_sentinels(df, "o_custkey", "o_orderkey", "o_orderdate")
        .withColumns({"state_mean": rounded(w.expanding(h, v), 3), "state_last3": rounded(w.rolling(h, v, 3), 3), "n": w.seen(h)})
        .where("is_sentinel")
        .select("o_custkey", F.col("o_orderdate").cast("date").alias("as_of"), "state_mean", "state_last3", "n")
    )


def track_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir)
    daily = f.groupBy("day").agg(F.count_if((F.col("p") > 0.5) == (F.col("y") == 1)).alias("hits"), F.count("*").alias("n"))
    out = w.track_record(daily, "day", "hits", "n")
    band = wilson(F.col("rate"), F.col("n"))
    return out.select("day", "hits", "n", rounded(F.col("rate")).alias("rate"), rounded(band["low"]).alias("low"), rounded(band["high"]).alias("high"))


QUERIES = {
    f.__name__: f
    for f in (
        causal_expanding, causal_rolling, causal_date_window, causal_decay, window_flavors, window_flavors_long, layoff_change_slope, recent_flag,
        daily_lagged_range_mean, class_share, conditional_rate, referee_tendency, chrono_rank, group_max_flag, sentinel_state, track_record,
    )
}

_PRIOR = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LAST = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
_EARLIER = "FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND (b.o_orderdate, b.o_orderkey) < (a.o_orderdate, a.o_orderkey)"
_DECAY = """(SELECT a.o_orderkey, sum(b.o_totalprice * power(0.5, date_diff('day', b.o_orderdate, a.o_orderdate) / 365.0))
        / sum(power(0.5, date_diff('day', b.o_orderdate, a.o_orderdate) / 365.0)) AS decayed {} GROUP BY a.o_orderkey)""".format(_EARLIER)
_FLAVORS = """
    SELECT o_orderkey, avg(v) {prior} AS ctd, avg(v) {l3} AS l3, avg(v) {l5} AS l5,
           (SELECT avg(b.o_totalprice * {f}) FROM orders b WHERE b.o_custkey = a.o_custkey AND (b.o_orderdate, b.o_orderkey) < (a.o_orderdate, a.o_orderkey)
              AND b.o_orderdate >= a.o_orderdate - INTERVAL 720 DAY) AS y2, d.decayed * {f} AS decay
    FROM (SELECT *, o_totalprice * {f} AS v FROM orders) a JOIN d USING (o_orderkey)"""
_FLAVOR = lambda f: _FLAVORS.format(prior=_PRIOR, l3=_LAST.format(3), l5=_LAST.format(5), f=f)
_ROUND = ", ".join(f'round({a}, 3) AS "{b}"' for a, b in (("ctd", "ctd"), ("l3", "l3"), ("l5", "l5"), ("y2", "2y"), ("decay", "decay")))

ORACLE_SQL = {
    "causal_expanding": f"""
        SELECT o_orderkey, round(avg(o_totalprice) {_PRIOR}, 4) AS mean_prior, round(sum(o_totalprice) {_PRIOR}, 4) AS sum_prior,
               round(max(o_totalprice) {_PRIOR}, 4) AS max_prior,
               round(CASE WHEN count(o_totalprice) {_PRIOR} >= 3 THEN min(o_totalprice) {_PRIOR} END, 4) AS min_prior_3,
               count(*) {_PRIOR} AS n_prior, count(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) {_PRIOR} AS n_prior_f
        FROM orders""",
    "causal_rolling": f"""
        SELECT o_orderkey, round(avg(o_totalprice) {_LAST.format(3)}, 4) AS mean_3, round(max(o_totalprice) {_LAST.format(5)}, 4) AS max_5,
               round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) {_LAST.format(5)}, 4) AS mean_f_5
        FROM orders""",
    "causal_date_window": f"""
        WITH j AS (
            SELECT a.o_orderkey, CASE WHEN b.o_orderstatus <> 'P' THEN b.o_totalprice END AS v, date_diff('day', b.o_orderdate, a.o_orderdate) AS age {_EARLIER})
        SELECT o_orderkey, round(avg(v) FILTER (age <= 365), 3) AS mean_365, round(sum(v) FILTER (age <= 720), 3) AS sum_720,
               round(max(v) FILTER (age <= 720), 3) AS max_720, round(min(v) FILTER (age <= 720), 3) AS min_720, count(v) FILTER (age <= 365) AS n_365
        FROM j GROUP BY o_orderkey""",
    "causal_decay": f"SELECT o_orderkey, round(decayed, 3) AS decayed FROM {_DECAY}",
    "window_flavors": f"WITH d AS {_DECAY} SELECT o_orderkey, {_ROUND} FROM ({_FLAVOR(1)})",
    "window_flavors_long": f"""WITH d AS {_DECAY} SELECT o_orderkey, 'o_totalprice' AS metric, {_ROUND} FROM ({_FLAVOR(1)})
        UNION ALL SELECT o_orderkey, 'halves', {_ROUND} FROM ({_FLAVOR(0.5)})""",
    "layoff_change_slope": f"""
        WITH o AS (SELECT *, row_number() OVER w AS rn, lag(o_orderdate) OVER w AS prev, lag(o_totalprice) OVER w AS prev_v
                   FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
        SELECT o_orderkey, CAST(prev AS DATE) AS previous, greatest(date_diff('day', prev, o_orderdate), 0) AS gap,
               round(o_totalprice - prev_v, 4) AS change,
               round(CASE WHEN rn > 3 THEN regr_slope(o_totalprice, rn) {_LAST.format(3)} END, 4) AS slope_3,
               round(CASE WHEN rn > 5 THEN regr_slope(o_totalprice, rn) {_LAST.format(5)} END, 4) AS slope_5
        FROM o""",
    "recent_flag": f"""
        SELECT a.o_orderkey, CAST(coalesce(max(CASE WHEN b.o_orderstatus = 'P' THEN 1 ELSE 0 END)
            FILTER (date_diff('day', b.o_orderdate, a.o_orderdate) <= 180), 0) AS BIGINT) AS flag {_EARLIER} GROUP BY a.o_orderkey""",
    "daily_lagged_range_mean": """
        WITH daily AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS v FROM orders GROUP BY 1),
        l AS (SELECT *, lag(v) OVER (ORDER BY day) AS lv FROM daily)
        SELECT day, round(v, 3) AS v, round(coalesce(CASE WHEN count(lv) OVER r >= 20 THEN avg(lv) OVER r END, avg(lv) OVER (ORDER BY day)), 3) AS prior_mean
        FROM l WINDOW r AS (ORDER BY day RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND CURRENT ROW)""",
    "class_share": f"""
        WITH {PERSPECTIVES_SQL},
        daily AS (SELECT class, day, count(*) FILTER (won_a = 1) AS hits, count(*) AS n FROM contests GROUP BY ALL),
        u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY class ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM daily)
        SELECT a.class, a.day, round(CASE WHEN sum(b.n) >= 20 THEN sum(b.hits) / sum(b.n) END, 6) AS share
        FROM u a LEFT JOIN u b ON a.class = b.class AND b.upto BETWEEN a.upto - 2000 AND a.upto - 1 GROUP BY a.class, a.day""",
    "conditional_rate": f"""
        WITH {PERSPECTIVES_SQL}
        SELECT contest_id, entity, round(coalesce(avg(won) OVER (PARTITION BY entity, class ORDER BY day, contest_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5), 6) AS rate FROM ledger""",
    "referee_tendency": f"""
        WITH {PERSPECTIVES_SQL},
        n AS (SELECT *, date_diff('day', DATE '1970-01-01', day) AS d, won_a::DOUBLE AS v FROM contests),
        s AS (SELECT contest_id,
                 coalesce(sum(v) OVER p, 0) AS s1, count(v) OVER p AS n1, coalesce(sum(v) OVER o, 0) AS s0, count(v) OVER o AS n0
              FROM n WINDOW p AS (PARTITION BY pool ORDER BY day, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                            o AS (PARTITION BY pool ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND 1096 PRECEDING))
        SELECT contest_id, round(CASE WHEN n1 > n0 THEN (s1 - s0) / (n1 - n0) END, 5) AS tendency FROM s""",
    "chrono_rank": """
        SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, dense_rank() OVER (ORDER BY CAST(o_orderdate AS DATE)) - 1 AS event_rank FROM orders""",
    "group_max_flag": """
        SELECT o_orderkey, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_orderdate) AS is_main,
               row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS slot FROM orders""",
    "sentinel_state": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
        SELECT o_custkey, CAST(max(o_orderdate) AS DATE) + 1 AS as_of, round(avg(o_totalprice), 3) AS state_mean,
               round(avg(o_totalprice) FILTER (k <= 3), 3) AS state_last3, count(*) AS n FROM r GROUP BY o_custkey""",
    "track_record": """
        WITH {}, d AS (SELECT day, count(*) FILTER ((p > 0.5) = (y = 1)) AS h, count(*) AS m FROM forecasts GROUP BY day),
        t AS (SELECT day, sum(h) OVER (ORDER BY day)::BIGINT AS hits, sum(m) OVER (ORDER BY day)::BIGINT AS n FROM d),
        z AS (SELECT *, hits / n AS rate, 1.959963984540054 AS z FROM t)
        SELECT day, hits, n, round(rate, 6) AS rate,
               round((rate + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(rate * (1 - rate) / n + z * z / (4 * n * n)), 6) AS low,
               round((rate + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(rate * (1 - rate) / n + z * z / (4 * n * n)), 6) AS high
        FROM z""".format(FORECASTS_SQL),
}
