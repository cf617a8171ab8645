"""Queries of forecasts with atoms, fitted blends, folds of time, re-grading and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.functions import cells
from priorwise.operators import calibrate, dist, evaluate, ledger, ml
from priorwise.operators.lineage import shared_folder
from priorwise.plans.views import FORECASTS_SQL, contests, forecasts, rounded, table
from priorwise.sources import files, pages


def mixed_pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms of line quantities against a law with atoms at both ends, and against one of whole numbers, with given uniforms."""
    li = table(spark, sf_dir, "lineitem")
    u = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 101 + 0.5) / 101.0
    y = F.least(F.greatest(F.col("l_quantity") - 10, F.lit(0.0)), F.lit(35.0))
    mixed = evaluate.hurdle_pit(y, F.lit(0.2), lambda x: 0.2 + 0.7 * x / 40, u, F.lit(35.0))
    whole = evaluate.discrete_pit(F.col("l_quantity"), lambda x: F.least(F.greatest(x / 51, F.lit(0.0)), F.lit(1.0)), u)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded(mixed).alias("mixed"), rounded(whole).alias("whole"))


def boundary_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A law of durations with atoms on its boundaries and at its end, read and inverted, and quantiles under a ceiling."""
    li = table(spark, sf_dir, "lineitem")
    numbers = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    law = (F.col("l_linenumber") / 10, numbers(0, 0.5, 1), numbers(0, 300, 900), F.lit(900.0), F.lit(0.2), numbers(300, 600))
    q = (F.col("l_orderkey") % 19 + 0.5) / 20
    under = dist.inverse_on_grid(numbers(0.25, 0.5, 0.9), numbers(0, 10, 20, 60), numbers(0, 0.3, 0.6, 1), F.col("l_quantity"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    read = li.select(*keys, dist.duration_cdf_with_boundaries(F.col("l_quantity") * 20, *law).alias("cdf"), dist.duration_quantile_with_boundaries(q, *law).alias("quantile"), under.alias("under"))
    return read.select(*keys, rounded(F.col("cdf")).alias("cdf"), rounded(F.col("quantile"), 4).alias("quantile"), *(rounded(F.get("under", F.lit(k)), 4).alias(n) for k, n in enumerate(("q25", "q50", "q90"))))


def blend_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three forecasts blended with the weights of least loss on even ids."""
    f = forecasts(spark, sf_dir).select("id", "p", "q", F.lit(0.15).alias("base"), "y")
    columns = ["p", "q", "base"]
    w = calibrate.blend_weights(f.where("id % 2 = 0"), columns)
    return f.select("id", calibrate.blended(columns, w).alias("blend"), *(F.lit(x).alias(f"w_{c}") for c, x in zip(columns, w)))


def time_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests scored by models of earlier contests only, a month apart, with weights that halve in a year."""
    rows = contests(spark, sf_dir).select("contest_id", "day", "a_quantity", "b_quantity", "won_a")
    return ml.out_of_time(rows, ["a_quantity", "b_quantity"], "won_a", "day", 5, 30, half_life=365.0).select("contest_id", "day", "fold", "score")


def regraded_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of orders by month, graded once, then graded again in two years with results that have changed."""
    path = f"{shared_folder(spark)}/graded-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders")
    log = o.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "A").otherwise("B").alias("predicted"), F.lit("pending").alias("status"), F.lit(None).cast("boolean").alias("correct"), F.date_format("o_orderdate", "yyyy-MM").alias("month")
    )
    results = lambda k: o.select("o_orderkey", F.when(F.col("o_orderkey") % k != 0, F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("B")).alias("winner"))
    files.write_table(ledger.grade_winners(log, results(5), "o_orderkey"), path, "month")
    months = [f"{y}-{m:02d}" for y in (1996, 1997) for m in range(1, 13)]
    again = lambda rows: ledger.grade_winners(rows, results(7), "o_orderkey", regrade=True)
    files.rewrite_days(spark, path, "month", months, again)
    files.rewrite_days(spark, path, "month", months, again)  # changes nothing
    return spark.read.parquet(path).select("o_orderkey", "predicted", "status", "correct", F.col("month").cast("string").alias("month"))


def history_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily and running totals of forecasts, a third of them replaced by live ones."""
    f = forecasts(spark, sf_dir).select("id", "day", F.when(F.col("status") == "resolved", F.col("y")).alias("hit"))
    live = f.where("id % 3 = 0").withColumn("hit", F.lit(1))
    out = ledger.history(f, live, "id", "day", "hit")
    return out.select("day", "n", F.col("live").cast("long").alias("live"), "resolved", "hits", "total_n", "total_resolved", "total_hits", rounded(F.col("rate")).alias("rate"))


def maker_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers above the bid that were filled, by market."""
    f = forecasts(spark, sf_dir).withColumns({"bid": F.col("q") - 0.015, "cost": F.col("q") - 0.005, "last": F.when(F.col("id") % 11 != 0, F.col("close"))})
    out = ledger.maker_stats(f, ["market"], "bid", "last", "y", "cost", "p")
    return out.select("market", "offers", "n", *(rounded(F.col(c)).alias(c) for c in ("hit_rate", "break_even", "realized", "claimed", "roi")))


def forecast_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rows of class probabilities and of quantile grids that orders stand for."""
    k = F.col("o_orderkey")
    probs = F.array((k % 10) / 10.0, 1 - (k % 10) / 10.0 + F.when(k % 13 == 0, 0.01).otherwise(0.0), F.when(k % 17 != 0, F.lit(0.0)))
    grid = F.array((k % 5).cast("double"), (k % 7).cast("double"), F.when(k % 19 != 0, (k % 9 + 3).cast("double")))
    return evaluate.violations(table(spark, sf_dir, "orders"), evaluate.forecast_rules(probs, grid))


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and labelled items of pages, which are made of parts."""
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    html = F.concat(
        F.when(k % 4 > 0, F.concat(F.lit("<span>Record: "), text(F.col("p_size")), F.lit("-"), text(k % 7), F.lit("-"), text(k % 3), F.lit(" (W-L-D)</span>"))).otherwise(""),
        F.lit("<ul><li><i>Size: </i></li><li>Reach: "), text(F.col("p_size") * 2), F.lit('.5</li><li class="x"> Share: '), text(k % 100), F.lit("%</li><li>Note: --</li></ul>"),
    )
    made = table(spark, sf_dir, "part").select("p_partkey", html.alias("html"))
    items = pages.labelled_items(made, "p_partkey", "html").groupBy("p_partkey").agg(
        F.count("*").alias("items"), F.max(F.when(F.col("label") == "Reach", F.col("number"))).alias("reach"), F.max(F.when(F.col("label") == "Share", F.col("number"))).alias("share"), F.count_if(F.col("value").isNull()).alias("empty")
    )
    records = made.select("p_partkey", pages.record(F.col("html")).alias("r")).select("p_partkey", "r.*")
    return records.join(items, "p_partkey").select("p_partkey", "wins", "losses", "draws", "items", rounded(F.col("reach")).alias("reach"), rounded(F.col("share")).alias("share"), "empty")


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight classes in noisy labels, and their pounds."""
    named = [*cells.CLASS_POUNDS, "catchweight"]
    k = F.col("p_partkey") % len(named)
    raw = F.concat(F.when(F.col("p_partkey") % 3 == 0, "UFC Women's ").otherwise("Road to "), F.element_at(F.array(*(F.lit(n.title()) for n in named)), (k + 1).cast("int")), F.lit(" Title Bout"))
    label = cells.class_label(raw, named)
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), cells.class_pounds(label).alias("pounds"))


QUERIES = {
    f.__name__: f
    for f in (mixed_pit, boundary_durations, blend_three, time_fold_scores, regraded_table, history_series, maker_lane, forecast_quality, page_records, class_weights)
}

_NAMES = [*cells.CLASS_POUNDS, "catchweight"]
_GRADE = "CASE WHEN o_orderkey % {0} = 0 THEN 'void' ELSE 'resolved' END AS status, CASE WHEN o_orderkey % {0} <> 0 THEN (o_orderkey % 3 = 0) = (o_orderkey % 2 = 0) END AS correct"

ORACLE_SQL = {
    "mixed_pit": """
        WITH l AS (SELECT *, ((l_orderkey * 7 + l_linenumber) % 101 + 0.5::DOUBLE) / 101.0::DOUBLE AS u, least(greatest(l_quantity - 10, 0), 35)::DOUBLE AS y FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               round(CASE WHEN y >= 35 THEN 0.2::DOUBLE + 0.7::DOUBLE * 35 / 40 + u * (1 - 0.2::DOUBLE - 0.7::DOUBLE * 35 / 40) WHEN y <= 0 THEN u * 0.2::DOUBLE ELSE 0.2::DOUBLE + 0.7::DOUBLE * y / 40 END, 6) AS mixed,
               round((l_quantity - 0.5::DOUBLE) / 51 + u * (least((l_quantity + 0.5::DOUBLE) / 51, 1) - (l_quantity - 0.5::DOUBLE) / 51), 6) AS whole FROM l""",
    "boundary_durations": """
        WITH l AS (SELECT *, l_quantity * 20::DOUBLE AS t, l_linenumber / 10.0::DOUBLE AS pf, (l_orderkey % 19 + 0.5::DOUBLE) / 20 AS q, l_quantity::DOUBLE AS c FROM lineitem),
        g AS (SELECT *, q / (1 - pf) AS r, CASE WHEN t <= 300 THEN t / 600 ELSE 0.5::DOUBLE + (t - 300) / 1200 END AS g,
                     CASE WHEN c <= 20 THEN 0.03::DOUBLE * c ELSE 0.6::DOUBLE + 0.01::DOUBLE * (c - 20) END AS top FROM l)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               round(CASE WHEN t >= 900 THEN 1 ELSE (1 - pf) * (0.8::DOUBLE * g + CASE WHEN t >= 300 THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN t >= 600 THEN 0.1::DOUBLE ELSE 0::DOUBLE END) END, 6) AS cdf,
               round(CASE WHEN q > 1 - pf THEN 900 WHEN r <= 0.4 THEN r / 0.8::DOUBLE * 600 WHEN r <= 0.5 THEN 300 WHEN r <= 0.7 THEN 300 + ((r - 0.1::DOUBLE) / 0.8::DOUBLE - 0.5::DOUBLE) * 1200
                          WHEN r <= 0.8 THEN 600 ELSE 300 + ((r - 0.2::DOUBLE) / 0.8::DOUBLE - 0.5::DOUBLE) * 1200 END, 4) AS quantile,
               round(least(CASE WHEN 0.25::DOUBLE * top <= 0.6 THEN 0.25::DOUBLE * top / 0.03::DOUBLE ELSE 20 + (0.25::DOUBLE * top - 0.6::DOUBLE) * 100 END, c), 4) AS q25,
               round(least(CASE WHEN 0.5::DOUBLE * top <= 0.6 THEN 0.5::DOUBLE * top / 0.03::DOUBLE ELSE 20 + (0.5::DOUBLE * top - 0.6::DOUBLE) * 100 END, c), 4) AS q50,
               round(least(CASE WHEN 0.9::DOUBLE * top <= 0.6 THEN 0.9::DOUBLE * top / 0.03::DOUBLE ELSE 20 + (0.9::DOUBLE * top - 0.6::DOUBLE) * 100 END, c), 4) AS q90 FROM g""",
    "regraded_table": f"""
        WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE 'B' END AS predicted, strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS month FROM orders)
        SELECT o_orderkey, predicted, month, {_GRADE.format(5)} FROM o WHERE month < '1996-01' OR month > '1997-12'
        UNION ALL SELECT o_orderkey, predicted, month, {_GRADE.format(7)} FROM o WHERE month BETWEEN '1996-01' AND '1997-12'""",
    "history_series": f"""
        WITH {FORECASTS_SQL}, r AS (SELECT day, (id % 3 = 0)::INT AS live, CASE WHEN id % 3 = 0 THEN 1 WHEN status = 'resolved' THEN y END AS hit FROM forecasts),
        d AS (SELECT day, count(*) AS n, sum(live)::BIGINT AS live, count(hit) AS resolved, coalesce(sum(hit), 0)::BIGINT AS hits FROM r GROUP BY 1)
        SELECT *, (sum(n) OVER w)::BIGINT AS total_n, (sum(resolved) OVER w)::BIGINT AS total_resolved, (sum(hits) OVER w)::BIGINT AS total_hits,
               round(CASE WHEN sum(resolved) OVER w > 0 THEN (sum(hits) OVER w) / (sum(resolved) OVER w) END, 6) AS rate
        FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "maker_lane": f"""
        WITH {FORECASTS_SQL}, f AS (SELECT *, q - 0.005::DOUBLE AS cost, coalesce(CASE WHEN id % 11 <> 0 THEN close END <= q - 0.015::DOUBLE + 0.01::DOUBLE + 1e-9::DOUBLE, false) AS filled FROM forecasts)
        SELECT market, count(*) AS offers, count(*) FILTER (filled) AS n, round(avg(y) FILTER (filled), 6) AS hit_rate, round(avg(cost) FILTER (filled), 6) AS break_even,
               round((avg(y) FILTER (filled)) - (avg(cost) FILTER (filled)), 6) AS realized, round((avg(p) FILTER (filled)) - (avg(cost) FILTER (filled)), 6) AS claimed, round((avg(y / cost) FILTER (filled)) - 1, 6) AS roi
        FROM f GROUP BY 1""",
    "forecast_quality": """
        WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS a, o_orderkey % 7 AS b, o_orderkey % 9 + 3 AS c FROM orders)
        SELECT 'null_probs' AS rule, count(*) FILTER (k % 17 = 0) AS n FROM o UNION ALL SELECT 'row_sum', count(*) FILTER (k % 17 <> 0 AND k % 13 = 0) FROM o
        UNION ALL SELECT 'out_of_range', count(*) FILTER (k % 17 <> 0 AND k % 13 = 0 AND k % 10 = 0) FROM o UNION ALL SELECT 'null_quantiles', count(*) FILTER (k % 19 = 0) FROM o
        UNION ALL SELECT 'falling', count(*) FILTER (k % 19 <> 0 AND (b < a OR c < b)) FROM o
        UNION ALL SELECT 'flat_tail', count(*) FILTER (k % 19 <> 0 AND c - a > 1e-9 AND (b - a <= 1e-9 OR c - b <= 1e-9)) FROM o""",
    "page_records": """
        SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_size END::INTEGER AS wins, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 7 END::INTEGER AS losses, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 3 END::INTEGER AS draws,
               4::BIGINT AS items, round(p_size * 2 + 0.5::DOUBLE, 6) AS reach, round((p_partkey % 100) / 100.0::DOUBLE, 6) AS share, 1::BIGINT AS empty FROM part""",
    "class_weights": f"""
        WITH n AS (SELECT p_partkey, {_NAMES!r}[p_partkey % {len(_NAMES)} + 1] AS name FROM part)
        SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'women ' || name ELSE name END AS label, {[*cells.CLASS_POUNDS.values(), None]!r}[p_partkey % {len(_NAMES)} + 1]::DOUBLE AS pounds FROM n""".replace("None", "NULL"),
}
