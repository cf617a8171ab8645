"""Queries of distributions, calibration, learners and streams."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.functions import maths
from priorwise.operators import calibrate, dist, ml
from priorwise.operators.lineage import shared_folder
from priorwise.plans.views import CONTESTS_SQL, FORECASTS_SQL, contests, forecasts, rounded, table
from priorwise.streaming import ledgers


def cdf_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted embedding components as quantile grids and samples."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.array_sort(F.transform("embedding", lambda v: F.abs(v.cast("double")) * 100)).alias("v"))
    n = F.size("v")
    qs = F.transform(F.sequence(F.lit(1), n), lambda i: (i - 1) / (n - 1.0))
    at, p0 = F.lit(7.5), F.lit(0.2)
    return x.select(
        "vec_id",
        rounded(dist.hurdle_cdf(at, p0, qs, F.col("v"))).alias("hurdle"),
        rounded(dist.hurdle_quantile(F.lit(0.6), p0, qs, F.col("v"))).alias("quantile"),
        rounded(dist.sample_cdf(at, F.col("v"))).alias("sample"),
        rounded(dist.sample_quantile(F.lit(0.9), F.col("v"))).alias("q90"),
        rounded(dist.duration_cdf(at, F.lit(0.3), qs, F.col("v"), F.lit(30.0))).alias("duration"),
        rounded(dist.mixture(F.array(F.lit(0.4), F.lit(0.6)), F.array(dist.sample_cdf(at, F.col("v")), F.lit(0.5)))).alias("mixture"),
    )


def event_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as its draws."""
    li = table(spark, sf_dir, "lineitem")
    out = dist.event_probability(li, "l_orderkey", {"returned": F.col("l_returnflag") == "R", "large": F.col("l_quantity") > 25, "both": (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25)})
    return out.select("l_orderkey", *(rounded(F.col(c)).alias(c) for c in ("returned", "large", "both")), "n_draws")


def joint_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    out = dist.joint_legs(li, "l_suppkey", "l_linenumber", [F.col("l_quantity") > 20, F.col("l_discount") > 0.03], 3.0)
    return out.select("l_suppkey", *(rounded(F.col(c)).alias(c) for c in ("joint", "product", "adjustment", "ev", "stake")), "verdict")


def stratum_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dist.stratum_quantiles(contests(spark, sf_dir), ["pool", "class"], "a_price", [0.1, 0.5, 0.9])
    return out.select("pool", "class", *(rounded(F.get("qv", F.lit(k)), 3).alias(n) for k, n in enumerate(("q10", "q50", "q90"))), "n")


def soft_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjustments of a probability before it is served."""
    f = forecasts(spark, sf_dir)
    p, q = F.col("p"), F.col("q")
    return f.select(
        "id", rounded(maths.soft_cap(p, 0.9)).alias("capped"), rounded(maths.temper(p + 1e-9, 1 + q)).alias("tempered"), rounded(maths.shrink_to_half(p, F.col("user_id") % 7)).alias("shrunk"),
        rounded(maths.recency_weight(F.datediff(F.lit("2024-02-01"), "day"), 10.0, 0.2)).alias("weight"), rounded(maths.no_vig(p + 0.01, q)).alias("no_vig"),
        rounded(maths.kelly(p, q, 0.5)).alias("kelly"), rounded(maths.maker_cost(q)).alias("maker"),
    )


def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir).select("id", "p", "y")
    return calibrate.isotonic(f.where("id % 2 = 0"), f, "p", "y").select("id", "p", "calibrated")


def platt_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir).select("id", "p", "y")
    return calibrate.platt(f.where("id % 2 = 0"), f).select("id", "p", "calibrated")


def grid_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature, cap and blend weight fitted on the forecasts, applied to them."""
    f = forecasts(spark, sf_dir).select("id", "p", "q", "y")
    t, cap, w = calibrate.temperature(f), calibrate.symmetric_cap(f), calibrate.blend_weight(f, "p", "q")
    tempered = maths.sigmoid(maths.logit(F.col("p")) / t)
    return f.select("id", tempered.alias("tempered"), F.least(F.greatest("p", F.lit(1 - cap)), F.lit(cap)).alias("capped"), calibrate.blended(["p", "q"], [w, 1 - w + 1e-9]).alias("blend"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.count("*").alias("n"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"))


def style_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a model that was fitted, kept and loaded again."""
    rows = _features(spark, sf_dir)
    path = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"
    ml.fitted_components(rows.where(F.col("l_orderkey") % 3 > 0), ml.numeric_features(rows, ["l_orderkey", "y"]), 2).save(path)
    return ml.with_components(rows, PipelineModel.load(path)).select("l_orderkey", F.abs("pc_1").alias("pc_1"), F.abs("pc_2").alias("pc_2"))


def out_of_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.out_of_fold(_features(spark, sf_dir), "l_orderkey", ["q", "d", "t", "n"], "y").select("l_orderkey", "y", "score")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = ledgers.table_stream(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def first_write_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and types of events, each written once however often it occurs, on a stream of the events table.

    The table spans a month, so that state a month old can be dropped.
    """
    keyed = _event_stream(spark, sf_dir).withColumn("key", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    stream = ledgers.first_write_wins(keyed, "key", "ts", "31 days")
    return ledgers.run_to_table(stream.select("key", "user_id", "event_type"), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


def windowed_hit_rate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _event_stream(spark, sf_dir)
    out = ledgers.run_to_table(ledgers.hit_rate_windows(stream, "ts", "event_type", "value"), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", "update", ["window", "event_type"])
    return out.select(F.col("window.start").cast("date").alias("day"), "event_type", "n", rounded(F.col("hit_rate"), 4).alias("mean_value"))


QUERIES = {
    f.__name__: f
    for f in (
        cdf_eval, event_probability, joint_legs, stratum_quantiles, soft_caps, isotonic_calibration, platt_calibration, grid_fits, style_components,
        out_of_fold_scores, first_write_stream, windowed_hit_rate_stream,
    )
}

_INTERP = """CASE WHEN {x} < v[1] THEN 0.0::DOUBLE WHEN {x} >= v[n] THEN 1.0::DOUBLE ELSE (k - 1) / (n - 1) + 1.0::DOUBLE / (n - 1) * ({x} - v[k]) / (v[k + 1] - v[k]) END"""

ORACLE_SQL = {
    "cdf_eval": f"""
        WITH e AS (SELECT vec_id, list_sort(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) * 100)) AS v, len(embedding) AS n FROM embeddings),
        k AS (SELECT *, len(list_filter(v, lambda x: x <= 7.5)) AS k FROM e),
        i AS (SELECT *, {_INTERP.format(x="7.5::DOUBLE")} AS f, k / n AS s FROM k)
        SELECT vec_id, round(0.2 + 0.8 * f, 6) AS hurdle, round(v[floor(0.5 * (n - 1))::INT + 1] + (v[least(floor(0.5 * (n - 1))::INT + 2, n)] - v[floor(0.5 * (n - 1))::INT + 1]) * (0.5 * (n - 1) - floor(0.5 * (n - 1))), 6) AS quantile,
               round(s, 6) AS sample, round(v[floor(0.9 * (n - 1))::INT + 1] + (v[least(floor(0.9 * (n - 1))::INT + 2, n)] - v[floor(0.9 * (n - 1))::INT + 1]) * (0.9 * (n - 1) - floor(0.9 * (n - 1))), 6) AS q90,
               round(0.7 * f, 6) AS duration, round(0.4 * s + 0.3, 6) AS mixture FROM i""",
    "event_probability": """
        SELECT l_orderkey, round(avg((l_returnflag = 'R')::INT), 6) AS returned, round(avg((l_quantity > 25)::INT), 6) AS large, round(avg((l_returnflag = 'R' AND l_quantity > 25)::INT), 6) AS both, count(*) AS n_draws
        FROM lineitem GROUP BY 1""",
    "joint_legs": """
        WITH g AS (SELECT l_suppkey, avg((l_quantity > 20 AND l_discount > 0.03)::INT) AS j, avg((l_quantity > 20)::INT) * avg((l_discount > 0.03)::INT) AS p FROM lineitem GROUP BY 1)
        SELECT l_suppkey, round(j, 6) AS joint, round(p, 6) AS product, round(j - p, 6) AS adjustment, round(j * 3 - 1, 6) AS ev, round(greatest((j * 3 - 1) / 2, 0), 6) AS stake,
               CASE WHEN j * 3 - 1 > 0.05 THEN 'PLAY' WHEN j * 3 - 1 > 0 THEN 'LEAN' ELSE 'PASS' END AS verdict FROM g""",
    "stratum_quantiles": f"""
        WITH {CONTESTS_SQL}
        SELECT pool, class, round(quantile_cont(a_price, 0.1), 3) AS q10, round(quantile_cont(a_price, 0.5), 3) AS q50, round(quantile_cont(a_price, 0.9), 3) AS q90, count(*) AS n FROM contests GROUP BY 1, 2""",
    "soft_caps": f"""
        WITH {FORECASTS_SQL},
        u AS (SELECT *, p - (greatest(60 * (p - 0.9), 0) + ln(1 + exp(-abs(60 * (p - 0.9))))) / 60 AS c1, p + 1e-9 AS pt, 1 + q AS t FROM forecasts),
        w AS (SELECT *, (1 - c1) - (greatest(60 * (1 - c1 - 0.9), 0) + ln(1 + exp(-abs(60 * (1 - c1 - 0.9))))) / 60 AS c2 FROM u)
        SELECT id, round(1 - c2, 6) AS capped, round(CASE WHEN abs(pt - 0.5) < 1e-6 THEN pt ELSE 1 / (1 + exp(-ln(pt / (1 - pt)) / t)) END, 6) AS tempered,
               round(0.5 + (p - 0.5) * least(1, (user_id % 7) / 4), 6) AS shrunk, round(greatest(power(0.5, date_diff('day', day, DATE '2024-02-01') / 10.0), 0.2), 6) AS weight,
               round((p + 0.01) / (p + 0.01 + q), 6) AS no_vig, round(CASE WHEN q >= 1 THEN 0 ELSE greatest(least((p - q) / (1 - q), 0.5), 0) END, 6) AS kelly,
               round(q + 0.01 + 0.25 * 0.07 * (q + 0.01) * (1 - (q + 0.01)), 6) AS maker FROM w""",
    "first_write_stream": "SELECT DISTINCT user_id || '|' || event_type AS key, user_id, event_type FROM events",
    "windowed_hit_rate_stream": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY 1, 2",
}
