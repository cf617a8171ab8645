"""Queries of forecast evaluation and of the forward ledger, over events as forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.functions import maths
from priorwise.operators import evaluate as e
from priorwise.operators import ledger, pairs
from priorwise.operators import stats
from priorwise.plans.views import CONTESTS_SQL, FORECASTS_SQL, contests, forecasts, rounded, table


def _round(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *(rounded(F.col(v), digits).alias(v) for v in values))


def winner_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(e.winner_metrics(forecasts(spark, sf_dir), ["market"]), ["market", "n"], ["accuracy", "log_loss", "brier"])


def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(e.auroc(forecasts(spark, sf_dir), ["market"]), ["market"], ["auroc"])


def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(e.ece(forecasts(spark, sf_dir), ["market"]), ["market"], ["ece"])


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = e.reliability_curve(forecasts(spark, sf_dir))
    return out.select(F.col("bin").cast("long").alias("bin"), rounded(F.col("centre"), 3).alias("centre"), "n", rounded(F.col("mean_y")).alias("mean_y"))


def murphy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(e.murphy(forecasts(spark, sf_dir)), [], ["uncertainty", "reliability", "resolution", "brier", "skill", "residual"])


def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double") / 100
    df = table(spark, sf_dir, "events").where("event_type in ('view', 'click', 'purchase')").select("event_type", (k * 0.5).alias("view"), ((1 - k) * 0.5).alias("click"), F.lit(0.5).alias("purchase"))
    return _round(e.class_metrics(df, ["view", "click", "purchase"], "event_type"), ["cls", "n"], ["brier", "ece", "rate"])


def brier_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.bootstrap(forecasts(spark, sf_dir), "id", 50)


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = e.rare_pooled(forecasts(spark, sf_dir).withColumn("who", F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string"))), "who", 30)
    labels = F.array_compact(F.array(F.col("market"), F.concat(F.lit("w"), F.weekofyear("day")), F.when(F.col("q") > 0.5, "dear"), F.col("who")))
    return _round(e.slices(f, labels), ["slice", "n", "flagged", "noise"], ["accuracy", "log_loss", "brier", "ece", "brier_low", "brier_high"])


def pinball_crps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding components as samples, and sorted as a quantile grid, against the first component."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    n = F.size("x")
    grid = F.transform(F.sequence(F.lit(1), n), lambda i: i / (n + 1.0))
    y = F.get("x", F.lit(0))
    return x.select("vec_id", rounded(e.crps_samples(F.col("x"), y)).alias("crps_samples"), rounded(e.crps_quantiles(grid, F.array_sort("x"), y)).alias("crps_grid"))


def ks_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir).withColumn("u", e.pit(F.lit(0.0), F.col("p") * 2))
    return _round(e.ks_uniform(f, ["market"], "u"), ["market", "n"], ["ks"])


def pit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.pit_histogram(forecasts(spark, sf_dir), "p").select(F.col("bin").cast("long").alias("bin"), "n")


def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(e.threshold_grid(forecasts(spark, sf_dir), [0.0, 0.05, 0.1, 0.2, 0.4], "p", "y", "q"), ["threshold", "n"], ["hit_rate", "roi"], 5)


def parlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.parlays(forecasts(spark, sf_dir), "day", "y")


def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_type", "value", (F.get_json_object("props", "$.k").cast("double") / 100).alias("p"))
    return _round(e.scorecard(ev, "event_type", [10, 50, 100], "value", "p"), ["event_type", "line", "n", "tier", "picks", "proven"], ["auroc", "ece", "skill", "pick_rate", "low", "high"])


def calib_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(e.calibration_z(forecasts(spark, sf_dir), ["market"]), ["market", "n", "hits", "flagged"], ["expected", "z", "p_value"], 4)


def gate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = e.winner_metrics(forecasts(spark, sf_dir))
    return _round(e.gates(m, {"accuracy": ("min", 0.5), "brier": ("max", 0.3), "log_loss": ("max", 0.2)}), ["metric", "passes", "all_pass"], ["value"])


def quality_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir)
    p = F.col("p")
    return e.violations(f, {"null_p": p.isNull(), "certain": (p <= 0) | (p >= 0.999), "dear": F.col("q") > 0.95, "crossed": F.col("close") < F.col("q")})


def determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir)
    return e.differences(f.select("id", "p"), f.where("id % 7 <> 0").select("id", (F.col("p") + F.when(F.col("id") % 5 == 0, 0.25).otherwise(0.0)).alias("p")), "id", "p")


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contests(spark, sf_dir).select("day", F.col("won_a").alias("y"), (F.col("a_quantity") / (F.col("a_quantity") + F.col("b_quantity"))).alias("p")).where("y is not null")
    return _round(e.walk_forward(c, "day", ["1996-01-01", "1996-07-01", "1999-01-01"], 6), ["cutoff", "n"], ["accuracy", "brier"])


def rollup_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ledger.hit_rates(forecasts(spark, sf_dir), ["market", "status"]), ["level", "name", "n", "resolved", "pending", "void"], ["hit_rate"])


def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir).where("status = 'resolved'").withColumn("cost", maths.taker_cost(F.col("q")))
    return _round(ledger.bucket_stats(f, ["market"], "p", "y", "cost"), ["market", "n"], ["hit_rate", "break_even", "realized", "claimed", "roi"])


def edge_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir).withColumn("bucket", stats.edges((F.col("p") - F.col("q")) * 100, [-100, 0, 3, 6, 10, 100]))
    return _round(f.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("y").alias("hit_rate")), ["bucket", "n"], ["hit_rate"])


def clv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("p") > F.col("q"), "yes").otherwise("no")
    return _round(ledger.closing_value(forecasts(spark, sf_dir), ["market"], "q", "close", side), ["market", "n", "moved"], ["beat_close", "mean_move"])


def drift_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir).withColumn("user", F.col("user_id") % 40)
    z = e.calibration_z(f, ["user"], with_p=False)
    return _round(ledger.drift(z, ledger.closing_value(f, ["user"], "q", "close"), ["user"]), ["user", "n"], ["z", "beat_close"], 4)


def anti_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First quote of each user and market is logged; the first ten days are the log so far."""
    f = forecasts(spark, sf_dir).select("id", "ts", "day", "p", F.concat_ws("|", F.col("user_id").cast("string"), "market").alias("key"))
    old = f.where("day < '2024-01-05'")
    log = pairs.keep_first(old, ["key"], ["ts", "id"]).withColumn("status", F.lit("resolved"))
    return ledger.append_new(log, f.where("day >= '2024-01-05'"), "key", ["ts", "id"]).select("id", "key", "status", rounded(F.col("p")).alias("p"))


def last_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir)
    log = f.select("id", "market", "day", "status", "q", "close")
    out = ledger.capture_close(log, f.select("market", "day", "q", "ts"), ["market", "day"], "q", "ts", F.lit("2024-01-15").cast("date"), "day")
    return out.select("id", rounded(F.col("close")).alias("close"))


def settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests settled for all kinds of contracts; the outcome label comes from quantity."""
    c = contests(spark, sf_dir)
    k = F.col("a_quantity") % 7
    outcome = F.when(k == 0, "NC").when(k == 1, "KO").when(k == 2, "SUB").when(k == 3, "DRAW").when(k == 4, "DQ").when(k == 5, F.lit(None)).otherwise("U-DEC")
    kinds = F.explode(F.array(*(F.lit(x) for x in ("winner", "method_ko", "method_sub", "method_dec", "distance", "mof_ko", "mof_sub", "mof_dec", "vicround_other", "end_before_r3", "win_in_r2"))))
    rows = c.select("contest_id", kinds.alias("kind"), (F.col("won_a") == 1).alias("won"), outcome.alias("outcome"), (F.col("b_quantity") % 5 + 1).cast("int").alias("end_round"))
    s = ledger.settle(F.col("kind"), F.col("won"), F.col("outcome"), F.col("end_round"), F.lit(3))
    return rows.select("contest_id", "kind", s.alias("s")).select("contest_id", "kind", F.col("s.realized").cast("long").alias("realized"), F.col("s.status").alias("status"))


def grade_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contests(spark, sf_dir)
    results = c.select("contest_id", F.expr("stack(2, 'a', a_quantity, 'b', b_quantity) as (side_of, value)")).where("value <> 7")
    asked = c.select("contest_id", F.expr("stack(2, 'a', 'over', 20.5D, 'b', 'under', 30D) as (side_of, side, line)"))
    return ledger.grade_lines(asked, results, ["contest_id", "side_of"]).select("contest_id", "side_of", "hit", "status")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir)
    stake = maths.kelly(F.col("p"), maths.taker_cost(F.col("q")), 0.25) * 1000
    best = ledger.best_positions(f, "user_id", stake, "q", "id")
    return ledger.scale_to_budget(best, ["market"], "stake", 500.0).select("user_id", "id", "market", rounded(F.col("stake"), 4).alias("stake"), "sized")


def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir).select("day", "id", "market", "y")
    feed = ledger.event_feed(f, "day", "id", ["market"], 100, hits=F.sum("y"))
    return feed.select("day", "page", "n", "hits", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["id"].cast("string"), r["market"])), ",").alias("rows"))


QUERIES = {
    f.__name__: f
    for f in (
        winner_metrics, auroc, ece, reliability, murphy, class_metrics, brier_bootstrap, slices, pinball_crps, ks_segments, pit_histogram, threshold_grid, parlay,
        scorecard, calib_z, gate_table, quality_sweep, determinism, walk_forward, rollup_hit_rate, bucket_stats, edge_buckets, clv_summary, drift_watch, anti_append,
        last_close, settle, grade_lines, positions, event_feed,
    )
}

_F = f"WITH {FORECASTS_SQL}"
_ERFC = " + ".join(f"({c}::DOUBLE) * power(t, {k})" for k, c in enumerate(e.ERFC_FIT))
_BIN = "CASE WHEN p < 1 THEN floor(p * {0}) ELSE {0} - 1 END"
_ECE = "(SELECT {k}, sum(n * abs(mp - my)) / sum(n) AS ece FROM (SELECT {k}, " + _BIN + " AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM {t} GROUP BY ALL) GROUP BY {k})"
_METRICS = "count(*) AS n, round(avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(-CASE WHEN y = 1 THEN ln(greatest(p, 1e-15)) ELSE ln(greatest(1 - p, 1e-15)) END), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier"
_AUC = """(SELECT {k}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (coalesce(below, 0) + neg / 2)) / sum(pos) / sum(neg) END AS auroc FROM
    (SELECT *, sum(neg) OVER (PARTITION BY {k} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM
    (SELECT {k}, p, sum(y)::DOUBLE AS pos, (count(*) - sum(y))::DOUBLE AS neg FROM {t} GROUP BY ALL)) GROUP BY {k})"""
_COST = "(q + 0.07::DOUBLE * q * (1 - q))"

ORACLE_SQL = {
    "winner_metrics": f"{_F} SELECT market, {_METRICS} FROM forecasts GROUP BY 1",
    "auroc": f"{_F} SELECT market, round(auroc, 6) AS auroc FROM {_AUC.format(k='market', t='forecasts')}",
    "ece": f"{_F} SELECT market, round(ece, 6) AS ece FROM {_ECE.format(10, k='market', t='forecasts')}",
    "reliability": f"""{_F}, b AS (SELECT {_BIN.format(10)} AS bin, count(*) AS n, avg(y) AS my FROM forecasts GROUP BY 1)
        SELECT g.range AS bin, round((g.range + 0.5) / 10, 3) AS centre, coalesce(n, 0) AS n, round(my, 6) AS mean_y FROM range(10) g LEFT JOIN b ON b.bin = g.range""",
    "murphy": f"""{_F}, b AS (SELECT {_BIN.format(10)} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM forecasts GROUP BY 1),
        r AS (SELECT avg(y) AS rate, avg((p - y) * (p - y)) AS brier FROM forecasts),
        t AS (SELECT rate * (1 - rate) AS unc, sum(n * (mp - my) * (mp - my)) / sum(n) AS rel, sum(n * (my - rate) * (my - rate)) / sum(n) AS res, brier FROM b, r GROUP BY rate, brier)
        SELECT round(unc, 6) AS uncertainty, round(rel, 6) AS reliability, round(res, 6) AS resolution, round(brier, 6) AS brier, round(1 - brier / unc, 6) AS skill, round(brier - unc - rel + res, 6) AS residual FROM t""",
    "class_metrics": f"""WITH k AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS k FROM events WHERE event_type IN ('view', 'click', 'purchase')),
        long AS (SELECT 'view' AS cls, k * 0.5 AS p, (event_type = 'view')::INT AS y FROM k UNION ALL SELECT 'click', (1 - k) * 0.5, (event_type = 'click')::INT FROM k
                 UNION ALL SELECT 'purchase', 0.5::DOUBLE, (event_type = 'purchase')::INT FROM k)
        SELECT cls, n, round(brier, 6) AS brier, round(ece, 6) AS ece, round(rate, 6) AS rate
        FROM (SELECT cls, count(*) AS n, avg((p - y) * (p - y)) AS brier, avg(y) AS rate FROM long GROUP BY 1) JOIN {_ECE.format(10, k='cls', t='long')} USING (cls)""",
    "slices": f"""{_F}, w AS (SELECT *, 'u' || (user_id % 50) AS who, count(*) OVER (PARTITION BY user_id % 50) >= 30 AS large FROM forecasts),
        s AS (SELECT p, y, unnest(list_filter([market, 'w' || weekofyear(day), CASE WHEN q > 0.5 THEN 'dear' END, CASE WHEN large THEN who ELSE 'Other' END], lambda x: x IS NOT NULL)) AS slice FROM w),
        h AS (SELECT slice, avg((p - y) * (p - y)) AS raw, 1.959963984540054::DOUBLE * stddev_pop((p - y) * (p - y)) / sqrt(count(*)) AS half FROM s GROUP BY 1)
        SELECT slice, n, accuracy, log_loss, brier, round(ece, 6) AS ece, round(raw - half, 6) AS brier_low, round(raw + half, 6) AS brier_high, n >= 50 AND raw > 0.255 AS flagged, n >= 50 AND raw > 0.255 AND raw - half <= 0.255 AS noise
        FROM (SELECT slice, {_METRICS} FROM s GROUP BY 1) JOIN h USING (slice) JOIN {_ECE.format(10, k='slice', t='s')} USING (slice)""",
    "pinball_crps": """
        WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, list_sort(CAST(embedding AS DOUBLE[])) AS s, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS y FROM embeddings)
        SELECT vec_id,
               round(list_sum(list_transform(x, lambda v: abs(v - y))) / n - list_sum(list_transform(range(1, n + 1), lambda i: s[i] * (2 * i - n - 1))) / (n * n), 6) AS crps_samples,
               round(2 * list_sum(list_transform(range(1, n), lambda i: CASE WHEN y >= s[i] THEN i / (n + 1) * (y - s[i]) ELSE (1 - i / (n + 1)) * (s[i] - y) END / (n + 1))), 6) AS crps_grid
        FROM e""",
    "ks_segments": f"""{_F}, k AS (SELECT market, p AS u, count(*) AS k FROM forecasts GROUP BY ALL),
        w AS (SELECT *, sum(k) OVER (PARTITION BY market ORDER BY u) AS hi, sum(k) OVER (PARTITION BY market) AS n FROM k)
        SELECT market, any_value(n)::BIGINT AS n, round(max(greatest(hi / n - u, u - (hi - k) / n)), 6) AS ks FROM w GROUP BY 1""",
    "pit_histogram": f"{_F} SELECT CAST(least(floor(p * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM forecasts GROUP BY 1",
    "threshold_grid": f"""{_F} SELECT threshold, count(*) AS n, round(avg(y), 5) AS hit_rate, round(avg(CASE WHEN y = 1 THEN 1 / q - 1 ELSE -1 END), 5) AS roi
        FROM forecasts, (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.4])::DOUBLE AS threshold) WHERE p - q >= threshold GROUP BY 1""",
    "parlay": f"""{_F}, g AS (SELECT day, count(*) AS n, sum(y)::BIGINT AS k FROM forecasts GROUP BY 1)
        SELECT day, n, k, n * (n - 1) // 2 AS pairs, k * (k - 1) // 2 AS pair_hits, n * (n - 1) * (n - 2) // 6 AS triples, k * (k - 1) * (k - 2) // 6 AS triple_hits FROM g""",
    "scorecard": f"""
        WITH long AS (SELECT event_type || '|' || line AS k, event_type, line, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS p, (value > line)::INT AS y
                      FROM events, (SELECT unnest([10.0, 50.0, 100.0])::DOUBLE AS line)),
        b AS (SELECT k, event_type, line, count(*) AS n, avg((p - y) * (p - y)) AS brier, var_pop(y) AS base FROM long GROUP BY ALL)
        SELECT event_type, line, n, round(auroc, 6) AS auroc, round(ece, 6) AS ece, round(CASE WHEN base > 0 THEN 1 - brier / base END, 6) AS skill,
               CASE WHEN n >= 30 AND 1 - brier / base > 0 AND auroc > 0.55 THEN 'TRUST' WHEN auroc > 0.5 THEN 'WATCH' ELSE 'CUT' END AS tier,
               picks, round(pick_rate, 6) AS pick_rate, round(low, 6) AS low, round(high, 6) AS high, coalesce(picks >= 30 AND low > 0.5, false) AS proven
        FROM b JOIN (SELECT k, picks, r AS pick_rate, c - h AS low, c + h AS high FROM
                     (SELECT k, picks, r, (r + z2 / (2 * picks)) / (1 + z2 / picks) AS c, sqrt(z2) / (1 + z2 / picks) * sqrt(r * (1 - r) / picks + z2 / (4 * picks * picks)) AS h
                      FROM (SELECT k, count(w) AS picks, avg(w) AS r, (3.841458820694124)::DOUBLE AS z2 FROM (SELECT k, CASE WHEN p >= 0.6 THEN y WHEN 1 - p >= 0.6 THEN 1 - y END AS w FROM long) GROUP BY 1))) USING (k) JOIN {_AUC.format(k='k', t='long')} USING (k) JOIN {_ECE.format(8, k='k', t='long')} USING (k)""",
    "calib_z": f"""{_F}, g AS (SELECT market, count(*) AS n, sum(y)::DOUBLE AS hits, sum(p) AS expected, (sum(y) - sum(p)) / sqrt(sum(p * (1 - p))) AS z FROM forecasts GROUP BY 1),
        x AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.5 * abs(z) / sqrt(2)) AS t FROM g), v AS (SELECT *, t * exp(-x * x + {_ERFC}) AS pv FROM x)
        SELECT market, n, hits, round(expected, 4) AS expected, round(z, 4) AS z, round(pv, 4) AS p_value, n >= 25 AND pv < 0.05 AS flagged FROM v""",
    "gate_table": f"""{_F}, m AS (SELECT avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1 ELSE 0 END) AS a, avg((p - y) * (p - y)) AS b, avg(-CASE WHEN y = 1 THEN ln(greatest(p, 1e-15)) ELSE ln(greatest(1 - p, 1e-15)) END) AS l FROM forecasts),
        g AS (SELECT 'accuracy' AS metric, a AS v, a >= 0.5 AS passes FROM m UNION ALL SELECT 'brier', b, b <= 0.3 FROM m UNION ALL SELECT 'log_loss', l, l <= 0.2 FROM m)
        SELECT metric, round(v, 6) AS value, passes, bool_and(passes) OVER () AS all_pass FROM g""",
    "quality_sweep": f"""{_F} SELECT 'null_p' AS rule, count(*) FILTER (p IS NULL) AS n FROM forecasts UNION ALL SELECT 'certain', count(*) FILTER (p <= 0 OR p >= 0.999) FROM forecasts
        UNION ALL SELECT 'dear', count(*) FILTER (q > 0.95) FROM forecasts UNION ALL SELECT 'crossed', count(*) FILTER (close < q) FROM forecasts""",
    "determinism": f"""{_F}, b AS (SELECT id, p + CASE WHEN id % 5 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS p2 FROM forecasts WHERE id % 7 <> 0)
        SELECT count(*) AS n, count(*) FILTER (b.id IS NULL) AS unmatched, max(abs(p - p2)) AS max_difference FROM forecasts f LEFT JOIN b ON f.id = b.id""",
    "walk_forward": f"""WITH {CONTESTS_SQL}, c AS (SELECT day, won_a AS y, a_quantity / (a_quantity + b_quantity) AS p FROM contests WHERE won_a IS NOT NULL),
        r AS (SELECT c.*, cutoff FROM c JOIN (SELECT unnest([DATE '1996-01-01', DATE '1996-07-01', DATE '1999-01-01']) AS cutoff) ON day > cutoff AND day <= cutoff + INTERVAL 6 MONTH)
        SELECT cutoff, count(*) AS n, round(avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1 ELSE 0 END), 6) AS accuracy, round(avg((p - y) * (p - y)), 6) AS brier FROM r GROUP BY ROLLUP (cutoff)""",
    "rollup_hit_rate": f"""{_F}, g AS (SELECT 'all' AS level, NULL AS name, * FROM forecasts UNION ALL SELECT 'market', market, * FROM forecasts UNION ALL SELECT 'status', status, * FROM forecasts)
        SELECT level, name, count(*) AS n, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'void') AS void,
               round(avg(y) FILTER (status = 'resolved'), 6) AS hit_rate FROM g GROUP BY 1, 2""",
    "bucket_stats": f"""{_F} SELECT market, count(*) AS n, round(avg(y), 6) AS hit_rate, round(avg({_COST}), 6) AS break_even, round(avg(y) - avg({_COST}), 6) AS realized,
        round(avg(p) - avg({_COST}), 6) AS claimed, round(avg(y / {_COST}) - 1, 6) AS roi FROM forecasts WHERE status = 'resolved' GROUP BY 1""",
    "edge_buckets": f"""{_F}, b AS (SELECT y, (p - q) * 100 AS e FROM forecasts)
        SELECT CASE WHEN e > -100 AND e <= 0 THEN '(-100,0]' WHEN e > 0 AND e <= 3 THEN '(0,3]' WHEN e > 3 AND e <= 6 THEN '(3,6]' WHEN e > 6 AND e <= 10 THEN '(6,10]' WHEN e > 10 AND e <= 100 THEN '(10,100]' END AS bucket,
               count(*) AS n, round(avg(y), 6) AS hit_rate FROM b GROUP BY 1""",
    "clv_summary": f"""{_F}, m AS (SELECT market, (close - q) * CASE WHEN p > q THEN 1 ELSE -1 END AS m FROM forecasts)
        SELECT market, count(*) AS n, count(*) FILTER (abs(m) > 1e-9) AS moved, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) FILTER (abs(m) > 1e-9), 6) AS beat_close, round(avg(m), 6) AS mean_move FROM m GROUP BY 1""",
    "drift_watch": f"""{_F}, u AS (SELECT *, user_id % 40 AS "user", close - q AS m FROM forecasts),
        g AS (SELECT "user", count(*) AS n, (sum(y) - sum(p)) / sqrt(sum(p * (1 - p))) AS z, avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) FILTER (abs(m) > 1e-9) AS b FROM u GROUP BY 1)
        SELECT "user", n, round(z, 4) AS z, round(b, 4) AS beat_close FROM g WHERE abs(z) > 1.6448536269514722 OR (n >= 5 AND b < 0.5)""",
    "anti_append": f"""{_F}, k AS (SELECT id, p, day, user_id || '|' || market AS key, row_number() OVER (PARTITION BY user_id, market ORDER BY ts, id) AS rn FROM forecasts)
        SELECT id, key, CASE WHEN day < DATE '2024-01-05' THEN 'resolved' ELSE 'pending' END AS status, round(p, 6) AS p FROM k WHERE rn = 1""",
    "last_close": f"""{_F}, l AS (SELECT market, day, arg_max(q, ts) AS last FROM forecasts GROUP BY ALL)
        SELECT id, round(CASE WHEN status = 'pending' AND f.day >= DATE '2024-01-15' THEN last ELSE close END, 6) AS close FROM forecasts f JOIN l ON l.market = f.market AND l.day = f.day""",
    "settle": f"""WITH {CONTESTS_SQL},
        r AS (SELECT contest_id, won_a = 1 AS won, b_quantity % 5 + 1 AS rd, CASE a_quantity % 7 WHEN 0 THEN 'NC' WHEN 1 THEN 'KO' WHEN 2 THEN 'SUB' WHEN 3 THEN 'DRAW' WHEN 4 THEN 'DQ' WHEN 5 THEN NULL ELSE 'U-DEC' END AS o FROM contests),
        k AS (SELECT *, unnest(['winner', 'method_ko', 'method_sub', 'method_dec', 'distance', 'mof_ko', 'mof_sub', 'mof_dec', 'vicround_other', 'end_before_r3', 'win_in_r2']) AS kind, CASE WHEN o = 'DRAW' THEN false ELSE won END AS side FROM r),
        y AS (SELECT *, CASE kind WHEN 'winner' THEN side WHEN 'method_ko' THEN side AND o IN ('KO', 'TKO', 'DQ') WHEN 'method_sub' THEN side AND o = 'SUB' WHEN 'method_dec' THEN side AND o IN ('U-DEC', 'S-DEC', 'M-DEC')
                WHEN 'mof_ko' THEN o IN ('KO', 'TKO', 'DQ') WHEN 'mof_sub' THEN o = 'SUB' WHEN 'mof_dec' THEN o IN ('U-DEC', 'S-DEC', 'M-DEC') WHEN 'distance' THEN o IN ('U-DEC', 'S-DEC', 'M-DEC', 'DRAW')
                WHEN 'vicround_other' THEN o IN ('NC', 'DRAW', 'U-DEC', 'S-DEC', 'M-DEC') WHEN 'end_before_r3' THEN o IN ('KO', 'TKO', 'DQ', 'SUB') AND rd < 3
                ELSE side AND o IN ('KO', 'TKO', 'DQ', 'SUB') AND rd = 2 END AS yes FROM k),
        s AS (SELECT *, CASE WHEN o IS NULL THEN 'pending' WHEN o = 'NC' AND kind <> 'vicround_other' THEN 'void' WHEN yes IS NULL THEN 'pending' ELSE 'resolved' END AS status FROM y)
        SELECT contest_id, kind, CASE WHEN status = 'resolved' THEN yes::BIGINT END AS realized, status FROM s""",
    "grade_lines": f"""WITH {CONTESTS_SQL}, v AS (SELECT contest_id, 'a' AS side_of, CASE WHEN a_quantity <> 7 THEN a_quantity > 20.5 END AS hit FROM contests
        UNION ALL SELECT contest_id, 'b', CASE WHEN b_quantity <> 7 THEN b_quantity <= 30 END FROM contests)
        SELECT *, CASE WHEN hit IS NULL THEN 'pending' ELSE 'resolved' END AS status FROM v""",
    "positions": f"""{_F}, s AS (SELECT *, CASE WHEN {_COST} >= 1 THEN 0.0::DOUBLE ELSE greatest(least((p - {_COST}) / (1 - {_COST}), 0.25::DOUBLE), 0.0::DOUBLE) END * 1000 AS stake FROM forecasts),
        b AS (SELECT * FROM s WHERE stake > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY stake DESC, q, id) = 1),
        z AS (SELECT *, floor(stake * least(1.0::DOUBLE, 500.0::DOUBLE / sum(stake) OVER (PARTITION BY market)) + 1e-9) AS sized FROM b)
        SELECT user_id, id, market, round(stake, 4) AS stake, sized FROM z WHERE sized > 0""",
    "event_feed": f"""{_F}, p AS (SELECT *, ((row_number() OVER (PARTITION BY day ORDER BY id) - 1) // 100)::INTEGER AS page, count(*) OVER (PARTITION BY day) AS n, (sum(y) OVER (PARTITION BY day))::BIGINT AS hits FROM forecasts)
        SELECT day, page, any_value(n) AS n, any_value(hits) AS hits, string_agg(id || ':' || market, ',' ORDER BY id) AS rows FROM p GROUP BY 1, 2""",
}
