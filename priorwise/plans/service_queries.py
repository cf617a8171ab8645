"""Queries of quotes, grading, rules, learners' reports and joined streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.functions import cells, maths
from priorwise.operators import ledger, ml, resolve, stats
from priorwise.operators import evaluate as e
from priorwise.operators.lineage import shared_folder
from priorwise.plans.views import CONTESTS_SQL, FORECASTS_SQL, contests, forecasts, rounded, table
from priorwise.sources import quotes
from priorwise.streaming import ledgers


def grade_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger quantity predicts the winner; every fifth contest is already graded."""
    c = contests(spark, sf_dir).withColumn("key", F.col("contest_id").cast("string"))
    log = c.select(
        "key", F.when(F.col("a_quantity") >= F.col("b_quantity"), F.col("a_id")).otherwise(F.col("b_id")).alias("predicted"),
        F.when(F.col("contest_id") % 5 == 0, "resolved").otherwise("pending").alias("status"), F.lit(None).cast("boolean").alias("correct"),
    )
    winner = F.when(F.col("won_a") == 1, F.col("a_id")).when(F.col("won_a") == 0, F.col("b_id"))
    results = c.where("contest_id % 3 > 0").select("key", F.when(F.col("contest_id") % 7 > 0, winner).alias("winner"))
    return ledger.grade_winners(log, results, "key")


def quote_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir)
    cost = maths.taker_cost(F.col("q"))
    return f.select(
        "id", rounded(F.col("p") - cost).alias("edge"), rounded(maths.kelly(F.col("p"), cost, 0.25)).alias("stake"), rounded(F.col("p") - maths.maker_cost(F.col("q") - 0.01)).alias("maker_edge"),
        maths.liquidity(F.col("user_id") * 100).alias("tier"), (F.abs(F.col("p") - F.col("q")) >= 0.2).alias("diverges"), rounded(maths.pick_score(F.col("p") - cost, F.col("p"))).alias("score"),
        rounded(maths.implied(F.lit(3.0), F.col("user_id") % 3 + 2)).alias("implied"),
    )


def compact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    text = F.when(n == 1, F.lit("kd:over")).when(n == 2, F.concat(F.lit("kd:over:"), q, F.lit(" min"))).when(n == 3, F.concat(F.lit("time:red:under:"), q, F.lit(" rounds"))).otherwise(F.lit("kd:over:bad"))
    x = li.select("l_orderkey", "l_linenumber", quotes.compact_line(text).alias("x")).select("l_linenumber", "x.*")
    return x.groupBy("l_linenumber", "market", "entity", "side").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


def boundary_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    share = stats.boundary_share(F.col("l_partkey") % 900, F.col("l_linenumber"))
    return li.groupBy("l_returnflag").agg(rounded(F.avg(share)).alias("share"))


def book_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as levels of a book."""
    li = table(spark, sf_dir, "lineitem")
    books = li.groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_discount") * 10).alias("price"), F.col("l_quantity").alias("quantity"))).alias("levels"))
    return books.select("l_orderkey", rounded(stats.depth_near(F.col("levels"), F.lit(0.505)), 4).alias("depth"))


def homonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two neighbouring customers the one active nearest to the order's date."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    candidates = o.select("o_orderkey", "day", F.explode(F.array("o_custkey", F.col("o_custkey") + 1)).alias("who"))
    activity = o.groupBy(F.col("o_custkey").alias("who")).agg(F.max("day").alias("active"))
    return resolve.nearest_active(candidates, activity, "o_orderkey", "who", "day", "active", 400)


_RULES = ((("small", "ring"), "tiny", 2.0), (("ring",), "ring", 1.0), (("red",), None, 0.0), (("widget",), "widget", 60.0))


def stat_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", cells.stat_rule(F.col("p_name"), _RULES).alias("r")).select("p_partkey", "r.market", "r.factor")


def log_odds_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contests(spark, sf_dir).where("won_a is not null").withColumn("p", F.col("a_quantity") / (F.col("a_quantity") + F.col("b_quantity")))
    return stats.log_odds_gap(c, "class", "won_a", "p").select("class", rounded(F.col("gap"), 5).alias("gap"), "n")


def merged_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's totals from evaluation, overridden by live ones."""
    f = forecasts(spark, sf_dir)
    old = f.groupBy("day").agg(F.count("*").alias("n")).withColumn("origin", F.lit("evaluation"))
    live = f.where("day >= '2024-01-20'").groupBy("day").agg(F.sum("y").cast("long").alias("n")).withColumn("origin", F.lit("live"))
    return ledger.merge_by_priority([old, live], "day").select("day", "n", "origin")


def conditional_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms of a two-part mixture, made uniform within the parts."""
    f = forecasts(spark, sf_dir)
    u = e.conditional_pit(F.col("p"), F.lit(0.2), F.col("p") < 0.2)
    out = e.ks_uniform(f.withColumn("u", u).withColumn("part", F.col("p") < 0.2), ["part"], "u")
    return out.select("part", "n", rounded(F.col("ks")).alias("ks"))


def _pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contests(spark, sf_dir).where("won_a is not null")
    return c.select("contest_id", "won_a", *(F.col(f"{s}_quantity").alias(f"quantity_{s}") for s in "ab"), *((F.col(f"{s}_id") % 10).alias(f"rank_{s}") for s in "ab"))


_FEATURES = ["quantity_a", "quantity_b", "rank_a", "rank_b"]


def model_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.importance(_pair_rows(spark, sf_dir), _FEATURES, "won_a")


def occlusion_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pair_rows(spark, sf_dir)
    return ml.occlusion(rows, "contest_id", {"size": ["quantity"], "rank": ["rank"]}, lambda df: ml.fit_scores(rows, df, _FEATURES, "won_a"))


def class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pair_rows(spark, sf_dir).withColumn("tier", F.when(F.col("quantity_a") > 35, 2).when(F.col("quantity_a") > 15, 1).otherwise(0))
    scored = ml.class_scores(rows.where("contest_id % 2 = 0"), rows, ["quantity_b", "rank_a", "quantity_a"], "tier")
    held = scored.where("contest_id % 2 = 1")
    return ml.served_classes(scored, held, "tier", [0.3, 0.4, 0.3]).select("contest_id", "tier", "probs", "served")


def _events(spark: SparkSession, sf_dir: str, kind: str, columns: list[str]) -> DataFrame:
    stream = ledgers.table_stream(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("event_type") == kind).select(*columns)


def graded_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a user graded by the signups that follow within a day."""
    views, signups = (_events(spark, sf_dir, k, ["user_id", "ts", "event_id"]) for k in ("view", "signup"))
    out = ledgers.run_to_table(ledgers.graded(views, signups, "user_id", "ts", "ts", "40 days"), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")
    return out.select("event_id", "user_id", "result_event_id")


def rating_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of customers after the stream of their orders, each against the next customer."""
    stream = ledgers.table_stream(spark, sf_dir, "orders.parquet", table(spark, sf_dir, "orders").schema)
    games = stream.select(
        F.col("o_orderpriority").alias("pool"), F.datediff("o_orderdate", F.lit("1970-01-01")).alias("day"), F.col("o_orderkey").alias("contest_id"), F.col("o_custkey").alias("a_id"),
        (F.col("o_custkey") + 1).alias("b_id"), (F.col("o_totalprice") > 200_000).cast("double").alias("won_a"),
    )
    with ledgers.rocks_state(spark):
        return ledgers.run_to_table(ledgers.running_ratings(games), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", "update", ["pool", "id"])


QUERIES = {
    f.__name__: f
    for f in (
        grade_winners, quote_edges, compact_lines, boundary_share, book_depth, homonyms, stat_rules, log_odds_gap, merged_history, conditional_uniformity,
        model_importance, occlusion_effects, class_model, graded_stream, rating_stream,
    )
}

_COST = "(q + 0.07::DOUBLE * q * (1 - q))"
_MAKER = "(q + 0.25 * 0.07 * q * (1 - q))"

ORACLE_SQL = {
    "grade_winners": f"""
        WITH {CONTESTS_SQL},
        g AS (SELECT *, CASE WHEN a_quantity >= b_quantity THEN a_id ELSE b_id END AS predicted, contest_id % 3 > 0 AND contest_id % 5 <> 0 AS due,
                     CASE WHEN contest_id % 7 > 0 THEN CASE won_a WHEN 1 THEN a_id WHEN 0 THEN b_id END END AS w FROM contests)
        SELECT CAST(contest_id AS VARCHAR) AS key, predicted, CASE WHEN due THEN CASE WHEN w IS NULL THEN 'void' ELSE 'resolved' END WHEN contest_id % 5 = 0 THEN 'resolved' ELSE 'pending' END AS status,
               CASE WHEN due THEN predicted = w END AS correct FROM g""",
    "quote_edges": f"""
        WITH {FORECASTS_SQL}
        SELECT id, round(p - {_COST}, 6) AS edge, round(CASE WHEN {_COST} >= 1 THEN 0 ELSE greatest(least((p - {_COST}) / (1 - {_COST}), 0.25), 0) END, 6) AS stake, round(p - {_MAKER}, 6) AS maker_edge,
               CASE WHEN user_id * 100 >= 10000 THEN 'DEEP' WHEN user_id * 100 >= 2000 THEN 'OK' ELSE 'THIN' END AS tier, abs(p - q) >= 0.2::DOUBLE AS diverges,
               round(CASE WHEN p - {_COST} > 0 THEN (p - {_COST}) * p ELSE 0 END, 6) AS score, round(power(3.0, -1.0 / (user_id % 3 + 2)), 6) AS implied FROM forecasts""",
    "compact_lines": """
        SELECT l_linenumber, CASE WHEN l_linenumber = 3 THEN 'time' ELSE 'kd' END AS market, CASE WHEN l_linenumber = 3 THEN 'red' END AS entity, CASE WHEN l_linenumber = 3 THEN 'under' ELSE 'over' END AS side,
               count(*) AS n, sum(CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN l_quantity * 60 WHEN 3 THEN l_quantity * 300 ELSE 0 END)::DOUBLE AS lines FROM lineitem GROUP BY ALL""",
    "boundary_share": """
        SELECT l_returnflag, round(avg(CASE WHEN l_linenumber > 1 AND len(list_filter(range(1, l_linenumber), lambda r: abs(l_partkey % 900 - r * 300) <= 30)) > 0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY 1""",
    "book_depth": """
        SELECT l_orderkey, round(sum(CASE WHEN abs((1 - l_discount * 10) - 0.505) <= 0.03 THEN l_quantity * (1 - l_discount * 10) ELSE 0 END), 4) AS depth FROM lineitem GROUP BY 1""",
    "homonyms": """
        WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders),
        c AS (SELECT o_orderkey, day, unnest([o_custkey, o_custkey + 1]) AS who FROM o),
        a AS (SELECT o_custkey AS who, max(day) AS active FROM o GROUP BY 1)
        SELECT o_orderkey, arg_min(who, (CASE WHEN abs(date_diff('day', active, day)) <= 400 THEN abs(date_diff('day', active, day)) ELSE 1000000 END) * 10000000 + who) AS who FROM c LEFT JOIN a USING (who) GROUP BY 1""",
    "stat_rules": """
        SELECT p_partkey, CASE WHEN p_name LIKE '%small%' AND p_name LIKE '%ring%' THEN 'tiny' WHEN p_name LIKE '%ring%' THEN 'ring' WHEN p_name LIKE '%red%' THEN NULL WHEN p_name LIKE '%widget%' THEN 'widget' END AS market,
               CASE WHEN p_name LIKE '%small%' AND p_name LIKE '%ring%' THEN 2.0::DOUBLE WHEN p_name LIKE '%ring%' THEN 1.0::DOUBLE WHEN p_name LIKE '%red%' THEN 0.0::DOUBLE WHEN p_name LIKE '%widget%' THEN 60.0::DOUBLE END AS factor
        FROM part""",
    "log_odds_gap": f"""
        WITH {CONTESTS_SQL}, g AS (SELECT class, avg(won_a) AS r, avg(a_quantity / (a_quantity + b_quantity)) AS m, count(*) AS n FROM contests WHERE won_a IS NOT NULL GROUP BY 1)
        SELECT class, round(ln(r / (1 - r)) - ln(m / (1 - m)), 5) AS gap, n FROM g""",
    "merged_history": f"""
        WITH {FORECASTS_SQL}
        SELECT day, CASE WHEN day >= DATE '2024-01-20' THEN sum(y)::BIGINT ELSE count(*) END AS n, CASE WHEN day >= DATE '2024-01-20' THEN 'live' ELSE 'evaluation' END AS origin FROM forecasts GROUP BY day""",
    "conditional_uniformity": f"""
        WITH {FORECASTS_SQL}, k AS (SELECT p < 0.2 AS part, least(greatest(CASE WHEN p < 0.2 THEN p / 0.2::DOUBLE ELSE (p - 0.2::DOUBLE) / 0.8::DOUBLE END, 0), 1) AS u, count(*) AS k FROM forecasts GROUP BY ALL),
        w AS (SELECT *, sum(k) OVER (PARTITION BY part ORDER BY u) AS hi, sum(k) OVER (PARTITION BY part) AS n FROM k)
        SELECT part, any_value(n)::BIGINT AS n, round(max(greatest(hi / n - u, u - (hi - k) / n)), 6) AS ks FROM w GROUP BY 1""",
    "graded_stream": """
        SELECT v.event_id, v.user_id, s.event_id AS result_event_id FROM events v JOIN events s ON v.user_id = s.user_id AND v.event_type = 'view' AND s.event_type = 'signup' AND s.ts >= v.ts AND s.ts <= v.ts + INTERVAL 1 DAY""",
}
