"""Queries of pairs, networks, ratings and fitted statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorwise.functions import maths
from priorwise.operators import network, pairs, ratings, stats
from priorwise.operators import windows as w
from priorwise.operators.lineage import checkpointed
from priorwise.plans.views import CONTESTS_SQL, PERSPECTIVES_SQL, contests, rounded, table


def perspective_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.perspectives(contests(spark, sf_dir)).select("contest_id", "entity", "opponent", "won", "price", "price_against", "quantity", "quantity_against")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = w.History(("entity",), ("day", "contest_id"), "day")
    df = pairs.perspectives(contests(spark, sf_dir))
    return df.select("contest_id", "day", "pool", "entity", "won", w.expanding(h, F.col("price")).alias("form"), w.seen(h).alias("n"))


def wide_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = pairs.wide_pairs(_long(spark, sf_dir), "contest_id", "entity", ["won", "form", "n"], ["pool"])
    return wide.select("contest_id", "pool", "entity_a", "entity_b", "won_a", rounded(F.col("form_a"), 4).alias("form_a"), rounded(F.col("form_b"), 4).alias("form_b"), "n_a", "n_b")


def symmetrize(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = contests(spark, sf_dir).select("contest_id", "a_price", "b_price", "won_a")
    wide = wide.select("contest_id", F.col("a_price").alias("price_a"), F.col("b_price").alias("price_b"), (F.col("a_price") - F.col("b_price")).alias("price_diff"), "won_a")
    out = pairs.symmetrize(wide, "won_a")
    return out.select("contest_id", "price_a", "price_b", rounded(F.col("price_diff"), 4).alias("price_diff"), "won_a", "is_flipped")


def perspective_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pairs.symmetrize(contests(spark, sf_dir).select("contest_id", F.col("a_price").alias("price_a"), F.col("b_price").alias("price_b"), "won_a"), "won_a")
    scored = both.withColumn("p", F.col("price_a") / (F.col("price_a") + 2 * F.col("price_b")))
    return pairs.perspective_average(scored, "contest_id", "p").select("contest_id", rounded(F.col("p")).alias("p"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = contests(spark, sf_dir).select("contest_id", *(F.col(f"{s}_{m}").alias(f"{m}_{s}") for s in "ab" for m in ("price", "quantity")))
    made = maths.mirror(
        [],
        lambda own, other: {
            "edge": F.greatest(own("price") - other("price"), F.lit(0.0)),
            "pressure": F.log1p(own("price")) * own("quantity"),
            "ratio": (own("quantity") + 0.1) / (other("quantity") + 0.1),
        },
    )
    cols = [f"{k}_{s}" for s in "ab" for k in ("edge", "pressure", "ratio")]
    return wide.select("contest_id", *made).select("contest_id", *(rounded(F.col(c), 4).alias(c) for c in cols))


def pair_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contests(spark, sf_dir)
    a = F.when(F.col("a_quantity") > 5, F.col("a_quantity"))
    b = F.when(F.col("b_quantity") > 5, F.col("b_quantity"))
    return c.select("contest_id", pairs.filled_difference(a, b, 30).alias("quantity_diff"), pairs.pair_label(F.when(a > 25, "HIGH").when(a.isNotNull(), "LOW"), F.when(b > 25, "HIGH").when(b.isNotNull(), "LOW")).alias("styles"))


def pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = pairs.latest(_long(spark, sf_dir).select("entity", "day", "contest_id", "form", "n"), "entity", ["day", "contest_id"]).select("entity", "form", "n")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    wanted = s.select(F.col("s_suppkey").alias("id_a"), (F.col("s_suppkey") + 1).alias("id_b"))
    return pairs.pairings(wanted, states, "entity").select("id_a", "id_b", rounded(F.col("form_a"), 4).alias("form_a"), rounded(F.col("form_b"), 4).alias("form_b"), "n_a", "n_b")


def career_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thin histories filled with the entity's average over all contests."""
    long = _long(spark, sf_dir)
    career = pairs.perspectives(contests(spark, sf_dir)).groupBy("entity").agg(F.avg("price").alias("career"))
    out = pairs.fill_from(long.select("contest_id", "entity", "form"), career, "entity", {"form": "career"})
    return out.select("contest_id", "entity", rounded(F.col("form"), 4).alias("form"))


def common_opponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = checkpointed(contests(spark, sf_dir).select("contest_id", "day", "a_id", "b_id", "won_a"))
    out = network.common_opponents(w.chronological_rank(pairs.perspectives(met, measures=()), "day"))
    return out.select("contest_id", "entity", rounded(F.col("advantage")).alias("advantage"), "n_common")


def elo_by_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings.elo_by_pool(contests(spark, sf_dir))
    return r.select("pool", "contest_id", "a_id", "b_id", rounded(F.col("a_pre")).alias("a_pre"), rounded(F.col("b_pre")).alias("b_pre"))


def rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one day next to each other by key, as contests of their customers in one pool."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    by_day = Window.partitionBy("day").orderBy("o_orderkey")
    two = o.withColumns({"n": F.row_number().over(by_day), "rival": F.lead(F.struct("o_custkey", "o_totalprice")).over(by_day)}).where("n % 2 = 1 AND rival.o_custkey <> o_custkey")
    return two.select(
        F.lit("all").alias("pool"), F.col("o_orderkey").alias("contest_id"), "day", F.col("o_custkey").alias("a_id"), F.col("rival.o_custkey").alias("b_id"), (F.col("o_totalprice") > F.col("rival.o_totalprice")).cast("int").alias("won_a")
    )


def elo_in_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings.elo_in_waves(rivals(spark, sf_dir))
    return r.select("contest_id", "a_id", "b_id", rounded(F.col("a_pre")).alias("a_pre"), rounded(F.col("b_pre")).alias("b_pre"))


def elo_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings.elo_by_period(contests(spark, sf_dir), F.year(F.date_add(F.lit("1970-01-01"), F.col("day"))))
    return r.select("pool", "contest_id", rounded(F.col("a_pre")).alias("a_pre"), rounded(F.col("b_pre")).alias("b_pre"))


def glicko_by_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings.glicko_by_pool(contests(spark, sf_dir))
    return r.withColumn("gap", pairs.gap(F.col("a_mu"), F.col("b_mu"), F.col("a_sigma"), F.col("b_sigma")))


def trueskill_by_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.trueskill_by_pool(contests(spark, sf_dir))


def _train() -> Column:
    return F.pmod(F.col("c_custkey"), F.lit(3)) != 0


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") > -500, F.col("c_acctbal")).alias("bal"))


def group_zscore_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stats.group_moments(_customers(spark, sf_dir), "c_mktsegment", "bal", _train())
    return df.select("c_custkey", rounded(stats.imputed("bal"), 4).alias("filled"), rounded(stats.z_score("bal")).alias("z"))


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quantile_tiers(_customers(spark, sf_dir), "bal", _train()).select("c_custkey", F.col("tier").cast("long").alias("tier"))


def train_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stats.train_percentile(_customers(spark, sf_dir), "c_mktsegment", "bal", _train())
    return df.select("c_custkey", rounded(F.col("percentile")).alias("percentile"))


def late_early_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return stats.late_early_ratio(lines, ["l_orderkey"], "l_linenumber", "l_quantity").select("l_orderkey", rounded(F.col("late_early")).alias("late_early"))


def round_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    out = stats.position_pivot(lines, ["l_orderkey"], "l_linenumber", ["l_quantity"])
    return out.select("l_orderkey", *(f"l_quantity_{k}" for k in range(1, 6)), rounded(F.col("l_quantity_decline")).alias("decline"))


def shrunk_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior record of a supplier: all its contests less those of the last two years."""
    df = pairs.perspectives(contests(spark, sf_dir))
    recent = F.col("day") >= F.lit("1999-08-01")
    g = df.groupBy("entity").agg(F.count("*").alias("n"), F.sum("won").alias("wins"), F.count_if(recent).alias("n_seen"), F.coalesce(F.sum(F.when(recent, F.col("won"))), F.lit(0)).alias("wins_seen"))
    rate = stats.shrunk_record(F.col("n"), F.col("wins"), F.col("wins_seen"), F.col("n_seen"))
    return g.select("entity", rounded(rate).alias("rate"), rounded(ratings.seed_offset(F.col("wins"), F.col("n") - F.col("wins")), 5).alias("seed"))


def rolling_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.rolling_prior(contests(spark, sf_dir), "class", "day")
    return out.select("class", rounded(F.col("prior")).alias("prior"), "is_recent")


def residual_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = contests(spark, sf_dir).withColumn("residual", F.col("a_price") / 1000 - F.col("a_quantity"))
    return stats.residuals_by_class(df, "class", "a_quantity", "residual").select("class", F.col("quartile").cast("long").alias("quartile"), "n", rounded(F.col("mean_residual"), 4).alias("mean_residual"))


def zero_rate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = contests(spark, sf_dir).withColumn("small", (F.col("b_quantity") < 10).cast("double"))
    return stats.contingency(df, "class", "a_quantity", "small").select("class", F.col("quartile").cast("long").alias("quartile"), rounded(F.col("rate")).alias("rate"), "n")


def line_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = contests(spark, sf_dir)
    out = stats.origin_and_line(df, ["pool"], "a_quantity", "a_price")
    factor = stats.calibration_factor(df.withColumn("guess", F.col("a_quantity") * 1500), ["pool"], "a_price", "guess")
    return out.join(factor, "pool").select("pool", *(rounded(F.col(c), 4).alias(c) for c in ("origin_slope", "slope", "intercept", "factor")), "n")


QUERIES = {
    f.__name__: f
    for f in (
        perspective_ledger, wide_pairs, symmetrize, perspective_average, interactions, pair_differences, pairings, career_fill, common_opponents,
        elo_by_pool, elo_in_waves, elo_by_period, glicko_by_pool, trueskill_by_pool, group_zscore_train, tiers, train_percentile, late_early_ratio, round_pivot,
        shrunk_record, rolling_prior, residual_cells, zero_rate_table, line_fit,
    )
}

_CUST = """
    c AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal > -500 THEN c_acctbal END AS bal, c_custkey % 3 <> 0 AS train FROM customer)"""
_LONG = (
    PERSPECTIVES_SQL
    + """,
    long AS (SELECT *, avg(price) OVER h AS form, count(*) OVER h AS n FROM ledger
             WINDOW h AS (PARTITION BY entity ORDER BY day, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
)

ORACLE_SQL = {
    "perspective_ledger": f"WITH {PERSPECTIVES_SQL} SELECT contest_id, entity, opponent, won, price, price_against, quantity, quantity_against FROM ledger",
    "wide_pairs": f"""
        WITH {_LONG}
        SELECT a.contest_id, a.pool, a.entity AS entity_a, b.entity AS entity_b, a.won AS won_a, round(a.form, 4) AS form_a, round(b.form, 4) AS form_b, a.n AS n_a, b.n AS n_b
        FROM long a JOIN long b ON a.contest_id = b.contest_id AND a.entity < b.entity""",
    "symmetrize": f"""
        WITH {CONTESTS_SQL}
        SELECT contest_id, a_price AS price_a, b_price AS price_b, round(a_price - b_price, 4) AS price_diff, won_a, false AS is_flipped FROM contests
        UNION ALL SELECT contest_id, b_price, a_price, round(b_price - a_price, 4), 1 - won_a, true FROM contests""",
    "perspective_average": f"""
        WITH {CONTESTS_SQL}
        SELECT contest_id, round((a_price / (a_price + 2 * b_price) + 1 - b_price / (b_price + 2 * a_price)) / 2, 6) AS p FROM contests""",
    "interactions": f"""
        WITH {CONTESTS_SQL}
        SELECT contest_id, round(greatest(a_price - b_price, 0), 4) AS edge_a, round(ln(1 + a_price) * a_quantity, 4) AS pressure_a, round((a_quantity + 0.1) / (b_quantity + 0.1), 4) AS ratio_a,
               round(greatest(b_price - a_price, 0), 4) AS edge_b, round(ln(1 + b_price) * b_quantity, 4) AS pressure_b, round((b_quantity + 0.1) / (a_quantity + 0.1), 4) AS ratio_b
        FROM contests""",
    "pair_differences": f"""
        WITH {CONTESTS_SQL}, q AS (SELECT contest_id, CASE WHEN a_quantity > 5 THEN a_quantity END AS a, CASE WHEN b_quantity > 5 THEN b_quantity END AS b FROM contests)
        SELECT contest_id, coalesce(a, 30) - coalesce(b, 30) AS quantity_diff,
               CASE WHEN a > 25 THEN 'HIGH' WHEN a IS NOT NULL THEN 'LOW' ELSE 'UNKNOWN' END || '_' || CASE WHEN b > 25 THEN 'HIGH' WHEN b IS NOT NULL THEN 'LOW' ELSE 'UNKNOWN' END AS styles
        FROM q""",
    "pairings": f"""
        WITH {_LONG}, s AS (SELECT * FROM long QUALIFY row_number() OVER (PARTITION BY entity ORDER BY day DESC, contest_id DESC) = 1)
        SELECT s_suppkey AS id_a, s_suppkey + 1 AS id_b, round(a.form, 4) AS form_a, round(b.form, 4) AS form_b, a.n AS n_a, b.n AS n_b
        FROM supplier LEFT JOIN s a ON a.entity = s_suppkey LEFT JOIN s b ON b.entity = s_suppkey + 1""",
    "career_fill": f"""
        WITH {_LONG} SELECT contest_id, entity, round(coalesce(form, (avg(price) OVER (PARTITION BY entity))), 4) AS form FROM long""",
    "common_opponents": f"""
        WITH {PERSPECTIVES_SQL},
        r AS (SELECT *, dense_rank() OVER (ORDER BY day) - 1 AS rk FROM ledger),
        p AS (SELECT c.contest_id, c.entity, c.opponent, c.rk AS now, h.opponent AS met, h.won, h.rk
              FROM r c JOIN r h ON h.entity = c.entity AND h.rk < c.rk AND h.opponent <> c.opponent AND h.won IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY c.contest_id, c.entity, h.opponent ORDER BY h.rk DESC, h.contest_id DESC) = 1),
        m AS (SELECT a.contest_id, a.entity, a.won - b.won AS margin,
                     (CASE WHEN a.won > 0 THEN 1.0 ELSE 0.8 END + CASE WHEN b.won > 0 THEN 1.0 ELSE 0.8 END)::DOUBLE / 2
                     * (power(0.5, (a.now - a.rk) / 50.0) + power(0.5, (b.now - b.rk) / 50.0)) / 2 AS w
              FROM p a JOIN p b ON a.contest_id = b.contest_id AND a.opponent = b.entity AND a.met = b.met),
        s AS (SELECT contest_id, entity, sum(margin * w) / sum(w) AS advantage, count(*) AS n_common FROM m GROUP BY ALL)
        SELECT r.contest_id, r.entity, round(coalesce(advantage, 0), 6) AS advantage, coalesce(n_common, 0) AS n_common FROM r LEFT JOIN s USING (contest_id, entity)""",
    "group_zscore_train": f"""
        WITH {_CUST},
        g AS (SELECT c_mktsegment, quantile_cont(bal, 0.5) FILTER (train) AS med, avg(bal) FILTER (train) AS m, stddev_samp(bal) FILTER (train) AS s FROM c GROUP BY 1)
        SELECT c_custkey, round(coalesce(bal, med), 4) AS filled, round((bal - m) / s, 6) AS z FROM c JOIN g USING (c_mktsegment)""",
    "tiers": f"""
        WITH {_CUST}, q AS (SELECT quantile_cont(bal, [0.25, 0.5, 0.75]) FILTER (train) AS cuts FROM c)
        SELECT c_custkey, CASE WHEN bal IS NOT NULL THEN CAST(len(list_filter(cuts, lambda x: x < bal)) AS BIGINT) END AS tier FROM c, q""",
    "train_percentile": f"""
        WITH {_CUST}
        SELECT a.c_custkey, round(coalesce((SELECT count(*) FILTER (b.bal < a.bal) / nullif(count(b.bal), 0)
            FROM c b WHERE b.train AND b.c_mktsegment = a.c_mktsegment AND a.bal IS NOT NULL AND b.bal IS NOT NULL), 0.5), 6) AS percentile FROM c a""",
    "late_early_ratio": """
        SELECT l_orderkey, round(greatest(least(avg(l_quantity) FILTER (l_linenumber IN (4, 5)) / greatest(avg(l_quantity) FILTER (l_linenumber IN (1, 2)), 1), 3), 0), 6) AS late_early
        FROM lineitem GROUP BY 1""",
    "round_pivot": """
        WITH p AS (SELECT l_orderkey, {} FROM lineitem GROUP BY 1)
        SELECT *, round(CASE WHEN l_quantity_1 > 0 THEN l_quantity_3 / l_quantity_1 END, 6) AS decline FROM p""".format(
        ", ".join(f"sum(l_quantity) FILTER (l_linenumber = {k}) AS l_quantity_{k}" for k in range(1, 6))
    ),
    "shrunk_record": f"""
        WITH {PERSPECTIVES_SQL},
        g AS (SELECT entity, count(*) AS n, sum(won) AS w, count(*) FILTER (day >= DATE '1999-08-01') AS ns, coalesce(sum(won) FILTER (day >= DATE '1999-08-01'), 0) AS ws FROM ledger GROUP BY 1)
        SELECT entity, round((least(greatest(w - ws, 0), greatest(n - ns, 0)) + 2.5) / (greatest(n - ns, 0) + 5.0), 6) AS rate,
               round(greatest(least(100 * (w / n - 0.5) * ln(1 + n), 120), -120), 5) AS seed FROM g""",
    "rolling_prior": f"""
        WITH {CONTESTS_SQL},
        e AS (SELECT max(day) - INTERVAL 36 MONTH AS since FROM contests),
        k AS (SELECT class, count(*) FILTER (day > since) AS r, count(*) AS e FROM contests, e GROUP BY class),
        t AS (SELECT *, sum(r) OVER () >= 50 AND min(r) OVER () >= 5 AS is_recent, sum(r) OVER () AS sr, sum(e) OVER () AS se FROM k)
        SELECT class, round(CASE WHEN is_recent THEN r / sr ELSE e / se END, 6) AS prior, is_recent FROM t""",
    "residual_cells": f"""
        WITH {CONTESTS_SQL}, q AS (SELECT quantile_cont(a_quantity, [0.25, 0.5, 0.75]) AS cuts FROM contests),
        r AS (SELECT class, CAST(len(list_filter(cuts, lambda x: x < a_quantity)) AS BIGINT) AS quartile, a_price / 1000 - a_quantity AS residual FROM contests, q),
        k AS (SELECT class, avg(residual) AS c, count(*) AS nc FROM r GROUP BY 1)
        SELECT class, quartile, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN avg(residual) WHEN any_value(nc) >= 10 THEN any_value(c) ELSE 0 END, 4) AS mean_residual
        FROM r JOIN k USING (class) GROUP BY 1, 2""",
    "zero_rate_table": f"""
        WITH {CONTESTS_SQL}, q AS (SELECT quantile_cont(a_quantity, [0.25, 0.5, 0.75]) AS cuts FROM contests),
        r AS (SELECT class, CAST(len(list_filter(cuts, lambda x: x < a_quantity)) AS BIGINT) AS quartile, CASE WHEN b_quantity < 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS small FROM contests, q)
        SELECT class, coalesce(quartile, -1) AS quartile, round(avg(small), 6) AS rate, count(*) AS n FROM r GROUP BY GROUPING SETS ((class, quartile), (class))""",
    "line_fit": f"""
        WITH {CONTESTS_SQL}
        SELECT pool, round(sum(a_quantity * a_price) / sum(a_quantity * a_quantity), 4) AS origin_slope, round(regr_slope(a_price, a_quantity), 4) AS slope,
               round(regr_intercept(a_price, a_quantity), 4) AS intercept, round(avg(a_price) / avg(a_quantity * 1500), 4) AS factor, count(*) AS n
        FROM contests GROUP BY 1""",
}
