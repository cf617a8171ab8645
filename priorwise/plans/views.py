"""Tables of a data set, and the views of them that the queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorwise.operators.windows import History


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded with half-way values nudged up, so that two engines round them alike."""
    return F.round(c.cast("double") + 10.0 ** -(digits + 3), digits)


def nudged(sql: str) -> str:
    """SQL whose ``round(x, digits)`` calls nudge half-way values as ``rounded`` does."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, commas, k = 1, [], start + 6
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[k], 0)
            if sql[k] == "," and depth == 1:
                commas.append(k)
            k += 1
        value, digits = sql[start + 6 : commas[-1]], int(sql[commas[-1] + 1 : k - 1])
        out += [sql[at:start], f"round(CAST({nudged(value)} AS DOUBLE) + 1e-{digits + 3}, {digits})"]
        at = k
    return "".join(out) + sql[at:]


#: orders of a customer in time; the key breaks ties of the date
BY_CUSTOMER = History(("o_custkey",), ("o_orderdate", "o_orderkey"), "o_orderdate")

_TIE_KEY = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose first two lines have different suppliers, as a contest for the larger price."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *_TIE_KEY, "l_quantity")
    first = Window.partitionBy("l_orderkey").orderBy(*_TIE_KEY, "l_quantity")
    side = lambda k: F.max(F.when(F.col("k") == k, F.struct("l_suppkey", "l_extendedprice", "l_quantity")))
    two = lines.withColumn("k", F.row_number().over(first)).where("k <= 2").groupBy("l_orderkey").agg(side(1).alias("a"), side(2).alias("b"))
    two = two.where("a.l_suppkey <> b.l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    places = (
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.col("r_name").alias("pool"))
    )
    won = F.when(F.col("a.l_extendedprice") > F.col("b.l_extendedprice"), 1).when(F.col("a.l_extendedprice") < F.col("b.l_extendedprice"), 0)
    return (
        two.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(places, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("contest_id"),
            F.col("o_orderdate").cast("date").alias("day"),
            "pool",
            F.col("o_orderpriority").alias("class"),
            F.col("a.l_suppkey").alias("a_id"),
            F.col("b.l_suppkey").alias("b_id"),
            F.col("a.l_extendedprice").alias("a_price"),
            F.col("b.l_extendedprice").alias("b_price"),
            F.col("a.l_quantity").alias("a_quantity"),
            F.col("b.l_quantity").alias("b_quantity"),
            won.alias("won_a"),
        )
    )


CONTESTS_SQL = """
    lines AS (
        SELECT l_orderkey, l_suppkey, l_extendedprice, l_quantity,
               row_number() OVER (PARTITION BY l_orderkey
                   ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k
        FROM lineitem),
    contests AS (
        SELECT o_orderkey AS contest_id, CAST(o_orderdate AS DATE) AS day, r_name AS pool, o_orderpriority AS class,
               a.l_suppkey AS a_id, b.l_suppkey AS b_id, a.l_extendedprice AS a_price, b.l_extendedprice AS b_price,
               a.l_quantity AS a_quantity, b.l_quantity AS b_quantity,
               CASE WHEN a.l_extendedprice > b.l_extendedprice THEN 1 WHEN a.l_extendedprice < b.l_extendedprice THEN 0 END AS won_a
        FROM lines a JOIN lines b ON a.l_orderkey = b.l_orderkey AND a.k = 1 AND b.k = 2 AND a.l_suppkey <> b.l_suppkey
        JOIN orders ON o_orderkey = a.l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""

PERSPECTIVES_SQL = (
    CONTESTS_SQL
    + """,
    ledger AS (
        SELECT contest_id, day, pool, class, a_id AS entity, b_id AS opponent, a_price AS price, b_price AS price_against,
               a_quantity AS quantity, b_quantity AS quantity_against, won_a AS won FROM contests
        UNION ALL
        SELECT contest_id, day, pool, class, b_id, a_id, b_price, a_price, b_quantity, a_quantity, 1 - won_a FROM contests)"""
)


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as forecasts: probability p, outcome y, market, price q and its close."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    p = F.least(F.col("value") / 500, F.lit(0.999))
    return e.select(
        F.col("event_id").alias("id"),
        "ts",
        F.col("ts").cast("date").alias("day"),
        "user_id",
        F.concat(F.lit("m"), F.col("user_id") % 5).alias("market"),
        p.alias("p"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
        ((k + 1) / 102.0).alias("q"),
        ((k + 1) / 102.0 + F.when(k % 3 == 0, 0.0).otherwise(F.when(k % 2 == 0, 0.02).otherwise(-0.01))).alias("close"),
        F.when(F.col("event_type").isin("error"), "void").when(F.col("event_type") == "view", "pending").otherwise("resolved").alias("status"),
    )


FORECASTS_SQL = """
    f0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
    forecasts AS (
        SELECT event_id AS id, ts, CAST(ts AS DATE) AS day, user_id, 'm' || (user_id % 5) AS market,
               least(value / 500, 0.999) AS p, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y,
               (k + 1) / 102.0::DOUBLE AS q,
               (k + 1) / 102.0::DOUBLE + CASE WHEN k % 3 = 0 THEN 0.0::DOUBLE WHEN k % 2 = 0 THEN 0.02::DOUBLE ELSE -0.01::DOUBLE END AS close,
               CASE event_type WHEN 'error' THEN 'void' WHEN 'view' THEN 'pending' ELSE 'resolved' END AS status
        FROM f0)"""
