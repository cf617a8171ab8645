"""Queries of matching, cleaning, labelling and reporting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from priorwise.functions import cells, maths, names
from priorwise.operators import calibrate, dist, evaluate, ml, pairs, records, stats
from priorwise.operators import windows as w
from priorwise.operators.lineage import shared_folder
from priorwise.plans.views import BY_CUSTOMER, CONTESTS_SQL, FORECASTS_SQL, PERSPECTIVES_SQL, contests, forecasts, rounded, table
from priorwise.sources import files

_OUTCOMES = ("KO", "SUB", "U-DEC", "S-DEC", "M-DEC", "DQ", "NC")


def either_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests found again by day and pair, half of them with their sides swapped."""
    c = contests(spark, sf_dir)
    swap = F.col("contest_id") % 2 == 0
    other = c.groupBy("day", F.when(swap, F.col("b_id")).otherwise(F.col("a_id")).alias("x"), F.when(swap, F.col("a_id")).otherwise(F.col("b_id")).alias("y")).agg(F.min("contest_id").alias("first"))
    other = pairs.keep_first(other.withColumns({"lo": F.least("x", "y"), "hi": F.greatest("x", "y")}), ["day", "lo", "hi"], ["first"]).drop("lo", "hi")
    return records.join_either_way(c, other, ("a_id", "b_id"), ("x", "y"), ["day"]).select("contest_id", "first")


def contest_name_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders, which name a supplier by a name that many share, with the id of the side of their contest."""
    short = lambda c: F.concat(F.lit("s"), (F.col(c) % 9).cast("string"))
    c = contests(spark, sf_dir).select("contest_id", short("a_id").alias("a_name"), "a_id", short("b_id").alias("b_name"), "b_id")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("contest_id"), "l_linenumber", "l_partkey", short("l_suppkey").alias("name"))
    return records.ids_by_contest(c, lines, "contest_id", "name", [("a_name", "a_id"), ("b_name", "b_id")]).select("contest_id", "l_linenumber", "l_partkey", "name", "entity")


def semi_join_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return records.only_ids(table(spark, sf_dir, "orders"), ids, "o_custkey").select("o_orderkey", "o_custkey")


def pivot_joined_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the quantities of their first five lines."""
    pivot = stats.position_pivot(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", ["l_quantity"])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(pivot, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_custkey", *(f"l_quantity_{k}" for k in range(1, 6)))


def first_line_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return records.first_part_label(orders, table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", {"l_quantity": "r2_quantity", "l_tax": "r2_tax"}, at=2).withColumn("r2_tax", rounded(F.col("r2_tax")))


def field_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests whose class and quantity are corrected; the correction's price is not allowed."""
    c = contests(spark, sf_dir).select("day", "a_id", "b_id", "contest_id", "class", "a_quantity", "a_price")
    new = c.where("contest_id % 10 = 0").select(
        "day", "a_id", "b_id", "contest_id", F.when(F.col("contest_id") % 20 == 0, "fixed").alias("class"), (F.col("a_quantity") + 1).alias("a_quantity"), F.lit(-1.0).alias("a_price")
    )
    return records.apply_overrides(c, new, ["day", "a_id", "b_id", "contest_id"], ["class", "a_quantity"]).select("contest_id", "class", "a_quantity", "a_price")


def rolling_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate").cast("date")).alias("day"))
    return records.rolling_split(o, "day").drop("day")


def _outcome():
    return F.element_at(F.array(*(F.lit(x) for x in _OUTCOMES)), (F.col("contest_id") % 7 + 1).cast("int"))


def label_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contests(spark, sf_dir).select("contest_id", _outcome().alias("outcome"), "won_a", F.when(F.col("contest_id") % 5 != 0, F.col("contest_id") % 5 == 1).alias("flag"))
    return records.clean_labels(c, "outcome", "won_a", "flag").select("contest_id", "outcome", "won_a")


def dated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("date")).alias("day"))
    kept, undated = records.dated(o, "day")
    return kept.withColumn("undated", F.lit(undated).cast("long"))


def still_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cards, with and without a start, some with text that is no date or no time."""
    k, date = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    day = F.when(k % 10 == 0, "soon").when(k % 10 != 1, date)
    clock = F.when(k % 3 == 0, F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":30"))).when(k % 3 == 1, "").when(k % 2 == 0, "late")
    return table(spark, sf_dir, "orders").select("o_orderkey", records.still_listed(day, clock, F.lit("2000-06-15 12:00:00").cast("timestamp")).alias("listed"))


def outcome_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of each side of a contest, and its earlier knockout rate among wins."""
    ledger = pairs.perspectives(contests(spark, sf_dir)).withColumn("outcome", _outcome())
    made = records.outcome_indicators(F.col("outcome"), F.col("won"), F.col("contest_id") % 10 == 0, F.col("contest_id") % 4 + 1, F.when(F.col("contest_id") % 3 == 0, 5).otherwise(3))
    rows = ledger.select("contest_id", "entity", "day", *(c.alias(n) for n, c in made.items()))
    rate = w.expanding(w.History(("entity",), ("day", "contest_id"), "day"), F.col("ko_win"))
    return rows.select("contest_id", "entity", *made, rounded(rate).alias("ko_rate")).fillna(-1.0)


def damage_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sum of an order's price and key, decayed over the customer's earlier orders."""
    o = table(spark, sf_dir, "orders").withColumns({"head": F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")), "leg": F.col("o_custkey").cast("double")})
    o = o.withColumn("raw", w.weighted_sum({"head": 1.0, "leg": 0.5}))
    return o.select("o_orderkey", rounded(F.col("raw"), 3).alias("raw"), rounded(w.decayed(BY_CUSTOMER, F.col("raw"), 365.0), 3).alias("damage"))


_CONCEPTS = (("metal", ("ring", "bolt", "steel")), ("colour", ("blue", "red", "green")), ("size", ("small", "large")))


def concept_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as features with suffixes, retail prices as importances, summed by group."""
    k = F.col("p_partkey") % 4
    suffix = F.when(k == 0, "_l5_a").when(k == 1, "_decay_diff").when(k == 2, "_b").otherwise("")
    p = table(spark, sf_dir, "part").select(F.concat(F.lower(F.regexp_replace("p_name", " ", "_")), suffix).alias("feature"), F.col("p_size").cast("double").alias("importance"))
    return p.groupBy(records.concept(F.col("feature"), _CONCEPTS).alias("concept")).agg(F.sum("importance").alias("importance"), F.count("*").alias("n"))


def status_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", (F.col("user_id") % 4).cast("string")).alias("kind"))
    known = {"view1": "live", "view": "off", "click": "Live"}
    plain, general = records.status_by_kind(F.col("kind"), known), records.status_by_kind(F.col("kind"), known, "general")
    return e.select("event_id", plain.alias("status"), general.alias("general"), records.status_by_kind(F.col("kind"), known, allowed=["live"]).alias("strict"))


def card_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    place = records.slot((n == 1) & (F.col("l_returnflag") == "R"), F.when(F.col("l_linestatus") == "F", F.when(n == 7, "early").otherwise("")), n - 1)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", place.alias("slot")).agg(F.count("*").alias("n"))


def entity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    career = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(
        F.col("s_suppkey").alias("entity"), F.when(F.col("s_suppkey") % 2 == 0, 10).alias("wins"), F.lit(4).alias("losses"), F.lit(None).cast("int").alias("draws")
    )
    won = F.when(F.col("contest_id") % 9 != 0, F.col("won"))
    return records.records(pairs.perspectives(contests(spark, sf_dir)).withColumn("won", won), "entity", "won", career)


def tercile_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contests(spark, sf_dir).withColumns({"p": F.col("a_price") / (F.col("a_price") + F.col("b_price")), "score": F.when(F.col("a_quantity") > 2, F.col("a_quantity"))})
    out = records.tercile_slices(c, "score", "day", "p", "won_a")
    return out.select("slice", "n", *(rounded(F.col(x)).alias(x) for x in ("predicted", "observed", "error")))


def latest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests of the five last days (the query is a feed of that length)."""
    return records.latest_events(contests(spark, sf_dir), "day", 5).select("contest_id", "day")


def top_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest effects of each order's lines (the feature is a top-n)."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum(F.floor(F.col("l_discount") * 100 + 0.5) - 5).alias("effect"))
    out = records.top_effects(li, ["l_orderkey"], "l_partkey", "effect", 3, 3.0)
    return out.select("l_orderkey", "l_partkey", "effect", F.col("rank").cast("long").alias("rank"))


def accumulated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that two rounds have found, each written and read again."""
    p = table(spark, sf_dir, "part")
    path = f"{shared_folder(spark)}/names-{uuid.uuid4().hex}"
    held = p.where("p_size < 20").select("p_name")
    files.write_table(records.accumulated(held.limit(0), held, "p_name"), f"{path}/1")
    files.write_table(records.accumulated(spark.read.parquet(f"{path}/1"), p.where("p_size >= 20").select("p_name"), "p_name"), f"{path}/2")
    return spark.read.parquet(f"{path}/2")


def climatology_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contests(spark, sf_dir)
    samples = F.array(*(F.col("a_quantity") * k for k in (0.5, 0.9, 1.0, 1.3)))
    train = F.col("contest_id") % 3 != 0
    out = records.climatology_skill(c.where(train), c.where(~train).withColumn("samples", samples), ["class"], "b_quantity", "samples", ["pool"])
    return out.select("pool", "n", *(rounded(F.col(x)).alias(x) for x in ("crps_model", "crps_pool", "skill")))


def conditional_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities against the forecast of the realized flag of their line, as a test of uniformity."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.groupBy("l_orderkey").agg(F.min("l_returnflag").alias("flag"), F.max("l_quantity").alias("y"))
    tops = {"A": 50.0, "R": 55.0, "N": 60.0}
    flags = F.explode(F.array(*(F.struct(F.lit(k).alias("flag"), F.lit(v).alias("top")) for k, v in tops.items())))
    made = rows.select("l_orderkey", flags.alias("f")).select("l_orderkey", "f.flag", "f.top")
    scored = records.realized_forecasts(rows, made, "l_orderkey", "flag").withColumn("u", (F.col("y") - 0.5) / F.col("top"))
    out = evaluate.ks_uniform(scored, ["flag"], "u")
    return out.select("flag", F.col("n").cast("long").alias("n"), rounded(F.col("ks")).alias("ks"), rounded(F.col("p_value"), 5).alias("p_value"))


def draw_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.coherence(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "A", "R", 40.0, 0.28)
    return out.select("check", rounded(F.col("value")).alias("value"), "holds")


def numeric_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions of odds, weights, ages and intervals over orders."""
    o = table(spark, sf_dir, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    p = (k % 90 + 5) / 100.0
    probs, prior = F.array(p, 1 - p), F.array(F.lit(0.7), F.lit(0.3))
    wald = maths.wald(p, k % 50 + 1)
    label = F.concat((k % 6 + 2).cast("string"), F.lit("pick_power"))
    pair = names.pair_key(F.col("o_orderdate").cast("date"), F.lit("x"), F.col("o_orderpriority"))
    columns = {
        "elapsed": cells.elapsed_seconds(k % 3 + 1, F.when(k % 5 != 0, k % 300)).cast("double"), "age": maths.age_years(F.col("o_orderdate"), F.lit("1970-01-01").cast("date")),
        "exposure": maths.exposure_weight(F.when(k % 7 != 0, k % 40 + 0.0), F.lit(25.0)), "shrunk": F.get(maths.shrink_to_prior(probs, prior), F.lit(0)), "kelly": maths.kelly_odds(p, F.lit(1.9), 0.25),
        "picks": maths.pick_count(label).cast("double"), "implied": maths.implied(F.lit(3.0), maths.pick_count(label)), "low": wald["low"], "high": wald["high"],
        "near_market": maths.shrink_to_market(p, F.lit(0.5)), "soft": F.get(maths.softmax(F.array(p, F.lit(0.5)), 0.5), F.lit(0)), "known": maths.nan_to_null(F.when(k % 4 == 0, F.lit(float("nan"))).otherwise(price)),
        "rising": F.get(maths.running_max(F.array(p, F.lit(0.5), 1 - p)), F.lit(2)), "weight": maths.temper_by(p, F.col("o_orderpriority"), {"1-URGENT": 1.5, "2-HIGH": 0.8}),
    }
    return o.select("o_orderkey", *(rounded(c).alias(n) for n, c in columns.items()), names.line_key(pair, F.col("o_orderstatus"), F.lit(None).cast("string"), line=p).alias("key"))


def payout_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Break-even probabilities by platform and variant."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("app_"), (F.col("user_id") % 3 + 2).cast("string"), F.lit("pick")).alias("variant"))
    payouts = spark.sql("SELECT * FROM VALUES ('app_2pick', 3D), ('app_3pick', 6D), ('app_4pick', 10D) AS t(variant, multiplier)")
    return maths.with_payout(e, payouts, "variant").select("event_id", "multiplier", rounded(F.col("break_even")).alias("break_even"))


def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survival and inverse values of the vectors' sorted components as grids and samples."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.array_sort(F.transform("embedding", lambda v: F.abs(v.cast("double")) * 100)).alias("v"))
    n = F.size("v")
    qs = F.transform(F.sequence(F.lit(1), n), lambda i: (i - 1) / (n - 1.0))
    p0 = F.lit(0.2)
    out = x.select(
        "vec_id", dist.hurdle_over(F.lit(7.5), p0, qs, F.col("v")).alias("over"), dist.sample_over(F.lit(7.5), F.col("v"), p0).alias("sample_over"), dist.sample_over(F.lit(0.5), F.col("v"), p0).alias("any"),
        dist.duration_quantile(F.lit(0.4), F.lit(0.3), qs, F.col("v"), F.lit(30.0)).alias("q40"), dist.duration_quantile(F.lit(0.9), F.lit(0.3), qs, F.col("v"), F.lit(30.0)).alias("q90"),
        F.get(dist.inverse_on_grid(F.array(F.lit(0.25)), F.col("v"), qs), F.lit(0)).alias("inverse"),
    )
    return out.select("vec_id", *(rounded(F.col(c)).alias(c) for c in out.columns if c != "vec_id"))


def distribution_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two points of each vector's sample distribution."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double")) * 100).alias("v"))
    return dist.curve(x, ["vec_id"], F.array(F.lit(5.0), F.lit(10.0)), lambda p: dist.sample_cdf(p, F.col("v"))).select("vec_id", "x", rounded(F.col("cdf")).alias("cdf"))


def nearest_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.sql("SELECT * FROM VALUES ('light', 10D), ('mid', 25D), ('heavy', 40D) AS t(class, pounds)")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("q"))
    return pairs.nearest_class(li, "q", classes, "class", "pounds").groupBy("l_orderkey", "class").agg(F.count("*").alias("n"))


def repeated_line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.repeated_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", F.col("count").alias("n"))


def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report by run date, replaced by a later run of the same path; a curated table that is missing adds nothing."""
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").cast("string").alias("run_date")).agg(F.count("*").alias("n"))
    files.write_table(e.where("event_type <> 'view'"), path, "run_date")
    files.write_table(e, path, "run_date")
    extra = files.read_override(spark, f"{path}-none", StructType.fromDDL("event_type string, note string"))
    return spark.read.parquet(path).join(extra, "event_type", "left").select("event_type", F.col("run_date").cast("string").alias("run_date"), "n", "note")


def zero_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the forecasts after the shift that makes it a tenth."""
    f = forecasts(spark, sf_dir)
    shift = calibrate.zero_rate_shift(f, "p", 0.1)
    return f.agg(F.count("*").alias("n"), F.round(F.avg(maths.sigmoid(maths.logit(F.col("p")) + shift)), 4).alias("mean"))


def rate_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor on quantities that brings them nearest to uniform on 0 to 60."""
    li = table(spark, sf_dir, "lineitem").select("l_quantity")
    grid = [0.9, 1.0, 1.1, 1.2, 1.3]
    return spark.createDataFrame([(float(calibrate.best_factor(li, "l_quantity", lambda x: maths.clip(x / 60.0, 0.0, 1.0), grid)),)], "factor double")


def half_life_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation scores of recency half-lives of a weighted probe on the forecasts."""
    f = forecasts(spark, sf_dir).withColumn("x", F.col("q"))
    return ml.half_life_scores(f.where("id % 4 <> 0"), f.where("id % 4 = 0"), ["p", "x"], "y", "day", [30.0, 365.0])


def hurdle_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a line is taxed at all, and the grid of positive taxes of its flag."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.sum(F.floor(F.col("l_tax") * 20)).alias("count"), F.min("l_returnflag").alias("flag"))
    out = ml.hurdle(li.where("l_orderkey % 3 <> 0"), li, ["q", "d"], "count", ["flag"], [0.25, 0.5, 0.75])
    return out.select("l_orderkey", "p_positive", "qv")


QUERIES = {
    f.__name__: f
    for f in (
        either_orientation, contest_name_ids, semi_join_ids, pivot_joined_back, first_line_label, field_overrides, rolling_split, label_hygiene, dated_rows, still_listed, outcome_rates, damage_index,
        concept_groups, status_fallback, card_slots, entity_records, tercile_slices, latest_days, top_effects, accumulated_names, climatology_skill, conditional_null, draw_coherence, numeric_forms,
        payout_lookup, curve_points, distribution_curve, nearest_classes, repeated_line_keys, report_table, zero_rate, rate_factor, half_life_choice, hurdle_scores,
    )
}

_OUTCOME_SQL = "['KO', 'SUB', 'U-DEC', 'S-DEC', 'M-DEC', 'DQ', 'NC'][contest_id % 7 + 1]"
_FLAG = "coalesce(contest_id % 10 = 0, false)"

ORACLE_SQL = {
    "either_orientation": f"""
        WITH {CONTESTS_SQL}
        SELECT contest_id, min(contest_id) OVER (PARTITION BY day, least(a_id, b_id), greatest(a_id, b_id)) AS first FROM contests""",
    "contest_name_ids": f"""
        WITH {CONTESTS_SQL}
        SELECT l_orderkey AS contest_id, l_linenumber, l_partkey, 's' || (l_suppkey % 9) AS name,
               CASE l_suppkey % 9 WHEN b_id % 9 THEN b_id WHEN a_id % 9 THEN a_id END AS entity
        FROM lineitem LEFT JOIN contests ON contest_id = l_orderkey""",
    "semi_join_ids": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "pivot_joined_back": "SELECT o_orderkey, o_custkey, {} FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2".format(
        ", ".join(f"sum(l_quantity) FILTER (l_linenumber = {k}) AS l_quantity_{k}" for k in range(1, 6))
    ),
    "first_line_label": """
        SELECT o_orderkey AS l_orderkey, o_orderstatus, coalesce(sum(l_quantity) FILTER (l_linenumber = 2), 0) AS r2_quantity, round(coalesce(sum(l_tax) FILTER (l_linenumber = 2), 0), 6) AS r2_tax
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "field_overrides": f"""
        WITH {CONTESTS_SQL}
        SELECT contest_id, CASE WHEN contest_id % 20 = 0 THEN 'fixed' ELSE class END AS class, CASE WHEN contest_id % 10 = 0 THEN a_quantity + 1 ELSE a_quantity END AS a_quantity, a_price FROM contests""",
    "rolling_split": """
        WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders),
        e AS (SELECT max(d) AS e, CAST(max(d) - INTERVAL 6 MONTH AS DATE) AS s FROM o), m AS (SELECT *, s + CAST(floor(date_diff('day', s, e) / 2) AS INT) AS mid FROM e)
        SELECT o_orderkey, coalesce(d <= e, false) AS in_train, coalesce(d >= s, false) AS in_val, coalesce(d >= s AND d < mid, false) AS in_val_a, coalesce(d >= mid, false) AS in_val_b FROM o, m""",
    "label_hygiene": f"""
        WITH {CONTESTS_SQL}, c AS (SELECT contest_id, {_OUTCOME_SQL} AS outcome, won_a FROM contests)
        SELECT * FROM c WHERE outcome NOT IN ('DQ', 'NC') AND won_a IS NOT NULL AND contest_id % 5 <> 1""",
    "dated_rows": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, (SELECT count(*) FILTER (o_orderkey % 7 = 0) FROM orders) AS undated FROM orders WHERE o_orderkey % 7 <> 0",
    "still_listed": """
        WITH o AS (SELECT o_orderkey, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
        SELECT o_orderkey, CASE WHEN k % 10 IN (0, 1) THEN true WHEN k % 3 = 0 THEN TIMESTAMP '2000-06-15 12:00:00' < CAST(d AS TIMESTAMP) + to_hours(24 + k % 24) + INTERVAL 30 MINUTE
               ELSE DATE '2000-06-15' <= d + 2 END AS listed FROM o""",
    "outcome_rates": f"""
        WITH {PERSPECTIVES_SQL},
        l AS (SELECT *, {_OUTCOME_SQL} AS o, contest_id % 4 + 1 AS r FROM ledger),
        i AS (SELECT contest_id, entity, day, won, r, o, (o = 'KO' AND NOT {_FLAG})::INT::DOUBLE AS ko, (o = 'SUB' AND NOT {_FLAG})::INT::DOUBLE AS sub, (o LIKE '%-DEC')::INT::DOUBLE AS dec FROM l),
        k AS (SELECT *, CASE WHEN won = 1 THEN ko END AS kw FROM i)
        SELECT contest_id, entity, coalesce(kw, -1) AS ko_win, CASE WHEN won = 1 THEN sub ELSE -1 END AS sub_win, CASE WHEN won = 0 THEN ko ELSE -1 END AS ko_loss, CASE WHEN won = 0 THEN sub ELSE -1 END AS sub_loss,
               least(ko + sub, 1) AS finish, dec AS decision, CASE WHEN r <= 2 THEN least(ko + sub, 1) ELSE 0.0 END AS early_finish, CASE WHEN r = 1 AND won = 1 THEN ko ELSE 0.0 END AS first_round_ko_win,
               CASE WHEN r = 1 AND won = 1 THEN sub ELSE 0.0 END AS first_round_sub_win, CASE WHEN contest_id % 3 = 0 THEN dec ELSE -1 END AS long_decision,
               coalesce(round(avg(kw) OVER (PARTITION BY entity ORDER BY day, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6), -1) AS ko_rate FROM k""",
    "damage_index": """
        WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice ELSE 0 END + 0.5::DOUBLE * o_custkey AS raw FROM orders)
        SELECT a.o_orderkey, round(any_value(a.raw), 3) AS raw, round(sum(b.raw * power(0.5, date_diff('day', b.o_orderdate, a.o_orderdate) / 365.0)) / sum(power(0.5, date_diff('day', b.o_orderdate, a.o_orderdate) / 365.0)), 3) AS damage
        FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND (b.o_orderdate, b.o_orderkey) < (a.o_orderdate, a.o_orderkey) GROUP BY 1""",
    "concept_groups": """
        SELECT CASE WHEN regexp_matches(lower(p_name), 'ring|bolt|steel') THEN 'metal' WHEN regexp_matches(lower(p_name), 'blue|red|green') THEN 'colour'
                    WHEN regexp_matches(lower(p_name), 'small|large') THEN 'size' ELSE 'other' END AS concept, sum(p_size)::DOUBLE AS importance, count(*) AS n FROM part GROUP BY 1""",
    "status_fallback": """
        SELECT event_id, CASE WHEN event_type = 'view' THEN CASE user_id % 4 WHEN 1 THEN 'live' ELSE 'off' END WHEN event_type = 'click' THEN 'Live' ELSE 'paper' END AS status,
               CASE WHEN event_type = 'view' THEN CASE user_id % 4 WHEN 1 THEN 'live' ELSE 'off' END WHEN event_type = 'click' THEN 'Live' ELSE 'general' END AS general,
               CASE WHEN event_type = 'click' OR (event_type = 'view' AND user_id % 4 = 1) THEN 'live' ELSE 'paper' END AS strict FROM events""",
    "card_slots": """
        SELECT l_orderkey, CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN 'title' WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN 'early' WHEN l_linenumber <= 5 THEN 'main' ELSE 'prelim' END AS slot, count(*) AS n
        FROM lineitem GROUP BY 1, 2""",
    "entity_records": f"""
        WITH {PERSPECTIVES_SQL}, l AS (SELECT entity, CASE WHEN contest_id % 9 <> 0 THEN won END AS won FROM ledger),
        g AS (SELECT entity, count(*) FILTER (won = 1) AS w, count(*) FILTER (won = 0) AS l, count(*) FILTER (won IS NULL) AS d FROM l GROUP BY 1),
        c AS (SELECT s_suppkey AS entity FROM supplier WHERE s_suppkey % 6 = 0)
        SELECT coalesce(g.entity, c.entity) AS entity, CASE WHEN c.entity IS NULL THEN w ELSE 10 END AS wins, CASE WHEN c.entity IS NULL THEN l ELSE 4 END AS losses, CASE WHEN c.entity IS NULL THEN d ELSE 0 END AS draws
        FROM g FULL JOIN c ON g.entity = c.entity""",
    "tercile_slices": f"""
        WITH {CONTESTS_SQL}, s AS (SELECT day, a_price / (a_price + b_price) AS p, won_a AS y, CASE WHEN a_quantity > 2 THEN a_quantity ELSE 0.0 END AS v FROM contests),
        q AS (SELECT quantile_cont(v, 0.33) AS a, quantile_cont(v, 0.67) AS b FROM s),
        t AS (SELECT CASE WHEN v < a THEN 'low' WHEN v < b THEN 'mid' ELSE 'top' END AS slice, p, y FROM s, q UNION ALL SELECT 'year ' || year(day), p, y FROM s)
        SELECT slice, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed, round(avg(p) - avg(y), 6) AS error FROM t GROUP BY 1 HAVING count(*) >= 20""",
    "latest_days": f"WITH {CONTESTS_SQL} SELECT contest_id, day FROM contests WHERE day IN (SELECT DISTINCT day FROM contests ORDER BY day DESC LIMIT 5)",
    "top_effects": """
        WITH g AS (SELECT l_orderkey, l_partkey, sum(floor(l_discount * 100 + 0.5::DOUBLE) - 5)::BIGINT AS effect FROM lineitem GROUP BY 1, 2),
        m AS (SELECT *, max(abs(effect)) OVER (PARTITION BY l_orderkey) AS top FROM g)
        SELECT l_orderkey, l_partkey, effect, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(effect) DESC, l_partkey) AS rank FROM m WHERE top < 3 OR abs(effect) >= 3 QUALIFY rank <= 3""",
    "accumulated_names": "SELECT DISTINCT p_name FROM part WHERE p_size IS NOT NULL",
    "climatology_skill": f"""
        WITH {CONTESTS_SQL},
        p AS (SELECT class, b_quantity AS v, count(*)::DOUBLE AS c FROM contests WHERE contest_id % 3 <> 0 GROUP BY 1, 2),
        h AS (SELECT a.class, sum(a.c * b.c * abs(a.v - b.v)) / sum(a.c * b.c) / 2 AS spread FROM p a JOIN p b USING (class) GROUP BY 1),
        r AS (SELECT contest_id, pool, class, b_quantity AS y, [0.5::DOUBLE * a_quantity, 0.9::DOUBLE * a_quantity, a_quantity, 1.3::DOUBLE * a_quantity] AS s FROM contests WHERE contest_id % 3 = 0),
        y AS (SELECT r.class, r.y, sum(p.c * abs(p.v - r.y)) / sum(p.c) AS near FROM (SELECT DISTINCT class, y FROM r) r JOIN p USING (class) GROUP BY 1, 2),
        m AS (SELECT pool, near - spread AS k, list_avg(list_transform(s, lambda x: abs(x - r.y))) - list_avg(list_transform(flatten(list_transform(s, lambda a: list_transform(s, lambda b: abs(a - b)))), lambda x: x)) / 2 AS c
              FROM r JOIN y USING (class, y) JOIN h USING (class))
        SELECT pool, count(*) AS n, round(avg(c), 6) AS crps_model, round(avg(k), 6) AS crps_pool, round(1 - avg(c) / avg(k), 6) AS skill FROM m GROUP BY 1""",
    "conditional_null": f"""
        WITH r AS (SELECT l_orderkey, min(l_returnflag) AS flag, max(l_quantity) AS y FROM lineitem GROUP BY 1),
        u AS (SELECT flag, (y - 0.5::DOUBLE) / CASE flag WHEN 'A' THEN 50.0::DOUBLE WHEN 'R' THEN 55.0::DOUBLE ELSE 60.0::DOUBLE END AS u FROM r WHERE flag IN ('A', 'R', 'N')),
        g AS (SELECT flag, u, count(*) AS k FROM u GROUP BY 1, 2), s AS (SELECT flag, u, k, sum(k) OVER (PARTITION BY flag ORDER BY u) AS hi, sum(k) OVER (PARTITION BY flag) AS n FROM g),
        t AS (SELECT flag, any_value(n)::BIGINT AS n, max(greatest(hi / n - u, u - (hi - k) / n)) AS ks FROM s GROUP BY 1 HAVING any_value(n) >= 20), z AS (SELECT *, sqrt(n) * ks AS t FROM t)
        SELECT flag, n, round(ks, 6) AS ks, round(CASE WHEN t < 0.2 THEN 1 ELSE greatest(least({" + ".join(f"{2 * (-1) ** (k - 1)} * exp(-{2 * k * k} * t * t)" for k in range(1, 41))}, 1), 0) END, 5) AS p_value FROM z""",
    "draw_coherence": """
        WITH m AS (SELECT avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag = 'A') AS gap, avg((l_quantity > 40)::INT) FILTER (l_returnflag = 'A') AS tail, count(*) FILTER (l_quantity IS NULL) AS missing FROM lineitem)
        SELECT 'mean_gap' AS "check", round(gap, 6) AS value, gap > 0 AS holds FROM m UNION ALL SELECT 'tail_share', round(tail, 6), tail <= 0.28 FROM m UNION ALL SELECT 'missing', round(missing, 6), missing = 0 FROM m""",
    "numeric_forms": """
        WITH o AS (SELECT *, o_orderkey AS k, (o_orderkey % 90 + 5) / 100.0::DOUBLE AS p, o_orderkey % 50 + 1 AS n FROM orders),
        q AS (SELECT *, 1.959963984540054::DOUBLE * sqrt(p * (1 - p) / n) AS half, CASE o_orderpriority WHEN '1-URGENT' THEN 1.5::DOUBLE WHEN '2-HIGH' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS t FROM o)
        SELECT o_orderkey, round(CASE WHEN k % 5 <> 0 THEN (k % 3) * 300 + k % 300 END, 6) AS elapsed, round(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) / 365.25::DOUBLE, 6) AS age,
               round(CASE WHEN k % 7 <> 0 THEN greatest(least((k % 40) / 25.0::DOUBLE, 1.0), 0.1) ELSE 1.0 END, 6) AS exposure, round(0.95::DOUBLE * p + 0.05::DOUBLE * 0.7::DOUBLE, 6) AS shrunk,
               round(greatest(least((p - 1 / 1.9::DOUBLE) / (1 - 1 / 1.9::DOUBLE), 0.25), 0), 6) AS kelly, round(k % 6 + 2, 6) AS picks, round(power(3.0::DOUBLE, -1.0::DOUBLE / (k % 6 + 2)), 6) AS implied,
               round(greatest(p - half, 0), 6) AS low, round(least(p + half, 1), 6) AS high, round((p + 0.5::DOUBLE) / 2, 6) AS near_market, round(exp(p / 0.5::DOUBLE) / (exp(p / 0.5::DOUBLE) + exp(1.0::DOUBLE)), 6) AS soft,
               round(CASE WHEN k % 4 <> 0 THEN o_totalprice END, 6) AS known, round(greatest(p, 0.5, 1 - p), 6) AS rising,
               round(CASE WHEN abs(p - 0.5::DOUBLE) < 1e-6 THEN p ELSE 1 / (1 + exp(-ln(p / (1 - p)) / t)) END, 6) AS weight,
               strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderpriority || '|x|' || o_orderstatus || '||' || printf('%.4f', p) AS key FROM q""",
    "payout_lookup": """
        SELECT event_id, [3.0::DOUBLE, 6.0::DOUBLE, 10.0::DOUBLE][user_id % 3 + 1] AS multiplier, round(power([3.0::DOUBLE, 6.0::DOUBLE, 10.0::DOUBLE][user_id % 3 + 1], -1.0::DOUBLE / (user_id % 3 + 2)), 6) AS break_even FROM events""",
    "distribution_curve": """
        SELECT vec_id, x, round(len(list_filter(embedding, lambda v: abs(v::DOUBLE) * 100 <= x)) / len(embedding), 6) AS cdf FROM embeddings, (SELECT unnest([5.0::DOUBLE, 10.0::DOUBLE]) AS x)""",
    "nearest_classes": """
        WITH l AS (SELECT l_orderkey, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q FROM lineitem)
        SELECT l_orderkey, CASE WHEN q IS NULL THEN NULL WHEN abs(q - 10) <= abs(q - 25) THEN 'light' WHEN abs(q - 25) <= abs(q - 40) THEN 'mid' ELSE 'heavy' END AS class, count(*) AS n FROM l GROUP BY 1, 2""",
    "repeated_line_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "report_table": "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS run_date, count(*) AS n, CAST(NULL AS VARCHAR) AS note FROM events GROUP BY 1, 2",
    "zero_rate": f"WITH {FORECASTS_SQL} SELECT count(*) AS n, 0.1::DOUBLE AS mean FROM forecasts",
}
