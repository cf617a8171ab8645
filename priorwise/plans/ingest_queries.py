"""Queries of parsing, resolution, splits and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.functions import cells, names
from priorwise.operators import resolve
from priorwise.operators.lineage import shared_folder
from priorwise.sources import files, pages, quotes
from priorwise.plans.views import table


def parse_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as a scraper would store them, made from order lines, and parsed."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    li = table(spark, sf_dir, "lineitem")
    odd = n == 7
    of = F.when(odd, "---").otherwise(F.concat(n.cast("string"), F.lit(" of "), q.cast("string")))
    clock = F.when(odd, "--").otherwise(F.concat((q % 5).cast("string"), F.lit(":"), F.lpad((q % 60).cast("string"), 2, "0")))
    height = F.concat((n + 3).cast("string"), F.lit("' "), (q % 12).cast("string"), F.lit('"'))
    weight = F.when(odd, "--").otherwise(F.concat(q.cast("string"), F.lit(" lbs.")))
    share = F.concat(q.cast("string"), F.lit("%"))
    date = F.when(n < 4, F.date_format("l_shipdate", "MMMM d, yyyy")).otherwise(F.date_format("l_shipdate", "MMM d, yyyy"))
    label = F.element_at(F.array(*(F.lit(x) for x in ("KO/TKO", "Submission", "Decision - Unanimous", "Decision - Split", "DQ", "Overturned", "odd"))), n)
    rows = li.select(
        "l_orderkey", "l_linenumber", cells.x_of_y(of).alias("xy"), cells.clock_seconds(clock).alias("seconds"), cells.feet_inches(height).alias("inches"),
        cells.leading_number(weight).alias("pounds"), cells.percent(share).alias("share"), cells.first_date(date).alias("day"), cells.outcome_label(label).alias("outcome"),
        cells.scheduled_rounds(F.concat(n.cast("string"), F.lit(" Rnd (5-5)"))).alias("rounds"), cells.url_tail(F.concat(F.lit("http://x/y/"), F.col("l_partkey").cast("string"))).alias("tail"),
    )
    total = lambda c: F.sum(c).cast("double")
    return rows.groupBy("l_orderkey").agg(
        total("xy.landed").alias("landed"), total("xy.tried").alias("tried"), total("seconds").alias("seconds"), total("inches").alias("inches"), total("pounds").alias("pounds"),
        F.round(F.sum("share") + 1e-9, 4).alias("share"), F.max("day").alias("day"), F.array_join(F.array_sort(F.collect_list("outcome")), ",").alias("outcomes"),
        total("rounds").alias("rounds"), total(F.col("tail").cast("long")).alias("tails"),
    )


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("  José "), F.col("c_name"), F.lit("-Smith, Jr. ")).alias("name"))
    a, b = F.col("c_name_key"), F.lit("supplier 7")
    c = c.select("c_custkey", names.spaced_key(F.col("name")).alias("c_name_key"), names.tight_key(F.col("name")).alias("tight"), names.plain_key(F.col("name")).alias("plain"), names.alnum_key(F.col("name")).alias("alnum"))
    return c.select("c_custkey", F.col("c_name_key").alias("spaced"), "tight", "plain", "alnum", names.pair_key(F.lit("2024-01-01").cast("date"), a, b).alias("pair"))


def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with accents in page titles, folded."""
    p = pages.page_fields(table(spark, sf_dir, "pages"))
    return p.select("page_id", names.fold_accents(F.col("title")).alias("folded"))


def json_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as exchange payloads of about a thousand markets of a day, parsed back to quotes."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    tail = F.when(k % 5 == 0, "DIST").when(k % 5 == 1, "KO").when(k % 5 == 2, F.concat(F.lit("R"), (k % 4 + 1).cast("string"))).when(k % 5 == 3, "ABC").otherwise("x")
    ticker = F.concat(F.lit("EV-"), F.upper(F.date_format("ts", "yyMMMdd")), F.lit("QRSTUV-"), tail)
    market = F.struct(ticker.alias("ticker"), F.lit("t").alias("title"), F.format_string("%.2f", k / 100).alias("yes_bid"), F.when(k % 2 == 0, F.format_string("%.2f", (k + 1) / 100)).alias("yes_ask"), F.lit("0.50").alias("last_price"), F.col("event_id").cast("string").alias("volume"))
    payloads = e.groupBy(F.col("ts").cast("date").alias("day"), F.floor(F.col("event_id") / 1000).alias("pull")).agg(F.to_json(F.struct(F.collect_list(market).alias("markets"))).alias("payload"))
    q = quotes.quote_rows(payloads, "payload")
    return q.select(F.col("volume").cast("long").alias("event_id"), "kind", "contest_date", "code", "bid", "ask")


_SERIES = ("winner", "method", "distance", "mof", "rounds", "vicround")


def series_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as payloads of six series, some of their markets beyond parsing, read back as quotes."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    series = F.element_at(F.array(*(F.lit(x) for x in _SERIES)), (F.col("event_id") % 6 + 1).cast("int"))
    tail = F.element_at(F.array(*(F.lit(x) for x in ("DIST", "KO", "DRAW", "3", "OTHER"))), (k % 5 + 1).cast("int"))
    method = F.element_at(F.array(F.lit("KO/TKO"), F.lit("Submission"), F.lit("Draw"), F.lit("decision"), F.lit(None).cast("string")), (k % 5 + 1).cast("int"))
    who = F.when(k % 4 == 0, "Al Bo").when(k % 4 == 1, "Other")
    strike = F.struct(method.alias("Method"), who.alias("Participant"), F.when(k % 3 > 0, (k % 3).cast("string")).otherwise("x").alias("Round"))
    title = F.when(k % 7 == 0, "Cy Do to win in Round 2").when(k % 7 == 1, "Ed Fa")
    market = F.struct(
        F.concat(F.lit("EV-AB-"), tail).alias("ticker"), F.lit("EV-26JUL11AB").alias("event_ticker"), title.alias("yes_sub_title"), F.format_string("%.2f", k / 100).alias("yes_bid_dollars"),
        F.when(k % 2 == 0, "bad").otherwise("0.50").alias("yes_ask_dollars"), F.col("event_id").cast("string").alias("volume_fp"), strike.alias("custom_strike"),
    )
    payloads = e.groupBy(series.alias("series"), F.floor(F.col("event_id") / 1000).alias("pull")).agg(F.to_json(F.struct(F.collect_list(market).alias("markets"))).alias("payload"))
    out = None
    for name in _SERIES:
        part = quotes.series_quotes(payloads.where(F.col("series") == name), "payload", name)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("volume").cast("long").alias("event_id"), "series", "kind", "entity", "code", "bid", "ask")


def card_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cards of matchups with one line each, parsed back."""
    return _parsed_cards(table(spark, sf_dir, "lineitem"))


def _parsed_cards(li: DataFrame) -> DataFrame:
    prop = F.struct(F.lit("kd").alias("market"), F.lit("over").alias("side"), F.col("l_quantity").alias("line"), F.when(F.col("l_linenumber") == 1, "flex").alias("payout"))
    m = F.struct(F.col("l_partkey").cast("string").alias("red"), F.col("l_suppkey").cast("string").alias("blue"), F.when(F.col("l_linenumber") == 2, 5).alias("rounds"), F.array(prop).alias("props"))
    cards = li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.first(F.col("l_orderkey").cast("string")).alias("card"), F.lit("power").alias("payout"), F.collect_list(m).alias("matchups"))).alias("j"))
    out = quotes.card_lines(cards, "j")
    return out.groupBy("card").agg(F.count("*").alias("n"), F.sum("rounds").cast("long").alias("rounds"), F.sum("line").alias("lines"), F.count_if(F.col("payout") == "power").alias("inherited"))


def html_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_fields(table(spark, sf_dir, "pages"))


def asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), "value")
    return resolve.as_of(buys, views, ["user_id"], "ts", ["view_id", "value"]).select("event_id", "asof_view_id", "asof_value")


def within_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("date").alias("day"))
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("day").alias("bought"))
    views = e.where("event_type = 'signup'").select(F.col("event_id").alias("other"), "user_id", F.col("day").alias("signed"))
    return resolve.within_days(buys, views, "user_id", "bought", "signed").groupBy("event_id").agg(F.count("*").alias("n"), F.max("other").alias("last"))


def two_pass_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("who"), F.concat_ws("|", F.col("o_orderdate").cast("date").cast("string"), "o_orderpriority").alias("code"))
    return resolve.inherit_by_code(rows, "who", "code", ["o_orderkey"]).select("o_orderkey", "who", "inherited")


def _damaged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Part names with another first letter, another last letter, swapped tokens or an initial, and a third of the names of parts as known ones."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    k, head, tail = F.col("p_partkey") % 6, F.substring_index("name", " ", 1), F.substring_index("name", " ", -1)
    worse = (
        F.when(k == 0, F.concat(F.lit("x"), F.substring("name", 2, 100)))
        .when(k == 1, F.concat(F.expr("left(name, length(name) - 1)"), F.lit("x")))
        .when(k == 2, F.concat_ws(" ", tail, head))
        .when(k == 4, F.concat_ws(" ", F.substring(head, 1, 1), tail))
        .otherwise(F.col("name"))
    )
    return p.select(worse.alias("name")), p.where("p_partkey % 3 = 0").select("name")


def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve.resolve_names(*_damaged(spark, sf_dir), cutoff=0.85)
    return out.select("name", "match", "how", F.round(F.col("score") + 1e-9, 6).alias("score"))


def name_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar known names of each damaged one."""
    out = resolve.suggestions(*_damaged(spark, sf_dir), cutoff=0.4)
    return out.select("name", "match", F.round(F.col("score") + 1e-9, 6).alias("score"), F.col("k").cast("long").alias("k"))


def temporal_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    o = o.select("*", *resolve.split_flags("day", {"train": ("1995-01-01", "1999-12-31"), "val": ("2000-01-01", "2000-06-30"), "test": ("2000-06-30", "2001-12-31")}))
    return resolve.tail_holdout(o, "day", "o_orderkey").select("o_orderkey", "in_train", "in_val", "in_test", "is_holdout")


def bounded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = spark.sql("SELECT * FROM VALUES ('A', 10D, 40D), ('R', 5D, 20D) AS b(l_returnflag, low, high)")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    return resolve.within_bounds(li, bounds, "l_returnflag", "l_quantity").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


def tripwire_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    curated = p.where("p_partkey % 10 = 0").select("p_partkey", (F.col("p_partkey") % 20 == 0).alias("flag"))
    flags, counts = resolve.counted_tripwire(p, curated, "p_partkey", "p_name", ["small", "ring"])
    return flags.select("p_partkey", "flag", "is_uncurated", *(F.lit(n).cast("long").alias(f"n_{c}") for c, n in counts.items()))


def class_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    found = resolve.first_containing(F.concat_ws(" ", "p_type", "p_name"), [("standard", "S"), ("ring", "G"), ("economy", "E")], "other")
    return p.select("p_partkey", found.alias("label"), cells.class_label(F.concat(F.lit("Women's "), F.col("p_type")), ["ECONOMY", "STANDARD"]).alias("cls"))


def token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    tokens = F.array(F.concat(F.lit("type:"), F.col("event_type")), F.concat(F.lit("user:"), (F.col("user_id") % 10).cast("string")))
    return e.where(resolve.matches_tokens(tokens, {"type": ["view", "click"], "user": ["1", "2", "3"]})).select("event_id", "event_type")


def outer_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("name"))
    return resolve.prefer_right(c, s, "id", ["name"])


def stale_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.struct("o_orderdate", "o_orderkey").alias("t"), "o_orderdate")
    kept = resolve.unsuperseded(o, "o_custkey", "t", F.struct(F.lit("2000-06-01").cast("timestamp").alias("o_orderdate"), F.lit(0).cast("long").alias("o_orderkey")))
    return kept.select("o_custkey", "o_orderkey")


def dead_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("feature"), F.when(F.col("l_tax") > 0.01, F.col("l_tax")).otherwise(0.0).alias("importance"), (F.col("l_shipdate") > "2001-06-01").alias("new"))
    return resolve.dead_everywhere(li.where("new").groupBy("feature").agg(F.min("importance").alias("importance")), "feature", "importance")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    files.export_csv(table(spark, sf_dir, "customer"), path)
    back = files.read_text_table(spark, path)
    return back.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pulls of quotes appended; the last one is read."""
    path = f"{shared_folder(spark)}/pulls-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    files.append_snapshot(e, path, F.lit("2024-01-01"))
    files.append_snapshot(e.where("event_id % 2 = 0"), path, F.lit("2024-01-02"))
    return files.latest_snapshot(spark, path, e.schema).select("event_id", "user_id", F.col("pull_ts").cast("string").alias("pull_ts"))


QUERIES = {
    f.__name__: f
    for f in (
        parse_fields, name_keys, folded_names, json_quotes, series_quotes, card_lines, html_fields, asof_latest, within_a_day, two_pass_resolution, fuzzy_names, name_suggestions, temporal_splits,
        bounded_rows, tripwire_flags, class_labels, token_filter, outer_precedence, stale_pruning, dead_features, csv_round_trip, latest_snapshot,
    )
}

_DAMAGED = """
        n AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN 'x' || substr(p_name, 2) WHEN 1 THEN left(p_name, length(p_name) - 1) || 'x'
                  WHEN 2 THEN split_part(p_name, ' ', -1) || ' ' || split_part(p_name, ' ', 1) WHEN 4 THEN left(p_name, 1) || ' ' || split_part(p_name, ' ', -1) ELSE p_name END AS name FROM part),
        k AS (SELECT DISTINCT p_name AS match FROM part WHERE p_partkey % 3 = 0),
        c AS (SELECT name, match, 1 - levenshtein(name, match) / greatest(length(name), length(match)) AS score, string_split(name, ' ') AS x, string_split(match, ' ') AS y,
                     split_part(name, ' ', -1) AS la, split_part(match, ' ', -1) AS lb, (SELECT list(match) FROM k) AS known FROM n, k)"""

ORACLE_SQL = {
    "parse_fields": """
        WITH l AS (SELECT *, CAST(l_quantity AS INT) AS q, l_linenumber AS n FROM lineitem)
        SELECT l_orderkey, sum(CASE WHEN n = 7 THEN 0 ELSE n END)::DOUBLE AS landed, sum(CASE WHEN n = 7 THEN 0 ELSE q END)::DOUBLE AS tried,
               sum(CASE WHEN n = 7 THEN 0 ELSE (q % 5) * 60 + q % 60 END)::DOUBLE AS seconds, sum((n + 3) * 12 + q % 12)::DOUBLE AS inches, sum(CASE WHEN n <> 7 THEN q END)::DOUBLE AS pounds,
               round(sum(CASE WHEN q > 1 THEN q / 100 ELSE q END) , 4) AS share, CAST(max(l_shipdate) AS DATE) AS day,
               string_agg(['KO', 'SUB', 'U-DEC', 'S-DEC', 'DQ', 'NC', 'NC'][n], ',' ORDER BY ['KO', 'SUB', 'U-DEC', 'S-DEC', 'DQ', 'NC', 'NC'][n]) AS outcomes,
               sum(n)::DOUBLE AS rounds, sum(l_partkey)::DOUBLE AS tails
        FROM l GROUP BY 1""",
    "name_keys": r"""
        WITH c AS (SELECT c_custkey, lower('  José ' || c_name || '-Smith, Jr. ') AS s FROM customer),
        k AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(s, '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS spaced,
              trim(regexp_replace(regexp_replace(s, '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS tight, regexp_replace(s, '[^\p{L}\p{N}]', '', 'g') AS alnum FROM c)
        SELECT c_custkey, spaced, tight, regexp_replace(spaced, ' jr$', '') AS plain, alnum, '2024-01-01|' || least(spaced, 'supplier 7') || '|' || greatest(spaced, 'supplier 7') AS pair FROM k""",
    "json_quotes": """
        WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
        SELECT event_id, CASE k % 5 WHEN 0 THEN 'distance' WHEN 1 THEN 'mof_ko' WHEN 2 THEN 'end_before_r' || (k % 4 + 1) ELSE 'winner' END AS kind, day AS contest_date, 'QRSTUV' AS code,
               k / 100 AS bid, CASE WHEN k % 2 = 0 THEN (k + 1) / 100 ELSE 0.5 END AS ask FROM e WHERE k % 5 < 4""",
    "series_quotes": r"""
        WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
        t AS (SELECT *, ['winner', 'method', 'distance', 'mof', 'rounds', 'vicround'][event_id % 6 + 1] AS series, ['DIST', 'KO', 'DRAW', '3', 'OTHER'][k % 5 + 1] AS tail, ['ko', 'sub', NULL, 'dec', NULL][k % 5 + 1] AS m,
              CASE k % 4 WHEN 0 THEN 'Al Bo' WHEN 1 THEN 'Other' END AS who, CASE k % 7 WHEN 0 THEN 'Cy Do to win in Round 2' WHEN 1 THEN 'Ed Fa' END AS title FROM e),
        q AS (SELECT *, CASE series WHEN 'winner' THEN CASE WHEN title IS NOT NULL THEN 'winner' END WHEN 'method' THEN CASE WHEN who IS NOT NULL THEN 'method_' || m END WHEN 'distance' THEN CASE WHEN tail = 'DIST' THEN 'distance' END
                WHEN 'mof' THEN 'mof_' || CASE WHEN k % 5 < 4 THEN m ELSE CASE tail WHEN 'KO' THEN 'ko' END END WHEN 'rounds' THEN CASE WHEN tail = '3' THEN 'end_before_r3' END
                ELSE CASE WHEN who = 'Other' OR (who IS NULL AND tail = 'OTHER') THEN 'vicround_other' WHEN who IS NOT NULL THEN CASE WHEN k % 3 > 0 THEN 'win_in_r' || (k % 3) END WHEN k % 7 = 0 THEN 'win_in_r2' END END AS kind,
              CASE series WHEN 'winner' THEN title WHEN 'method' THEN who WHEN 'vicround' THEN CASE WHEN who = 'Al Bo' THEN who WHEN who IS NULL AND tail <> 'OTHER' THEN 'Cy Do' END END AS entity FROM t)
        SELECT event_id, series, kind, entity, '26JUL11AB' AS code, k / 100 AS bid, CASE WHEN k % 2 <> 0 THEN 0.5::DOUBLE END AS ask FROM q WHERE kind IS NOT NULL""",
    "card_lines": """
        SELECT CAST(l_orderkey AS VARCHAR) AS card, count(*) AS n, sum(CASE WHEN l_linenumber = 2 THEN 5 ELSE 3 END)::BIGINT AS rounds, sum(l_quantity) AS lines, count(*) FILTER (l_linenumber <> 1) AS inherited
        FROM lineitem GROUP BY 1""",
    "html_fields": r"""
        SELECT page_id, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang, nullif(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '') AS title,
               nullif(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '') AS heading, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS n_links,
               regexp_extract_all(html, '<a href="([^"]*)"', 1)[1] AS first_link FROM pages""",
    "asof_latest": """
        SELECT b.event_id, v.event_id AS asof_view_id, v.value AS asof_value
        FROM (SELECT * FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON b.user_id = v.user_id AND b.ts >= v.ts""",
    "within_a_day": """
        SELECT b.event_id, count(*) AS n, max(v.event_id) AS last FROM events b JOIN events v ON b.user_id = v.user_id AND b.event_type = 'purchase' AND v.event_type = 'signup'
            AND abs(date_diff('day', CAST(b.ts AS DATE), CAST(v.ts AS DATE))) <= 1 GROUP BY 1""",
    "two_pass_resolution": """
        WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS who, CAST(o_orderdate AS DATE) || '|' || o_orderpriority AS code FROM orders),
        k AS (SELECT code, arg_min(who, o_orderkey) AS e FROM r WHERE who IS NOT NULL GROUP BY 1)
        SELECT o_orderkey, coalesce(who, e) AS who, who IS NULL AND e IS NOT NULL AS inherited FROM r LEFT JOIN k USING (code)""",
    "fuzzy_names": f"""
        WITH {_DAMAGED},
        t AS (SELECT name, min(match) AS match FROM c WHERE NOT list_contains(known, name) AND length(la) >= 3 AND length(lb) >= 3
                AND CASE WHEN la = lb THEN starts_with(x[1], y[1]) OR starts_with(y[1], x[1]) OR len(x) < 2 OR len(y) < 2 ELSE list_contains(x, lb) OR list_contains(y, la) END
              GROUP BY 1 HAVING count(*) = 1),
        h AS (SELECT name, match, 1 AS rk, score FROM c WHERE name = match UNION ALL SELECT name, match, 2, score FROM t JOIN c USING (name, match)
              UNION ALL SELECT name, match, 3, score FROM c WHERE NOT list_contains(known, name) AND score >= 0.85),
        b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY name ORDER BY rk, score DESC, match) = 1)
        SELECT name, match, coalesce(['exact', 'surname', 'similar'][rk], 'unresolved') AS how, round(score, 6) AS score FROM n LEFT JOIN b USING (name)""",
    "name_suggestions": f"""
        WITH {_DAMAGED}
        SELECT name, match, round(score, 6) AS score, row_number() OVER (PARTITION BY name ORDER BY score DESC, match) AS k FROM c WHERE score >= 0.4 QUALIFY k <= 5""",
    "temporal_splits": """
        WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
        SELECT o_orderkey, d BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' AS in_train, d BETWEEN DATE '2000-01-01' AND DATE '2000-06-30' AS in_val,
               d BETWEEN DATE '2000-06-30' AND DATE '2001-12-31' AS in_test, d > (SELECT max(d) - INTERVAL 6 MONTH FROM o) AS is_holdout FROM o""",
    "bounded_rows": """
        SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem
        WHERE CASE l_returnflag WHEN 'A' THEN l_quantity BETWEEN 10 AND 40 WHEN 'R' THEN l_quantity BETWEEN 5 AND 20 ELSE true END GROUP BY 1""",
    "tripwire_flags": """
        WITH p AS (SELECT p_partkey, regexp_matches(lower(p_name), 'small|ring') AS hit, p_partkey % 10 = 0 AS cur FROM part),
        f AS (SELECT p_partkey, CASE WHEN cur THEN p_partkey % 20 = 0 ELSE hit END AS flag, hit AND NOT cur AS is_uncurated FROM p)
        SELECT *, (SELECT count(*) FILTER (flag) FROM f) AS n_flagged, (SELECT count(*) FILTER (is_uncurated) FROM f) AS n_uncurated FROM f""",
    "class_labels": """
        WITH p AS (SELECT p_partkey, lower(p_type || ' ' || p_name) AS t, p_type FROM part)
        SELECT p_partkey, CASE WHEN contains(t, 'standard') THEN 'S' WHEN contains(t, 'ring') THEN 'G' WHEN contains(t, 'economy') THEN 'E' ELSE 'other' END AS label,
               CASE WHEN contains(p_type, 'STANDARD') THEN 'women STANDARD' WHEN contains(p_type, 'ECONOMY') THEN 'women ECONOMY' END AS cls FROM p""",
    "token_filter": "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click') AND user_id % 10 IN (1, 2, 3)",
    "outer_precedence": """
        SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_name END, c_name) AS name
        FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) FULL JOIN supplier ON c_custkey = s_suppkey""",
    "stale_pruning": """
        SELECT o_custkey, o_orderkey FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) WHERE o_orderdate >= TIMESTAMP '2000-06-01'""",
    "dead_features": """
        SELECT l_suppkey AS feature FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-06-01' GROUP BY 1 HAVING min(CASE WHEN l_tax > 0.01 THEN l_tax ELSE 0 END) <= 1e-6""",
    "csv_round_trip": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "latest_snapshot": "SELECT event_id, user_id, '2024-01-02' AS pull_ts FROM events WHERE event_id % 2 = 0",
}
