"""Rows of quotes, cards and lines from nested payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorwise.functions.cells import ticker_code, ticker_date, ticker_tail

MARKETS = "struct<markets:array<struct<ticker:string,title:string,yes_bid:string,yes_ask:string,last_price:string,volume:string>>>"
CARD = "struct<card:string,payout:string,matchups:array<struct<red:string,blue:string,rounds:int,title:boolean,props:array<struct<market:string,side:string,line:double,payout:string>>>>>"

#: fixed values: suffixes of contract tickers and what they ask
SUFFIXES = (("DIST", "distance"), ("KO", "mof_ko"), ("SUB", "mof_sub"), ("DEC", "mof_dec"))


def contract_kind(ticker: Column) -> Column:
    """Kind by the last part of the ticker: a known suffix, a round (R and digits), else a winner code; null if empty."""
    tail = ticker_tail(ticker)
    out = F.when(tail.rlike(r"^R\d+$"), F.concat(F.lit("end_before_r"), F.regexp_extract(tail, r"(\d+)$", 1)))
    for suffix, kind in SUFFIXES:
        out = out.when(tail == suffix, kind)
    return out.when(tail.rlike(r"^[A-Z]{3,}$"), "winner")


def quote_rows(payloads: DataFrame, column: str) -> DataFrame:
    """One row for each quote that can be parsed; prices as doubles."""
    kept = [c for c in payloads.columns if c != column]
    rows = payloads.select(*kept, F.explode(F.from_json(column, MARKETS)["markets"]).alias("m"))
    number = lambda c: F.col(f"m.{c}").try_cast("double")
    out = rows.select(
        *kept, F.col("m.ticker").alias("ticker"), contract_kind(F.col("m.ticker")).alias("kind"), ticker_date(F.col("m.ticker")).alias("contest_date"),
        F.substring(ticker_code(F.col("m.ticker")), 8, 6).alias("code"), number("yes_bid").alias("bid"), F.coalesce(number("yes_ask"), number("last_price")).alias("ask"), number("volume").alias("volume"),
    )
    return out.where("kind IS NOT NULL")


SERIES_MARKETS = (
    "struct<markets:array<struct<ticker:string,event_ticker:string,yes_sub_title:string,yes_bid_dollars:string,yes_ask_dollars:string,last_price_dollars:string,volume_fp:string,"
    "custom_strike:struct<Method:string,Participant:string,Round:string>>>>"
)
#: fixed values: method labels and ticker suffixes of contests that end by a method
METHODS = (("submission", "sub"), ("decision", "dec"))
METHOD_SUFFIXES = (("KO", "ko"), ("SUB", "sub"), ("DEC", "dec"))
ROUND_TITLE = r"^\s*(.+?)\s+to win in [Rr]ound\s+(\d+)"


def _method(label: Column) -> Column:
    """ko, sub or dec by a label; null for others, such as a draw."""
    text = F.lower(F.trim(label))
    out = F.when(text.contains("ko"), "ko")
    for name, short in METHODS:
        out = out.when(text == name, short)
    return out


def series_kind(series: str, ticker: Column, strike: Column, sub_title: Column) -> Column:
    """struct(kind, entity) of a market of a series; a null kind cannot be parsed.

    Series: winner, method (of a side), distance, mof (method of the contest),
    rounds, vicround (side and round, by the strike, else by the subtitle).
    """
    tail, who = ticker_tail(ticker), F.nullif(F.trim(strike["Participant"]), F.lit(""))
    nobody = F.lit(None).cast("string")
    pair = lambda kind, entity=nobody: F.struct(kind.alias("kind"), F.when(kind.isNotNull(), entity).alias("entity"))
    if series == "winner":
        name = F.nullif(F.trim(sub_title), F.lit(""))
        return pair(F.when(name.isNotNull(), F.lit("winner")), name)
    if series == "method":
        return pair(F.when(who.isNotNull(), F.concat(F.lit("method_"), _method(strike["Method"]))), who)
    if series == "distance":
        return pair(F.when(tail == "DIST", F.lit("distance")))
    if series == "mof":
        by_tail = F.lit(None).cast("string")
        for suffix, short in METHOD_SUFFIXES:
            by_tail = F.when(tail == suffix, short).otherwise(by_tail)
        return pair(F.concat(F.lit("mof_"), F.when(F.nullif(strike["Method"], F.lit("")).isNotNull(), _method(strike["Method"])).otherwise(by_tail)))
    if series == "rounds":
        return pair(F.when(tail.rlike(r"^\d+$"), F.concat(F.lit("end_before_r"), tail)))
    if series == "vicround":
        n = F.trim(strike["Round"]).try_cast("int").cast("string")
        titled = F.nullif(F.regexp_extract(sub_title, ROUND_TITLE, 2), F.lit(""))
        stated = F.when(who == "Other", F.lit("vicround_other")).otherwise(F.concat(F.lit("win_in_r"), n))
        kind = F.when(who.isNotNull(), stated).when(tail == "OTHER", F.lit("vicround_other")).otherwise(F.concat(F.lit("win_in_r"), titled))
        side = F.when(who.isNotNull(), F.when(who != "Other", who)).when(tail != "OTHER", F.regexp_extract(sub_title, ROUND_TITLE, 1))
        return pair(kind, side)
    raise ValueError(f"unknown series {series}")


def series_quotes(payloads: DataFrame, column: str, series: str) -> DataFrame:
    """One row for each market of a series' payload that can be parsed; prices as doubles, null where they cannot be read."""
    kept = [c for c in payloads.columns if c != column]
    rows = payloads.select(*kept, F.explode(F.from_json(column, SERIES_MARKETS)["markets"]).alias("m"))
    number = lambda c: F.col(f"m.{c}").try_cast("double")
    rows = rows.withColumn("k", series_kind(series, F.col("m.ticker"), F.col("m.custom_strike"), F.col("m.yes_sub_title"))).where("k.kind IS NOT NULL")
    return rows.select(
        *kept, F.col("m.ticker").alias("ticker"), F.substring_index(F.col("m.event_ticker"), "-", -1).alias("code"), "k.kind", "k.entity", number("yes_bid_dollars").alias("bid"),
        number("yes_ask_dollars").alias("ask"), number("last_price_dollars").alias("last"), number("volume_fp").alias("volume"),
    )


def card_lines(payloads: DataFrame, column: str) -> DataFrame:
    """Matchups and their lines of cards; three rounds, no title and the card's payout by default."""
    card = payloads.select(F.from_json(column, CARD).alias("c"))
    matchups = card.select("c.card", "c.payout", F.posexplode_outer("c.matchups").alias("slot", "m"))
    lines = matchups.select(
        "card", "slot", "m.red", "m.blue", F.coalesce("m.rounds", F.lit(3)).alias("rounds"), F.coalesce("m.title", F.lit(False)).alias("title"), "payout", F.explode_outer("m.props").alias("p")
    )
    return lines.select("card", "slot", "red", "blue", "rounds", "title", "p.market", "p.side", "p.line", F.coalesce("p.payout", "payout").alias("payout"))


def line_value(text: Column) -> Column:
    """Number of a line; ``min`` counts 60 and ``rounds`` 300 seconds, what cannot be read is 0."""
    number = F.regexp_extract(F.trim(text), r"^(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    factor = F.when(text.rlike(r"min\s*$"), 60).when(text.rlike(r"rounds?\s*$"), 300).otherwise(1)
    return F.coalesce(number * factor, F.lit(0.0))


def compact_line(text: Column) -> Column:
    """``market:side``, ``market:side:line`` or ``market:entity:side:line`` as struct(market, entity, side, line)."""
    p = F.split(text, ":")
    n = F.size(p)
    return F.struct(
        F.get(p, F.lit(0)).alias("market"),
        F.when(n == 4, F.get(p, F.lit(1))).alias("entity"),
        F.when(n == 4, F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(1))).alias("side"),
        F.when(n >= 3, line_value(F.get(p, n - 1))).alias("line"),
    )
