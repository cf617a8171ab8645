"""A forward ledger: predictions logged once, closed, settled and reported."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: outcome labels that count as knockouts, and decisions
KO_FAMILY = ("KO", "TKO", "DQ")
DECISIONS = ("U-DEC", "S-DEC", "M-DEC")


def append_new(log: DataFrame, batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The log and the batch's rows with new keys; of a key's rows the first by ``order`` wins. New rows are pending."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    fresh = batch.withColumn("__k", rank).where("__k = 1").drop("__k").join(log.select(key), key, "left_anti")
    return log.unionByName(fresh.withColumn("status", F.lit("pending")), allowMissingColumns=True)


def capture_close(log: DataFrame, quotes: DataFrame, keys: Sequence[str], price: str, time: str, today: Column, date: str) -> DataFrame:
    """Pending rows of today or later with the latest quoted price as ``close``; others keep theirs."""
    last = quotes.where(F.col(price).isNotNull()).groupBy(*keys).agg(F.max_by(price, time).alias("__last"))
    joined = log.join(last, list(keys), "left")
    open_row = (F.col("status") == "pending") & (F.col(date) >= today) & F.col("__last").isNotNull()
    return joined.withColumn("close", F.when(open_row, F.col("__last")).otherwise(F.col("close"))).select(*log.columns)


def settle(kind: Column, won: Column, outcome: Column, end_round: Column, planned: Column) -> Column:
    """struct(realized, hit, status) of a yes-contract on a side; an unknown result stays pending.

    Kinds: winner, method_ko, method_sub, method_dec, distance, mof_ko, mof_sub,
    mof_dec, end_before_rN, win_in_rN, vicround_other. A draw loses side bets; no contest voids
    all but vicround_other, which it makes true. Disqualification counts as knockout.
    """
    n = F.regexp_extract(kind, r"_r(\d+)$", 1).try_cast("int")
    ko, sub, dec = outcome.isin(*KO_FAMILY), outcome == "SUB", outcome.isin(*DECISIONS)
    no_contest = outcome == "NC"
    draw = outcome == "DRAW"
    side = F.when(draw, F.lit(False)).otherwise(won)
    finish = ko | sub
    yes = (
        F.when(kind == "winner", side)
        .when(kind == "method_ko", side & ko)
        .when(kind == "method_sub", side & sub)
        .when(kind == "method_dec", side & dec)
        .when(kind == "distance", dec | draw)
        .when(kind == "mof_ko", ko)
        .when(kind == "mof_sub", sub)
        .when(kind == "mof_dec", dec)
        .when(kind == "vicround_other", no_contest | dec | draw)
        .when(kind.startswith("end_before_r"), finish & (end_round < n))
        .when(kind.startswith("win_in_r"), side & finish & (end_round == n))
    )
    void = no_contest & (kind != "vicround_other")
    status = F.when(outcome.isNull(), "pending").when(void, "void").when(yes.isNull(), "pending").otherwise("resolved")
    done = status == "resolved"
    return F.struct(F.when(done, yes.cast("int")).alias("realized"), F.when(done, yes).alias("hit"), status.alias("status"))


def grade_winners(log: DataFrame, results: DataFrame, key: str, regrade: bool = False) -> DataFrame:
    """Pending rows (all with ``regrade``) with the winner of their contest; ``correct`` is null for no winner."""
    joined = log.join(results.select(key, F.col("winner").alias("__w"), F.lit(True).alias("__known")), key, "left")
    due = F.col("__known").isNotNull() & (F.lit(True) if regrade else F.col("status") == "pending")
    status = F.when(due, F.when(F.col("__w").isNull(), "void").otherwise("resolved")).otherwise(F.col("status"))
    correct = F.when(due, F.col("predicted") == F.col("__w")).otherwise(F.col("correct"))
    return joined.select(*(status.alias(c) if c == "status" else correct.alias(c) if c == "correct" else F.col(c) for c in log.columns))


def grade_lines(rows: DataFrame, results: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Rows (side over or under, line) against results by keys: over needs more than the line; a missing result is pending."""
    joined = rows.join(results.select(*keys, F.col(value).alias("actual")), list(keys), "left")
    hit = F.when(F.col("side") == "over", F.col("actual") > F.col("line")).when(F.col("side") == "under", F.col("actual") <= F.col("line"))
    return joined.withColumn("hit", hit).withColumn("status", F.when(hit.isNull(), "pending").otherwise("resolved"))


def hit_rates(df: DataFrame, groups: Sequence[str], hit: str = "y") -> DataFrame:
    """Totals, resolved, pending and void rows and hit rate, for each group column alone and over all, in one pass."""
    sets = [[], *[[F.col(g)] for g in groups]]
    done = F.col("status") == "resolved"
    out = df.groupingSets(sets, *groups).agg(
        F.count("*").alias("n"),
        F.count_if(done).alias("resolved"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "void").alias("void"),
        F.avg(F.when(done, F.col(hit))).alias("hit_rate"),
        *(F.grouping(g).alias(f"__{g}") for g in groups),
    )
    level = F.lit("all")
    name = F.lit(None).cast("string")
    for g in groups:
        level = F.when(F.col(f"__{g}") == 0, F.lit(g)).otherwise(level)
        name = F.when(F.col(f"__{g}") == 0, F.col(g).cast("string")).otherwise(name)
    return out.select(level.alias("level"), name.alias("name"), "n", "resolved", "pending", "void", "hit_rate")


def bucket_stats(df: DataFrame, by: Sequence[str], p: str, hit: str, cost: str) -> DataFrame:
    """n, hit rate, mean break-even, realized and claimed edge, and flat return."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(hit).alias("hit_rate"),
        F.avg(cost).alias("break_even"),
        (F.avg(hit) - F.avg(cost)).alias("realized"),
        (F.avg(p) - F.avg(cost)).alias("claimed"),
        (F.avg(F.col(hit) / F.col(cost)) - 1).alias("roi"),
    )


def maker_stats(df: DataFrame, by: Sequence[str], bid: str, close: str, hit: str, cost: str, p: str) -> DataFrame:
    """``bucket_stats`` of offers one cent above the bid that were filled, and how many were made.

    An offer is filled if the close came down to it, that is close <= bid + 0.01;
    one without a close is not.
    """
    filled = F.coalesce(F.col(close) <= F.col(bid) + 0.01 + 1e-9, F.lit(False))
    made = df.groupBy(*by).agg(F.count("*").alias("offers"))
    return made.join(bucket_stats(df.where(filled), by, p, hit, cost), list(by), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def closing_value(df: DataFrame, by: Sequence[str], price: str, close: str, side: Column | None = None) -> DataFrame:
    """Rows whose price moved, share of those that beat the close, and mean move, signed by side."""
    move = (F.col(close) - F.col(price)) * (F.when(side == "no", -1).otherwise(1) if side is not None else F.lit(1))
    moved = F.abs(move) > 1e-9
    return df.where(F.col(close).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(moved).alias("moved"),
        F.avg(F.when(moved, (move > 0).cast("double"))).alias("beat_close"),
        F.avg(move).alias("mean_move"),
    )


def drift(calibration: DataFrame, closing: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups whose calibration or closing value calls for a look."""
    both = calibration.join(closing.select(*by, "beat_close"), list(by), "left")
    return both.where((F.abs("z") > 1.6448536269514722) | ((F.col("n") >= 5) & (F.col("beat_close") < 0.5)))


def best_positions(df: DataFrame, contest: str, stake: Column, price: str, key: str) -> DataFrame:
    """The row with the largest stake of each contest; equal stakes go to the lower price, then the key."""
    rows = df.withColumn("stake", stake).where("stake > 0")
    rank = F.row_number().over(Window.partitionBy(contest).orderBy(F.desc("stake"), price, key))
    return rows.withColumn("__k", rank).where("__k = 1").drop("__k")


def scale_to_budget(df: DataFrame, by: Sequence[str], stake: str, budget: float, unit: float = 1.0) -> DataFrame:
    """Stakes scaled down together to the budget, in whole units; rows left with nothing are dropped."""
    total = F.sum(stake).over(Window.partitionBy(*by))
    units = F.floor(F.col(stake) * F.least(F.lit(1.0), budget / total) / unit + 1e-9) * unit
    return df.withColumn("sized", units.cast("double")).where("sized > 0")


def event_feed(df: DataFrame, event: str, order: str, columns: Sequence[str], size: int = 100, **totals: Column) -> DataFrame:
    """Pages of at most ``size`` contests of each event in order, as an array of structs, with totals of the event.

    ``n`` counts the event's contests; ``totals`` are further aggregates over
    them. Places are numbered as rows pass, so no array is longer than a page.
    """
    page = F.floor((F.row_number().over(Window.partitionBy(event).orderBy(order)) - 1) / size).cast("int")
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    pages = df.withColumn("page", page).groupBy(event, "page").agg(rows.alias("rows"))
    whole = df.groupBy(event).agg(F.count("*").alias("n"), *(c.alias(n) for n, c in totals.items()))
    return pages.join(whole, event).select(event, "page", "rows", *whole.columns[1:])


def history(past: DataFrame, live: DataFrame, key: str, event: str, hit: str) -> DataFrame:
    """Series of events from evaluation rows and live ones, which replace those of their keys.

    For each event its rows, those resolved and their hits, and the same added up
    over all events to it, with the hit rate so far. Works on one row an event.
    """
    rows = past.join(live.select(key), key, "left_anti").withColumn("__live", F.lit(0)).unionByName(live.withColumn("__live", F.lit(1)), allowMissingColumns=True)
    daily = rows.groupBy(event).agg(F.count("*").alias("n"), F.sum("__live").alias("live"), F.count(hit).alias("resolved"), F.sum(F.coalesce(F.col(hit).cast("long"), F.lit(0))).alias("hits"))
    so_far = Window.orderBy(event).rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumns({f"total_{c}": F.sum(c).over(so_far) for c in ("n", "resolved", "hits")})
    return out.withColumn("rate", F.when(F.col("total_resolved") > 0, F.col("total_hits") / F.col("total_resolved")))


def merge_by_priority(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of tables in which a key's row comes from the last table that has it."""
    out = None
    for k, part in enumerate(parts):
        ranked = part.withColumn("__p", F.lit(k))
        out = ranked if out is None else out.unionByName(ranked, allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__p")))
    return out.withColumn("__k", rank).where("__k = 1").drop("__k", "__p")
