"""Rows of contests: matching, cleaning, overriding, labelling, and small reports over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorwise.operators.evaluate import crps_samples
from priorwise.operators.lineage import counted

#: fixed values: outcomes that settle who won
VALID_OUTCOMES = ("KO", "SUB", "U-DEC", "S-DEC", "M-DEC")
_DECISIONS = ("U-DEC", "S-DEC", "M-DEC")


# ---------------------------------------------------------------- joins


def join_either_way(left: DataFrame, right: DataFrame, pair: tuple[str, str], other: tuple[str, str], on: Sequence[str] = ()) -> DataFrame:
    """Left join of pairs whichever side comes first: both tables meet on the least and the greatest of a pair.

    A null side matches nothing. Columns of ``right`` but for its pair and ``on`` are added.
    """
    key = lambda df, p: df.withColumns({"__low": F.least(*p), "__high": F.when(F.col(p[0]).isNotNull() & F.col(p[1]).isNotNull(), F.greatest(*p))})
    joined = key(left, pair).join(key(right, other).drop(*other), [*on, "__low", "__high"], "left")
    return joined.drop("__low", "__high")


def ids_by_contest(contests: DataFrame, details: DataFrame, contest: str, name: str, sides: Sequence[tuple[str, str]]) -> DataFrame:
    """``details`` with ``entity``: the id of the side of its contest that bears the name.

    ``sides`` are (name column, id column) of the contests. Only names of the
    same contest are looked at, so namesakes elsewhere do no harm; if both sides
    share a name the last one is taken.
    """
    pairs = ", ".join(f"{k}, {n}, {i}" for k, (n, i) in enumerate(sides))
    long = contests.select(contest, F.expr(f"stack({len(sides)}, {pairs}) as (__k, {name}, __id)")).where(f"{name} IS NOT NULL AND __id IS NOT NULL")
    known = long.groupBy(contest, name).agg(F.max_by("__id", "__k").alias("entity"))
    return details.join(known, [contest, name], "left")


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a set of ids; repeated ids change nothing."""
    return df.join(ids.select(key), key, "left_semi")


def first_part_label(parents: DataFrame, children: DataFrame, keys: Sequence[str], position: str, values: Mapping[str, str], at: int = 1) -> DataFrame:
    """``parents`` with sums over their children at one position (value column -> label); without such children 0."""
    sums = children.where(F.col(position) == at).groupBy(*keys).agg(*(F.sum(v).alias(label) for v, label in values.items()))
    joined = parents.join(sums, list(keys), "left")
    return joined.select(*parents.columns, *(F.coalesce(label, F.lit(0)).alias(label) for label in values.values()))


def apply_overrides(rows: DataFrame, overrides: DataFrame, keys: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Fields of rows replaced by those of the override with the same keys.

    Only allowed fields are replaced, and only by values that are not null; of
    several overrides for a field the greatest value counts. Rows stay as many.
    """
    fields = [c for c in overrides.columns if c in allowed and c in rows.columns]
    picked = overrides.groupBy(*keys).agg(*(F.max(c).alias(f"__{c}") for c in fields), F.count("*").alias("__n")).drop("__n")
    joined = rows.join(picked, list(keys), "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns))


# ---------------------------------------------------------------- filters and splits


def rolling_split(df: DataFrame, date: str, months: int = 6) -> DataFrame:
    """``df`` with flags of a split that ends at its last date.

    ``in_train`` holds for all dated rows; the last months are halved into
    ``in_val_a`` and ``in_val_b``, and make up ``in_val``.
    """
    end = df.agg(F.max(date).cast("date").alias("__end"))
    start = F.add_months("__end", -months)
    middle = F.date_add(start, F.floor(F.datediff("__end", start) / 2).cast("int"))
    d = F.col(date).cast("date")
    rows = df.crossJoin(F.broadcast(end))  # one row
    flags = {"in_train": d <= F.col("__end"), "in_val": d >= start, "in_val_a": (d >= start) & (d < middle), "in_val_b": d >= middle}
    return rows.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in flags.items()}).drop("__end")


def clean_labels(df: DataFrame, outcome: str, label: str, flagged: str | None = None, valid: Sequence[str] = VALID_OUTCOMES) -> DataFrame:
    """Rows with a valid outcome and a label, without flagged ones (a null flag is none)."""
    out = df.where(F.col(outcome).isin(*valid) & F.col(label).isNotNull())
    return out if flagged is None else out.where(~F.coalesce(F.col(flagged), F.lit(False)))


def dated(df: DataFrame, date: str) -> tuple[DataFrame, int]:
    """Rows with a date, and the number of those dropped; ``df`` is computed once."""
    kept, counts = counted(df, F.col(date).isNotNull(), undated=F.col(date).isNull())
    return kept, counts["undated"]


def still_listed(day: Column, clock: Column, now: Column) -> Column:
    """Whether a card of that text date and start time is still shown.

    With a start: until 24 hours after it; else to the end of the second day
    after its date. A date that cannot be read is kept.
    """
    date = F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))
    text = F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(" "), F.trim(clock))
    start = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")))
    listed = F.when(start.isNotNull(), now < start + F.expr("INTERVAL 24 HOURS")).otherwise(now.cast("date") <= F.date_add(date.cast("date"), 2))
    return F.coalesce(listed, F.lit(True))


# ---------------------------------------------------------------- indicators and labels


def outcome_indicators(outcome: Column, won: Column, flagged: Column, end_round: Column, planned: Column) -> dict[str, Column]:
    """1 or 0 where a condition applies, null elsewhere; flagged rows count as neither knockout nor submission.

    They stay in the denominators: a flagged win is 0 for ``ko_win``, not null.
    """
    clean = ~F.coalesce(flagged, F.lit(False))
    as_number = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    ko, sub = as_number((outcome == "KO") & clean), as_number((outcome == "SUB") & clean)
    decision, finish = as_number(outcome.isin(*_DECISIONS)), F.least(ko + sub, F.lit(1.0))
    known = outcome.isNotNull()
    first = F.coalesce(end_round == 1, F.lit(False)) & F.coalesce(won == 1, F.lit(False))
    return {
        "ko_win": F.when(won == 1, ko), "sub_win": F.when(won == 1, sub), "ko_loss": F.when(won == 0, ko), "sub_loss": F.when(won == 0, sub),
        "finish": F.when(known, finish), "decision": F.when(known, decision), "early_finish": F.when(known, finish * as_number(end_round <= 2)),
        "first_round_ko_win": F.when(known, ko * first.cast("double")), "first_round_sub_win": F.when(known, sub * first.cast("double")),
        "long_decision": F.when(known & (F.coalesce(planned, F.lit(3)) >= 5), decision),
    }


def concept(feature: Column, groups: Sequence[tuple[str, Sequence[str]]], default: str = "other") -> Column:
    """Group of a feature name: side and window suffixes are dropped, the first group with a part that occurs wins."""
    base = F.regexp_replace(F.regexp_replace(feature, "_(a|b|diff)$", ""), "_(ctd|l3|l5|2y|decay)(?=_|$)", "")
    out = None
    for name, parts in groups:
        test = F.lit(False)
        for part in parts:
            test = test | base.contains(part)
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(default) if out is None else F.coalesce(out, F.lit(default))


def status_by_kind(kind: Column, by_kind: Mapping[str, str], default: str | None = None, last: str = "paper", allowed: Sequence[str] | None = None) -> Column:
    """Setting of a kind: its own, that of its family (trailing digits dropped), the general one, then ``last``.

    With ``allowed``, a setting of any other value counts as ``last``, in either case of letters.
    """
    known = F.create_map(*(F.lit(x) for pair in by_kind.items() for x in pair)) if by_kind else F.create_map().cast("map<string,string>")
    found = F.coalesce(F.try_element_at(known, kind), F.try_element_at(known, F.regexp_replace(kind, r"\d+$", "")), F.lit(default), F.lit(last))
    return found if allowed is None else F.when(F.lower(found).isin(*allowed), F.lower(found)).otherwise(F.lit(last))


def slot(title: Column, segment: Column, position: Column, main: int = 5) -> Column:
    """Place on a card: title, else what was stated, else main for the first positions (from 0), else prelim."""
    stated = F.when(segment != "", segment)
    return F.when(F.coalesce(title, F.lit(False)), "title").otherwise(F.coalesce(stated, F.when(position < main, "main").otherwise("prelim")))


# ---------------------------------------------------------------- reports


def records(ledger: DataFrame, entity: str, won: str, career: DataFrame | None = None) -> DataFrame:
    """Wins, losses and others of each entity; where ``career`` (entity, wins, losses, draws) has wins and losses, those."""
    own = ledger.groupBy(entity).agg(F.count_if(F.col(won) == 1).alias("wins"), F.count_if(F.col(won) == 0).alias("losses"), F.count_if(F.col(won).isNull()).alias("draws"))
    if career is None:
        return own
    better = career.where("wins IS NOT NULL AND losses IS NOT NULL").select(entity, F.struct("wins", "losses", F.coalesce("draws", F.lit(0)).alias("draws")).alias("__c"))
    joined = own.join(better, entity, "full")
    return joined.select(entity, *(F.coalesce(F.col(f"__c.{c}").cast("long"), F.col(c)).alias(c) for c in ("wins", "losses", "draws")))


def tercile_slices(df: DataFrame, score: str, date: str, predicted: str, observed: str, least: int = 20) -> DataFrame:
    """Mean forecast, mean outcome and their difference in each third of a score and in each year, from ``least`` rows on.

    The cut points are the 33rd and 67th percentiles; a null score counts as 0.
    """
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    cuts = df.agg(F.percentile(value, [0.33, 0.67]).alias("__cuts"))
    rows = df.crossJoin(F.broadcast(cuts))  # one row
    third = F.when(value < F.col("__cuts")[0], "low").when(value < F.col("__cuts")[1], "mid").otherwise("top")
    labels = F.array(third, F.concat(F.lit("year "), F.year(date).cast("string")))
    long = rows.select(F.explode(F.array_compact(labels)).alias("slice"), F.col(predicted).alias("p"), F.col(observed).alias("y"))
    out = long.groupBy("slice").agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("observed"))
    return out.where(F.col("n") >= least).withColumn("error", F.col("predicted") - F.col("observed"))


def latest_events(df: DataFrame, date: str, n: int) -> DataFrame:
    """Rows of the n latest dates."""
    dates = df.where(F.col(date).isNotNull()).select(date).distinct().orderBy(F.desc(date)).limit(n)
    return df.join(F.broadcast(dates), date, "left_semi")  # n rows


def top_effects(df: DataFrame, by: Sequence[str], name: str, value: str, n: int = 5, floor: float = 0.0) -> DataFrame:
    """The n largest effects of each group by magnitude, with their rank; those below the floor only where none reaches it."""
    size = F.abs(value)
    some = F.max(size).over(Window.partitionBy(*by))
    rows = df.withColumn("__some", some).where((F.col("__some") < floor) | (size >= floor))
    order = Window.partitionBy(*by).orderBy(F.desc(size), name)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("__some")


def accumulated(held: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """Names of either table; a name that was held is never lost."""
    return held.select(name).unionByName(new.select(name)).where(F.col(name).isNotNull()).distinct()


# ---------------------------------------------------------------- forecasts against references


def pool_crps(train: DataFrame, rows: DataFrame, strata: Sequence[str], value: str, least: int = 10) -> DataFrame:
    """``rows`` with ``crps_pool``: score of the training values of the row's stratum as a forecast of its value.

    All values of a pool count. The score comes from the distinct values of a
    pool with running counts and sums, so no pool is gathered; a stratum of
    fewer than ``least`` training rows is scored against all of them.
    """
    label = F.concat_ws("\x00", *(F.coalesce(F.col(s).cast("string"), F.lit("\x01")) for s in strata))
    ok = train.where(F.col(value).isNotNull()).select(label.alias("__s"), F.col(value).cast("double").alias("v"))
    both = ok.unionByName(ok.select(F.lit(None).cast("string").alias("__s"), "v")).groupBy("__s", "v").agg(F.count("*").cast("double").alias("c"))
    both = both.withColumn("__s", F.coalesce("__s", F.lit("\x02")))
    w = Window.partitionBy("__s").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    steps = both.withColumns({"upto": F.sum("c").over(w), "sum_upto": F.sum(F.col("c") * F.col("v")).over(w)})
    # x_(1) <= ... <= x_(n): the mean distance of two of them is 2 / n^2 * sum of (2 i - n - 1) x_(i)
    ranks = F.col("c") * (2 * F.col("upto") - F.col("c"))
    pools = steps.groupBy("__s").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("v")).alias("sum"), F.sum(ranks * F.col("v")).alias("ranked"))
    pools = pools.withColumn("spread", (F.col("ranked") - F.col("n") * F.col("sum")) / (F.col("n") * F.col("n")))
    large = pools.where((F.col("n") >= least) & (F.col("__s") != "\x02")).select(F.col("__s").alias("__own"), F.lit(True).alias("__has"))
    asked = rows.withColumns({"__own": label, "__y": F.col(value).cast("double")}).join(large, "__own", "left")
    asked = asked.withColumn("__s", F.when(F.col("__has"), F.col("__own")).otherwise(F.lit("\x02")))
    # the last step at or below each asked value, by one sweep over steps and asked values
    points = asked.where("__y IS NOT NULL").select("__s", F.col("__y").alias("v")).distinct()
    sweep = steps.select("__s", "v", F.struct("upto", "sum_upto").alias("at"), F.lit(0).alias("k")).unionByName(
        points.withColumns({"at": F.lit(None).cast("struct<upto:double,sum_upto:double>"), "k": F.lit(1)})
    )
    last = F.last("at", ignorenulls=True).over(Window.partitionBy("__s").orderBy("v", "k").rowsBetween(Window.unboundedPreceding, 0))
    found = sweep.withColumn("at", last).where("k = 1").select("__s", F.col("v").alias("__y"), "at")
    out = asked.join(found, ["__s", "__y"], "left").join(pools.select("__s", "n", "sum", "spread"), "__s", "left")
    below, less = F.coalesce("at.upto", F.lit(0.0)), F.coalesce("at.sum_upto", F.lit(0.0))
    near = (F.col("__y") * (2 * below - F.col("n")) + F.col("sum") - 2 * less) / F.col("n")
    return out.select(*rows.columns, (near - F.col("spread")).alias("crps_pool"))


def climatology_skill(train: DataFrame, rows: DataFrame, strata: Sequence[str], value: str, samples: str, by: Sequence[str] = (), least: int = 10) -> DataFrame:
    """Mean score of sampled forecasts, of the stratum's training values, and the skill of the first over the second."""
    scored = pool_crps(train, rows, strata, value, least).withColumn("__m", crps_samples(F.col(samples), F.col(value)))
    out = scored.groupBy(*by).agg(F.count("*").alias("n"), F.avg("__m").alias("crps_model"), F.avg("crps_pool").alias("crps_pool"))
    return out.withColumn("skill", F.when(F.col("crps_pool") > 0, 1 - F.col("crps_model") / F.col("crps_pool")))


def realized_forecasts(rows: DataFrame, forecasts: DataFrame, key: str, label: str) -> DataFrame:
    """Rows with the forecast that was made for the class which came about; rows of other classes drop out."""
    return rows.join(forecasts, [key, label])


def coherence(draws: DataFrame, label: str, value: str, lower: str, higher: str, tail: float, bound: float) -> DataFrame:
    """check, value, holds: the mean of class ``lower`` lies below that of ``higher``, its share above ``tail`` within the bound, and no value is missing."""
    of = lambda c, x: F.avg(F.when(F.col(label) == c, x))
    row = draws.agg(
        (of(higher, F.col(value)) - of(lower, F.col(value))).alias("mean_gap"), of(lower, (F.col(value) > tail).cast("double")).alias("tail_share"), F.count_if(F.col(value).isNull()).cast("double").alias("missing")
    )
    holds = F.when(F.col("check") == "mean_gap", F.col("value") > 0).when(F.col("check") == "tail_share", F.col("value") <= bound).otherwise(F.col("value") == 0)
    stacked = row.select(F.expr("stack(3, 'mean_gap', mean_gap, 'tail_share', tail_share, 'missing', missing) as (check, value)"))
    return stacked.withColumn("holds", F.coalesce(holds, F.lit(False)))
