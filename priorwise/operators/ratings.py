"""Ratings of entities in pools of contests.

A rating couples both sides of every contest, so within a pool contests are
taken in order. Pools are independent: Spark sorts their contests into
partitions, and a task streams through them with only the ratings of the pool
in memory. A pool that is too large for one task is rated in waves, with equal
results: a wave takes every contest that is the next one of both its sides, and
these share no entity, so they are rated side by side. There are as many waves
as the longest chain of contests that build on each other, which follows the
histories of entities and not the size of the pool. Where histories are long,
it is rated by periods instead, where all contests of a period use the ratings
at its start and the updates are Spark aggregates.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorwise.operators.lineage import checkpointed, removed, shared_folder


@dataclass(frozen=True)
class EloRule:
    """Constants of the Elo update; ``long_gap`` is in days."""

    start: float = 1500.0
    k: float = 24.0
    scale: float = 400.0
    opponent_share: float = 0.4
    opponent_scale: float = 200.0
    flagged: float = 0.25
    long_gap: int = 365
    pull: float = 0.25


def seed_offset(wins: Column, losses: Column, limit: float = 120.0) -> Column:
    """Start above or below the mean from an earlier record: 100 * (p - 1/2) * log1p(n), limited."""
    n = wins + losses
    raw = 100 * (wins / F.when(n > 0, n) - 0.5) * F.log1p(n)
    return F.coalesce(F.greatest(F.least(raw, F.lit(limit)), F.lit(-limit)), F.lit(0.0))


SCHEMA = "pool string, contest_id long, a_id long, b_id long, a_pre double, b_pre double"


#: values of both sides before a contest, given the contest; puts what follows from it into the states it was made with
Rater = Callable[[SimpleNamespace], tuple]
#: the state of each entity, numbers that only its rater reads
States = dict[int, tuple[float, ...]]


def _sweep(rater: Callable[[States], Rater], fields: list[str]):
    """Rate rows that are sorted by pool and time; a new pool starts anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, rate = object(), None
        for batch in batches:
            names = batch.schema.names
            values = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                c = SimpleNamespace(**dict(zip(names, row)))
                if c.pool != pool:
                    pool, rate = c.pool, rater({})
                values.append(rate(c))
            keys = [batch.column(n) for n in ("pool", "contest_id", "a_id", "b_id")]
            made = [pa.array(x, pa.float64()) for x in zip(*values)] if values else [pa.array([], pa.float64())] * (len(fields) - 4)
            yield pa.RecordBatch.from_arrays([*keys, *made], fields)

    return run


def _swept(contests: DataFrame, rater: Callable[[States], Rater], schema: str) -> DataFrame:
    rows = _prepared(contests).repartition("pool").sortWithinPartitions("pool", "day", "contest_id")
    return rows.mapInArrow(_sweep(rater, [x.split()[0] for x in schema.split(", ")]), schema)


def _elo(rule: EloRule, state: States) -> Rater:
    def rate(c: SimpleNamespace) -> tuple:
        sides = []
        for who, seed in ((c.a_id, c.a_seed), (c.b_id, c.b_seed)):
            r, last = state.get(who, (rule.start + seed, None))
            if last is not None and c.day - last > rule.long_gap:
                r += rule.pull * (rule.start - r)
            state[who] = (r, c.day)
            sides.append(r)
        a, b = sides
        if c.won_a is not None and c.weight:
            expected = 1 / (1 + 10 ** ((b - a) / rule.scale))
            k = rule.k * c.weight * (rule.flagged if c.flagged else 1.0)
            up = lambda rival: 1 + rule.opponent_share * math.tanh((rival - rule.start) / rule.opponent_scale)
            state[c.a_id] = (a + k * up(b) * (c.won_a - expected), c.day)
            state[c.b_id] = (b + k * up(a) * (expected - c.won_a), c.day)
        return a, b

    return rate


def _prepared(contests: DataFrame) -> DataFrame:
    have = set(contests.columns)
    default = {"weight": F.lit(1.0), "flagged": F.lit(False), "a_seed": F.lit(0.0), "b_seed": F.lit(0.0)}
    return contests.select(
        "pool",
        "contest_id",
        F.datediff("day", F.lit("1970-01-01")).alias("day"),
        "a_id",
        "b_id",
        F.col("won_a").cast("double").alias("won_a"),
        *((F.col(c) if c in have else d).alias(c) for c, d in default.items()),
    )


def elo_by_pool(contests: DataFrame, rule: EloRule = EloRule()) -> DataFrame:
    """Ratings of both sides before each contest.

    ``contests`` has pool, contest_id, day, a_id, b_id, won_a, and may have
    weight, flagged, a_seed and b_seed. A contest without a result or with
    weight 0 changes no rating but counts as activity.
    """
    return _swept(contests, lambda held: _elo(rule, held), SCHEMA)


def elo_by_period(contests: DataFrame, period: Column, rule: EloRule = EloRule()) -> DataFrame:
    """Pre-contest ratings where a period's contests all use the ratings at its start, by the same rule.

    Suits one pool of any size: each period is a join and an aggregation over
    its own contests, and appends its rows to one table of the shared folder.
    Contests without result are rated and count as activity. A side that was
    away longer than the rule's gap before a contest is pulled back once, as
    measured from its last contest of earlier periods.
    """
    spark = contests.sparkSession
    folder = f"{shared_folder(spark)}/ratings-{uuid.uuid4().hex}"
    rows = _prepared(contests).withColumn("period", period)
    rows.write.partitionBy("period").parquet(f"{folder}/contests")
    c = spark.read.schema(rows.schema).parquet(f"{folder}/contests")
    state = checkpointed(c.select("pool", F.col("a_id").alias("id")).limit(0).withColumns({"rating": F.lit(0.0), "last": F.lit(0)}))
    up = lambda rival: 1 + rule.opponent_share * F.tanh((F.col(rival) - rule.start) / rule.opponent_scale)
    for row in c.select("period").distinct().orderBy("period").toLocalIterator():
        now = c.where(F.col("period").eqNullSafe(F.lit(row.period)))
        for s in "ab":
            held = state.select("pool", F.col("id").alias(f"{s}_id"), F.col("rating").alias("__r"), F.col("last").alias("__l"))
            rating = F.coalesce("__r", F.lit(rule.start) + F.col(f"{s}_seed"))
            away = F.coalesce(F.col("day") - F.col("__l") > rule.long_gap, F.lit(False))
            pulled = F.when(away, rating + rule.pull * (rule.start - rating)).otherwise(rating)
            now = now.join(held, ["pool", f"{s}_id"], "left").withColumn(f"{s}_pre", pulled).drop("__r", "__l")
        games = checkpointed(now)
        expected = 1 / (1 + F.pow(F.lit(10.0), (F.col("b_pre") - F.col("a_pre")) / rule.scale))
        gain = rule.k * F.col("weight") * F.when(F.col("flagged"), F.lit(rule.flagged)).otherwise(1.0) * (F.col("won_a") - expected)
        move = lambda s, d: F.struct(F.col(f"{s}_id").alias("id"), F.col(f"{s}_pre").alias("pre"), F.coalesce(d, F.lit(0.0)).alias("d"), "day")
        moves = games.select("pool", F.explode(F.array(move("a", gain * up("b_pre")), move("b", -gain * up("a_pre")))).alias("m"))
        new = moves.groupBy("pool", "m.id").agg((F.min_by("m.pre", "m.day") + F.sum("m.d")).alias("rating"), F.max("m.day").alias("last"))
        state = checkpointed(state.join(new, ["pool", "id"], "left_anti").unionByName(new))
        games.select("pool", "contest_id", "a_id", "b_id", "a_pre", "b_pre").write.mode("append").parquet(f"{folder}/rated")
    if c.isEmpty():
        return c.select("pool", "contest_id", "a_id", "b_id", F.lit(0.0).alias("a_pre"), F.lit(0.0).alias("b_pre"))
    removed(spark, f"{folder}/contests")
    return spark.read.parquet(f"{folder}/rated")


UNCERTAIN_SCHEMA = "pool string, contest_id long, a_id long, b_id long, a_mu double, a_sigma double, b_mu double, b_sigma double"


def _glicko(start: float, phi0: float, sigma0: float, tau: float, state: States) -> Rater:
    def volatility(phi: float, v: float, delta: float, sigma: float) -> float:
        a = math.log(sigma * sigma)

        def f(x: float) -> float:
            e = math.exp(x)
            d = phi * phi + v + e
            return e * (delta * delta - d) / (2 * d * d) - (x - a) / (tau * tau)

        low = a
        if delta * delta > phi * phi + v:
            high = math.log(delta * delta - phi * phi - v)
        else:
            k = 1
            while f(a - k * tau) < 0:
                k += 1
            high = a - k * tau
        f_low, f_high = f(low), f(high)
        for _ in range(100):
            if abs(high - low) <= 1e-6:
                break
            x = low + (low - high) * f_low / (f_high - f_low)
            fx = f(x)
            if fx * f_high <= 0:
                low, f_low = high, f_high
            else:
                f_low /= 2
            high, f_high = x, fx
        return math.exp(low / 2)

    def rate(c: SimpleNamespace) -> tuple:
        a = state.get(c.a_id, (start + c.a_seed, phi0, sigma0))
        b = state.get(c.b_id, (start + c.b_seed, phi0, sigma0))
        no_result = c.won_a is None or not c.weight
        for who, own, rival, score in ((c.a_id, a, b, c.won_a), (c.b_id, b, a, None if no_result else 1 - c.won_a)):
            mu, phi, sigma = own
            if no_result:
                state[who] = (mu, min(phi0, math.sqrt(phi * phi + (173.7178 * sigma) ** 2)), sigma)
                continue
            m, m_r, p, p_r = (mu - start) / 173.7178, (rival[0] - start) / 173.7178, phi / 173.7178, rival[1] / 173.7178
            g = 1 / math.sqrt(1 + 3 * p_r * p_r / math.pi**2)
            e = 1 / (1 + math.exp(-g * (m - m_r)))
            v = 1 / (g * g * e * (1 - e))
            gain = g * (score - e) * (c.weight * (0.25 if c.flagged else 1.0))
            sigma = volatility(p, v, v * gain, sigma)
            wide = math.sqrt(p * p + sigma * sigma)
            p = 1 / math.sqrt(1 / (wide * wide) + 1 / v)
            state[who] = (start + 173.7178 * (m + p * p * gain), 173.7178 * p, sigma)
        return a[0], a[1], b[0], b[1]

    return rate


def glicko_by_pool(contests: DataFrame, start: float = 1500.0, phi0: float = 350.0, sigma0: float = 0.06, tau: float = 0.5) -> DataFrame:
    """Rating and deviation of both sides before each contest (Glicko-2; both sides update from their state before it)."""
    return _swept(contests, lambda held: _glicko(start, phi0, sigma0, tau, held), UNCERTAIN_SCHEMA)


def _trueskill(mu0: float, sigma0: float, beta: float, tau: float, draw: float, state: States) -> Rater:
    pdf = lambda x: math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    cdf = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))

    def quantile(p: float) -> float:
        low, high = -10.0, 10.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if cdf(mid) < p else (low, mid)
        return (low + high) / 2

    margin = quantile((draw + 1) / 2) * math.sqrt(2) * beta

    def rate(c: SimpleNamespace) -> tuple:
        a = state.get(c.a_id, (mu0 + c.a_seed / 1500 * mu0, sigma0))
        b = state.get(c.b_id, (mu0 + c.b_seed / 1500 * mu0, sigma0))
        if c.won_a is not None and c.weight:
            (w, won), (l, lost) = ((c.a_id, a), (c.b_id, b)) if c.won_a > 0.5 else ((c.b_id, b), (c.a_id, a))
            sw, sl = won[1] ** 2 + tau * tau, lost[1] ** 2 + tau * tau
            spread = math.sqrt(sw + sl + 2 * beta * beta)
            t, e = (won[0] - lost[0]) / spread, margin / spread
            below = max(cdf(t - e), 1e-12)
            v = pdf(t - e) / below
            shrink = v * (v + t - e)
            part = 0.25 if c.flagged else 1.0
            state[w] = (won[0] + part * sw / spread * v, math.sqrt(max(sw * (1 - sw / spread**2 * shrink), 1e-12)))
            state[l] = (lost[0] - part * sl / spread * v, math.sqrt(max(sl * (1 - sl / spread**2 * shrink), 1e-12)))
        return *a, *b

    return rate


def trueskill_by_pool(contests: DataFrame, mu0: float = 25.0, sigma0: float = 25 / 3, beta: float = 25 / 6, tau: float = 25 / 300, draw: float = 0.01) -> DataFrame:
    """Mean and deviation of both sides before each contest (two players, from the published update)."""
    return _swept(contests, lambda held: _trueskill(mu0, sigma0, beta, tau, draw, held), UNCERTAIN_SCHEMA)


def _ordered(rows: DataFrame) -> DataFrame:
    """Contests with the place of each among those of its sides (``a_at``, ``b_at``, from 1)."""
    sides = rows.select("pool", "contest_id", "day", F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.col(f"{s}_id").alias("id")) for s in "ab"))).alias("e"))
    at = F.row_number().over(Window.partitionBy("pool", "e.id").orderBy("day", "contest_id"))
    placed = sides.withColumn("at", at).groupBy("pool", "contest_id").agg(*(F.max(F.when(F.col("e.s") == s, F.col("at"))).alias(f"{s}_at") for s in "ab"))
    return rows.join(placed, ["pool", "contest_id"])


def _rate_wave(rater: Callable[[States], Rater], width: int):
    """Values before each contest, and both sides' states after it; no two rows have an entity in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: States = {}
        rate = rater(held)
        for batch in batches:
            names = batch.schema.names
            before, after = [], ([], [])
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                c = SimpleNamespace(**dict(zip(names, row)))
                held.clear()
                for who, state in ((c.a_id, c.a_state), (c.b_id, c.b_state)):
                    if state is not None:
                        held[who] = tuple(state)
                before.append(rate(c))
                for side, who in zip(after, (c.a_id, c.b_id)):
                    side.append(held.get(who))
            pre = list(zip(*before)) if before else [()] * width
            states = [pa.array(x, pa.list_(pa.float64())) for x in after]
            keys = [batch.column(n) for n in ("pool", "contest_id", "a_id", "b_id")]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x, pa.float64()) for x in pre), *states], [*"pool contest_id a_id b_id".split(), *(f"v{k}" for k in range(width)), "a_state", "b_state"])

    return run


def _in_waves(contests: DataFrame, rater: Callable[[States], Rater], schema: str) -> DataFrame:
    spark = contests.sparkSession
    fields = [x.split()[0] for x in schema.split(", ")][4:]
    folder = f"{shared_folder(spark)}/waves-{uuid.uuid4().hex}"
    rows = _ordered(_prepared(contests).where("a_id <> b_id"))
    rows.write.parquet(f"{folder}/contests")
    c = spark.read.schema(rows.schema).parquet(f"{folder}/contests")
    entities = c.select("pool", F.explode(F.array("a_id", "b_id")).alias("id")).distinct()
    state = checkpointed(entities.select("pool", "id", F.lit(0).alias("done"), F.lit(None).cast("array<double>").alias("state")))
    values = ", ".join(f"v{k} double" for k in range(len(fields)))
    wave = 0
    while True:
        ready = c
        for s in "ab":
            held = state.select("pool", F.col("id").alias(f"{s}_id"), (F.col("done") + 1).alias(f"{s}_at"), F.col("state").alias(f"{s}_state"))
            ready = ready.join(held, ["pool", f"{s}_id", f"{s}_at"])
        ready = ready.drop("a_at", "b_at")
        path = f"{folder}/rated/wave={wave}"
        rated = ready.mapInArrow(_rate_wave(rater, len(fields)), f"pool string, contest_id long, a_id long, b_id long, {values}, a_state array<double>, b_state array<double>")
        rated.write.parquet(path)
        rated = spark.read.schema(rated.schema).parquet(path)
        if rated.isEmpty():
            break
        moved = rated.select("pool", F.explode(F.array(*(F.struct(F.col(f"{s}_id").alias("id"), F.col(f"{s}_state").alias("new")) for s in "ab"))).alias("m")).select("pool", "m.*")
        state = checkpointed(state.join(moved.withColumn("moved", F.lit(1)), ["pool", "id"], "left").select("pool", "id", (F.col("done") + F.coalesce("moved", F.lit(0))).alias("done"), F.coalesce("new", "state").alias("state")))
        wave += 1
    removed(spark, f"{folder}/contests")
    rated = spark.read.schema(rated.schema).parquet(f"{folder}/rated/*")
    return rated.select("pool", "contest_id", "a_id", "b_id", *(F.col(f"v{k}").alias(n) for k, n in enumerate(fields)))


def elo_in_waves(contests: DataFrame, rule: EloRule = EloRule()) -> DataFrame:
    """``elo_by_pool`` for pools of any size, a job for each wave; contests of an entity with itself are left out."""
    return _in_waves(contests, lambda held: _elo(rule, held), SCHEMA)


def glicko_in_waves(contests: DataFrame, start: float = 1500.0, phi0: float = 350.0, sigma0: float = 0.06, tau: float = 0.5) -> DataFrame:
    """``glicko_by_pool`` for pools of any size, in waves."""
    return _in_waves(contests, lambda held: _glicko(start, phi0, sigma0, tau, held), UNCERTAIN_SCHEMA)


def trueskill_in_waves(contests: DataFrame, mu0: float = 25.0, sigma0: float = 25 / 3, beta: float = 25 / 6, tau: float = 25 / 300, draw: float = 0.01) -> DataFrame:
    """``trueskill_by_pool`` for pools of any size, in waves."""
    return _in_waves(contests, lambda held: _trueskill(mu0, sigma0, beta, tau, draw, held), UNCERTAIN_SCHEMA)
