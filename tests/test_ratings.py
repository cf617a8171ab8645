"""Ratings against replays in plain Python, written from the published formulas."""

import datetime as dt
import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from priorwise.operators import ratings

START = dt.date(2015, 1, 1)
SCHEMA = "pool string, contest_id long, day date, a_id long, b_id long, won_a int, weight double, flagged boolean, a_seed double, b_seed double"


def made(n=160, seed=5):
    r = random.Random(seed)
    rows, at = [], 0
    for k in range(n):
        at += r.choice((0, 1, 9, 200))
        a, b = r.sample(range(9), 2)
        rows.append((r.choice("pq"), k, START + dt.timedelta(days=at), a, b, r.choice((0, 1, 1, None)), r.choice((1.0, 1.5, 0.0)), r.random() < 0.2, 10.0 * (a % 3), 10.0 * (b % 3)))
    return rows


def rated(spark, maker, rows):
    out = maker(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(out) == len(rows)
    return {x.contest_id: x for x in out}


def test_elo(spark):
    rows = made()
    got = rated(spark, ratings.elo_by_pool, rows)
    now, seen = {}, {}
    for pool, k, day, a, b, won, weight, flagged, sa, sb in rows:
        pre = []
        for who, s in ((a, sa), (b, sb)):
            x = now.get((pool, who), 1500 + s)
            if (pool, who) in seen and (day - seen[pool, who]).days > 365:
                x = 0.75 * x + 0.25 * 1500
            now[pool, who], seen[pool, who] = x, day
            pre.append(x)
        assert (got[k].a_pre, got[k].b_pre) == (pytest.approx(pre[0], abs=1e-9), pytest.approx(pre[1], abs=1e-9))
        if won is not None:
            surprise = won - 1 / (1 + 10 ** ((pre[1] - pre[0]) / 400))
            scale = 24 * weight * (0.25 if flagged else 1)
            now[pool, a] = pre[0] + scale * (1 + 0.4 * math.tanh((pre[1] - 1500) / 200)) * surprise
            now[pool, b] = pre[1] - scale * (1 + 0.4 * math.tanh((pre[0] - 1500) / 200)) * surprise


@pytest.mark.parametrize("days", [900, 4000])
def test_elo_by_period(spark, days):
    rows = made(60, 6)
    period = F.floor((F.col("day") - F.lit((START - dt.date(1970, 1, 1)).days)) / days)
    got = rated(spark, lambda c: ratings.elo_by_period(c, period), rows)
    now, seen = {}, {}
    for p in sorted({(x[2] - START).days // days for x in rows}):
        start, last, gains, first, dates = dict(now), dict(seen), {}, {}, {}
        for pool, k, day, a, b, won, weight, flagged, sa, sb in (x for x in rows if (x[2] - START).days // days == p):
            pre = []
            for who, s in ((a, sa), (b, sb)):
                x = start.get((pool, who), 1500 + s)
                if (pool, who) in last and (day - last[pool, who]).days > 365:
                    x = 0.75 * x + 0.25 * 1500
                first.setdefault((pool, who), x)
                dates[pool, who] = max(dates.get((pool, who), day), day)
                pre.append(x)
            assert (got[k].a_pre, got[k].b_pre) == (pytest.approx(pre[0], abs=1e-9), pytest.approx(pre[1], abs=1e-9))
            surprise = 0.0 if won is None else won - 1 / (1 + 10 ** ((pre[1] - pre[0]) / 400))
            scale = 24 * weight * (0.25 if flagged else 1)
            gains[pool, a] = gains.get((pool, a), 0) + scale * (1 + 0.4 * math.tanh((pre[1] - 1500) / 200)) * surprise
            gains[pool, b] = gains.get((pool, b), 0) - scale * (1 + 0.4 * math.tanh((pre[0] - 1500) / 200)) * surprise
        for who, gain in gains.items():
            now[who], seen[who] = first[who] + gain, dates[who]
    assert ratings.elo_by_period(spark.createDataFrame([], SCHEMA), period).count() == 0


def test_glicko(spark):
    rows = made(150, 7)
    got = rated(spark, ratings.glicko_by_pool, rows)
    scale, tau, now = 173.7178, 0.5, {}

    def volatility(phi, v, delta, sigma):
        def f(x):
            e = math.exp(x)
            return e * (delta**2 - phi**2 - v - e) / (2 * (phi**2 + v + e) ** 2) - (x - math.log(sigma**2)) / tau**2

        low, high = -60.0, 10.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) > 0 else (low, mid)
        return math.exp((low + high) / 4)

    for pool, k, _, a, b, won, weight, flagged, sa, sb in rows:
        x, y = now.get((pool, a), (1500 + sa, 350.0, 0.06)), now.get((pool, b), (1500 + sb, 350.0, 0.06))
        assert (got[k].a_mu, got[k].a_sigma, got[k].b_mu, got[k].b_sigma) == tuple(pytest.approx(z, rel=1e-6) for z in (*x[:2], *y[:2]))
        for who, own, rival, s in ((a, x, y, won), (b, y, x, None if won is None else 1 - won)):
            mu, phi, sigma = (own[0] - 1500) / scale, own[1] / scale, own[2]
            if won is None or not weight:
                now[pool, who] = (own[0], min(350.0, math.hypot(own[1], scale * sigma)), sigma)
                continue
            g = 1 / math.sqrt(1 + 3 * (rival[1] / scale / math.pi) ** 2)
            e = 1 / (1 + math.exp(-g * (mu - (rival[0] - 1500) / scale)))
            v = 1 / (g * g * e * (1 - e))
            step = weight * (0.25 if flagged else 1) * g * (s - e)
            sigma = volatility(phi, v, v * step, sigma)
            new = 1 / math.sqrt(1 / (phi**2 + sigma**2) + 1 / v)
            now[pool, who] = (1500 + scale * (mu + new**2 * step), scale * new, sigma)


def test_trueskill(spark):
    rows = made(150, 8)
    got = rated(spark, ratings.trueskill_by_pool, rows)
    n, beta, tau, now = NormalDist(), 25 / 6, 25 / 300, {}
    margin = n.inv_cdf((0.01 + 1) / 2) * math.sqrt(2) * beta
    for pool, k, _, a, b, won, weight, flagged, sa, sb in rows:
        x, y = now.get((pool, a), (25 + sa / 60, 25 / 3)), now.get((pool, b), (25 + sb / 60, 25 / 3))
        assert (got[k].a_mu, got[k].a_sigma, got[k].b_mu, got[k].b_sigma) == tuple(pytest.approx(z, rel=1e-7) for z in (*x, *y))
        if won is None or not weight:
            continue
        (w, up), (lo, down) = ((a, x), (b, y)) if won else ((b, y), (a, x))
        vw, vl = up[1] ** 2 + tau**2, down[1] ** 2 + tau**2
        c = math.sqrt(2 * beta**2 + vw + vl)
        z = (up[0] - down[0] - margin) / c
        v = n.pdf(z) / max(n.cdf(z), 1e-12)
        share = 0.25 if flagged else 1.0
        now[pool, w] = (up[0] + share * vw / c * v, math.sqrt(vw * (1 - vw / c**2 * v * (v + z))))
        now[pool, lo] = (down[0] - share * vl / c * v, math.sqrt(vl * (1 - vl / c**2 * v * (v + z))))


@pytest.mark.parametrize("by_pool, in_waves", [(ratings.elo_by_pool, ratings.elo_in_waves), (ratings.glicko_by_pool, ratings.glicko_in_waves), (ratings.trueskill_by_pool, ratings.trueskill_in_waves)])
def test_waves_equal_pools(spark, by_pool, in_waves):
    """Contests in waves have the ratings of a sweep through the pool, as waves keep every entity's order."""
    r = random.Random(8)
    rows = [(p, k, START + dt.timedelta(days=r.randrange(900)), 9 * (a // 9) + a % 9, b, w, x, f, s, t) for (p, k, _, a, b, w, x, f, s, t) in made(70, 3)]
    rows = [(p, k, d, a + 9 * (k % 4), b + 9 * (k % 4), *rest) for p, k, d, a, b, *rest in rows]
    want, got = rated(spark, by_pool, rows), rated(spark, in_waves, rows)
    for k, x in want.items():
        assert all(got[k][f] == (pytest.approx(x[f], abs=1e-9) if isinstance(x[f], float) else x[f]) for f in x.__fields__)
    assert in_waves(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0
