"""Prior windows against recomputation from the strict prefix, and the no-leak property."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from priorwise.operators import windows as w

H = w.History(("who",), ("day", "k"), "day")


def rows(seed=1, n=60):
    r = random.Random(seed)
    start = dt.date(2020, 1, 1)
    return [(k, r.choice("abc"), start + dt.timedelta(days=r.randrange(0, 400)), None if r.random() < 0.2 else float(r.randrange(100))) for k in range(n)]


def features(spark, data):
    v = F.col("v")
    df = spark.createDataFrame(data, "k int, who string, day date, v double").repartition(3)
    return {
        r.k: r
        for r in df.select(
            "k", w.expanding(H, v).alias("ctd"), w.rolling(H, v, 3).alias("l3"), w.date_window(H, v, 90).alias("near"), w.date_window(H, v, 90, "max").alias("top"),
            w.decayed(H, v, 100.0).alias("decayed"), w.seen(H).alias("n"), w.slope(H, v, 3).alias("slope"), w.slope(H, v, 4).alias("slope4"),
        ).collect()
    }


def mean(xs):
    xs = [x for x in xs if x is not None]
    return sum(xs) / len(xs) if xs else None


def same(a, b):
    return (a is None and b is None) or a == pytest.approx(b, abs=1e-7)


def test_against_prefix(spark):
    data = rows()
    got = features(spark, data)
    for k, who, day, _ in data:
        prior = sorted((d, j, v) for j, x, d, v in data if x == who and (d, j) < (day, k))
        g = got[k]
        assert g.n == len(prior)
        assert same(g.ctd, mean([v for *_, v in prior]))
        assert same(g.l3, mean([v for *_, v in prior[-3:]]))
        near = [v for d, _, v in prior if (day - d).days <= 90]
        assert same(g.near, mean(near))
        assert same(g.top, max((v for v in near if v is not None), default=None))
        held = [(0.5 ** ((day - d).days / 100), v) for d, _, v in prior if v is not None]
        assert same(g.decayed, sum(a * v for a, v in held) / sum(a for a, _ in held) if held else None)
        last = [v for *_, v in prior[-3:]]
        assert same(g.slope, (last[2] - last[0]) / 2 if len(last) == 3 and None not in last else None)


def test_a_row_never_sees_itself(spark):
    data = rows(5, 30)
    before = features(spark, data)
    k, who, day, _ = data[7]
    data[7] = (k, who, day, 1e6)
    after = features(spark, data)
    assert before[k] == after[k]


def test_sentinel_is_the_next_row(spark):
    df = spark.createDataFrame(rows(3, 20), "k int, who string, day date, v double")
    out = w.with_sentinels(df, "who", "k", "day")
    state = out.select("who", "is_sentinel", w.expanding(H, F.col("v")).alias("m")).where("is_sentinel").collect()
    want = {r.who: r.m for r in df.groupBy("who").agg(F.avg("v").alias("m")).collect()}
    assert {r.who for r in state} == set(want) and all(same(r.m, want[r.who]) for r in state)


def test_empty_table(spark):
    df = spark.createDataFrame([], "k int, who string, day date, v double")
    assert df.select(*w.flavors(H, ["v"])).count() == 0


def values_of(spark, data, *columns):
    df = spark.createDataFrame(data, "k int, who string, day date, v double").repartition(3)
    return {r[0]: tuple(r)[1:] for r in df.select("k", *columns).collect()}


def test_old_extremes_leave_no_trace(spark):
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(days=n)
    data = [(0, "a", day(0), float("nan")), (1, "a", day(1), 1e17), (2, "a", day(500), 1.0), (3, "a", day(501), 2.0), (4, "a", day(502), None)]
    got = values_of(spark, data, w.date_window(H, F.col("v"), 90), w.date_window(H, F.col("v"), 90, "sum"), w.date_window(H, F.col("v"), 90, "count"))
    assert got[2] == (None, None, 0) and got[3] == (1.0, 1.0, 1) and got[4] == (1.5, 3.0, 2)


def test_decay_over_thousands_of_half_lives(spark):
    r = random.Random(9)
    at, data = 0, []
    for k in range(120):
        at += r.choice((0, 1, 3, 50, 399, 400, 401, 900, 5000))
        data.append((k, "a", dt.date(1900, 1, 1) + dt.timedelta(days=at % 60000), None if r.random() < 0.2 else float(r.randrange(100))))
    data = [(k, *row[1:]) for k, row in enumerate(sorted(data, key=lambda x: x[2]))]
    got = values_of(spark, data, w.decayed(H, F.col("v"), 1.0))
    for k, _, day, _ in data:
        prior = [(d, v) for j, _, d, v in data if j < k and v is not None]
        last = max((d for d, _ in prior), default=None)
        held = [(0.5 ** (last - d).days if (last - d).days < 1000 else 0.0, v) for d, v in prior]
        assert same(got[k][0], sum(a * v for a, v in held) / sum(a for a, _ in held) if held else None)


def test_weighted_sum(spark):
    got = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double").select(w.weighted_sum({"a": 1.0, "b": 0.5}).alias("x")).collect()
    assert [r.x for r in got] == [1.0, 3.5]
