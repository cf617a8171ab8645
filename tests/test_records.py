"""Matching, cleaning, labelling and reporting on small frames, and fits that SQL cannot express."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from priorwise.functions import maths
from priorwise.operators import calibrate, dist, ml, records


def test_pairs_match_either_way(spark):
    left = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "c", None), (4, "x", "y")], "id int, a string, b string")
    right = spark.createDataFrame([("b", "a", 10), ("c", None, 11)], "p string, q string, v int")
    got = {r.id: r.v for r in records.join_either_way(left, right, ("a", "b"), ("p", "q")).collect()}
    assert got == {1: 10, 2: 10, 3: None, 4: None}


def test_names_resolve_within_their_contest(spark):
    contests = spark.createDataFrame([(1, "bo", 5, "al", 6), (2, "bo", 7, None, 8), (3, "cy", 1, "cy", 2)], "c int, an string, ai int, bn string, bi int")
    details = spark.createDataFrame([(1, "bo"), (2, "bo"), (1, "al"), (2, "al"), (3, "cy"), (9, "bo"), (None, "bo")], "c int, name string")
    got = sorted((tuple(r) for r in records.ids_by_contest(contests, details, "c", "name", [("an", "ai"), ("bn", "bi")]).collect()), key=str)
    assert got == sorted([(1, "bo", 5), (2, "bo", 7), (1, "al", 6), (2, "al", None), (3, "cy", 2), (9, "bo", None), (None, "bo", None)], key=str)


def test_overrides_keep_to_the_allow_list(spark):
    rows = spark.createDataFrame([(1, "x", 5), (2, None, 6)], "k int, f string, g int")
    new = spark.createDataFrame([(1, "y", 9), (1, None, 8), (2, "z", None), (3, "w", 1)], "k int, f string, g int")
    assert sorted(map(tuple, records.apply_overrides(rows, new, ["k"], ["f"]).collect())) == [(1, "y", 5), (2, "z", 6)]
    assert sorted(map(tuple, records.apply_overrides(rows, new.limit(0), ["k"], ["f"]).collect())) == [(1, "x", 5), (2, None, 6)]


def test_undated_rows_are_counted(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1)), (2, None), (3, None)], "k int, d date")
    kept, counts = records.dated(df, "d")
    assert [r.k for r in kept.collect()] == [1] and tuple(counts.first()) == (2, 1)


def test_still_listed(spark):
    cases = [("2020-01-01", "10:00", True), ("2020-01-01", "08:30:00", False), ("2019-12-31", "", True), ("2019-12-30", None, False), ("soon", "10:00", True), (None, None, True), ("2019-12-31", "late", True)]
    df = spark.createDataFrame(cases, "d string, t string, want boolean")
    now = F.lit("2020-01-02 09:00:00").cast("timestamp")
    assert all(r.got == r.want for r in df.select("want", records.still_listed(F.col("d"), F.col("t"), now).alias("got")).collect())


def test_flagged_rows_stay_in_denominators(spark):
    df = spark.createDataFrame([("KO", 1, False, 1), ("KO", 1, True, 1), ("SUB", 0, None, 2), (None, None, None, None)], "o string, w int, f boolean, r int")
    made = records.outcome_indicators(F.col("o"), F.col("w"), F.col("f"), F.col("r"), F.lit(3))
    got = df.select(*(c.alias(n) for n, c in made.items())).collect()
    assert [r.ko_win for r in got] == [1, 0, None, None] and [r.finish for r in got] == [1, 0, 1, None] and [r.sub_loss for r in got] == [None, None, 1, None]
    assert [r.first_round_ko_win for r in got] == [1, 0, 0, None] and [r.long_decision for r in got] == [None] * 4


def test_effects_below_the_floor(spark):
    df = spark.createDataFrame([("a", "x", 5.0), ("a", "y", -9.0), ("a", "z", 0.1), ("b", "x", 0.1), ("b", "y", -0.2)], "g string, n string, v double")
    got = sorted((r.g, r.n, r["rank"]) for r in records.top_effects(df, ["g"], "n", "v", 5, 1.0).collect())
    assert got == [("a", "x", 2), ("a", "y", 1), ("b", "x", 2), ("b", "y", 1)]


def test_pool_scores_against_all_pairs(spark):
    r = random.Random(3)
    train = [(r.choice("ab"), float(r.randrange(20))) for _ in range(60)] + [("rare", 3.0), (None, None)]
    rows = [(k, r.choice(["a", "b", "rare", "new", None]), float(r.randrange(-2, 25))) for k in range(40)] + [(99, "a", None)]

    def crps(xs, y):
        return sum(abs(x - y) for x in xs) / len(xs) - sum(abs(a - b) for a in xs for b in xs) / (2 * len(xs) ** 2)

    pools = {s: [v for t, v in train if t == s and v is not None] for s in ("a", "b", "rare", "new", None)}
    every = [v for _, v in train if v is not None]
    got = records.pool_crps(spark.createDataFrame(train, "s string, v double"), spark.createDataFrame(rows, "id int, s string, v double"), ["s"], "v").collect()
    assert len(got) == len(rows)
    for x in got:
        pool = pools[x.s] if len(pools[x.s]) >= 10 else every
        assert x.crps_pool is None if x.v is None else x.crps_pool == pytest.approx(crps(pool, x.v))


def test_status_falls_back(spark):
    kinds = spark.createDataFrame([("end_r2",), ("end_r3",), ("end_r",), ("winner",), (None,)], "k string")
    got = [r.s for r in kinds.select(records.status_by_kind(F.col("k"), {"end_r2": "live", "end_r": "off"}).alias("s")).collect()]
    assert got == ["live", "off", "off", "paper", "paper"]


def test_payouts_must_be_known(spark):
    df, payouts = spark.createDataFrame([("2pick",), (None,)], "v string"), spark.createDataFrame([("2pick", 3.0)], "v string, multiplier double")
    assert sorted((r.break_even or 0 for r in maths.with_payout(df, payouts, "v").collect())) == [0, pytest.approx(3**-0.5)]
    with pytest.raises(Exception, match="no payout"):
        maths.with_payout(spark.createDataFrame([("9pick",)], "v string"), payouts, "v").collect()


def test_half_life_follows_a_change(spark):
    r = random.Random(1)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    made = lambda k, sign: (day(k), x := r.uniform(-2, 2), int(r.random() < 1 / (1 + 2.718 ** (-3 * sign * x))))
    changed = [made(k, -1 if k < 700 else 1) for k in range(1000)]
    stable = [made(k, 1) for k in range(1000)]
    frame = lambda rows: spark.createDataFrame(rows, "day date, x double, y int")
    later = frame([made(1001, 1) for _ in range(400)])
    scores = ml.half_life_scores(frame(changed), later, ["x"], "y", "day", [60.0, 2000.0])
    assert ml.best_half_life(scores) == 60.0
    assert ml.best_half_life(ml.half_life_scores(frame(stable), later, ["x"], "y", "day", [60.0])) is None


def test_hurdle_ranks_positives(spark):
    r = random.Random(2)
    rows = [(k, x := r.uniform(0, 1), "ab"[k % 2], 0 if r.random() > x else r.randrange(1, 9)) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, s string, n int")
    got = ml.hurdle(df, df, ["x"], "n", ["s"], [0.5]).collect()
    pos, neg = [g.p_positive for g in got if g.n > 0], [g.p_positive for g in got if g.n == 0]
    assert sum(a > b for a in pos for b in neg) > 0.75 * len(pos) * len(neg)
    for s in "ab":
        values = sorted(n for *_, t, n in rows if t == s and n > 0)
        middle = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
        assert {tuple(g.qv) for g in got if g.s == s} == {(middle,)}


def test_shift_and_factor(spark):
    df = spark.createDataFrame([(p / 100,) for p in range(1, 100)], "p double")
    shift = calibrate.zero_rate_shift(df, "p", 0.2)
    assert df.agg(F.avg(maths.sigmoid(maths.logit(F.col("p")) + shift))).first()[0] == pytest.approx(0.2, abs=1e-5)
    assert calibrate.best_factor(df, "p", lambda x: maths.clip(x * 2, 0.0, 1.0), [0.25, 0.5, 1.0]) == 0.5


def test_curve_values(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    qs, qv, p0 = F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)), F.array(F.lit(1.0), F.lit(4.0), F.lit(9.0)), F.lit(0.2)
    assert one(dist.hurdle_over(F.lit(4.0), p0, qs, qv)) == pytest.approx(0.4)
    assert one(dist.sample_over(F.lit(4.0), qv, p0)) == pytest.approx(1 / 3) and one(dist.sample_over(F.lit(0.5), qv, p0)) == pytest.approx(0.8)
    assert one(dist.duration_quantile(F.lit(0.8), F.lit(0.3), qs, qv, F.lit(30.0))) == 30.0
    assert one(dist.duration_quantile(F.lit(0.35), F.lit(0.3), qs, qv, F.lit(30.0))) == pytest.approx(4.0)
    assert one(dist.inverse_on_grid(F.array(F.lit(0.5)), qv, F.array(F.lit(0.0), F.lit(0.6), F.lit(0.5)))) == [pytest.approx(2.5)]
