import datetime as dt

import pytest
from pyspark.sql import functions as F

from priorwise.operators import calibrate, dist, evaluate, ledger, pairs, ratings, resolve


def contests(spark, rows):
    return spark.createDataFrame(rows, "pool string, contest_id long, day date, a_id long, b_id long, won_a int")


def test_elo_by_hand(spark):
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    got = ratings.elo_by_pool(contests(spark, [("p", 1, day(0), 1, 2, 1), ("p", 2, day(10), 1, 2, 0), ("p", 3, day(20), 1, 2, None), ("q", 4, day(0), 1, 2, 1)])).orderBy("contest_id").collect()
    assert [(r.a_pre, r.b_pre) for r in got[:2]] == [(1500, 1500), (1512, 1488)]
    assert got[2].a_pre < 1512 and got[3].a_pre == 1500


def test_uncertain_ratings_move_toward_the_winner(spark):
    c = contests(spark, [("p", k, dt.date(2020, 1, 1 + k), 1, 2, 1) for k in range(8)])
    for out in (ratings.glicko_by_pool(c), ratings.trueskill_by_pool(c)):
        last = out.orderBy(F.desc("contest_id")).first()
        assert last.a_mu > last.b_mu and last.a_sigma < out.orderBy("contest_id").first().a_sigma


def test_symmetrize_twice_is_the_same(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0, -3.0, 1)], "id int, x_a double, x_b double, x_diff double, won_a int")
    out = pairs.symmetrize(df, "won_a")
    flipped = out.where("is_flipped").drop("is_flipped")
    assert tuple(flipped.first()) == (1, 5.0, 2.0, 3.0, 0)
    assert pairs.symmetrize(flipped, "won_a").where("is_flipped").drop("is_flipped").collect() == df.collect()


def test_auroc_against_pairs(spark):
    data = [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.8, 0), (0.9, 1)]
    pos, neg = [p for p, y in data if y], [p for p, y in data if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert evaluate.auroc(spark.createDataFrame(data, "p double, y int")).first().auroc == pytest.approx(want)


def test_crps_of_samples(spark):
    xs, y = [1.0, 4.0, 2.0], 3.0
    want = sum(abs(x - y) for x in xs) / 3 - sum(abs(a - b) for a in xs for b in xs) / 18
    got = spark.createDataFrame([(xs, y)], "x array<double>, y double").select(evaluate.crps_samples(F.col("x"), F.col("y")).alias("c")).first().c
    assert got == pytest.approx(want)


@pytest.mark.parametrize(
    "kind,won,outcome,rnd,want",
    [
        ("winner", True, "KO", 1, (1, "resolved")), ("winner", None, "DRAW", 3, (0, "resolved")), ("method_ko", True, "DQ", 2, (1, "resolved")), ("distance", False, "U-DEC", 3, (1, "resolved")),
        ("winner", True, "NC", 1, (None, "void")), ("vicround_other", None, "NC", 1, (1, "resolved")), ("end_before_r3", True, "SUB", 2, (1, "resolved")), ("win_in_r2", False, "KO", 2, (0, "resolved")),
        ("winner", None, None, None, (None, "pending")),
    ],
)
def test_settlement(spark, kind, won, outcome, rnd, want):
    df = spark.createDataFrame([(kind, won, outcome, rnd)], "k string, w boolean, o string, r int")
    s = df.select(ledger.settle(F.col("k"), F.col("w"), F.col("o"), F.col("r"), F.lit(3)).alias("s")).first().s
    assert (s.realized, s.status) == want


def test_first_write_wins(spark):
    log = spark.createDataFrame([("a", 1, "resolved")], "key string, t int, status string")
    new = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "key string, t int")
    assert sorted(map(tuple, ledger.append_new(log, new, "key", ["t"]).collect())) == [("a", 1, "resolved"), ("b", 2, "pending")]


def test_budget(spark):
    df = spark.createDataFrame([("c", 1, 30.0), ("c", 2, 10.0), ("c", 3, 0.2)], "card string, id int, stake double")
    got = {r.id: r.sized for r in ledger.scale_to_budget(df, ["card"], "stake", 20.0).collect()}
    assert got == {1: 14.0, 2: 4.0}


def test_as_of_takes_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 5)], "u int, t int")
    right = spark.createDataFrame([(1, 5, "x"), (1, 3, "y")], "u int, t int, v string")
    assert sorted(map(tuple, resolve.as_of(left, right, ["u"], "t", ["v"]).collect()), key=str) == [(1, 1, None), (1, 5, "x"), (2, 5, None)]


def test_name_resolution(spark):
    known = spark.createDataFrame([(n,) for n in ("ann lee", "bob ray", "rob ray", "alex pereira", "sharabutdin magomedov", "murad magomedov", "andre lima", "jo")], "name string")
    cases = {
        "an lee": ("ann lee", "surname"), "bob rai": ("bob ray", "similar"), "bobb ray": ("bob ray", "surname"), "alex perreira": ("alex pereira", "similar"), "pereira alex": ("alex pereira", "surname"),
        "shara magomedov": ("sharabutdin magomedov", "surname"), "ali magomedov": (None, "unresolved"), "murtazali magomedova": (None, "unresolved"), "zz top": (None, "unresolved"), "jo": ("jo", "exact"),
        "x": ("ann lee", "override"),
    }
    names = spark.createDataFrame([(n,) for n in [*cases, "jo"]] + [(None,)], "name string")
    overrides = spark.createDataFrame([("x", "ann lee")], "name string, match string")
    got = {r.name: (r.match, r.how) for r in resolve.resolve_names(names, known, overrides, cutoff=0.8).collect()}
    assert got == {**cases, None: (None, "unresolved")}
    assert resolve.resolve_names(names.limit(0), known).count() == 0 and {r.how for r in resolve.resolve_names(names, known.limit(0)).collect()} == {"unresolved"}


@pytest.mark.parametrize("cutoff", [0.5, 0.7, 0.85, 1.0])
def test_similar_pairs_are_complete(spark, cutoff):
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("ab ") for _ in range(r.randrange(1, 12)))
    names, known = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {(a, b) for a in names for b in known if 1 - edits(a, b) / max(len(a), len(b)) >= cutoff - 1e-12}
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = [(x.name, x.match) for x in resolve.similar_pairs(frame(names, "name"), frame(known, "match"), cutoff).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_cdf_laws(spark):
    qs, qv = F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)), F.array(F.lit(1.0), F.lit(4.0), F.lit(9.0))
    f = lambda x: spark.range(1).select(dist.hurdle_cdf(F.lit(x), F.lit(0.2), qs, qv).alias("f")).first().f
    assert [f(-1.0), f(0.0), f(4.0), f(9.0)] == [0, 0.2, pytest.approx(0.6), 1]


def test_isotonic_rises(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.9, 1)], "p double, y int")
    got = [r.calibrated for r in calibrate.isotonic(df, df).orderBy("p").collect()]
    assert got == sorted(got)
