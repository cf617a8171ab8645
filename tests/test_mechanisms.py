"""Blends, folds of time, kept models, laws with atoms, re-grading, counts in one pass and paged feeds."""

import datetime as dt
import math
import os
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from priorwise.operators import calibrate, dist, evaluate, ledger, lineage, ml, records, resolve
from priorwise.sources import files


def scored(spark, n=3000, seed=4):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        x, z = r.gauss(0, 1), r.gauss(0, 1)
        p = 1 / (1 + math.exp(-(0.9 * x + 0.5 * z)))
        clip = lambda v: min(max(v, 0.001), 0.999)
        rows.append((k, clip(1 / (1 + math.exp(-1.2 * x))), clip(1 / (1 + math.exp(-0.9 * z))), clip(r.random()), int(r.random() < p)))
    return rows, spark.createDataFrame(rows, "id long, a double, b double, c double, y int")


def loss(rows, w, in_logits):
    total = 0.0
    for _, *x, y in rows:
        if in_logits:
            p = 1 / (1 + math.exp(-sum(v * math.log(q / (1 - q)) for v, q in zip(w, x))))
        else:
            p = sum(v * q for v, q in zip(w, x))
        total -= math.log(p if y else 1 - p)
    return total / len(rows)


@pytest.mark.parametrize("in_logits", [False, True])
def test_blend_of_three(spark, in_logits):
    """Weights on the simplex whose loss no point of a fine grid beats."""
    rows, df = scored(spark, 1200)
    w = calibrate.blend_weights(df, ["a", "b", "c"], in_logits=in_logits)
    assert min(w) >= 0 and sum(w) == pytest.approx(1)
    near = [(w[0] + i / 200, w[1] + j / 200, w[2] - (i + j) / 200) for i in range(-3, 4) for j in range(-3, 4)]
    coarse = [(i / 12, j / 12, 1 - (i + j) / 12) for i in range(13) for j in range(13 - i)]
    best = min(loss(rows, v, in_logits) for v in [*near, *coarse] if min(v) >= 0)
    assert loss(rows, w, in_logits) <= best + 1e-9
    odd = df.withColumn("a", F.when(F.col("id") % 100 != 0, F.col("a")))
    assert sum(calibrate.blend_weights(odd, ["a", "b"])) == pytest.approx(1) and calibrate.blend_weights(df.limit(0), ["a", "b"]) == [0.5, 0.5]


def test_zero_rate_shift(spark):
    df = spark.createDataFrame([(0.1,), (0.4,), (0.8,), (None,)], "p double")
    shift = calibrate.zero_rate_shift(df, "p", 0.25)
    mean = sum(1 / (1 + math.exp(-(math.log(p / (1 - p)) + shift))) for p in (0.1, 0.4, 0.8)) / 3
    assert mean == pytest.approx(0.25, abs=1e-6)


def test_refined_factor(spark):
    """A factor between the points of a coarse grid is found by refinement."""
    r = random.Random(2)
    df = spark.createDataFrame([(r.random() / 1.37,) for _ in range(4000)], "v double")
    cdf = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    coarse, fine = calibrate.best_factor(df, "v", cdf, [0.5, 1.0, 1.5, 2.0], 0), calibrate.best_factor(df, "v", cdf, [0.5, 1.0, 1.5, 2.0])
    assert coarse == 1.5 and abs(fine - 1.37) < 0.05


def test_time_folds(spark):
    """No row is scored by a model that saw its date, a later one, or one within the embargo."""
    r = random.Random(1)
    start = dt.date(2020, 1, 1)
    rows = [(k, start + dt.timedelta(days=r.randrange(300)), float(r.random()), 0) for k in range(600)]
    # the label is known from x before day 200 and turned around after it
    rows = [(k, d, x, int((x > 0.5) == ((d - start).days < 200))) for k, d, x, _ in rows] + [(900, None, 0.5, 1)]
    df = spark.createDataFrame(rows, "id long, day date, x double, y int")
    got = {r.id: r for r in ml.out_of_time(df, ["x"], "y", "day", 5, 10).collect()}
    assert len(got) == len(rows) and got[900].score is None and got[900].fold is None
    folds = {}
    for r_ in got.values():
        if r_.fold is not None:
            folds.setdefault(r_.fold, []).append(r_.day)
    assert sorted(folds) == [0, 1, 2, 3, 4, 5] and all(max(folds[f]) < min(folds[f + 1]) for f in range(5))
    assert all((r_.score is None) == (r_.fold in (None, 0)) for r_ in got.values())
    # in the fold that holds day 200, models that saw only earlier days are wrong about the later ones
    turned = [r_ for r_ in got.values() if r_.day and (r_.day - start).days >= 200 and r_.fold == got[min(got, key=lambda k: abs(((got[k].day or start) - start).days - 200))].fold]
    assert turned and sum((r_.score > 0.5) == (r_.y == 1) for r_ in turned) < 0.2 * len(turned)
    assert ml.out_of_time(df.limit(0), ["x"], "y", "day").count() == 0


def test_kept_components(spark, tmp_path):
    rows, df = scored(spark, 300)
    features = ml.numeric_features(df, ["id", "y"])
    assert features == ["a", "b", "c"]
    model = ml.fitted_components(df.where("id % 2 = 0"), features, 2)
    model.save(str(tmp_path / "model"))
    pair = [{r.id: (r.pc_1, r.pc_2) for r in ml.with_components(df, m).collect()} for m in (model, PipelineModel.load(str(tmp_path / "model")))]
    assert pair[0] == pair[1] and len(pair[0]) == 300
    same = {r.id: (r.pc_1, r.pc_2) for r in ml.standard_pca(df, features, F.col("id") % 2 == 0, 2).collect()}
    assert all(abs(x) == pytest.approx(abs(y)) for k in same for x, y in zip(same[k], pair[0][k]))


def test_served_classes(spark):
    """Overconfident classes are cooled down: the served ones lose less on held rows, and sum to one."""
    r = random.Random(6)
    rows = []
    for k in range(900):
        true = [r.random() + 0.2 for _ in range(3)]
        p = [t / sum(true) for t in true]
        hot = [x**3 for x in p]
        rows.append((k, r.choices(range(3), p)[0], [h / sum(hot) for h in hot]))
    df = spark.createDataFrame(rows, "id long, c int, probs array<double>")
    out = ml.served_classes(df, df.where("id % 2 = 0"), "c", [1 / 3] * 3).where("id % 2 = 1").collect()
    cost = lambda f: sum(-math.log(r_[f][r_.c]) for r_ in out) / len(out)
    assert all(sum(r_.served) == pytest.approx(1) for r_ in out) and cost("served") < cost("probs") - 0.01


def test_transforms_of_atoms(spark):
    """Draws from laws with atoms become uniform; without a spread of the atoms they are not."""
    r = random.Random(3)
    n = 6000
    mixed = [0.0 if (x := r.random()) < 0.25 else 8.0 if x > 0.9 else (x - 0.25) / 0.65 * 8 for _ in range(n)]
    whole = [float(sum(r.random() < 0.4 for _ in range(30))) for _ in range(n)]
    df = spark.createDataFrame([(k, m, w) for k, (m, w) in enumerate(zip(mixed, whole))], "id long, m double, w double")
    u = evaluate.hashed_uniform(F.col("id"))
    low = lambda x: 0.25 + 0.65 * x / 8
    mass = [math.comb(30, k) * 0.4**k * 0.6 ** (30 - k) for k in range(31)]
    upto = F.array(*(F.lit(sum(mass[:k])) for k in range(32)))  # the exact law, at half-way values
    steps = lambda x: F.get(upto, F.floor(x).cast("int") + 1)
    got = df.select(
        "id", evaluate.hurdle_pit(F.col("m"), F.lit(0.25), low, u, F.lit(8.0)).alias("a"), evaluate.hurdle_pit(F.col("m"), F.lit(0.25), low, F.lit(0.5), F.lit(8.0)).alias("b"), evaluate.discrete_pit(F.col("w"), steps, u).alias("c")
    )
    p = {c: evaluate.ks_uniform(got.withColumn("g", F.lit(c)), ["g"], c).first().p_value for c in "abc"}
    assert p["a"] > 0.01 and p["c"] > 0.01 and p["b"] < 1e-6
    assert got.collect() == got.collect()


def test_durations_with_atoms(spark):
    """F(F^-1(q)) >= q, with equality away from atoms, and nothing earlier reaches q."""
    numbers = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    law = (F.lit(0.3), numbers(0, 0.4, 1), numbers(30, 200, 890), F.lit(900.0), F.lit(0.25), numbers(300, 600))
    cdf = lambda t: dist.duration_cdf_with_boundaries(t, *law)
    q = (F.col("id") + 0.5) / 400
    rows = spark.range(400).select(q.alias("q"), dist.duration_quantile_with_boundaries(q, *law).alias("t"))
    got = rows.select("q", "t", cdf(F.col("t")).alias("f"), cdf(F.col("t") - 1e-6).alias("before")).collect()
    atoms = 0
    for r in got:
        assert r.f >= r.q - 1e-9 and r.before <= r.q + 1e-9
        if r.t not in (300.0, 600.0, 900.0):
            assert r.f == pytest.approx(r.q, abs=1e-9)
        else:
            atoms += 1
    assert atoms > 100 and [r.t for r in got] == sorted(r.t for r in got)
    none = (F.lit(0.3), numbers(0, 0.4, 1), numbers(30, 200, 890), F.lit(900.0), F.lit(0.25), F.array().cast("array<double>"))
    plain = spark.range(40).select((F.col("id") * 25.0).alias("t")).select(dist.duration_cdf_with_boundaries(F.col("t"), *none).alias("a"), dist.duration_cdf(F.col("t"), *none[:4]).alias("b")).collect()
    assert all(r.a == pytest.approx(r.b) for r in plain)


def test_ceiling(spark):
    numbers = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    inverse = lambda c: spark.range(1).select(dist.inverse_on_grid(numbers(0.0, 0.5, 1.0), numbers(0, 10, 20), numbers(0, 0.5, 1), c).alias("x")).first().x
    assert inverse(None) == [0.0, 10.0, 20.0] and inverse(F.lit(10.0)) == [0.0, 5.0, 10.0] and inverse(F.lit(99.0)) == [0.0, 10.0, 20.0]


def test_curves_are_read_once(spark):
    """Curves read at points that are themselves read from curves; every expression stands in the plan once for each reading."""
    from priorwise.functions import maths

    assert spark.range(50).select(maths.once(F.rand(1), lambda v: v - v).alias("x")).distinct().collect()[0].x == 0
    numbers = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    x, ys = F.col("id") / 10, [0.0, 0.5, 0.75, 1.0]
    for _ in range(6):
        x = maths.interp(x, numbers(0, 0.25, 0.5, 1), numbers(*ys))
    read = spark.range(12).select("id", x.alias("x"))
    expected = [k / 10 for k in range(12)]
    for _ in range(6):
        expected = [float(np.interp(v, [0, 0.25, 0.5, 1], ys)) for v in expected]
    assert [r.x for r in read.orderBy("id").collect()] == pytest.approx(expected)
    law = (F.lit(0.3), numbers(0, 0.4, 1), numbers(30, 200, 890), F.lit(900.0), F.lit(0.25), numbers(300, 600))
    curves = spark.range(3).select(dist.duration_quantile_with_boundaries(F.col("id") / 5, *law), dist.inverse_on_grid(numbers(0.25, 0.5), numbers(0, 10, 20), numbers(0, 0.5, 1), F.col("id") * 9.0))
    plan = lambda df: df._jdf.queryExecution().analyzed().toString().count("lambdafunction(")
    assert plan(read) < 30 and plan(curves) < 80, plan(curves)
    assert spark.range(1).select(maths.interp(F.lit(None).cast("double"), numbers(0, 1), numbers(0, 1)).alias("x")).first().x is None


def test_counts_in_one_pass(spark, tmp_path):
    """Kept rows and counts come from one scan, also where nothing is counted."""
    path = str(tmp_path / "t")
    spark.createDataFrame([(k, None if k % 4 == 0 else dt.date(2020, 1, 1)) for k in range(40)], "id long, day date").write.parquet(path)
    kept, undated = records.dated(spark.read.parquet(path), "day")
    assert undated == 10 and kept.count() == 30
    assert "FileScan" not in kept._jdf.queryExecution().executedPlan().toString()  # the scan is done, nothing reads it again
    assert records.dated(kept, "day")[1] == 0 and records.dated(kept.limit(0), "day")[1] == 0
    words = spark.createDataFrame([(1, "big ring"), (2, "bolt"), (3, "ring"), (4, None)], "id long, name string")
    flags, counts = resolve.counted_tripwire(words, words.where("id = 3").select("id", F.lit(False).alias("flag")), "id", "name", ["ring"])
    assert counts == {"flagged": 1, "uncurated": 1} and flags.count() == 4
    assert lineage.counted(words, None, none=F.col("name") == "x")[1] == {"none": 0}


def test_models_are_applied_after_counts(spark):
    """Counting leaves nothing in the session that Spark's own binary logistic models cannot carry to the tasks."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    session = spark.newSession()
    rows = session.createDataFrame([(k, k % 7 + 0.5 * (k % 2), k % 2, dt.date(2020, 1, 1) if k % 3 else None) for k in range(40)], "id long, x double, y int, day date")
    kept, undated = records.dated(rows, "day")
    assert undated == 14
    known = VectorAssembler(inputCols=["x"], outputCol="v").transform(kept.withColumn("y", F.col("y").cast("double")))
    assert len(LogisticRegression(featuresCol="v", labelCol="y").fit(known).transform(known).collect()) == 26


def test_regrading_touches_its_days(spark, tmp_path):
    """Only days whose rows differ are written; a second run writes nothing."""
    path = str(tmp_path / "log")
    log = spark.createDataFrame([(k, "A", "resolved", k % 2 == 0, f"2024-01-0{k % 4 + 1}") for k in range(40)], "id long, predicted string, status string, correct boolean, day string")
    files.write_table(log, path, "day")
    seen = lambda: {f"{d}/{f}": os.path.getmtime(f"{path}/{d}/{f}") for d in os.listdir(path) if d.startswith("day=") for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")}
    results = spark.createDataFrame([(k, "A" if k != 8 else "B") for k in range(0, 40, 4)], "id long, winner string")
    change = lambda rows: ledger.grade_winners(rows, results, "id", regrade=True)
    before = seen()
    assert files.rewrite_days(spark, path, "day", ["2024-01-01", "2024-01-02"], change) == ["2024-01-01"]
    after = seen()
    same = {k for k in before if not k.startswith("day=2024-01-01")}
    assert same and all(before[k] == after.get(k) for k in same) and before.keys() != after.keys()
    assert files.rewrite_days(spark, path, "day", ["2024-01-01", "2024-01-02"], change) == [] and seen() == after
    got = {r.id: (r.status, r.correct) for r in spark.read.parquet(path).collect()}
    assert len(got) == 40 and got[8] == ("resolved", False) and got[4] == ("resolved", True) and got[3] == ("resolved", False)


def test_pages_and_history(spark):
    rows = spark.createDataFrame([("d", k, k % 3 == 0) for k in range(25)] + [("e", 1, True)], "day string, id long, hit boolean")
    feed = ledger.event_feed(rows, "day", "id", ["hit"], 10, hits=F.count_if("hit")).orderBy("day", "page").collect()
    assert [(r.day, r.page, len(r.rows), r.n, r.hits) for r in feed] == [("d", 0, 10, 25, 9), ("d", 1, 10, 25, 9), ("d", 2, 5, 25, 9), ("e", 0, 1, 1, 1)]
    assert [x.id for r in feed[:3] for x in r.rows] == list(range(25))
    past = spark.createDataFrame([(1, "d", 1), (2, "d", 0), (3, "e", None)], "id long, day string, hit int")
    live = spark.createDataFrame([(2, "d", 1), (4, "f", 0)], "id long, day string, hit int")
    got = [tuple(r) for r in ledger.history(past, live, "id", "day", "hit").orderBy("day").collect()]
    assert got == [("d", 2, 1, 2, 2, 2, 2, 2, 1.0), ("e", 1, 0, 0, 0, 3, 2, 2, 1.0), ("f", 1, 1, 1, 0, 4, 3, 2, pytest.approx(2 / 3))]


def test_picks(spark):
    rows = [("g", 0.9, 1)] * 50 + [("g", 0.1, 0)] * 20 + [("g", 0.5, 1)] * 9 + [("h", 0.55, 1)]
    got = {r.g: r for r in evaluate.pick_record(spark.createDataFrame(rows, "g string, p double, y int"), ["g"], "p", "y").collect()}
    assert (got["g"].picks, got["g"].pick_rate, got["g"].proven) == (70, 1.0, True) and got["g"].low > 0.9
    assert (got["h"].picks, got["h"].pick_rate, got["h"].low, got["h"].proven) == (0, None, None, False)


def test_folds_of_time_are_scored_without_the_models(spark):
    """No fold's plan carries a function that holds its model."""
    r = random.Random(8)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(120)]
    df = spark.createDataFrame([(k, days[k // 3], x := r.uniform(-1, 1), int(x + r.uniform(-1, 1) > 0)) for k in range(360)], "id int, day date, x double, y int")
    got = ml.out_of_time(df, ["x"], "y", "day", 3, 10, half_life=30.0)
    assert "UDF" not in got._jdf.queryExecution().toString()
    scores = [(g.fold, g.score) for g in got.collect()]
    assert len(scores) == 360 and all((s is None) == (f == 0) for f, s in scores)
