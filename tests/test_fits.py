"""Calibration fits, bootstrap, learners and the rating stream against plain Python or closed forms."""

import datetime as dt
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from priorwise.operators import calibrate, evaluate, ml
from priorwise.streaming import ledgers


@pytest.fixture(scope="module")
def scored(spark):
    r = random.Random(1)
    rows = [(k, p := round(r.uniform(0.02, 0.98), 3), int(r.random() < 1 / (1 + math.exp(-(1.8 * math.log(p / (1 - p)) + 0.4))))) for k in range(1500)]
    return rows, spark.createDataFrame(rows, "id long, p double, y int").repartition(3)


def nll(rows, f):
    return -sum(math.log(f(p)) if y else math.log(1 - f(p)) for _, p, y in rows) / len(rows)


def test_isotonic_is_the_pooled_mean(scored):
    rows, df = scored
    got = {r.id: r.calibrated for r in calibrate.isotonic(df, df).collect()}
    blocks = []
    by_p = {}
    for _, p, y in rows:
        n, s = by_p.get(p, (0, 0))
        by_p[p] = (n + 1, s + y)
    for p in sorted(by_p):
        blocks.append([*by_p[p], [p]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            n, s, ps = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + s, blocks[-1][2] + ps]
    fit = {p: s / n for n, s, ps in blocks for p in ps}
    assert all(got[k] == pytest.approx(fit[p], abs=1e-9) for k, p, _ in rows)


def test_platt_and_temperature_minimise_the_loss(scored):
    rows, df = scored
    z = lambda p: math.log(p / (1 - p))
    got = {r.id: r.calibrated for r in calibrate.platt(df, df).collect()}
    loss = -sum(math.log(got[k]) if y else math.log(1 - got[k]) for k, _, y in rows) / len(rows)
    best = min(nll(rows, lambda p, a=a, b=b: 1 / (1 + math.exp(-(a * z(p) + b)))) for a in [1 + k / 50 for k in range(70)] for b in [k / 25 for k in range(-5, 25)])
    assert loss <= best + 1e-4
    t = calibrate.temperature(df)
    grid = [0.1 * 1.02**k for k in range(230)]
    assert nll(rows, lambda p: 1 / (1 + math.exp(-z(p) / t))) <= min(nll(rows, lambda p, t=t: 1 / (1 + math.exp(-z(p) / t))) for t in grid) + 1e-6


def test_cap_and_blend(spark):
    rows = [(0.95, int(k % 10 < 8)) for k in range(200)] + [(0.05, int(k % 10 < 2)) for k in range(200)]
    df = spark.createDataFrame(rows, "p double, y int")
    assert calibrate.symmetric_cap(df) == 0.8
    two = df.withColumns({"a": F.col("y") * 0.6 + 0.2, "b": F.lit(0.5)})
    assert calibrate.blend_weight(two, "a", "b") == 1.0
    assert two.select(calibrate.blended(["a", "b"], [1, 3]).alias("x")).where("y = 1 OR true").agg(F.max("x")).first()[0] == pytest.approx(0.575)


def test_bootstrap_covers_the_score(scored):
    rows, df = scored
    got = evaluate.bootstrap(df, "id", 300).first()
    brier = sum((p - y) ** 2 for _, p, y in rows) / len(rows)
    spread = math.sqrt(sum(((p - y) ** 2 - brier) ** 2 for _, p, y in rows)) / len(rows)
    assert got.mean == pytest.approx(brier, abs=spread) and got.high - got.low == pytest.approx(2 * 1.96 * spread, rel=0.25)
    assert tuple(evaluate.bootstrap(df.repartition(7), "id", 300).first()) == pytest.approx(tuple(got))


def test_normal_tail(spark):
    zs = [-6.0, -1.5, 0.0, 0.3, 1.0, 2.5, 4.0, 7.0, None]
    got = [r.t for r in spark.createDataFrame([(z,) for z in zs], "z double").select(evaluate.normal_tail(F.col("z")).alias("t")).collect()]
    assert got[-1] is None and all(t == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-6, abs=1e-12) for z, t in zip(zs[:-1], got))


def test_components_are_uncorrelated_and_ordered(spark):
    r = random.Random(3)
    rows = [(k, x := r.gauss(0, 1), x * 0.8 + r.gauss(0, 0.3), r.gauss(0, 1)) for k in range(400)]
    df = ml.standard_pca(spark.createDataFrame(rows, "id int, a double, b double, c double"), ["a", "b", "c"], F.col("id") % 4 != 0, 3)
    m = df.where("id % 4 <> 0").agg(*(F.var_samp(f"pc_{k}").alias(f"v{k}") for k in (1, 2, 3)), F.corr("pc_1", "pc_2").alias("r")).first()
    assert m.v1 > m.v2 > m.v3 and abs(m.r) < 1e-6 and m.v1 + m.v2 + m.v3 == pytest.approx(3, rel=1e-6)


def test_learners_find_what_matters(spark):
    r = random.Random(4)
    rows = [(k, x := r.gauss(0, 1), r.gauss(0, 1), int(r.random() < 1 / (1 + math.exp(-2 * x))), (x > 0.5) + (x > -0.5)) for k in range(900)]
    df = spark.createDataFrame(rows, "id int, x_a double, x_b double, y int, c int")
    out = ml.out_of_fold(df, "id", ["x_a", "x_b"], "y").collect()
    pos, neg = [r.score for r in out if r.y], [r.score for r in out if not r.y]
    assert len(out) == 900 and sum(a > b for a in pos for b in neg) > 0.8 * len(pos) * len(neg)
    found = {r.feature: r.importance for r in ml.importance(df, ["x_a", "x_b"], "y").collect()}
    assert found["x_a"] > 0.6 and sum(found.values()) == pytest.approx(1)
    probs = ml.class_scores(df, df, ["x_a", "x_b"], "c").collect()
    assert all(sum(r.probs) == pytest.approx(1) for r in probs) and sum(max(range(3), key=lambda k: r.probs[k]) == r.c for r in probs) > 0.75 * len(probs)
    effects = ml.occlusion(df.limit(50), "id", {"x": ["x"]}, lambda d: d.withColumn("score", F.col("x_a") - 2 * F.col("x_b"))).collect()
    want = {k: (a - 2 * b) - (-(a + b) / 2) for k, a, b, *_ in rows}
    assert len(effects) == 50 and all(e.effect == pytest.approx(want[e.id]) for e in effects)


def test_running_ratings(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.choice("pq"), dt.date(2020, 1, 1) + dt.timedelta(days=k // 3), k, *r.sample(range(6), 2), r.choice((0, 1, None))) for k in range(90)]
    schema = "pool string, day date, contest_id long, a_id long, b_id long, won_a int"
    folder = str(tmp_path / "in")
    os.mkdir(folder)
    now, got = {}, {}
    stream = spark.readStream.schema(schema).parquet(folder)
    for part in (rows[:40], rows[40:70], rows[70:]):  # each run goes on from the checkpoint of the one before
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        for pool, _, _, a, b, won in part:
            x, y = now.get((pool, a), 1500.0), now.get((pool, b), 1500.0)
            gain = 0.0 if won is None else 24 * (won - 1 / (1 + 10 ** ((y - x) / 400)))
            now[pool, a], now[pool, b] = x + gain, y - gain
        with ledgers.rocks_state(spark):
            found = ledgers.run_to_table(ledgers.running_ratings(stream), str(tmp_path / "out"), "update", ["pool", "id"]).collect()
        got = {(x.pool, x.id): x.rating for x in found}
        assert len(found) == len(got) and got.keys() == now.keys() and all(v == pytest.approx(now[k], abs=1e-9) for k, v in got.items())
    assert {(x.pool, x.id): x.n for x in found} == {k: sum(k in ((p, a), (p, b)) for p, _, _, a, b, _ in rows) for k in now}


def test_first_writes_of_late_rows(spark, tmp_path):
    """Within the watermark a key is written once, rows that are too late not at all, and later keys again."""
    schema = "key string, ts timestamp, v int"
    folder = str(tmp_path / "in")
    os.mkdir(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    day = lambda d: dt.datetime(2024, 1, d)
    for part in ([("a", day(1), 1), ("a", day(2), 2), ("b", day(10), 3)], [("c", day(1), 4), ("a", day(11), 5), ("b", day(11), 6)], [("d", day(25), 7)], [("b", day(26), 8)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        found = ledgers.run_to_table(ledgers.first_write_wins(stream, "key", "ts", "3 days"), str(tmp_path / "out"))
    assert sorted(x.v for x in found.collect()) in ([1, 3, 5, 7, 8], [2, 3, 5, 7, 8])


@pytest.mark.parametrize("labels", ["both", "ones", "zeros"])
def test_logistic_scores_need_no_model_in_their_plan(spark, labels):
    """Scores are those of Spark's own model, and no function that holds a model is shipped to tasks."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    r = random.Random(4)
    y = {"both": lambda x: int(r.random() < 1 / (1 + 2.7 ** (-x))), "ones": lambda x: 1, "zeros": lambda x: 0}[labels]
    rows = [(k, x := r.uniform(-3, 3), None if k % 9 == 0 else r.uniform(0, 1), y(x), r.uniform(0.1, 1)) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int, w double")
    got = ml.fit_scores(df, df, ["a", "b"], "y", weight="w")
    assert "UDF" not in got._jdf.queryExecution().toString()
    known = df.fillna(0.0, ["a", "b"]).withColumn("y", F.col("y").cast("double"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v"), LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", maxIter=50, regParam=1e-3)]).fit(known)
    want = {x.id: x.p for x in model.transform(known).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    assert {x.id: pytest.approx(x.score, abs=1e-12) for x in got.collect()} == want
