"""A join whose hot keys are dealt to several tasks gives the rows of the plain one."""

from pyspark.sql import functions as F

from priorwise.llm.shared import checkpointed, joined_by_spread_key


def test_hot_cold_null_and_lonely_keys(spark):
    # key 0 holds a third of the rows, of which many are equal; key 99 has no class, class 50 no row
    rows = checkpointed(spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, 99).otherwise(F.col("id") % 40 + 1).alias("k"), (F.col("id") % 5).alias("v")))
    classes = rows.where("k <> 99").groupBy("k").agg(F.count("*").alias("n_rows")).unionByName(spark.sql("SELECT 50L AS k, 0L AS n_rows")).withColumn("c", F.col("k") * 10)
    want = sorted(tuple(r) for r in rows.join(classes.drop("n_rows"), "k").select("k", "v", "c").collect())
    for most in (1, 16, 300, 10_000):
        got = joined_by_spread_key(rows, classes, "k", most)
        assert got.columns == ["k", "v", "c"]
        assert sorted(tuple(r) for r in got.collect()) == want, most


def test_parts_of_a_hot_key_are_even(spark):
    rows = checkpointed(spark.range(4000).select(F.lit(7).alias("k"), F.lit(None).cast("long").alias("v")))
    classes = spark.sql("SELECT 7 AS k, 4000L AS n_rows, 'x' AS c")
    met = joined_by_spread_key(rows, classes, "k", 500)
    assert met.count() == 4000 and met.where("c = 'x'").count() == 4000


def test_empty_tables(spark):
    rows = checkpointed(spark.range(0).select(F.col("id").alias("k")))
    classes = spark.sql("SELECT 1L AS k, 0L AS n_rows, 2 AS c").where("false")
    assert joined_by_spread_key(rows, classes, "k", 1).count() == 0


def test_a_plan_of_a_large_radius():
    import numpy as np

    from priorwise.llm.simhash import plan_parts

    for radius in (0, 3, 15):
        plan = plan_parts(1000, np.full((64, 64), 250.0) + np.eye(64) * 250.0, radius)
        assert sum(t + 1 for _, t in plan) == radius + 1 and all(t <= len(bits) for bits, t in plan)
