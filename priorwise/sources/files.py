"""Typed tables from files and back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from priorwise.operators.lineage import checkpointed


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; all columns are strings, headers and cells trimmed."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*(F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in raw.columns))


def read_override(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Curated CSV table; empty where the file does not exist."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.option("header", True).schema(schema).csv(path) if fs.exists(target) else spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, replacing what is there; with ``by`` in partitions."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_snapshot(df: DataFrame, path: str, pulled: Column) -> None:
    """Rows of one pull, kept beside those of earlier pulls."""
    df.withColumn("pull_ts", pulled).write.mode("append").partitionBy("pull_ts").json(path)


def latest_snapshot(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of the last pull; other partitions are not read."""
    rows = spark.read.schema(StructType([*schema.fields]).add("pull_ts", "string")).json(path)
    last = rows.agg(F.max("pull_ts")).first()[0]
    return rows.where(F.col("pull_ts") == F.lit(last))


def rewrite_days(spark: SparkSession, path: str, day: str, days: Sequence[str], change: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Rows of the given days as ``change`` makes them; only days whose rows differ are written anew, and returned.

    Other days keep their files, so a second run with the same change writes
    nothing. The new rows are complete before the old ones are replaced.
    """
    table = spark.read.parquet(path)
    old = table.where(F.col(day).cast("string").isin(*days))
    new = checkpointed(change(old).select(*table.columns))
    # rows that are on one side more often than on the other
    counts = old.withColumn("__n", F.lit(1)).unionByName(new.withColumn("__n", F.lit(-1))).groupBy(*table.columns).agg(F.sum("__n").alias("__n"))
    touched = sorted(r[0] for r in counts.where("__n <> 0").select(F.col(day).cast("string")).distinct().collect())  # at most the days given
    if touched:
        (new.where(F.col(day).cast("string").isin(*touched)).repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path))
    return touched
