"""What the operators share: checkpoints, bounded broadcasts, batch sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorwise.operators.lineage import checkpointed, shared_folder

__all__ = ["checkpointed", "in_small_batches", "joined_by_spread_key", "nested", "shared_folder", "small", "stored", "unnested"]

#: bytes of narrow tables that are broadcast at most
SMALL_BYTES = 32 << 20
#: rows of one key that a task meets in a join at most
HOT_ROWS = 1 << 20
#: rows of texts that travel between Spark and Python at once
BATCH_ROWS = 1000


def small(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted with the lengths of their strings, have at most ``most`` bytes; else as it is."""
    lengths = [F.sum(F.octet_length(c)).alias(f"n{k}") for k, (c, kind) in enumerate(df.dtypes) if kind in ("string", "binary")]
    size = df.agg(F.count("*").alias("n"), *lengths).first()
    return F.broadcast(df) if size[0] * (16 + 8 * len(df.columns)) + sum(x or 0 for x in size[1:]) <= most else df


def joined_by_spread_key(rows: DataFrame, classes: DataFrame, key: str, most: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the columns of their class; no task meets more than about ``most`` rows of one key.

    ``classes`` holds each key once and ``n_rows``, how many of the rows have
    it, which is left out of the result. A key with more rows than ``most`` is
    repeated once for every ``most`` of them, and its rows are dealt to these
    by a hash of their place, so that repeated rows spread too: ``rows`` must be
    a checkpoint or a stored table, whose rows keep their places when a task is
    run again. There is one such key for every ``most`` rows at most; that
    table is broadcast if its bytes are few.
    """
    splits = F.ceil(F.col("n_rows") / most).cast("int")
    hot = checkpointed(classes.where(F.col("n_rows") > most).select(key, splits.alias("splits")))
    if hot.isEmpty():
        return rows.join(classes.drop("n_rows"), key)
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("splits", F.lit(1))).cast("int")
    spread = rows.join(small(hot), key, "left").withColumn("part", dealt).drop("splits")
    repeated = classes.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(splits, F.lit(1)) - 1))).drop("n_rows")
    return spread.join(repeated, [key, "part"]).drop("part")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table of the shared folder and read from there; smaller than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nested(df: DataFrame, *kept: str) -> DataFrame:
    """The kept columns and ``row``, which holds all others, so that working columns clash with none of them."""
    rest = [c for c in df.columns if c not in kept]
    filler = "_" * (1 + max(map(len, df.columns)))  # a struct needs a field
    return df.select(*kept, F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(True).alias(filler)).alias("row"))


def unnested(df: DataFrame, columns: list[str], *kept: str) -> DataFrame:
    """The columns that ``nested`` has put away, in their order, with the kept ones as they are now."""
    return df.select(*(F.col(c) if c in kept else F.col("row").getField(c).alias(c) for c in columns))


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after a setting of its session that keeps batches of texts small on both sides of the exchange with Python."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df
