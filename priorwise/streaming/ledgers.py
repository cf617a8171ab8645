"""The ledger's steps on streams, with state bounded by watermarks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType


def table_stream(spark: SparkSession, folder: str, file: str, schema: StructType) -> DataFrame:
    """Parquet files with a name below a folder, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def first_write_wins(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def graded(predictions: DataFrame, results: DataFrame, key: str, made: str, known: str, late: str = "1 hour", within: str = "1 day") -> DataFrame:
    """Predictions with results that follow within the interval; both sides forget what is older."""
    p, r = predictions.withWatermark(made, late).alias("p"), results.withWatermark(known, late).alias("r")
    near = F.expr(f"p.{key} = r.{key} AND r.{known} >= p.{made} AND r.{known} <= p.{made} + INTERVAL {within}")
    return p.join(r, near).select("p.*", *(F.col(f"r.{c}").alias(f"result_{c}") for c in results.columns if c != key))


def hit_rate_windows(stream: DataFrame, time: str, by: str, hit: str, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and hit rate by market in (sliding) windows of time."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, by).agg(F.count("*").alias("n"), F.avg(hit).alias("hit_rate"))


_RATING = "pool string, id long, rating double, n long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ratings(StatefulProcessor):
    """Ratings of one pool's entities, each an entry of its own, so that a batch reads and writes only its entities."""

    def __init__(self, k: float) -> None:
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("ratings", "id long", "rating double, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["day", "contest_id"], kind="stable")
        now: dict[int, tuple[float, int]] = {}
        for i in pd.unique(pd.concat([batch["a_id"], batch["b_id"]])).tolist():
            now[i] = self.held.getValue((i,)) if self.held.containsKey((i,)) else (1500.0, 0)
        for c in batch[["a_id", "b_id", "won_a"]].itertuples(index=False):
            (a, n), (b, m) = now[c.a_id], now[c.b_id]
            gain = 0.0 if pd.isna(c.won_a) else self.k * (c.won_a - 1 / (1 + 10 ** ((b - a) / 400)))
            now[c.a_id], now[c.b_id] = (a + gain, n + 1), (b - gain, m + 1)
        for i, (rating, n) in now.items():
            self.held.updateValue((i,), (float(rating), int(n)))
        out = sorted(now)
        yield pd.DataFrame({"pool": key[0], "id": out, "rating": [now[i][0] for i in out], "n": [now[i][1] for i in out]})

    def close(self) -> None:
        pass


def running_ratings(stream: DataFrame, k: float = 24.0) -> DataFrame:
    """Ratings of the entities of each batch after it, from a stream of contests (pool, day, contest_id, a_id, b_id, won_a).

    Contests within a batch are taken in order. The state has one entry for each
    entity of a pool and is never dropped, as ratings last. Run it with
    ``rocks_state``, as such state is kept in RocksDB.
    """
    return stream.groupBy("pool").transformWithStateInPandas(_Ratings(k), _RATING, "update", "none")


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start within this block keep their state in RocksDB; the session's setting is restored after it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream over what is there and return what it wrote below ``folder``; run again, it goes on where it ended.

    In update mode a batch writes the rows that it changed to a folder of its
    own, which a repeated batch replaces, and the newest row of each of ``keys``
    is returned. In complete mode each batch replaces what the one before wrote.
    """
    spark, out = stream.sparkSession, f"{folder}/out"
    schema = stream.schema
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    elif mode == "update":
        writer = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    else:
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    query = writer.start()
    query.awaitTermination()
    if mode != "update":
        return spark.read.schema(schema).parquet(out)
    written = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(out)
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("row"))
    return newest.select("row.*")
