"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where that is unset and Spark runs in one process, as in tests, a local one is set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if not folder:
        one_process = context.master.startswith("local") and not context.master.startswith("local-cluster")
        if not held.isDefined() and not one_process:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = held.get() if held.isDefined() else f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
    if not held.isDefined():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from files in the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame, kept: Column | None = None, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """Rows of ``df`` (those where ``kept`` holds), and counts over all of them, also when they are 0.

    ``df`` is computed once; rows and counts are read from its checkpoint. An
    ``Observation`` would count in the same pass, but leaves a manager in the session
    that cannot be serialised, and Spark's binary logistic models carry their session
    to the tasks: none could be applied after it.
    """
    rows = checkpointed(df)
    found = rows.agg(*(F.count_if(c).alias(n) for n, c in counts.items())).first()
    return rows if kept is None else rows.where(kept), {n: int(x) for n, x in found.asDict().items()}


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that an operator has written and no plan reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
