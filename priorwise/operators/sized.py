"""Broadcasts of tables whose size in bytes has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bytes of a table that are broadcast at most
SMALL_BYTES = 32 << 20


def small(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted with the lengths of strings and arrays, have at most ``most`` bytes; else as it is."""
    sizes = []
    for k, field in enumerate(df.schema.fields):
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            sizes.append(F.sum(F.octet_length(f"`{field.name}`")).alias(f"n{k}"))
        elif kind not in ("array", "map", "struct"):
            continue
        else:
            sizes.append(F.sum(F.octet_length(F.to_json(F.struct(f"`{field.name}`")))).alias(f"n{k}"))
    size = df.agg(F.count("*").alias("n"), *sizes).first()
    return F.broadcast(df) if size[0] * (16 + 8 * len(df.columns)) + sum(x or 0 for x in size[1:]) <= most else df
