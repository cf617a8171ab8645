"""Keys of documents that travel with packed arrays, and groups of documents of bounded size.

A document is known by its id. Where ids are null or repeated, 128 bits of the
text's hashes tell rows apart, so rows with equal ids and texts are one
document. Documents are dealt to groups by a hash of the whole key, so that
neither regular ids nor many null ones gather in one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorwise.llm.packed import id_column, pack
from priorwise.llm.shared import in_small_batches

#: bytes of text whose windows meet in one part, and bytes of text in a group of documents
PART_BYTES = 16 << 20
GROUP_BYTES = 8 << 20

_PLAIN = np.dtype([("id", "<i8"), ("grp", "<i4")])
_MARKED = np.dtype([("id", "<i8"), ("m1", "<i8"), ("m2", "<i8"), ("grp", "<i4")])


@dataclass(frozen=True)
class Keyed:
    """``source`` (doc_id, text, m1, m2, grp), whether marks are in use, and numbers of parts and groups that follow the size of the texts."""

    source: DataFrame
    marked: bool
    parts: int
    groups: int

    @property
    def dtype(self) -> np.dtype:
        return _MARKED if self.marked else _PLAIN


def keyed(docs: DataFrame) -> Keyed:
    spark = in_small_batches(docs).sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = rows.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, groups = max(least, -(-size // PART_BYTES)), max(2 * least, -(-size // GROUP_BYTES))
    text = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("long")
    marks = (F.xxhash64(text), F.xxhash64(F.lit(7), text)) if marked else (zero, zero)
    rows = rows.withColumns({"m1": marks[0], "m2": marks[1]})
    key = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "m1") if marked else F.xxhash64("doc_id")
    return Keyed(rows.withColumn("grp", F.pmod(key, F.lit(groups)).cast("int")), marked, parts, groups)


def keys_of(rows: pa.RecordBatch, dtype: np.dtype) -> np.ndarray:
    out = np.empty(rows.num_rows, dtype)
    out["id"] = id_column(rows)
    for name in dtype.names[1:]:
        out[name] = rows.column(name).to_numpy(zero_copy_only=False)
    return out


def _order(keys: np.ndarray, *within: np.ndarray) -> np.ndarray:
    """Order by group, id and marks, then by further arrays."""
    names = [n for n in ("m2", "m1") if n in keys.dtype.names]
    return np.lexsort((*within, *(keys[n] for n in names), keys["id"]))


def changes(keys: np.ndarray) -> np.ndarray:
    """Whether each of the sorted keys differs from the one before."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return new


def ranks(keys: np.ndarray) -> np.ndarray:
    """Dense rank of each key by id and marks."""
    order = _order(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(changes(keys[order])) - 1
    return out


def by_group(keys: np.ndarray, order_by: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, payload): the documents of a group and counts of each, then the columns in the order of the documents."""
    if not len(keys):
        return
    order = _order(keys, order_by)
    order = order[np.argsort(keys["grp"][order], kind="stable")]
    keys = keys[order]
    edges = np.flatnonzero(np.concatenate([[True], keys["grp"][1:] != keys["grp"][:-1], [True]]))
    groups, payloads = [], []
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
        new = np.flatnonzero(changes(keys[s:e]))
        counts = np.diff(np.append(new, e - s)).astype(np.uint32)
        groups.append(int(keys["grp"][s]))
        payloads.append(pack(docs=keys[s:e][new], counts=counts, **{k: v[order[s:e]] for k, v in columns.items()}))
    yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(payloads, pa.binary())], ["grp", "payload"])
