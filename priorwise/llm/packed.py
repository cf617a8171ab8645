"""Arrays packed into binary values, for rows that travel through a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: stands for a null doc_id
NO_ID = np.iinfo(np.int64).min


def _planes(a: np.ndarray) -> bytes:
    """Bytes of an array by significance, which compress better than its items."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def _unplaned(data: memoryview, n: int, dtype: type | np.dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).view(dtype).ravel()


def pack(**arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays.values()], np.int64)
    return head.tobytes() + b"".join(_planes(a) for a in arrays.values())


def unpack(data: bytes, **dtypes: type | np.dtype) -> dict[str, np.ndarray]:
    view = memoryview(data)
    sizes = np.frombuffer(view[: 8 * len(dtypes)], np.int64)
    at, out = 8 * len(dtypes), {}
    for (name, dtype), n in zip(dtypes.items(), sizes.tolist()):
        width = n * np.dtype(dtype).itemsize
        out[name] = _unplaned(view[at : at + width], n, dtype)
        at += width
    return out


def id_column(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
