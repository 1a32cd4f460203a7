"""Vectors as base64 of little-endian 32-bit floats, and back."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(vector) -> str | None:
    return None if vector is None else base64.b64encode(np.asarray(vector, "<f4").tobytes()).decode()


def decode(text: str | None) -> np.ndarray | None:
    if text is None:
        return None
    raw = base64.b64decode(text, validate=True)
    if len(raw) % 4:
        raise ValueError(f"{len(raw)} bytes are no 32-bit floats")
    return np.frombuffer(raw, "<f4")


def _bytes(vectors: pa.Array) -> pa.Array:
    """Lists of 32-bit floats as their bytes: the values' buffer with offsets four times as large."""
    vectors = vectors.cast(pa.large_list(pa.float32()))
    if vectors.offset or vectors.null_count:  # slices and nulls: one whole array without gaps
        vectors = pa.array(vectors.to_pylist(), vectors.type)
    offsets = np.frombuffer(vectors.buffers()[1], "<i8")[: len(vectors) + 1] * 4
    validity = vectors.buffers()[0]
    return pa.Array.from_buffers(pa.large_binary(), len(vectors), [validity, pa.py_buffer(offsets), vectors.values.buffers()[1]]).cast(pa.binary())


def _floats(raw: pa.Array) -> pa.Array:
    raw = pa.array(raw.to_pylist(), pa.large_binary()) if raw.offset or raw.null_count else raw.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], "<i8")[: len(raw) + 1]
    if (offsets % 4).any():
        raise ValueError(f"{np.diff(offsets)[np.diff(offsets) % 4 > 0][0]} bytes are no 32-bit floats")
    data = raw.buffers()[2] if raw.buffers()[2] is not None else pa.py_buffer(b"")
    values = pa.Array.from_buffers(pa.float32(), int(offsets[-1]) // 4, [None, data])
    return pa.Array.from_buffers(pa.large_list(pa.float32()), len(raw), [raw.buffers()[0], pa.py_buffer(offsets // 4)], children=[values]).cast(pa.list_(pa.float32()))


def to_base64(vectors: Column | str) -> Column:
    run = F.arrow_udf(_bytes, "binary")
    return F.translate(F.base64(run(vectors)), "\r\n", "")  # Spark breaks long texts into lines


def from_base64(texts: Column | str) -> Column:
    run = F.arrow_udf(_floats, "array<float>")
    return run(F.unbase64(texts))
