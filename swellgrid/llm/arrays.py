"""Sums of long count arrays: one partial array per partition, added in chunks.

A chunk travels deflated, since the array of a small partition is mostly zeros.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

SCHEMA = "chunk int, counts binary, rows long"


def emit(counts: np.ndarray, rows: int, chunks: int) -> pa.RecordBatch:
    """The partial array of a partition as ``chunks`` rows."""
    parts = counts.reshape(chunks, -1)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(chunks), pa.int32()), pa.array([zlib.compress(p, 1) for p in parts], pa.binary()), pa.array([rows] * chunks, pa.int64())],
        names=["chunk", "counts", "rows"],
    )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    rows: dict[int, int] = {}
    for b in batches:
        for chunk, raw, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            part = np.frombuffer(zlib.decompress(raw), np.int64)
            total[chunk] = total[chunk] + part if chunk in total else part
            rows[chunk] = rows.get(chunk, 0) + n
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([zlib.compress(x, 1) for x in total.values()], pa.binary()), pa.array(list(rows.values()), pa.int64())],
            names=["chunk", "counts", "rows"],
        )


def total(parts: DataFrame, chunks: int) -> tuple[np.ndarray | None, int]:
    """The summed array and number of rows.  Partitions are streamed, so memory is one array."""
    with small_batches(parts.sparkSession):
        got = sorted(parts.repartition(chunks, "chunk").mapInArrow(_add, SCHEMA).collect(), key=lambda r: r["chunk"])
    if not got:
        return None, 0
    return np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in got]), got[0]["rows"]
