"""Element-wise totals of one fixed-size vector of counts over all partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import in_arrow

#: Entries of the vector that are summed as one row.
PART = 1 << 16
#: Tasks whose parts are summed as one group, before the groups' sums are.
FAN_IN = 1024


def packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, compressed."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(counts.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(counts.astype(f"<u{width}").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=f"<u{data[0]}").astype(np.int64)


def total(rows: DataFrame, size: int, count: Callable[[Iterator[pa.RecordBatch], np.ndarray], None]) -> np.ndarray:
    """Sum of the vectors that ``count(batches, vector)`` fills in each partition.

    What reaches the driver is the vector itself, of the fixed ``size``.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, group = np.zeros(size, dtype=np.int64), TaskContext.get().partitionId() // FAN_IN
        count(batches, vector)
        for p in range(-(-size // PART)):
            own = vector[p * PART : (p + 1) * PART]
            if own.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "group": pa.array([group], pa.int32()), "counts": pa.array([packed(own)], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        summed = np.zeros(PART, dtype=np.int64)
        for x in group["counts"]:
            own = unpacked(x.as_py())
            summed[: len(own)] += own
        return pa.table({"part": group["part"][:1], "group": pa.array([0], pa.int32()), "counts": pa.array([packed(summed)], pa.binary())})

    schema = "part int, group int, counts binary"
    filled = in_arrow(rows, fill, schema).groupBy("part", "group").applyInArrow(add, schema)
    out = np.zeros(-(-size // PART) * PART, dtype=np.int64)
    for r in filled.groupBy("part").applyInArrow(add, schema).collect():
        out[r["part"] * PART : (r["part"] + 1) * PART] = unpacked(r["counts"])
    return out[:size]
