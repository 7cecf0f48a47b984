"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import discard, materialize, remove, shared_dir

__all__ = ["crc_mod", "discard", "in_arrow", "materialize", "per_worker", "remove", "shared_dir"]

#: What this worker keeps from task to task: one thing at most.
_held: dict = {}


def per_worker(key: tuple, make: Callable):
    """This worker's ``make()`` for a key. A worker keeps one such thing, the last one asked for."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def in_arrow(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: bool = False) -> DataFrame:
    """``rows.mapInArrow`` whose tasks give back unused memory at their end.

    Unless the work ``keeps`` what ``per_worker`` holds, it goes first: workers are used again for
    other operators' tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _held.clear()
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library than glibc
                pass

    return rows.mapInArrow(run, schema)


def crc_mod(id_column: str, mod: int):
    """crc32 of the id written as text, modulo ``mod`` (null ids: the empty text)."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(text) % F.lit(mod)
