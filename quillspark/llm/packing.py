"""Packing of token sequences: harmonic classes of reciprocal capacity.

A document's ids are cut into pieces whose lengths are capacity/k for k = 1, 2, 4, ...:
as many whole sequences as fit, then the binary digits of what is left. A class's bin
holds exactly k pieces, so a full bin has no padding. Workers cut and count on their own;
a prefix sum over (worker, class) counts tells each worker which bins it fills, and it
fills them without seeing any other worker's rows. As each length divides all larger
ones, the classes' last, partly filled bins are one run of descending lengths, and at most
one sequence of all ends short.

Contract: null text counts as empty (its only id is the end id); documents may repeat, and
each row is packed by itself; an empty table gives no pieces. Input columns other than the
id and text are ignored, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, materialize
from .encoding import encode_in_small_batches

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, worker long, rank long"


def piece_lengths(tokens: int, capacity: int) -> list[int]:
    """Whole sequences, then one power of two for each binary digit of the rest."""
    rest = tokens % capacity
    digits = [1 << i for i in reversed(range(capacity.bit_length())) if rest >> i & 1]
    return [capacity] * (tokens // capacity) + digits


def cut(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit), each ranked in its worker and class."""
    end = end_id.to_bytes(4, "little")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("worker", pa.int64()), ("rank", pa.int64())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, filled = TaskContext.get().partitionId(), {}
        out, size = [], 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, ids in encode_in_small_batches(tokenizer_path, batch.column(1)):
                ids += end
                total, start = len(ids) // 4, 0
                for length in piece_lengths(total, capacity):
                    rank = filled.get(length, 0)
                    filled[length] = rank + 1
                    out.append((keys[i], start, length, ids[4 * start : 4 * (start + length)], total, worker, rank))
                    start += length
                size += len(ids)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), pieces, PIECES, keeps=True)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack ``docs`` into sequences of at most ``capacity`` ids (a power of two).

    Returns one row for each piece: ``doc_id, start, length, ids, doc_tokens, sequence_id,
    offset``. A document's pieces cover its ids once; a sequence's pieces lie from offset 0
    on without a gap.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    # Written once: worker numbers and ranks must not change between the two passes.
    made = materialize(cut(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    filled = made.groupBy("length", "worker").agg((F.max("rank") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each class and worker, written so that Spark knows its size: it broadcasts the table only if that is small.
    starts = materialize(filled.select("length", "worker", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")))
    classes = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # log2(capacity) + 1 rows at most
    at, base = 0, F.lit(0).cast("long")
    for length in sorted(classes, reverse=True):
        base = F.when(F.col("length") == length, F.lit(at).cast("long")).otherwise(base)
        at += length * classes[length]
    place = base + (F.col("earlier") + F.col("rank")) * F.col("length")
    return (
        made.join(starts.drop("n"), ["length", "worker"])
        .withColumn("place", place)
        .select("doc_id", "start", "length", "ids", "doc_tokens",
                F.expr(f"place div {capacity}").alias("sequence_id"),
                (F.col("place") % F.lit(capacity)).cast("long").alias("offset"))
    )
