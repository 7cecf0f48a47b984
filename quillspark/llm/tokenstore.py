"""Token-id shards with a minimal perfect hash index over document keys.

Layout below one folder of the shared file system:

* ``shard-NNNNNN.bin``: ids of documents one after the other in ascending order of key, as
  raw little-endian integers of 2 bytes (4 for vocabularies beyond 65,536);
* ``rows``: Parquet, one row per stored document with its shard, place and global start;
* ``index``: Parquet, one row per bucket of keys with the bucket's minimal perfect hash
  (displacements) and, in hash order, each key's fingerprint, shard, place and length.

A lookup hashes a key to its bucket and slot, compares the stored fingerprint, and reads
one slice of one shard: the time does not depend on the number of documents.

Contract: a null text is the empty text; a null key is a key of its own and comes first;
rows that repeat a key are all stored, told apart by ``copy`` (0, 1, ... in stored order,
which follows the text's hash); an empty table gives an empty store. Columns other than key
and text are ignored, whatever their names. Very long texts are written one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import in_arrow, materialize, shared_dir
from .encoding import encode_in_small_batches, largest_id

#: Keys in a bucket of the index, on average.
BUCKET_KEYS = 1024
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("place", "<u8"), ("n", "<u8")])


@dataclass(frozen=True)
class TokenStore:
    """A written store: where it lies, its id width in bytes, and its number of buckets."""

    path: str
    width: int
    buckets: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def index(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/index")


def mix(keys: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys and seeds."""
    with np.errstate(over="ignore"):
        x = keys ^ (np.asarray(seed, dtype=np.uint64) * _GOLDEN + np.uint64(0x632BE59BD9B4E019))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_mph(keys: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash (hash and displace) of distinct 64-bit keys.

    Keys fall into groups of about four. Larger groups come first, each taking the first
    seed that sends its keys to free slots; a group of one stores its slot as ``-slot - 1``.
    """
    n = len(keys)
    groups = max(1, -(-n // 4))
    of = (mix(keys, 0) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(groups + 1))
    sizes = np.diff(ends)
    seeds = np.zeros(groups, dtype=np.int64)
    used = np.zeros(n, dtype=bool)
    tries = np.arange(1, 65, dtype=np.uint64)
    for g in np.argsort(-sizes, kind="stable"):
        if sizes[g] <= 1:
            break
        own, first = keys[order[ends[g] : ends[g + 1]]], 0
        while True:
            slots = (mix(own[None, :], (tries + np.uint64(first))[:, None]) % np.uint64(n)).astype(np.int64)
            ranked = np.sort(slots, axis=1)
            good = ~used[slots].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                k = int(good.argmax())
                seeds[g] = first + k + 1
                used[slots[k]] = True
                break
            first += len(tries)
            if first > 1 << 24:
                raise ValueError("two keys have the same 64-bit hash")
    seeds[sizes == 1] = -np.flatnonzero(~used)[: (sizes == 1).sum()] - 1
    return seeds.astype("<i4")


def mph_slots(seeds: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key; keys outside the set get an arbitrary slot."""
    seed = seeds[(mix(keys, 0) % np.uint64(len(seeds))).astype(np.int64)].astype(np.int64)
    there = (mix(keys, np.maximum(seed, 0).astype(np.uint64)) % np.uint64(n)).astype(np.int64)
    return np.where(seed < 0, -seed - 1, there)


def _key_columns(key: str, copy):
    """The key's 64-bit hash and its independent 32-bit fingerprint."""
    text = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null"))
    return F.xxhash64(text, copy), F.crc32(F.concat(text, F.lit("/"), copy.cast("string"))).cast("long")


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> TokenStore:
    """Encode every document, append ``end_id`` and write shards, rows and index.

    ``width`` is the bytes of a stored id (2 or 4); a tokenizer with larger ids is refused.
    """
    spark = docs.sparkSession
    if max(largest_id(tokenizer_path), end_id) >= 1 << 8 * width:
        raise ValueError(f"the tokenizer has ids that {width} bytes do not hold; choose width=4")
    path = shared_dir(spark)
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root)
    end, kind = end_id.to_bytes(4, "little"), f"<u{width}"
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("nth", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, place, nth, final = task.partitionId(), 0, 0, ""
        out, fs, made = None, None, []
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, ids in encode_in_small_batches(tokenizer_path, batch.column(1)):
                if out is None:
                    fs, root = pafs.FileSystem.from_uri(path)
                    final = f"{root}/shard-{shard:06d}.bin"
                    out = fs.open_output_stream(f"{final}.{task.taskAttemptId()}")
                ids = np.frombuffer(ids + end, dtype="<u4").astype(kind)
                out.write(ids.tobytes())
                made.append((keys[i], shard, place, len(ids), nth))
                place, nth = place + len(ids), nth + 1
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], schema=schema)
                made = []
        if out is not None:
            out.close()
            fs.move(f"{final}.{task.taskAttemptId()}", final)  # a retried task writes the same bytes again

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "tie", "input"]
    dealt = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .withColumns({"tie": F.xxhash64("text"), "input": F.monotonically_increasing_id()})
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
    )
    stored = materialize(in_arrow(dealt.select("doc_id", "text"), write, "doc_id long, shard long, place long, n long, nth long", keeps=True))
    totals = stored.groupBy("shard").agg(F.sum("n").alias("ids"), F.count("*").alias("docs"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    shards = materialize(totals.select("shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("first_id"), F.coalesce(F.sum("docs").over(earlier), F.lit(0)).alias("first_doc")))
    placed = stored.join(shards, "shard").withColumns({"start": F.col("first_id") + F.col("place"), "ordinal": F.col("first_doc") + F.col("nth")})
    repeated = materialize(placed.groupBy(F.col("doc_id").alias("key")).agg(F.min("ordinal").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    rows = placed.join(repeated, F.col("doc_id").eqNullSafe(F.col("key")), "left").withColumn("copy", F.coalesce(F.col("ordinal") - F.col("first"), F.lit(0)))
    rows.select("doc_id", "copy", "shard", "place", "n", "start").write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    buckets = max(1, -(-rows.count() // BUCKET_KEYS))
    store = TokenStore(path, width, buckets)
    hashed, fingerprint = _key_columns("doc_id", F.col("copy"))
    keyed = rows.select("shard", "place", "n", hashed.alias("key"), fingerprint.alias("fingerprint")).withColumn("bucket", F.pmod("key", F.lit(buckets)))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        keys = part["key"].to_numpy().astype(np.int64).view(np.uint64)
        seeds = build_mph(keys)
        slots = np.empty(len(part), dtype=_SLOT)
        at = mph_slots(seeds, keys, len(keys))
        for name in _SLOT.names:
            slots[name][at] = part[name].to_numpy()
        return pd.DataFrame({"bucket": [part["bucket"].iloc[0]], "n": [len(part)], "displacements": [seeds.tobytes()], "slots": [slots.tobytes()]})

    index = keyed.groupBy("bucket").applyInPandas(build, "bucket long, n long, displacements binary, slots binary")
    index.write.parquet(f"{path}/index")
    return store


def lookup(store: TokenStore, keys: DataFrame, key: str = "doc_id", copy: str | None = None) -> DataFrame:
    """Where each key's ids lie, by the index alone: ``key, copy, shard, place, n``.

    Keys that are not stored are left out (but for a fingerprint that agrees by chance,
    one in 2**32).
    """
    spark = keys.sparkSession
    which = F.col(copy).cast("long") if copy else F.lit(0).cast("long")
    hashed, fingerprint = _key_columns(key, which)
    asked = keys.select(F.col(key).cast("long").alias("doc_id"), which.alias("copy"), hashed.alias("key"), fingerprint.alias("fingerprint")).withColumn("bucket", F.pmod("key", F.lit(store.buckets)))

    def find(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or index.empty:
            return pd.DataFrame({"doc_id": [], "copy": [], "shard": [], "place": [], "n": []})
        row = index.iloc[0]
        slots = np.frombuffer(row["slots"], dtype=_SLOT)
        at = mph_slots(np.frombuffer(row["displacements"], dtype="<i4"), asked["key"].to_numpy().astype(np.int64).view(np.uint64), len(slots))
        hit = slots["fingerprint"][at] == asked["fingerprint"].to_numpy()
        found = slots[at[hit]]
        return pd.DataFrame({"doc_id": asked["doc_id"][hit].to_numpy(), "copy": asked["copy"][hit].to_numpy(), **{c: found[c].astype(np.int64) for c in ("shard", "place", "n")}})

    return (
        asked.groupBy("bucket")
        .cogroup(store.index(spark).groupBy("bucket"))
        .applyInPandas(find, "doc_id long, copy long, shard long, place long, n long")
    )


def read_ids(store: TokenStore, places: DataFrame) -> DataFrame:
    """Add ``ids`` (little-endian unsigned 32-bit) to located rows, read from the shards."""
    path, width = store.path, store.width
    names = places.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        opened, file = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = []
                for shard, place, n in zip(*(part.column(c).to_pylist() for c in ("shard", "place", "n")), strict=True):
                    if shard != opened:
                        if file is not None:
                            file.close()
                        opened, file = shard, fs.open_input_file(f"{root}/shard-{shard:06d}.bin")
                    raw = file.read_at(n * width, place * width)
                    ids.append(np.frombuffer(raw, dtype=f"<u{width}").astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], names=[*names, "ids"])

    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = places.repartitionByRange(parts, "shard", "place").sortWithinPartitions("shard", "place")
    return in_arrow(near, read, StructType([*near.schema.fields, StructField("ids", BinaryType())]))
