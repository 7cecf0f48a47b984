"""Byte-level BPE from a file of ranks: whole pre-tokens by a perfect hash, the rest by a heap.

A pattern cuts a text into pre-tokens. First tier: a minimal perfect hash over the
vocabulary's byte strings gives each pre-token one slot; if the slot's string is the
pre-token, its rank is the id. Second tier: any other pre-token starts as single bytes in a
doubly linked list, with a heap of the neighbouring pairs that have a rank. The pair of least
rank, the leftmost of equals, is joined until no pair has one, in ``m log m`` steps for m bytes.
The result is that of joining by rank over the whole string at every step, as the public
library for such files does.

Rows are encoded and decoded by themselves in tasks; nothing is shuffled. The driver builds the
hash once (a number for four strings of the vocabulary, sent with the tasks); a worker reads
the file once and keeps the ids of a bounded number of second-tier pre-tokens; forgetting them
costs time only. The file must be at the same path on all workers.

Contract: a null text is the empty text, which has no ids; no special tokens are made, their
strings are ordinary text. Keys may be null or repeat; each row is encoded by itself. A null
list of ids decodes to no bytes; an id that is not in the file raises an error. An empty table
gives an empty one. Of the input, only key and text are read, so other columns' names cannot
clash. Very long texts, and pre-tokens of any length, are encoded whole.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import in_arrow, per_worker
from .tokenstore import build_mph, mph_slots

#: Second-tier pre-tokens whose ids a worker keeps, and as many of the generation before; what one part
#: of the texts adds comes on top.
KEPT = 300_000
#: Longer pre-tokens are not kept, so the kept ones' memory is bounded.
KEPT_CHARS = 64
#: Characters, or ids, that are worked on at once (or one whole text).
PART = 4_000_000
#: Bits of an id: two ids are one integer.
_SHIFT = 31


def vocabulary(path: str) -> dict[bytes, int]:
    """Byte string -> rank, from a file with base64 of the bytes, a space and the rank in each line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    found = {base64.b64decode(a): int(b) for a, b in pairs}
    if len(found) != len(pairs) or len(set(found.values())) != len(pairs):
        raise ValueError("a vocabulary must name each string and each rank once")
    if any(bytes([i]) not in found for i in range(256)):
        raise ValueError("a vocabulary must hold every single byte")
    return found


def _keys(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64)


def perfect_hash(path: str) -> bytes:
    """The displacements of the minimal perfect hash over a file's strings."""
    return build_mph(_keys(vocabulary(path))).tobytes()


class Encoder:
    """Both tiers over a file of ranks; ids are 32-bit integers, packed as little-endian bytes."""

    def __init__(self, path: str, seeds: bytes):
        of = vocabulary(path)
        self.seeds = np.frombuffer(seeds, dtype="<i4")
        keys = _keys(of)
        slots = mph_slots(self.seeds, keys, len(of))
        self.words: list[bytes] = [b""] * len(of)
        self.ranks = np.zeros(len(of), dtype="<i4")
        for slot, (word, rank) in zip(slots.tolist(), of.items(), strict=True):
            self.words[slot], self.ranks[slot] = word, rank
        self.single = np.array([of[bytes([i])] for i in range(256)], dtype=np.int64)
        #: (left id, right id) in one integer -> the id of the two joined.
        self.joined: dict[int, int] = {}
        for word, rank in of.items():
            for cut in range(1, len(word)):
                left = of.get(word[:cut])
                right = of.get(word[cut:]) if left is not None else None
                if right is not None:
                    self.joined[left << _SHIFT | right] = rank
        #: The same for two bytes.
        self.pairs = np.array([[of.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)], dtype=np.int64)
        #: The linked list of a string of n bytes, before any are joined.
        self.after = [list(range(1, n + 1)) for n in range(KEPT_CHARS)]
        self.before = [list(range(-1, n - 1)) for n in range(KEPT_CHARS)]
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First tier: whether the vocabulary holds each string, and the rank that its slot names."""
        slots = mph_slots(self.seeds, _keys(words), len(self.words))
        own = map(self.words.__getitem__, slots.tolist())
        hit = np.fromiter(map(bytes.__eq__, own, words), dtype=bool, count=len(words))
        return hit, self.ranks[slots]

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Second tier: the ids of each string, from its bytes and a heap of their pairs' ranks."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        bits = int(sizes.max()).bit_length()
        ranks = np.append(self.pairs[raw[:-1], raw[1:]], -1)  # of each byte and the next
        ranks[ends[sizes > 0] - 1] = -1
        places = np.arange(len(raw)) - np.repeat(ends - sizes, sizes)
        queued = np.where(ranks >= 0, ranks << bits | places, -1).tolist()
        ids, ranks, made, start = self.single[raw].tolist(), ranks.tolist(), [], 0
        for end in ends.tolist():
            made.append(self._join(ids[start:end], ranks[start:end], [x for x in queued[start:end] if x >= 0], bits))
            start = end
        return made

    def _join(self, ids: list[int], rank_at: list[int], heap: list[int], bits: int) -> bytes:
        """Joins the pair of least rank, the leftmost of equals, until no pair has one.

        ``rank_at`` has the rank of each place's pair (-1: none), ``heap`` ranks with their places.
        """
        n, joined, mask = len(ids), self.joined.get, (1 << bits) - 1
        after, before = (self.after[n][:], self.before[n][:]) if n < len(self.after) else (list(range(1, n + 1)), list(range(-1, n - 1)))
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, rank = top & mask, top >> bits
            if rank_at[i] != rank:  # one of the two was joined meanwhile
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], rank_at[j], r = rank, -1, -1
            if k < n:
                before[k] = i
                if (r := joined(rank << _SHIFT | ids[k], -1)) >= 0:
                    heappush(heap, r << bits | i)
            rank_at[i] = r
            h = before[i]
            if h >= 0:
                rank_at[h] = r = joined(ids[h] << _SHIFT | rank, -1)
                if r >= 0:
                    heappush(heap, r << bits | h)
        left, i = array("i"), 0
        while i < n:
            left.append(ids[i])
            i = after[i]
        return left.tobytes()

    def _tiers(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct pre-tokens; those of the second tier are remembered."""
        raw = [x.encode() for x in words]
        hit, ranks = self.whole(raw)
        packed, missed = ranks.tobytes(), np.flatnonzero(~hit).tolist()
        ids = {words[i]: packed[4 * i : 4 * i + 4] for i in np.flatnonzero(hit).tolist()}
        made = dict(zip(map(words.__getitem__, missed), self.merged(list(map(raw.__getitem__, missed))), strict=True))
        self._keep({x: found for x, found in made.items() if len(x) <= KEPT_CHARS})
        return ids | made

    def _keep(self, ids: dict[str, bytes]) -> None:
        if len(self.recent) > KEPT:
            self.older, self.recent = self.recent, {}
        self.recent.update(ids)

    def encode(self, texts: list[str], pattern: regex.Pattern) -> list[bytes]:
        """The ids of each text; each distinct pre-token of the texts is looked up once."""
        cut = [pattern.findall(text) for text in texts]
        new, ids = set().union(*cut), {}
        for known in (self.recent, self.older):
            own = {x: known[x] for x in new & known.keys()}
            if known is self.older:
                self._keep(own)
            ids |= own
            new -= own.keys()
        ids |= self._tiers(list(new))
        return [b"".join(map(ids.__getitem__, words)) for words in cut]


class Decoder:
    """The byte string of each id of a file of ranks."""

    def __init__(self, path: str):
        self.words = {rank: word for word, rank in vocabulary(path).items()}

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.words.__getitem__, ids.tolist()))


def _in_parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows whose sizes add up to at most ``PART``, or of one row."""
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and total + size > PART:
            yield first, i
            first, total = i, 0
        total += size
    if len(sizes):
        yield first, len(sizes)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of integers): every whole text's ids."""
    seeds = perfect_hash(ranks_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cutter = per_worker(("ranks", ranks_path), lambda: Encoder(ranks_path, seeds)), regex.compile(pattern)
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column(1)))
            for first, end in _in_parts(sizes):
                found = own.encode(batch.column(1).slice(first, end - first).to_pylist(), cutter)
                ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), dtype="<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), ids], names=["doc_id", "ids"])

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")), work, "doc_id long, ids array<int>", keeps=True)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", to: str = "bytes") -> DataFrame:
    """Add the bytes that the ids stand for as column ``to``."""
    names = encoded.columns
    if to in names:
        raise ValueError(f"there is a column {to} already")
    at = names.index(ids_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = per_worker(("words", ranks_path), lambda: Decoder(ranks_path))
        for batch in batches:
            sizes = np.asarray(batch.column(at).value_lengths().fill_null(0))
            for first, end in _in_parts(sizes):
                part = batch.slice(first, end - first)
                ids, ends = np.asarray(part.column(at).flatten()), np.cumsum(sizes[first:end])
                made = [own.decode(x) for x in np.split(ids, ends[:-1])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=[*names, to])

    return in_arrow(encoded, work, StructType([*encoded.schema.fields, StructField(to, BinaryType())]), keeps=True)
