"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. A shingle is five words. Its weight in a document is its count times its inverse document
   frequency, ``1 + min(ln(N / df), L) / L`` with ``L = ln(1 / RARE)``, in steps of 1 / 65535:
   shingles in less than one of ten thousand documents are all equally rare, so a pair's
   similarity does not depend on the size of the corpus. df is counted exactly over all
   documents for every shingle that may be less rare: a first pass counts shingles in slots of a
   fixed number, a second one counts those in slots that are full enough. At most
   ``shingles of a document / RARE`` of them exist, and they lie in sorted files in the shared
   folder, which workers map.
2. Texts with equal word sequences are one node. Each node draws ``bands * rows`` consistent
   weighted samples; two nodes meet in a band if all its rows agree, which happens in some
   band with a probability of 99.8 % at a weighted Jaccard similarity of 0.8.
3. Only nodes that share a bucket get their shingles written, by another pass over the texts.
   In two rounds each band's bucket has one, then a few centres, which are compared with its
   members outside their component; this joins nearly all there is to join. Then, in buckets
   that still hold several components, members outside the largest one are held against all
   others, block by block inside tasks: pairs of different components that agree in
   ``SKETCH_AGREES`` of their samples (sketches of one byte each) are candidates, and only
   links come out. All candidates are verified by the exact weighted Jaccard similarity of
   the whole shingle multisets, so every pair of a bucket is tested, estimated as too far
   apart, or connected.
4. A class is a connected component of links. The result is written, and all intermediate
   tables are removed.

Contract: null texts and texts without words are each a class of their own; texts of one to
four words have one shingle; repeated rows are members of one class; class ids are the
smallest doc_id of the class (nulls only if all are null); very long texts are worked on whole,
one at a time; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lm, vectors
from .common import discard, in_arrow, materialize, remove, shared_dir
from .shingles import chunks, content_keys, mix, shingle_sets, word_hashes

#: Keys in one file of document frequencies.
DF_PART = 4_000_000
#: Share of documents below which all shingles are equally rare.
RARE = 1e-4
#: Slots of the first count of shingles. The more shingles a document has, the more slots are full
#: enough to be counted exactly; the result does not depend on it.
DF_SLOTS = 1 << 22
#: An element's low bits hold its weight above 1, in these steps.
STEPS = (1 << 16) - 1
#: Slots of the filter of documents to verify.
FILTER_SLOTS = 1 << 22
#: Share of samples that a pair agrees in to be verified: 4.5 deviations below 0.8 for 80 samples.
SKETCH_AGREES = 0.6
#: Equal texts that a task recognises: only the first is sampled. What is forgotten costs time only.
SEEN_TEXTS = 100_000
#: Members of a bucket that meet in one task.
BLOCK = 512
_GRAIN = 1 << 16
SIGNED = "row long, doc_id long, k1 long, k2 long, bands array<long>, sketch binary"


def lower_bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def batches_of(texts: pa.Array, size: int = 400_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, word counts) for about ``size`` bytes at a time."""
    for at in range(0, len(texts), 1000):
        data = [lower_bytes(t) for t in texts.slice(at, 1000).to_pylist()]
        for start, end in chunks(data, size):
            yield at + start, *word_hashes(data[start:end])


@dataclass
class Frequencies:
    """Number of documents, and exact document frequencies from ``least`` on, in mapped files."""

    path: str
    n_docs: int
    least: int
    firsts: tuple[int, ...]
    parts: dict = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "parts": {}}

    def of(self, values: np.ndarray) -> np.ndarray:
        """Each shingle's frequency; 1 for those below ``least``."""
        unique, back = np.unique(values.view(np.int64), return_inverse=True)
        found = np.ones(len(unique), dtype=np.int64)
        part = np.searchsorted(np.array(self.firsts, dtype=np.int64), unique, side="right") - 1
        for p in np.unique(part[part >= 0]).tolist():
            if p not in self.parts:
                self.parts[p] = lm.map_arrays(self.path, f"df-{p:06d}")
            stored, at = self.parts[p], np.flatnonzero(part == p)
            place = np.minimum(np.searchsorted(stored["key"], unique[at]), len(stored["key"]) - 1)
            found[at] = np.where(stored["key"][place] == unique[at], stored["n"][place], 1)
        return found[back]

    def steps(self, values: np.ndarray) -> np.ndarray:
        """Each shingle's inverse document frequency above 1, in ``STEPS``."""
        rarity = np.log(self.n_docs / self.of(values)).clip(0, -math.log(RARE)) / -math.log(RARE)
        return np.rint(rarity * STEPS).astype(np.uint64)


def slot_of(values: np.ndarray, slots: int) -> np.ndarray:
    return (mix(values) & np.uint64(slots - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame, width: int) -> Frequencies:
    """In how many documents a shingle is, for all that are in ``RARE`` of the documents, and in two at least."""
    texts = docs.select("text")

    def fill(batches: Iterator[pa.RecordBatch], totals: np.ndarray) -> None:
        for b in batches:
            totals[DF_SLOTS] += b.num_rows
            for _, hashes, counts in batches_of(b.column(0)):
                _, value, nth = shingle_sets(hashes, counts, width)
                np.add.at(totals, slot_of(value[nth == 0], DF_SLOTS), 1)

    totals = vectors.total(texts, DF_SLOTS + 1, fill)
    n_docs = int(totals[DF_SLOTS])
    least = max(2, math.ceil(RARE * n_docs))
    spark = docs.sparkSession
    full = spark.sparkContext.broadcast(np.packbits(totals[:DF_SLOTS] >= least))  # DF_SLOTS / 8 bytes
    path = shared_dir(spark)
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root)

    def often(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        _, value, nth = shingle_sets(hashes, counts, width)
        value = value[nth == 0]
        slot = slot_of(value, DF_SLOTS)
        return value[full.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1 == 1]

    def write(part: int, keys: np.ndarray, counts: np.ndarray) -> None:
        lm.write_arrays(path, f"df-{part:06d}", {"key": keys.astype("<i8"), "n": counts.astype("<i8")})

    common = lm.counted(texts, often, least, batches_of)
    level = lm.write_parts(common, max(1, -(-common.count() // DF_PART)), write)
    discard(common)
    return Frequencies(path, n_docs, least, level.firsts)


def weights_of(elements: np.ndarray) -> np.ndarray:
    return 1 + (elements & np.uint64(STEPS)) / STEPS


class Sampler:
    """Consistent weighted samples of many weighted sets at once.

    Gamma(2, 1) draws come from tables of quantiles, indexed by a hash of element and sample.
    The least ``ln a`` names both the chosen element and its level, so it is the sample.
    """

    def __init__(self, samples: int):
        grid = (np.arange(_GRAIN) + 0.5) / _GRAIN
        low, high = np.zeros(_GRAIN), np.full(_GRAIN, 40.0)
        for _ in range(60):  # quantiles of Gamma(2, 1): 1 - (1 + x) exp(-x)
            mid = (low + high) / 2
            below = 1 - (1 + mid) * np.exp(-mid) < grid
            low, high = np.where(below, mid, low), np.where(below, high, mid)
        self.gamma, self.log_gamma = low, np.log(low)
        self.seeds = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def sample(self, elements: np.ndarray, log_weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row of samples (64-bit) for each set; ``starts`` are the sets' first elements."""
        out = np.empty((len(starts), len(self.seeds)), dtype=np.int64)
        low = np.uint64(_GRAIN - 1)
        for k, seed in enumerate(self.seeds):
            h = (elements ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x94D049BB133111EB)
            r = self.gamma[(h >> np.uint64(16)) & low]
            beta = ((h >> np.uint64(32)) & low) * (1.0 / _GRAIN)
            level = np.floor(log_weights / r + beta)
            level -= beta
            level += 1
            level *= r
            out[:, k] = np.minimum.reduceat(self.log_gamma[h >> np.uint64(48)] - level, starts).view(np.int64)
        return out


class Fresh:
    """Tells the first of equal texts, as far as it remembers."""

    def __init__(self):
        self.seen: set[int] = set()

    def of(self, keys: np.ndarray, wanted: np.ndarray) -> list[int]:
        out = []
        for i in np.flatnonzero(wanted).tolist():
            key = int(keys[0, i]) << 64 | int(keys[1, i])
            if key not in self.seen:
                out.append(i)
                if len(self.seen) < SEEN_TEXTS:
                    self.seen.add(key)
        return out


def elements(frequencies: Frequencies, hashes: np.ndarray, counts: np.ndarray, chosen: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element, steps, starts, ends) of the chosen texts: an element for each shingle occurrence."""
    mask = np.zeros(len(counts), dtype=bool)
    mask[chosen] = True
    owner, value, nth = shingle_sets(hashes[np.repeat(mask, counts)], np.where(mask, counts, 0), width)
    element = np.where(nth > 0, mix(value + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), value)
    starts = np.searchsorted(owner, chosen)
    return element, frequencies.steps(value), starts, np.append(starts[1:], len(value))


def sign(docs: DataFrame, frequencies: Frequencies, width: int, bands: int, rows: int) -> DataFrame:
    """Content keys and band values of all documents.

    Only the first of equal texts in a partition is sampled; the others' ``bands`` are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, first_ones = Sampler(bands * rows), Fresh()
        band_seeds = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for b in batches:
            for first, hashes, counts in batches_of(b.column(2)):
                n, keys = len(counts), content_keys(hashes, counts)
                fresh = first_ones.of(keys, counts > 0)
                chosen: list = [None] * n
                sketches: list = [None] * n
                if fresh:
                    element, steps, starts, _ = elements(frequencies, hashes, counts, fresh, width)
                    samples = sampler.sample(element, np.log(1 + steps / STEPS), starts).view(np.uint64)
                    grouped = np.zeros((len(fresh), bands), dtype=np.uint64)
                    for j in range(rows):
                        grouped = mix(grouped + samples[:, j::rows])
                    grouped = mix(grouped ^ band_seeds).view(np.int64)
                    short = (mix(samples) >> np.uint64(56)).astype(np.uint8)
                    for i, g, x in zip(fresh, grouped, short, strict=True):
                        chosen[i], sketches[i] = g, x.tobytes()
                signed, none = keys.view(np.int64), counts == 0
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, n), b.column(1).slice(first, n), pa.array(signed[0], pa.int64(), mask=none), pa.array(signed[1], pa.int64(), mask=none),
                     pa.array(chosen, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    names=["row", "doc_id", "k1", "k2", "bands", "sketch"])

    return in_arrow(docs.select("row", "doc_id", "text"), run, SIGNED)


def shingles_of(docs: DataFrame, nodes: DataFrame, frequencies: Frequencies, width: int) -> DataFrame:
    """(row, sketch, elements) of the nodes (k1, k2, row, sketch), from the texts.

    ``elements`` are sorted 64-bit values, one per shingle occurrence: 48 bits of its hash
    and 16 of its weight.
    """
    wanted = key_filter(nodes.select("k1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_ones = Fresh()
        for b in batches:
            for _, hashes, counts in batches_of(b.column(0)):
                keys = content_keys(hashes, counts)
                fresh = first_ones.of(keys, (counts > 0) & wanted.value[slot_of(keys[0], FILTER_SLOTS)])
                if fresh:
                    element, steps, starts, ends = elements(frequencies, hashes, counts, fresh, width)
                    weighted = (element & ~np.uint64(STEPS)) | steps
                    made = [np.unique(weighted[s:e]).astype("<u8").tobytes() for s, e in zip(starts, ends, strict=True)]
                    k1, k2 = keys[:, fresh].view(np.int64)
                    yield pa.RecordBatch.from_pydict({"k1": k1, "k2": k2, "elements": pa.array(made, pa.binary())})

    made = in_arrow(docs.select("text"), run, "k1 long, k2 long, elements binary")
    # Equal texts of several partitions: of each, one stays.
    return nodes.join(made.groupBy("k1", "k2").agg(F.first("elements").alias("elements")), ["k1", "k2"]).select("row", "sketch", "elements")


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted element sets."""
    both = weights_of(np.intersect1d(a, b, assume_unique=True)).sum()
    return float(both / (weights_of(a).sum() + weights_of(b).sum() - both))


def key_filter(keys: DataFrame):
    """A broadcast array of ``FILTER_SLOTS`` marks: which slots hold any of the keys, in any column."""

    def mark(batches: Iterator[pa.RecordBatch], slots: np.ndarray) -> None:
        for x in batches:
            for c in x.columns:
                slots[slot_of(c.to_numpy().view(np.uint64), FILTER_SLOTS)] = 1

    return keys.sparkSession.sparkContext.broadcast(vectors.total(keys, FILTER_SLOTS, mark) > 0)  # fixed size


def among(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """The stored nodes whose number is in any column of ``rows``, and a few that share a filter slot with one."""
    wanted = key_filter(rows)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield x.filter(pa.array(wanted.value[slot_of(x.column(0).to_numpy().view(np.uint64), FILTER_SLOTS)]))

    return in_arrow(stored, needed, stored.schema)


def verify(pairs: DataFrame, needed: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the threshold; ``needed`` holds their elements."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (batch.slice(at, 1000) for batch in batches for at in range(0, batch.num_rows, 1000)):
            one, two = x.column(2).to_pylist(), x.column(3).to_pylist()
            good = [weighted_jaccard(np.frombuffer(p, dtype="<u8"), np.frombuffer(q, dtype="<u8")) >= threshold - 1e-9 for p, q in zip(one, two, strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = pairs.join(needed.select(F.col("row").alias("a"), F.col("elements").alias("one")), "a")
    both = first.join(needed.select(F.col("row").alias("b"), F.col("elements").alias("two")), "b")
    return in_arrow(both.select("a", "b", "one", "two"), check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(row, old, comp): each linked row's smallest connected row, by label spreading and pointer jumps."""
    edges = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    labels = materialize(edges.groupBy(F.col("a").alias("row")).agg(F.lit(-1).cast("long").alias("old"), F.least(F.col("a"), F.min("b")).alias("comp")))
    while not labels.where("comp <> old").isEmpty():
        known = labels.select("row", "comp")
        near = edges.join(known.withColumnRenamed("row", "b"), "b").groupBy(F.col("a").alias("row")).agg(F.min("comp").alias("near"))
        spread = known.join(near, "row").select("row", F.col("comp").alias("old"), F.least("comp", "near").alias("to"))
        jump = known.select(F.col("row").alias("to"), F.col("comp").alias("next"))
        moved = materialize(spread.join(jump, "to").select("row", "old", F.least("to", "next").alias("comp")))
        discard(labels)
        labels = moved
    return labels


def with_components(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(band, row, comp) of buckets that hold more than one component."""
    if labels is None:
        return members.withColumn("comp", F.col("row"))
    here = members.join(labels.select("row", "comp"), "row", "left").withColumn("comp", F.coalesce("comp", "row"))
    split = here.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band")
    return here.join(split, "band")


def missing_links(here: DataFrame, stored: DataFrame, threshold: float) -> DataFrame:
    """(a, b): verified links between a bucket's components, as many as connect them.

    Members outside the bucket's largest component meet all members, in pairs of blocks.
    """
    sizes = here.groupBy("band", "comp").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("band").agg(F.sum("n").alias("m"), F.max(F.struct("n", "comp")).alias("big"))
    buckets = buckets.select("band", F.col("big.comp").alias("big"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("m") - F.col("big.n")) / BLOCK).cast("int").alias("outer"))
    rows = materialize(here.join(buckets, "band").join(among(stored, here.select("row")), "row"))
    block = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inner = rows.select("band", block("blocks").alias("i"), upto("outer").alias("j"), "row", "comp", "sketch", "elements", F.lit(False).alias("out"))
    outer = rows.where("comp <> big").select("band", upto("blocks").alias("i"), block("outer").alias("j"), "row", "comp", "sketch", "elements", F.lit(True).alias("out"))

    def compare(group: pa.Table) -> pa.Table:
        out, row, comp = (group[c].to_numpy() for c in ("out", "row", "comp"))
        comp = comp.copy()
        sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), dtype=np.uint8).reshape(len(row), -1)
        sets = [np.frombuffer(x, dtype="<u8") for x in group["elements"].to_pylist()]
        total = np.array([weights_of(x).sum() for x in sets])
        least = SKETCH_AGREES * sketch.shape[1]
        every, found = np.flatnonzero(~out), []
        for k in np.flatnonzero(out):
            near = every[comp[every] != comp[k]]
            near = near[(sketch[near] == sketch[k]).sum(axis=1) >= least]
            if not len(near):
                continue
            both = np.concatenate([sets[c] for c in near])
            owner = np.repeat(np.arange(len(near)), [len(sets[c]) for c in near])
            at = np.minimum(np.searchsorted(sets[k], both), len(sets[k]) - 1)
            shared = np.bincount(owner, weights=np.where(sets[k][at] == both, weights_of(both), 0.0), minlength=len(near))
            for c in near[shared / (total[near] + total[k] - shared) >= threshold - 1e-9]:
                if comp[c] != comp[k]:
                    found.append((min(row[c], row[k]), max(row[c], row[k])))
                    comp[comp == comp[c]] = comp[k]
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    made = materialize(inner.union(outer).groupBy("band", "i", "j").applyInArrow(compare, "a long, b long").distinct())
    discard(rows)
    return made


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = 16, rows: int = 5, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, centres: int = 3) -> DataFrame:
    """``doc_id, class_id, linked, row, comp`` for every row of ``docs``.

    ``linked`` is true if the row's text is linked to a different text; ``row`` is a number
    of each row (``row_col`` if given, which must be distinct) and ``comp`` the class's
    smallest such number among its nodes, which also tells classes without a doc_id apart.
    """
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    own = docs.select(number.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    frequencies = document_frequencies(own, width)
    signed = materialize(sign(own, frequencies, width, bands, rows))

    # One node for each word sequence: its first sampled row.
    sampled = F.when(F.col("bands").isNotNull(), F.struct("row", "sketch", "bands"))
    nodes = materialize(signed.where("k1 is not null").groupBy("k1", "k2").agg(F.min(sampled).alias("first")).select("k1", "k2", "first.*"))
    values = materialize(nodes.select("row", F.explode("bands").alias("band")))
    shared = values.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = materialize(values.join(shared, "band"))
    discard(values)
    meeting = members.select("row").distinct()
    stored = materialize(shingles_of(own, nodes.select("k1", "k2", "row", "sketch").join(meeting, "row", "left_semi"), frequencies, width))

    links = labels = None
    found, passed = [], []
    for turn in range(3):
        here = with_components(members, labels)
        if labels is not None:
            here = materialize(here)
            passed.append(here)
            discard(labels)
        if turn == 2:
            new = missing_links(here, stored, threshold)
        else:
            # First one centre, the same in as many bands as can be; then a few, in each band others.
            if turn == 0:
                chosen = here.groupBy("band").agg(F.min("row").alias("centre")).withColumn("own", F.col("centre"))
            else:
                order = Window.partitionBy("band").orderBy(F.xxhash64("band", "row"))
                chosen = here.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= centres).select("band", F.col("row").alias("centre"), F.col("comp").alias("own"))
            pairs = here.join(chosen, "band").where("comp <> own").select(F.least("row", "centre").alias("a"), F.greatest("row", "centre").alias("b"))
            pairs = materialize(pairs.distinct())
            passed.append(pairs)
            sets = stored.select("row", "elements")
            new = materialize(verify(pairs, among(sets, pairs.select("a", "b")) if turn else sets, threshold).distinct())
        found.append(new)
        links = found[-1] if links is None else links.union(found[-1])
        labels = components(links)
    discard(members, stored, *passed, *found)
    done = classes(signed, nodes.select("k1", "k2", F.col("row").alias("node")), labels)
    discard(signed, nodes, labels)
    remove(own.sparkSession, frequencies.path)
    return done


def classes(signed: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row's class: its node's component, named by the smallest doc_id."""
    comp = nodes.join(labels.select(F.col("row").alias("node"), "comp"), "node", "left").select("k1", "k2", F.coalesce("comp", "node").alias("comp"), F.col("comp").isNotNull().alias("linked"))
    # Rows without words have no key: each is its own class, and they do not meet in a join.
    none = signed.where("k1 is null").select("row", "doc_id", F.col("row").alias("comp"), F.lit(False).alias("linked"))
    by_key = signed.where("k1 is not null").select("row", "doc_id", "k1", "k2").join(comp, ["k1", "k2"]).select("row", "doc_id", "comp", "linked").union(none)
    by_key = materialize(by_key)
    # Written before the join, so that a giant class is split over tasks.
    names = materialize(by_key.groupBy("comp").agg(F.min("doc_id").alias("class_id")))
    done = materialize(by_key.join(names, "comp").select("doc_id", "class_id", "linked", "row", "comp"))
    discard(by_key, names)
    return done
