"""Language-model scores from an n-gram trie in Elias-Fano levels.

Counting: a pass over the training texts for each order. A key is (context node, word); only
n-grams whose both halves were kept in the level below are counted, and those seen at least
``min_count`` times are kept: this drops no n-gram that passes, since its halves are as
frequent. Partitions pre-aggregate and send sorted, delta-coded blocks dealt by a hash of the
whole key, so frequent contexts are spread.

Model: absolute discounting, interpolated down to the unigram estimate
``(c + 0.5) / (N + 0.5 (V + 1))``; what pruned n-grams held goes to the lower order.

Files: level 1 holds the words' hashes in order with their counts; a word's number is its
place. Level n holds, in parts of about ``part_nodes`` nodes in key order, each context's
pointer to its successors and the successors themselves as one Elias-Fano sequence of
(context - first context) * V + word, with probabilities and back-off weights quantised to
one byte. A query is the successor search of a word relative to its context. Tasks map the
files into memory from the shared folder (or from a copy that is unlinked at once where the
folder is not a local path).

Contract: null texts count as empty (one end token); rows that repeat count each; without
training texts every token's probability is 1; an empty table gives no rows.
"""

from __future__ import annotations

import json
import mmap
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialize, per_worker, shared_dir
from .eliasfano import EliasFano, encode
from .shingles import NOT_SPACE, chunks, mix, word_hashes

END = np.uint64(0x5851F42D4C957F2D)  # the end token's hash
FLUSH = 1_500_000  # keys that a task holds before it sends them
CHUNK = 500_000  # bytes of text that are worked on at once
SLICE = 250_000  # nodes that are worked on at once when a part is written
BUCKET_CHARS = 6_000_000  # characters of the texts whose keys are added up in one group
STEP, STEP_BACK = 0.04, 0.025  # of the quantised log10 values
WORD_BITS = np.uint64(32)
WORD_MASK = np.uint64((1 << 32) - 1)


def token_arrays(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hashes, counts): hashes with an end token after each text's words."""
    for at in range(0, len(texts), 1000):
        data = [(t or "").encode("utf-8", "replace").lower() for t in texts.slice(at, 1000).to_pylist()]
        for start, end in chunks(data, CHUNK):
            words, n = word_hashes(data[start:end], NOT_SPACE)
            yield at + start, np.insert(words, np.cumsum(n), END), n + 1


# --- counting ---------------------------------------------------------------


def pack_block(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as deltas and their counts, byte planes apart, compressed."""
    deltas = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = deltas.view(np.uint8).reshape(-1, 8).T.tobytes() + np.minimum(counts, 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), dtype=np.uint8)
    n = len(raw) // 12
    deltas = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(deltas, dtype=np.uint64), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def counted(texts: DataFrame, keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray], least: int, arrays: Callable = token_arrays) -> DataFrame:
    """(key, n) for all keys that ``keys_of(hashes, counts)`` gives at least ``least`` times.

    ``arrays`` yields the (first text, hashes, counts) of texts. Keys are dealt over as many
    buckets as the texts' length asks for, so that a bucket does not grow with the input.
    """
    chars = texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            bucket = (mix(keys) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, counts = keys[order], counts[order]
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(ends)):
                part = slice(ends[b], ends[b + 1])
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int64()), "block": [pack_block(keys[part], counts[part])]})

        for x in batches:
            for _, hashes, counts in arrays(x.column(0)):
                keys = keys_of(hashes, counts)
                held.append(keys)
                n += len(keys)
                if n > FLUSH:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def add(group: pa.Table) -> pa.Table:
        parts = [unpack_block(x.as_py()) for x in group["block"]]
        keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(counts, first)
        keep = sums >= least
        return pa.table({"key": keys[first][keep].view(np.int64), "n": sums[keep]})

    blocks = in_arrow(texts, send, "bucket long, block binary", keeps=True)
    return materialize(blocks.groupBy("bucket").applyInArrow(add, "key long, n long"))


# --- files ------------------------------------------------------------------


def write_arrays(uri: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays; a retried task writes the same bytes again."""
    fs, root = pafs.FileSystem.from_uri(uri)
    head, at, body = {}, 0, []
    for key, a in arrays.items():
        head[key] = (at, len(a), a.dtype.str)
        body.append(np.ascontiguousarray(a))
        at += a.nbytes + -a.nbytes % 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    own = f"{root}/{name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
    with fs.open_output_stream(own) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for a in body:
            out.write(pa.py_buffer(a))
            out.write(b"\0" * (-a.nbytes % 8))
    fs.move(own, f"{root}/{name}")


def map_arrays(uri: str, name: str) -> dict[str, np.ndarray]:
    """The file's arrays, mapped into memory."""
    fs, root = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(f"{root}/{name}", "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with fs.open_input_stream(f"{root}/{name}") as f, tempfile.TemporaryFile() as copy:
            while part := f.read(1 << 24):
                copy.write(part)
            copy.flush()
            data = mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(data[:8], "little")
    return {k: np.frombuffer(data, dtype=t, count=n, offset=8 + size + at) for k, (at, n, t) in json.loads(data[8 : 8 + size]).items()}


@dataclass(frozen=True)
class Level:
    """A level's parts: first key and first node of each, and the number of all nodes."""

    firsts: tuple[int, ...]
    bases: tuple[int, ...]
    nodes: int
    back: frozenset[int] = frozenset()  # parts with back-off weights


@dataclass(frozen=True)
class Model:
    """What tasks need to open the files; its size is that of the lists of parts."""

    path: str
    tokens: int  # N
    texts: int
    levels: tuple[Level, ...] = field(default=())
    begin_back: float = 0.0

    @property
    def words(self) -> int:  # V
        return self.levels[0].nodes if self.levels else 0


class Trie:
    """Queries on the mapped files."""

    def __init__(self, model: Model):
        self.model, self.files, self.sequences = model, {}, {}

    def file(self, kind: str, level: int, part: int) -> dict[str, np.ndarray]:
        name = f"{kind}{level}-{part:06d}"
        if name not in self.files:
            self.files[name] = map_arrays(self.model.path, name)
        return self.files[name]

    def sequence(self, level: int, part: int, prefix: str = "word") -> EliasFano:
        if (level, part, prefix) not in self.sequences:
            a = self.file("level", level, part)
            self.sequences[level, part, prefix] = EliasFano({k: a[f"{prefix}_{k}"] for k in ("high", "ones", "zeros", "low", "shape")})
        return self.sequences[level, part, prefix]

    def _by_part(self, of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if not len(of):
            return
        order = np.argsort(of, kind="stable")
        values, starts = np.unique(of[order], return_index=True)
        for p, at in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
            if p >= 0:
                yield p, at

    def part_of(self, level: int, nodes: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.model.levels[level - 1].bases, dtype=np.int64), nodes, side="right") - 1

    def field(self, level: int, nodes: np.ndarray, name: str, kind: str = "level") -> np.ndarray:
        """A stored field of each node; 0 where its part has no such file."""
        info = self.model.levels[level - 1]
        out = np.zeros(len(nodes), dtype=np.int64)
        for p, at in self._by_part(self.part_of(level, nodes)):
            if kind == "level" or p in info.back:
                out[at] = self.file(kind, level, p)[name][nodes[at] - info.bases[p]]
        return out

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words by their hashes; -1 for unknown ones."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        if not self.model.words:
            return out
        unique, back = np.unique(hashes.view(np.int64), return_inverse=True)
        found = np.full(len(unique), -1, dtype=np.int64)
        info = self.model.levels[0]
        for p, at in self._by_part(np.searchsorted(np.array(info.firsts), unique, side="right") - 1):
            stored = self.file("level", 1, p)["hash"]
            place = np.minimum(np.searchsorted(stored, unique[at]), len(stored) - 1)
            found[at] = np.where(stored[place] == unique[at], place + info.bases[p], -1)
        return found[back]

    def find(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Node of each (context node, word) by successor search; -1 if there is none."""
        info = self.model.levels[level - 1]
        known = np.flatnonzero((context >= 0) & (word >= 0)) if info.nodes else np.empty(0, dtype=np.int64)
        out = np.full(len(context), -1, dtype=np.int64)
        if not len(known):
            return out
        keys, back = np.unique(context[known].astype(np.uint64) << WORD_BITS | word[known].astype(np.uint64), return_inverse=True)
        found = np.full(len(keys), -1, dtype=np.int64)
        parts = np.searchsorted(np.array(info.firsts, dtype=np.uint64), keys, side="right") - 1
        for p, at in self._by_part(parts):
            low, n = self.file("level", level, p)["contexts"].tolist()
            c = (keys[at] >> WORD_BITS).astype(np.int64) - low
            inside = np.flatnonzero(c < n)
            x = c[inside] * self.model.words + (keys[at][inside] & WORD_MASK).astype(np.int64)
            place, same = self.sequence(level, p).successor(x)
            found[at[inside]] = np.where(same, place + info.bases[p], -1)
        out[known] = found[back]
        return out

    def last_words(self, level: int, nodes: np.ndarray) -> np.ndarray:
        info = self.model.levels[level - 1]
        out = np.empty(len(nodes), dtype=np.int64)
        for p, at in self._by_part(self.part_of(level, nodes)):
            out[at] = self.sequence(level, p).get(nodes[at] - info.bases[p]) % self.model.words
        return out

    def successors(self, level: int, context: int) -> np.ndarray:
        """Words that follow a context node of the level below, by its pointers."""
        out = []
        for p in range(len(self.model.levels[level - 1].firsts)):
            low, n = self.file("level", level, p)["contexts"].tolist()
            if low <= context < low + n:
                a, b = self.sequence(level, p, "pointer").get(np.array([context - low, context - low + 1]))
                out.append(self.sequence(level, p).get(np.arange(a, b)) % self.model.words)
        return np.concatenate(out) if out else np.empty(0, dtype=np.int64)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        m = self.model
        return np.log10((count + 0.5) / (m.tokens + 0.5 * (m.words + 1)))

    def backs(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """log10 back-off weights of context nodes; 0 for -1."""
        out = np.zeros(len(nodes))
        at = np.flatnonzero(nodes >= 0)
        own = nodes[at]
        values = np.zeros(len(own))
        real = np.flatnonzero(own < self.model.levels[level - 1].nodes)
        values[real] = -STEP_BACK * self.field(level, own[real], "back", "back")
        values[own == self.model.levels[level - 1].nodes] = self.model.begin_back  # the begin of a text
        out[at] = values
        return out

    def nodes(self, ids: np.ndarray, firsts: np.ndarray, order: int) -> list[np.ndarray]:
        """For each order from 1, the node of the n-gram that ends at each token."""
        found = [ids]
        for level in range(2, order + 1):
            before = np.concatenate([[-1], found[-1][:-1]])
            # The begin of a text is a context word of its own, numbered V; nothing reaches over it.
            before[firsts] = self.model.words if level == 2 else -1
            found.append(self.find(level, before, ids))
        return found


def opened(model: Model) -> Trie:
    """This worker's view of the model's files."""
    key = f"{model.path}/{len(model.levels)}/{[len(x.back) for x in model.levels]}"
    return per_worker(("trie", key), lambda: Trie(model))


# --- building ---------------------------------------------------------------


def write_parts(rows: DataFrame, parts: int, write: Callable[[int, np.ndarray, np.ndarray], None]) -> Level:
    """Deal (key, n) rows by key range, write a part file each, and list the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(0).to_numpy(), b.column(1).to_numpy()] for b in batches if b.num_rows]
        if got:
            part = TaskContext.get().partitionId()
            counts, keys = (np.concatenate([g.pop() for g in got]) for _ in range(2))  # batches go as they are put together
            write(part, keys, counts)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "first": pa.array([int(keys[0])], pa.int64()), "n": pa.array([len(keys)], pa.int64())})

    dealt = rows.select("key", "n").repartitionByRange(parts, "key").sortWithinPartitions("key")
    listed = sorted((r["part"], r["first"], r["n"]) for r in in_arrow(dealt, run, "part long, first long, n long", keeps=True).collect())
    size = max((x[0] for x in listed), default=-1) + 1
    sizes = dict((x[0], x[2]) for x in listed)
    # Parts that stayed empty (possible for few keys) take their successor's place.
    firsts, bases, at, names = [], [], 0, dict((x[0], x[1]) for x in listed)
    for p in range(size):
        later = next(names[i] for i in range(p, size) if i in names)
        firsts.append(later)
        bases.append(at)
        at += sizes.get(p, 0)
    return Level(tuple(firsts), tuple(bases), at)


def add_level(model: Model, kept: DataFrame, part_nodes: int, discount: float) -> Model:
    """Write the next level from its kept (key, n) rows, and the contexts' back-off weights."""
    path, level = model.path, len(model.levels) + 1
    below = model.levels[-1]
    n = kept.count()
    context = F.shiftrightunsigned("key", 32)
    stats = kept.groupBy(context.alias("context")).agg(F.sum("n").alias("s"), F.count("*").alias("k"))
    part = F.size(F.filter(F.lit(list(below.bases) or [0]), lambda b: b <= F.col("context"))) - 1
    begin = stats.where(F.col("context") == below.nodes).collect() if level == 2 else []
    held = model

    def log_back(s: np.ndarray, k: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.log10(np.maximum(1 - (s - discount * k) / np.maximum(c, 1), 1e-6))

    def write_back(group: pa.Table) -> pa.Table:
        p = group["part"][0].as_py()
        size = (below.bases[p + 1] if p + 1 < len(below.bases) else below.nodes) - below.bases[p]
        back = np.zeros(size, dtype=np.uint8)
        for at in range(0, len(group), SLICE):
            nodes, s, k = (group[x].slice(at, SLICE).to_numpy() for x in ("context", "s", "k"))
            c = opened(held).field(level - 1, nodes, "count", "level")
            back[nodes - below.bases[p]] = np.clip(np.rint(-log_back(s, k, c) / STEP_BACK), 0, 255)
        write_arrays(path, f"back{level - 1}-{p:06d}", {"back": back})
        return pa.table({"part": pa.array([p], pa.int64())})

    backs = stats.where(F.col("context") < below.nodes).withColumn("part", part).groupBy("part").applyInArrow(write_back, "part long")
    below = replace(below, back=frozenset(r["part"] for r in backs.collect()))
    begin_back = float(log_back(np.array([begin[0]["s"]]), np.array([begin[0]["k"]]), np.array([model.texts]))[0]) if begin else model.begin_back
    held = replace(model, levels=(*model.levels[:-1], below), begin_back=begin_back)
    base_model = held

    def write(part: int, keys: np.ndarray, counts: np.ndarray) -> None:
        trie = opened(base_model)
        keys = keys.view(np.uint64)
        low = int(keys[0] >> WORD_BITS)
        size = int(keys[-1] >> WORD_BITS) - low + 1
        quantised, values = np.empty(len(keys), dtype=np.uint8), np.empty(len(keys), dtype=np.uint64)
        for at in range(0, len(keys), SLICE):
            here = slice(at, at + SLICE)
            ctx, word = (keys[here] >> WORD_BITS).astype(np.int64), (keys[here] & WORD_MASK).astype(np.int64)
            real = ctx < below.nodes
            c = np.full(len(ctx), base_model.texts, dtype=np.int64)
            c[real] = trie.field(level - 1, ctx[real], "count", "level")
            if level == 2:
                lower = trie.unigram(trie.field(1, word, "count", "level"))
            else:  # the shorter n-gram was kept, as it is as frequent
                lower = -STEP * trie.field(2, trie.find(2, trie.last_words(2, ctx), word), "p", "level")
            p = (counts[here] - discount) / c + 10 ** (trie.backs(level - 1, ctx) + lower)
            quantised[here] = np.clip(np.rint(-np.log10(np.minimum(p, 1)) / STEP), 0, 255)
            values[here] = (ctx - low) * base_model.words + word
        starts = np.empty(size + 1, dtype=np.uint32)  # of each context's successors
        for at in range(0, size + 1, SLICE):
            heads = np.arange(low + at, low + min(at + SLICE, size + 1), dtype=np.uint64) << WORD_BITS
            starts[at : at + SLICE] = np.searchsorted(keys, heads)
        words, pointers = encode(values, size * base_model.words), encode(starts, len(keys) + 1)
        write_arrays(path, f"level{level}-{part:06d}", {
            "contexts": np.array([low, size], dtype="<i8"), "p": quantised, "count": counts.astype("<u4"),
            **{f"word_{k}": v for k, v in words.items()}, **{f"pointer_{k}": v for k, v in pointers.items()}})

    made = write_parts(kept, max(1, -(-n // part_nodes)), write)
    return replace(base_model, levels=(*base_model.levels, made))


def train(docs: DataFrame, text_col: str = "text", order: int = 3, min_count: int = 2, discount: float = 0.75, part_nodes: int = 2_000_000) -> Model:
    """Count and build the trie of ``docs``; the order is 1, 2 or 3."""
    if order not in (1, 2, 3):
        raise ValueError("order must be 1, 2 or 3")
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    path = shared_dir(spark)
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root)
    words = counted(texts, lambda hashes, counts: hashes, 1)
    totals = words.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    ends = words.where(F.col("key") == int(END.view(np.int64))).first()
    if totals["v"] >= 1 << 32:
        raise ValueError("more than 2**32 different words; raise the counts that are kept")

    def write(part: int, keys: np.ndarray, counts: np.ndarray) -> None:
        write_arrays(path, f"level1-{part:06d}", {"hash": keys.astype("<i8"), "count": counts.astype("<i8")})

    level = write_parts(words, max(1, -(-totals["v"] // (4 * part_nodes))), write)
    model = Model(path, totals["n"] or 0, ends["n"] if ends else 0, (level,))
    for n in range(2, order + 1):
        below = model

        def keys_of(hashes: np.ndarray, counts: np.ndarray, n: int = n, below: Model = below) -> np.ndarray:
            trie = opened(below)
            ids = trie.word_ids(hashes)
            often = trie.field(1, ids, "count", "level") >= min_count
            firsts = np.cumsum(counts) - counts
            nodes = trie.nodes(np.where(often, ids, -1), firsts, n - 1)
            context = np.concatenate([[-1], nodes[-1][:-1]])
            context[firsts] = below.words if n == 2 else -1
            # The shorter n-gram that ends here must have been kept, too.
            keep = np.flatnonzero((context >= 0) & (nodes[-1] >= 0))
            return context[keep].astype(np.uint64) << WORD_BITS | ids[keep].astype(np.uint64)

        model = add_level(model, counted(texts, keys_of, min_count), part_nodes, discount)
    return model


# --- scoring ----------------------------------------------------------------


def score_tokens(trie: Trie, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, log10 of the unigram estimate, log10 of the model) for each token."""
    model, order = trie.model, len(trie.model.levels)
    ids = trie.word_ids(hashes)
    known = ids >= 0
    c = np.zeros(len(ids), dtype=np.int64)
    c[known] = trie.field(1, ids[known], "count", "level")
    base = trie.unigram(c) if model.levels else np.zeros(len(ids))
    firsts = np.cumsum(counts) - counts
    nodes = trie.nodes(ids, firsts, order)
    out, done = np.zeros(len(ids)), np.zeros(len(ids), dtype=bool)
    for level in range(order, 1, -1):
        hit = np.flatnonzero(~done & (nodes[level - 1] >= 0))
        out[hit] -= STEP * trie.field(level, nodes[level - 1][hit], "p", "level")
        done[hit] = True
        context = np.concatenate([[-1], nodes[level - 2][:-1]])
        context[firsts] = model.words if level == 2 else -1
        rest = np.flatnonzero(~done)
        out[rest] += trie.backs(level - 1, context[rest])
    out[~done] += base[~done]
    return known, base, out


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_tokens, n_known, base_score, score``."""
    keep = [c for c in docs.columns if c != text_col]
    names = ["n_tokens", "n_known", "base_score", "score"]
    if clash := set(names) & set(keep):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    rows = docs.select(text_col, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = opened(model)
        for b in batches:
            for start, hashes, counts in token_arrays(b.column(0)):
                known, base, own = score_tokens(trie, hashes, counts)
                firsts = np.cumsum(counts) - counts
                sums = [counts, *(np.add.reduceat(x, firsts) for x in (known.astype(np.int64), base, own))]
                part = b.slice(start, len(counts))
                new = [pa.array(x, t) for x, t in zip(sums, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *new], names=[*keep, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]] + ["n_tokens long, n_known long, base_score double, score double"])
    return in_arrow(rows, run, schema, keeps=True)

