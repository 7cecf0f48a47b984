"""Benchmark decontamination: pigeonhole edit matching.

A test item that may differ in at most e edits is cut into e + 1 pieces; wherever it occurs
with at most e edits, at least one piece occurs exactly. One automaton finds all pieces of
all items in a text, and each hit's surroundings are verified with Myers' bit-parallel edit
distance: first on small parts of the item around the piece, then on larger ones, last on the whole,
where overlapping windows of one item are one pass. Texts and items are compared in lower case with every run of white space and
punctuation as one space, and an item only matches whole words at its ends.

Scale: documents are scanned once where they lie, with no shuffle. The items go to the
tasks in blocks of about ``block_chars`` characters; a larger benchmark takes one scan for
each block, one after the other, so what is broadcast at a time never grows beyond that bound.

Contract: null or empty texts match nothing, items without a letter or digit match nothing;
repeated documents are reported once each row, repeated items under each of their ids, null ids
as null; of equally close places the first, then the shortest stands; texts of any length are scanned whole; empty
tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialize, per_worker

_ASCII = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))
_OTHER = re.compile(r"[^\w\x00-\x7f]")  # neither ASCII nor letter nor digit
FOUND = "doc_id long, item_id long, distance int, start int, end int, matches int"


def normalise(text: str | None) -> str:
    """Lower case; each run of characters that are neither letters nor digits is one space."""
    if not text:
        return ""
    low = text.lower()
    if not low.isascii() and _OTHER.search(low):
        low = _OTHER.sub(" ", low)
    return b" ".join(low.encode("utf-8", "replace").translate(_ASCII).split()).decode()


def cuts(length: int, errors: int, start: int = 0) -> list[int]:
    """Bounds of ``errors + 1`` pieces of nearly the same length, from ``start`` on."""
    return [start + length * i // (errors + 1) for i in range(errors + 2)]


def scores(pattern_bits: dict[str, int], m: int, text: str, anchored: bool = False) -> Iterator[int]:
    """By end (from 0): the pattern's least edit distance to a part of ``text`` that ends there.

    Parts may begin anywhere, or only where the text does if ``anchored``.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    yield m
    for ch in text:
        eq = pattern_bits.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | anchored) & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        yield score


def myers(pattern_bits: dict[str, int], m: int, text: str, anchored: bool = False) -> list[int]:
    return list(scores(pattern_bits, m, text, anchored))


def bits(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


ONE, FAR = 1 << 32, 1 << 61


def runs(item: str, text: str, ends: list[int], errors: int) -> list[tuple[int, int, int]]:
    """(distance, start, end) of the closest run of whole words that ends at each of some places, within ``errors``.

    Of equally close runs with one end the longest. ``ends`` ascend; distances are filled in column by
    column, each with the place where it began, on the diagonals only that lead to these ends.
    """
    m = len(item)
    codes, steps = np.frombuffer(item.encode("utf-32-le"), np.uint32), np.arange(m + 1) * ONE
    first, last = ends[0] - m - errors, ends[-1] - m + errors
    column, wanted, found = np.full(m + 1, FAR), set(ends), []
    for j in range(max(0, first), ends[-1] + 1):
        low, high = max(0, j - last), min(m, j - first)
        part = column[low : high + 1] + ONE
        if j:
            change = np.where(codes[max(low, 1) - 1 : high] == ord(text[j - 1]), 0, ONE)
            inner = part[1:] if low == 0 else part
            np.minimum(inner, column[max(low, 1) - 1 : high] + change, out=inner)
        if low == 0:
            part[0] = j if j and text[j - 1] == " " else FAR
        else:
            column[low - 1] = FAR
        part -= steps[low : high + 1]
        np.minimum.accumulate(part, out=part)
        column[low : high + 1] = part + steps[low : high + 1]
        if j in wanted and column[m] < (errors + 1) * ONE:
            found.append((int(column[m]) // ONE, int(column[m]) % ONE, j))
    return found


#: A piece that more items share is common: an item with such pieces is cut anew outside them, if there is room.
SHARED = 8
#: The shortest piece that an item is cut anew into.
LEAST_PIECE = 8
#: A piece that stands more often in one item points to a range of places instead of each.
REPEATED = 4
#: Remembered tests of a text, and bit masks of a worker; beyond them they are made again.
REMEMBERED = 50_000
#: Windows up to this length are remembered by their content, longer ones by their place.
BY_CONTENT = 256


class Matcher:
    """Finds items within their error budgets in normalised texts.

    A hit of a piece is tried on ever larger parts of the item, halves of halves first: a part of
    n pieces may differ by n - 1 edits, and if a whole fits its budget, so does one of its halves.
    Only places where all parts fit are compared with the whole item, places near each other at once.
    """

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        ids: dict[str, list[int]] = {}
        for item_id, text in items:
            if text := normalise(text):
                ids.setdefault(text, []).append(item_id)
        self.items = [(same, text, int(len(text) * error_rate)) for text, same in ids.items()]
        self.cuts = [cuts(len(text) + 2, errors) for _, text, errors in self.items]
        self.masks: dict[str, dict[str, int]] = {}
        in_items = Counter(piece for i in range(len(self.items)) for piece in set(self.pieces(i)))
        for i, (_, _, errors) in enumerate(self.items):
            common = [in_items[piece] > SHARED for piece in self.pieces(i)]
            if any(common):
                self.cuts[i] = self.outside(self.cuts[i], common, errors)
        places: dict[str, list[tuple[int, int, int]]] = {}
        for i in range(len(self.items)):
            own: dict[str, list[int]] = {}
            for leaf, piece in enumerate(self.pieces(i)):
                if piece:
                    own.setdefault(piece, []).append(leaf)
            for piece, leaves in own.items():
                ranges = [(leaves[0], leaves[-1])] if len(leaves) > REPEATED else [(leaf, leaf) for leaf in leaves]
                places.setdefault(piece, []).extend((i, *r) for r in ranges)
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.ready = bool(places)
        if self.ready:
            self.automaton.make_automaton()

    def pieces(self, i: int) -> list[str]:
        own, at = f" {self.items[i][1]} ", self.cuts[i]
        return [own[a:b] for a, b in zip(at, at[1:], strict=False)]

    @staticmethod
    def outside(at: list[int], common: list[bool], errors: int) -> list[int]:
        """Bounds of as many pieces in the longest stretch without a common one, or ``at`` if that is too short."""
        stretches = [list(g) for rare, g in groupby(range(len(common)), lambda x: not common[x]) if rare]
        if not stretches:
            return at
        longest = max(stretches, key=lambda g: at[g[-1] + 1] - at[g[0]])
        start, length = at[longest[0]], at[longest[-1] + 1] - at[longest[0]]
        return cuts(length, errors, start) if length // (errors + 1) >= LEAST_PIECE else at

    def mask(self, pattern: str) -> dict[str, int]:
        if pattern not in self.masks:
            if len(self.masks) >= REMEMBERED or len(pattern) > 100 * BY_CONTENT:
                self.masks.clear()
            self.masks[pattern] = bits(pattern)
        return self.masks[pattern]

    def fits(self, norm: str, i: int, low: int, high: int, begin: int, tested: dict) -> bool:
        """Whether the item's pieces ``low`` to ``high`` stand within their budget where the item would begin at ``begin``."""
        a, b, k = self.cuts[i][low], self.cuts[i][high], high - low - 1
        base = begin - begin % (k + 1)  # one test for all begins of a group
        at = max(0, base + a - k)
        window, part = norm[at : max(0, base + b + 2 * k)], f" {self.items[i][1]} "[a:b]
        key = (part, window) if len(window) <= BY_CONTENT else (i, low, high, at)
        if key not in tested:
            if len(tested) >= REMEMBERED:
                tested.clear()
            tested[key] = any(score <= k for score in scores(self.mask(part), b - a, window))
        return tested[key]

    def candidates(self, norm: str) -> dict[int, list[tuple[int, int]]]:
        """By item: windows of the text that hold all its places within the budget, and maybe others."""
        tested: dict = {}
        near: dict[int, set[tuple[int, int]]] = {}
        for end, (size, at) in self.automaton.iter(norm):
            for i, leaf, last in at:
                own, errors = self.cuts[i], self.items[i][2]
                begin, earliest = end - size + 1 - own[leaf], end - size + 1 - own[last]
                groups = (earliest // (errors + 1), begin // (errors + 1))
                known = near.get(i, ())
                if groups in known:
                    continue
                if leaf != last or all(self.fits(norm, i, low, high, begin, tested) for low, high in halves(leaf, errors + 1)):
                    near.setdefault(i, set()).add(groups)
        windows: dict[int, list[tuple[int, int]]] = {}
        for i, found in near.items():
            _, item, errors = self.items[i]
            for first, last in sorted(found):
                low, high = max(0, first * (errors + 1) - errors), (last + 1) * (errors + 1) + len(item) + 2 + 2 * errors
                own = windows.setdefault(i, [])
                if own and low <= own[-1][1]:
                    own[-1] = (own[-1][0], max(high, own[-1][1]))
                else:
                    own.append((low, high))
        return windows

    def find(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item id, distance, start, end, matches) for each item that occurs in the text.

        ``matches`` counts from the left, by their ends, runs that do not begin before the last one counted ends.
        """
        norm = f" {normalise(text)} "
        if not self.ready or len(norm) < 3:
            return []
        rows = []
        for i, windows in self.candidates(norm).items():
            ids, item, errors = self.items[i]
            best, matches, ended = None, 0, 0
            for low, high in windows:
                window = norm[low:high]
                ends = [end for end, score in enumerate(scores(self.mask(item), len(item), window)) if score <= errors and window[end : end + 1] == " "]
                for distance, start, end in runs(item, window, ends, errors) if ends else ():
                    best = min(best or (errors + 1, 0, 0), (distance, start + low - 1, end + low - 1))
                    if start + low >= ended:
                        matches, ended = matches + 1, end + low
            if best:
                rows += [(item_id, *best, matches) for item_id in ids]
        return rows


def halves(leaf: int, n: int) -> list[tuple[int, int]]:
    """The parts of ``n`` pieces, halved again and again, that hold piece ``leaf``: the smallest of two or more first."""
    low, high, parts = 0, n, []
    while high - low > 1:
        parts.append((low, high))
        middle = (low + high) // 2
        low, high = (low, middle) if leaf < middle else (middle, high)
    return parts[::-1]


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def item_blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_chars: int) -> tuple[int, Iterator]:
    """The number of blocks of about ``block_chars`` characters, and a broadcast of each block's items in turn.

    A block goes when the next one is asked for; there is one, without items, if there are none.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-chars // block_chars))

    def blocks() -> Iterator:
        for block in range(n):
            part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
            held = benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r["item_id"], r["text"]) for r in part.collect()]))
            yield held
            held.destroy()

    return n, blocks()


def matcher_of(held, error_rate: float) -> Matcher:
    """This worker's matcher of a block."""
    key, items = held.value
    return per_worker(("items", key, error_rate), lambda: Matcher(items, error_rate))


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = 8_000_000) -> DataFrame:
    """One row for each document and item that it contains within ``error_rate`` edits a character.

    ``doc_id, item_id, distance, start, end, matches``: the closest match (the first of
    equals), its place in the normalised text, and the number of separate matches.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")

    def scan(held):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(held, error_rate)
            for batch in small(batches):
                rows = [(doc_id, *hit) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in matcher.find(text)]
                if rows:
                    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "distance", "start", "end", "matches"])

        return in_arrow(read, find, FOUND, keeps=True)

    n, blocks = item_blocks(benchmark, item_col, item_text_col, block_chars)
    if n == 1:
        return scan(next(blocks))
    return reduce(DataFrame.unionByName, [materialize(scan(held)) for held in blocks])  # written before the block goes


def without_matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = 8_000_000) -> DataFrame:
    """``docs`` with all columns, less the rows that contain an item; nothing is shuffled or joined."""
    where = docs.columns.index(text_col)

    def clean(docs: DataFrame, held) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(held, error_rate)
            for batch in small(batches):
                yield batch.filter(pa.array([not matcher.find(t) for t in batch.column(where).to_pylist()], pa.bool_()))

        return in_arrow(docs, keep, docs.schema, keeps=True)

    n, blocks = item_blocks(benchmark, item_col, item_text_col, block_chars)
    if n == 1:
        return clean(docs, next(blocks))
    for held in blocks:
        docs = materialize(clean(docs, held))  # written before the block goes
    return docs
