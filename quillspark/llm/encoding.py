"""Text to token ids with a public tokenizer, as little-endian unsigned 32-bit bytes.

A byte-level BPE tokenizer splits text before every space that a non-space follows, so a
text's ids are those of its chunks in a row. Chunks repeat far more often than texts do:
each distinct chunk goes through the tokenizers library once per worker, each distinct chunk
of a batch is looked up once, and Arrow puts the ids of all chunks together. Texts in which a special token's string occurs go through the
library whole. ``tests/llm/test_encoding_packing.py`` holds both ways against each other.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import per_worker

#: Distinct chunks that a worker keeps for good, the first that it meets, as frequent ones come early, and of
#: those met after them, until they are forgotten together; a chunk that is forgotten costs time only.
CACHE_CHUNKS, RECENT_CHUNKS = 450_000, 150_000

_SAFE_CUT = re.compile(r" (?=\S)")
_ENDS = ".,;:!?\"#$%&()*+-/<=>@[\\]^`{|}~"  # after a word, these are pre-tokens of their own
_ODD_SPACE = re.compile(r" (?:\s|\Z)")


class ChunkEncoder:
    """Encodes texts with one tokenizer file; ``encode(texts)`` gives bytes for each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens
        words = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(words.values(), default=0) + 1, dtype=bool)  # ids that begin with a space
        self.begins[[i for w, i in words.items() if len(space) == 1 and w.startswith(space[0])]] = True
        self.inner: dict[str, bytes] = {}  # chunks that a space goes before
        self.recent: dict[str, bytes] = {}  # of these, what was met when ``inner`` was full
        self.first: dict[str, bytes] = {}  # chunks at the start of a text

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    def _spaced(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks with a space before each: many chunks in one text, cut at ids that begin with a space."""
        joined = [" " + " ".join(chunks[i : i + 200]) for i in range(0, len(chunks), 200)]
        ids = np.frombuffer(b"".join(self._library(joined)), dtype="<u4")
        cuts = (4 * np.append(np.flatnonzero(self.begins[ids]), len(ids))).tolist()
        if len(cuts) != len(chunks) + 1:  # a tokenizer whose ids do not show the spaces
            return self._library([" " + x for x in chunks])
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def _learn_first(self, chunks: set[str]) -> None:
        if len(self.first) > 2 * RECENT_CHUNKS and not chunks <= self.first.keys():
            self.first.clear()
        new = [x for x in chunks if x not in self.first]
        self.first.update(zip(new, self._library(new), strict=True))

    def _learn_inner(self, chunks: set[str]) -> dict[str, bytes]:
        """Learn chunks that ``inner`` lacks; the dictionary that holds them all.

        A word with punctuation after it is the word's ids and the punctuation's.
        """
        inner, cache, plain, ended = self.inner, self.inner, set(), []
        if len(inner) > CACHE_CHUNKS:
            if len(self.recent) > RECENT_CHUNKS:
                self.recent = {}
            cache = self.recent
        for x in chunks:
            if x in cache:
                continue
            word = x.rstrip(_ENDS)
            if len(word) < len(x) and word.isalpha():
                ended.append((x, word, x[len(word) :]))
                if word not in inner and word not in cache:
                    plain.add(word)
            else:
                plain.add(x)
        new = list(plain)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            cache.update(zip(part, self._spaced(part), strict=True))
        self._learn_first({x[2] for x in ended})
        cache.update([(x, (inner.get(word) or cache[word]) + self.first[end]) for x, word, end in ended])
        return cache

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text; a null counts as the empty text.

        Arrow splits the texts and numbers the batch's distinct chunks; only these are looked up one by one.
        """
        out, whole, plain, odd = [b""] * len(texts), [], [], []
        for i, text in enumerate(texts):
            if text:
                kind = whole if any(x in text for x in self.special) else odd if _ODD_SPACE.search(text) else plain
                kind.append(i)
        if whole:
            for i, ids in zip(whole, self._library([texts[i] for i in whole]), strict=True):
                out[i] = ids
        cut = plain + odd
        if not cut:
            return out
        split = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        split = pa.concat_arrays([split, pa.array([_SAFE_CUT.split(texts[i]) for i in odd], split.type)]) if odd else split
        bounds, coded = split.offsets.to_numpy(), split.values.dictionary_encode()
        chunks, of = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()
        firsts = [chunks[k] for k in of[bounds[:-1]].tolist()]
        of[bounds[:-1]] = len(chunks) + np.arange(len(cut))
        self._learn_first(set(firsts))
        first = [self.first[x] for x in firsts]  # before other chunks may clear it
        ids = list(map(self.inner.get, chunks))
        inside = np.bincount(of, minlength=len(chunks)) > 0  # not at the start of texts only
        gaps = [k for k in np.flatnonzero(inside[: len(chunks)]).tolist() if ids[k] is None]
        if gaps:
            known = self._learn_inner({chunks[k] for k in gaps})
            for k in gaps:
                ids[k] = known[chunks[k]]
        joined = pa.array([x or b"" for x in ids] + first, pa.large_binary()).take(pa.array(of))
        places = np.frombuffer(joined.buffers()[1], dtype="<i8")[bounds].tolist()
        data = memoryview(joined.buffers()[2] or b"")
        for i, start, end in zip(cut, places, places[1:], strict=False):
            out[i] = bytes(data[start:end])
        return out


def largest_id(path: str) -> int:
    """The largest id that a tokenizer file knows, added tokens included."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return max(max(tokenizer.get_vocab(with_added_tokens=True).values(), default=0), max(tokenizer.get_added_tokens_decoder(), default=0))


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder of a tokenizer file."""
    return per_worker(("encoder", path), lambda: ChunkEncoder(path))


def encode_in_small_batches(path: str, column: pa.Array, chars: int = 4_000_000, rows: int = 1000):
    """Yield (position, ids) with at most about ``chars`` characters, or one text, in work at once."""
    coder = encoder(path)
    for first in range(0, len(column), rows):
        texts, start = column.slice(first, rows).to_pylist(), 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end] or "") <= chars):
                size += len(texts[end] or "")
                end += 1
            yield from enumerate(coder.encode(texts[start:end]), first + start)
            start = end
