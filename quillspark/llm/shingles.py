"""Word hashes and word shingles of many texts at once, with numpy.

Words are maximal runs of ASCII letters and digits and of all bytes beyond ASCII, in lower
case. A word's hash comes from prefix sums of a polynomial over the bytes of all texts, so
that no word becomes a Python object.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Powers that a worker keeps; those of longer texts are made anew.
KEPT_POWERS = 1 << 20

WORD_BYTES = np.array([i > 127 or chr(i).isalnum() for i in range(256)])
#: Bytes that separate tokens on white space alone: blank and \\t to \\r.
NOT_SPACE = np.array([i not in (32, 9, 10, 11, 12, 13) for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambling."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = n if n > KEPT_POWERS else min(KEPT_POWERS, max(2 * n, 1 << 16))
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= KEPT_POWERS:
            _powers[base] = have
    return have[:n]


def word_hashes(texts: list[bytes], kept: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and each text's number of words."""
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    inside = kept[data]
    if not inside.any():
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    step = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])
    hashes = mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(data))[starts])
    borders = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, borders)]))
    return hashes, counts


def chunks(texts: list[bytes], size: int):
    """Ranges (from, to) of texts with about ``size`` bytes together, one text at least."""
    start = 0
    while start < len(texts):
        end, total = start, 0
        while end < len(texts) and (end == start or total + len(texts[end]) <= size):
            total += len(texts[end])
            end += 1
        yield start, end
        start = end


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted shingles of each text: (text, shingle hash, which occurrence in the text from 0).

    A text with fewer than ``width`` words, but some, has one shingle: all its words.
    """
    n = len(hashes)
    text = np.repeat(np.arange(len(counts)), counts)
    odd = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(width)]
    padded = np.concatenate([hashes, np.zeros(width, dtype=np.uint64)])
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    full = np.zeros(n, dtype=bool)
    if n >= width:
        full[: n - width + 1] = text[: n - width + 1] == text[width - 1 :]
    at = np.flatnonzero(full)
    value = np.zeros(len(at), dtype=np.uint64)
    for i in range(width):
        value += padded[at + i] * odd[i]
    owner = text[at]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for i in range(width - 1):
            extra += np.where(i < counts[short], padded[firsts[short] + i], np.uint64(0)) * odd[i]
        value, owner = np.concatenate([value, extra + np.uint64(1)]), np.concatenate([owner, short])
    value = mix(value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if not len(value):
        return owner, value, np.empty(0, dtype=np.int64)
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])
    run = np.flatnonzero(new)
    nth = np.arange(len(value)) - np.repeat(run, np.diff(np.concatenate([run, [len(value)]])))
    return owner, value, nth


def content_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each text's word sequence (zeros for a text without words)."""
    text = np.repeat(np.arange(len(counts)), counts)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    place = (np.arange(len(hashes)) - firsts[text]).astype(np.uint64)
    out = np.zeros((2, len(counts)), dtype=np.uint64)
    has = np.flatnonzero(counts)
    for i, seed in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
        if len(hashes):
            out[i, has] = np.add.reduceat(mix(hashes + mix(place + np.uint64(seed))), firsts[has])
    return out
