"""Words of UTF-8 texts and hashes of word runs, by numpy over whole blocks of bytes.

A word is a maximal run of word bytes; its hash is a polynomial over a table of random numbers, one for
each (case-folded) byte, in the ring of 64-bit integers. Runs of k words hash their words' hashes in order.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from . import shared

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: 0-9, A-Z, a-z and every byte of a non-ASCII character.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@functools.lru_cache(maxsize=4)
def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)[_FOLD] * np.uint64(2) + np.uint64(1)


_kept: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(size: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64; one pair for each worker, as long as was ever needed."""
    if size > len(_kept[0]):
        size = max(size, shared.CHUNK_BYTES + 1024)
        base = int(np.random.default_rng(2).integers(1, 2**62)) * 4 + 3
        for i, factor in enumerate((base, pow(base, -1, 2**64))):
            powers = np.full(size, factor, np.uint64)
            powers[0] = 1
            _kept[i] = np.cumprod(powers)
    return _kept


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the splitmix64 finisher)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for each span; equal contents have equal hashes wherever they stand.

    ``values`` come from a table of random numbers; another table gives an independent hash.
    """
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it (one more entry at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = word_bytes[data]
    edge = inside[1:] != inside[:-1]
    begins, stops = edge & inside[1:], edge & inside[:-1]
    seams = offsets[1:-1]
    seams = seams[(seams > 0) & (seams < len(data))]
    seams = seams[inside[seams] & inside[seams + 1]]  # a word must not run on into the next text
    begins[seams] = stops[seams] = True
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops), np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    return span_hashes(_table(seed)[data], starts, ends)


def gram_hashes(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of the k words from each word on; k - 1 fewer than the words. Runs over the seams of texts are for the caller to drop."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15 + 2 * seed) + hashes[i : i + n]
    return mix(out)


def segments(data: np.ndarray, word_bytes: np.ndarray):
    """Byte ranges of about one block that end between words; a longer word makes a longer range."""
    at = 0
    while at < len(data):
        end = min(len(data), at + shared.CHUNK_BYTES)
        while end < len(data) and word_bytes[data[end - 1]] and word_bytes[data[end]]:
            ahead = np.flatnonzero(~word_bytes[data[end : end + 4096]])
            end = end + int(ahead[0]) if len(ahead) else min(len(data), end + 4096)
        yield at, end
        at = end


def hash_words(column: pa.Array, seed: int = 1, word_bytes: np.ndarray = WORD_BYTES):
    """Yields (first row, last row, word hashes, words before each row) for blocks of a string column.

    A text longer than a block is hashed a segment at a time, so that memory follows its words only.
    """
    data, offsets = shared.utf8(column)
    for i, k in shared.blocks(offsets):
        part, offs = data[offsets[i] : offsets[k]], offsets[i : k + 1] - offsets[i]
        if k == i + 1 and len(part) > shared.CHUNK_BYTES:
            hashes = [word_hashes(p := part[a:b], *word_spans(p, np.array([0, b - a]), word_bytes)[:2], seed) for a, b in segments(part, word_bytes)]
            one = np.concatenate(hashes)
            yield i, k, one, np.array([0, len(one)])
        else:
            starts, ends, before = word_spans(part, offs, word_bytes)
            yield i, k, word_hashes(part, starts, ends, seed), before
