"""Indicator features of whole texts, as hashed buckets, by numpy over blocks of bytes.

Features of a text (each counts once, however often it occurs): its words and word pairs (white-space
separated, A-Z lower-cased), prefixes of words, and the same for word *shapes*: letters, digits and other
bytes by kind, repeats collapsed, so that "Word!!" and "Others!" look alike. One more feature says how
often words repeat. Names, languages and sources are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import shared
from .words import gram_hashes, mix, segments, span_hashes, word_hashes, word_spans

BUCKETS = 1 << 20
#: So many that features of a text practically never share one; for models with few weights.
WIDE = 1 << 40
#: Everything but ASCII white space.
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False
#: Upper case, lower case and non-ASCII, digits; other bytes stand for themselves.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 65, 97, 97, 48
_KIND_VALUE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
#: Salts that keep the kinds of features apart.
WORD, PAIR, SHAPE, SHAPE_PAIR, REPEAT, PREFIX = range(1, 7)


def _salted(hashes: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    return (mix(hashes + np.uint64(kind * 0x632BE59BD9B4E019 % 2**64)) % np.uint64(buckets)).astype(np.int64)


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    kind = _KIND[data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    at = np.r_[0, np.cumsum(new)]
    return span_hashes(_KIND_VALUE[kind[new]], at[starts], at[ends])


def _block(data: np.ndarray, offsets: np.ndarray, kinds: tuple[int, ...], prefixes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket), sorted and distinct."""
    starts, ends, before = word_spans(data, offsets, SOLID)
    n = np.diff(before)
    row = np.repeat(np.arange(len(n)), n)
    words = word_hashes(data, starts, ends)
    last = np.zeros(len(row), bool)
    last[before[1:][n > 0] - 1] = True
    found = []
    if WORD in kinds:
        found.append((row, _salted(words, WORD, buckets)))
    if PAIR in kinds and len(words) > 1:
        found.append((row[:-1][~last[:-1]], _salted(gram_hashes(words, 2), PAIR, buckets)[~last[:-1]]))
    if SHAPE in kinds:
        shapes = _shapes(data, starts, ends)
        found.append((row, _salted(shapes, SHAPE, buckets)))
        if len(words) > 1:
            found.append((row[:-1][~last[:-1]], _salted(gram_hashes(shapes, 2), SHAPE_PAIR, buckets)[~last[:-1]]))
    for size in prefixes:
        long = ends - starts > size
        found.append((row[long], _salted(word_hashes(data, starts[long], starts[long] + size) + np.uint64(size), PREFIX, buckets)))
    if REPEAT in kinds:
        by = np.lexsort((words, row))
        new = np.r_[True, (row[by][1:] != row[by][:-1]) | (words[by][1:] != words[by][:-1])] if len(row) else np.zeros(0, bool)
        distinct = np.bincount(row[by][new], minlength=len(n))
        found.append((np.arange(len(n)), _repeats(distinct, n, buckets)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.unique(np.concatenate([r for r, _ in found]) * buckets + np.concatenate([b for _, b in found]))
    return key // buckets, key % buckets


def _repeats(distinct: np.ndarray, n: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket for tenths of distinct words and the size's power of two."""
    share, size = (10 * distinct // np.maximum(n, 1)).astype(np.uint64), np.minimum(np.log2(n + 1), 20).astype(np.uint64)
    return _salted(share * np.uint64(32) + size, REPEAT, buckets)


def _long(data: np.ndarray, kinds: tuple[int, ...], prefixes: tuple[int, ...], buckets: int) -> np.ndarray:
    """Buckets of one long text, a segment at a time; each begins with the word before, for pairs."""
    all_found, seen, n, last = np.zeros(0, np.int64), np.zeros(0, np.uint64), 0, 0
    for a, b in segments(data, SOLID):
        part = data[last:b]
        _, found = _block(part, np.array([0, len(part)]), tuple(k for k in kinds if k != REPEAT), prefixes, buckets)
        all_found = np.union1d(all_found, found)
        starts, ends, _ = word_spans(data[a:b], np.array([0, b - a]), SOLID)
        seen, n = np.union1d(seen, word_hashes(data[a:b], starts, ends)), n + len(starts)
        last = a + int(starts[-1]) if len(starts) else last
    if REPEAT in kinds:
        all_found = np.union1d(all_found, _repeats(np.array([len(seen)]), np.array([n]), buckets))
    return all_found


def features(column: pa.Array, kinds: tuple[int, ...] = (WORD, PAIR, SHAPE, REPEAT), prefixes: tuple[int, ...] = (), buckets: int = BUCKETS):
    """Yields (first row, last row, feature rows from 0, buckets) for blocks of a string column."""
    data, offsets = shared.utf8(column)
    for i, k in shared.blocks(offsets):
        if k == i + 1 and offsets[k] - offsets[i] > shared.CHUNK_BYTES:
            bucket = _long(data[offsets[i] : offsets[k]], kinds, prefixes, buckets)
            yield i, k, np.zeros(len(bucket), np.int64), bucket
            continue
        yield i, k, *_block(data[offsets[i] : offsets[k]], offsets[i : k + 1] - offsets[i], kinds, prefixes, buckets)
