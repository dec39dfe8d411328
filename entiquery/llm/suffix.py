"""Suffix arrays by two-stage sorting, with numpy.

Suffixes smaller than their successors are sorted directly. The others are induced: buckets of first
symbols are scanned in order, and each suffix met puts the suffix one symbol longer, if that is larger than
its successor, at the front end of its own bucket.
"""

from __future__ import annotations

import numpy as np

from .words import span_hashes

_VALUES = np.random.default_rng(31).integers(1, 2**63, 513, dtype=np.uint64)
#: Symbols (9 bits each) in a 64-bit key.
PACK = 7


def packed(text: np.ndarray) -> np.ndarray:
    """At each place the next PACK symbols as one integer; zeros follow the end. Symbols are 0..511."""
    wide = np.concatenate([text.astype(np.uint64), np.zeros(PACK, np.uint64)])
    out = np.zeros(len(text) + 1, np.uint64)
    for i in range(PACK):
        out[:-1] = out[:-1] << np.uint64(9) | wide[i : i + len(text)]
    return out


def rising(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last is not."""
    n = len(text)
    if not n:
        return np.zeros(0, bool)
    change = np.flatnonzero(text[1:] != text[:-1])  # last places of runs
    up = np.zeros(n, bool)
    sizes = np.diff(np.r_[-1, change, n - 1])
    return np.repeat(np.r_[text[change] < text[change + 1], False], sizes) if n else up


def _direct(keys: np.ndarray, places: np.ndarray, depth: int, alike: np.ndarray | None) -> np.ndarray:
    """``places`` sorted by their first ``depth`` symbols; only what is still tied is looked at again.

    ``alike``: a hash of the ``depth`` symbols at each place. Ties that are alike to the end need no more rounds.
    """
    last = len(keys) - 1
    order = places[np.argsort(keys[places], kind="stable")]
    tied = np.zeros(len(order), bool)
    same = keys[order][1:] == keys[order][:-1]
    group = np.cumsum(np.r_[True, ~same]) if len(order) else np.zeros(0, np.int64)
    at = PACK
    while at < depth:
        tied[:] = False
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if alike is not None and len(where):
            own = alike[order[where]]
            first = np.flatnonzero(np.r_[True, group[where][1:] != group[where][:-1]])
            sizes = np.diff(np.r_[first, len(where)])
            mixed = ~np.logical_and.reduceat(own == np.repeat(own[first], sizes), first)
            where = where[np.repeat(mixed, sizes)]
        if not len(where):
            break
        part, of = order[where], group[where]
        key = keys[np.minimum(part + at, last)]
        by = np.lexsort((key, of))
        part, of, key = part[by], of[by], key[by]
        order[where] = part
        apart = np.r_[False, (key[1:] != key[:-1]) & (of[1:] == of[:-1])]
        split = np.zeros(len(order), np.int64)
        split[where] = apart
        group = group + np.cumsum(split)
        same = np.zeros(len(same), bool)
        same[where[1:] - 1] = (where[1:] == where[:-1] + 1) & (group[where[1:]] == group[where[:-1]])
        at += PACK
    return order


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Places in the order of their suffixes, to ``depth`` symbols at least (whole suffixes if None).

    ``text``: integers from 0 to 511; a suffix that ends is smaller than one that goes on.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    text = text.astype(np.int64) + 1 if text.max(initial=0) < 511 else text.astype(np.int64)
    up = rising(text)
    places = np.flatnonzero(up)
    alike = None
    if depth is not None:
        ends = np.minimum(np.arange(n) + depth, n)
        alike = span_hashes(_VALUES[text], np.arange(n), ends)
    direct = _direct(packed(text), places, n if depth is None else depth, alike)
    symbols = int(text.max()) + 1
    first = text[direct]
    cuts = np.searchsorted(first, np.arange(symbols + 1))
    waiting: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    waiting[int(text[-1])].append(np.array([n - 1]))
    out = []

    def send(found: np.ndarray, c: int) -> None:
        before = found[found > 0] - 1
        before = before[text[before] > c]
        kinds = text[before]
        by = np.argsort(kinds, kind="stable")
        kinds, before = kinds[by], before[by]
        ends = np.flatnonzero(np.r_[kinds[1:] != kinds[:-1], True]) + 1 if len(kinds) else []
        a = 0
        for b in ends:
            waiting[int(kinds[a])].append(before[a:b])
            a = b

    for c in range(symbols):
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        falling = []
        while len(level):  # runs of the same symbol lead back into the bucket
            falling.append(level)
            level = level[level > 0] - 1
            level = level[(text[level] == c) & ~up[level]]
        for part in falling:
            send(part, c)
        own = direct[cuts[c] : cuts[c + 1]]
        send(own, c)
        out += [*falling, own]
        waiting[c] = []
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix in ``order`` with the one before it, up to ``most``; 0 for the first."""
    wide = np.concatenate([text.astype(np.int64) + 1, np.zeros(most + 1, np.int64)])
    keys = np.concatenate([packed(wide), np.zeros(most + 1, np.uint64)])
    a, b = order[:-1], order[1:]
    length = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    for at in range(0, most, PACK):
        x = keys[a[alive] + at] ^ keys[b[alive] + at]
        equal = x == 0
        bits = np.zeros(len(x), np.int64)
        bits[~equal] = np.floor(np.log2(x[~equal].astype(np.float64))).astype(np.int64)
        high = x >> np.minimum(bits, 63).astype(np.uint64)
        bits -= (high == 0) & ~equal  # rounding up of a large integer
        length[alive] += np.where(equal, PACK, PACK - 1 - bits // 9)
        alive = alive[equal]
    length = np.minimum(length, most)
    ends = len(text) - np.maximum(a, b)
    return np.r_[0, np.minimum(length, ends)] if len(order) else np.zeros(0, np.int64)
