"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most 3 bits exactly if some value lies within 1 bit of one and 2 of
the other. Every fingerprint therefore emits variants: itself, all 64 with one bit flipped, and some with
two. Of the pairs of bits only 496 are needed: any three differing bits hold two in the same 32-bit half,
and fingerprints at an odd distance differ in the parity of their bit counts, so even fingerprints emit
the pairs of the lower half and odd ones those of the upper half. (No smaller set of pairs will do: the
pairs left out must form a graph without triangles, which has at most 1024 edges.)

Variants are shuffled by some of their bits, a cell. A fingerprint travels once to each cell that any of
its variants lies in (36 of 16,384 cells, not 561 rows) and is spread there; equal variants are found by
sorting. In a run of equal variants with a member at distance 0 or 1, that member links to all others:
distances add up to 3 at most, which is checked bit by bit. Runs with distance-2 members only say nothing;
their links are found at other variants. So links grow with the rows and never with the square of a group.

Defined results: a null text is empty; documents without words have fingerprint zero and link like any
other; repeated rows and equal texts share a fingerprint; a null doc_id takes part but is never a
component_id unless the component has no other; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, shared
from .features import SOLID
from .words import segments

HALF = 32
#: Bits of a cell from each half, and the fingerprints a cell may hold on average before it takes more bits (from 33 million on).
CELL_BITS, CELL = 7, 2048
#: Variants that are sorted together.
SORT = 1 << 20
_PRINT = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("fingerprint", pa.int64())])
_SENT = pa.schema([("cell", pa.int32()), ("fingerprint", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: str | bytes, words: int) -> list[int]:
    """XXH64 (seed 42) of every ``words``-word shingle, repeats included; of the whole if it is shorter."""
    from xxhash import xxh64_intdigest

    w = (text.encode() if isinstance(text, str) else text).lower().split()  # bytes: A-Z and ASCII white space only
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)] if w else []
    return [xxh64_intdigest(s, 42) for s in shingles]


def majority_bits(hashes: list[list[int]]) -> np.ndarray:
    """For each list the 64 bits that are set in over half of its hashes."""
    n = np.array([len(h) for h in hashes])
    out = np.zeros(len(hashes), np.uint64)
    if n.sum():
        flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(n.sum()))
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = n > 0
        ones = np.add.reduceat(bits, (np.cumsum(n) - n)[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > n[full, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def long_print(data: np.ndarray, words: int) -> int:
    """The fingerprint of one long text, its shingles a segment at a time."""
    ones, n, before = np.zeros(64, np.int64), 0, []
    for a, b in segments(data, SOLID):
        w = before + data[a:b].tobytes().split()
        if len(w) >= words:
            h = np.array(shingle_hashes(b" ".join(w), words), np.uint64)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(h)
        before = w[-(words - 1) :] if words > 1 else []
    if not n:  # fewer words than a shingle
        return int(majority_bits([shingle_hashes(b" ".join(before), words)])[0])
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def block_prints(text: pa.Array, words: int):
    """Yields (first row, last row, fingerprints) for blocks of a string column, whole texts."""
    data, offsets = shared.utf8(text)
    for i, k in shared.blocks(offsets):
        if k == i + 1 and offsets[k] - offsets[i] > shared.CHUNK_BYTES:
            yield i, k, np.array([long_print(data[offsets[i] : offsets[k]], words)], np.uint64)
        else:
            yield i, k, majority_bits([shingle_hashes(t or "", words) for t in text[i:k].to_pylist()])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(uid, doc_id, fingerprint) of whole texts; uid is the row's place in the scan."""

    def run(batches):
        for b in batches:
            uid, doc, text = b.columns
            for i, k, prints in block_prints(text, words):
                yield shared.batch(_PRINT, uid[i:k], doc[i:k], prints.view(np.int64))

    shared.ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id(), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(shared.lean(run), "uid long, doc_id long, fingerprint long")


class Ball:
    """Variants of 64-bit fingerprints, by cell. ``bits``: of a cell, from each half."""

    def __init__(self, bits: int):
        self.bits = bits
        one = np.uint64(1) << np.arange(64, dtype=np.uint64)
        inside = [[p for p in range(h * HALF, h * HALF + bits)] for h in (0, 1)]
        outside = [[p for p in range(h * HALF + bits, (h + 1) * HALF)] for h in (0, 1)]
        flips = lambda sets: np.array([np.bitwise_or.reduce(one[list(s)]) if s else np.uint64(0) for s in sets], np.uint64)
        #: For each way in which a cell differs from the fingerprint's own: the flips that lead there, by role (half of the pairs).
        self.ways: list[tuple[int, int | None, np.ndarray]] = []
        for role in (0, 1):
            stay = [(), *((p,) for h in (0, 1) for p in outside[h]), *combinations(outside[role], 2)]
            self.ways.append((0, role, flips(stay)))
            for h in (0, 1):
                for p in inside[h]:
                    self.ways.append((self._cell_bit(p), role, flips([(p,), *(((p, q) for q in outside[h]) if h == role else ())])))
            for p, q in combinations(inside[role], 2):
                self.ways.append((self._cell_bit(p) | self._cell_bit(q), role, flips([(p, q)])))

    def _cell_bit(self, p: int) -> int:
        return 1 << (p if p < HALF else p - HALF + self.bits)

    def cell(self, prints: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        return (prints & mask | (prints >> np.uint64(HALF) & mask) << np.uint64(self.bits)).astype(np.int32)

    @staticmethod
    def role(prints: np.ndarray) -> np.ndarray:
        return np.bitwise_count(prints) & 1

    def sent(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells that hold variants of each fingerprint: (cell, fingerprint)."""
        own, role = self.cell(prints), self.role(prints)
        parts = [(own[m] ^ np.int32(d), prints[m]) for d, r, _ in self.ways for m in [role == r]]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def links(self, cells: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Pairs (n x 2) that tie together what is within 3 bits, of fingerprints sent to these cells."""
        if not len(prints):
            return np.zeros((0, 2), np.uint64)
        differs, role = cells ^ self.cell(prints), self.role(prints)
        size = sum(len(f) * int(((differs == d) & (role == r)).sum()) for d, r, f in self.ways)
        pieces = -(-size // SORT)
        found = []
        for piece in range(pieces):  # more than one only for a crowded cell: the same variants, a share at a time
            v, who, dist = [], [], []
            for d, r, f in self.ways:
                own = np.flatnonzero((differs == d) & (role == r))
                for i in range(0, len(own), max(1, SORT // len(f))):
                    some = own[i : i + max(1, SORT // len(f))]
                    value = (prints[some][:, None] ^ f).reshape(-1)
                    p, k = np.repeat(some, len(f)), np.tile(np.bitwise_count(f), len(some))
                    if pieces > 1:
                        keep = (value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(pieces) == piece
                        value, p, k = value[keep], p[keep], k[keep]
                    v.append(value)
                    who.append(p)
                    dist.append(k)
            v, who, dist = np.concatenate(v), np.concatenate(who), np.concatenate(dist)
            order = np.argsort(v)
            same = v[order][1:] == v[order][:-1]
            run = np.zeros(len(v), bool)
            run[1:] |= same
            run[:-1] |= same
            order = order[run]
            if not len(order):
                continue
            v, who, dist = v[order], prints[who[order]], dist[order]
            order = np.lexsort((who, dist, v))
            v, who, dist = v[order], who[order], dist[order]
            first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            centre = np.repeat(first, np.diff(np.r_[first, len(v)]))
            pairs = np.stack([who[centre], who], 1)[dist[centre] < 2]
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 3]
            found.append(np.unique(pairs, axis=0))
        return _forest(np.unique(np.concatenate(found), axis=0)) if found else np.zeros((0, 2), np.uint64)


def _forest(pairs: np.ndarray) -> np.ndarray:
    """The pairs that join what earlier ones did not."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    keep = []
    for i, (a, b) in enumerate(pairs.tolist()):
        if (ra := root(a)) != (rb := root(b)):
            parent[max(ra, rb)] = min(ra, rb)
            keep.append(i)
    return pairs[keep]


def cell_bits(n: int) -> int:
    """Bits of a cell from each half for ``n`` fingerprints; the same up to 33 million, so that what is sent grows with n."""
    return int(min(14, max(CELL_BITS, np.ceil(np.log2(max(n, 1) / CELL) / 2))))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within 3 bits of each other."""
    spark = prints.sparkSession
    n = prints.count()
    ball = Ball(cell_bits(n))

    def send(batches):
        for b in batches:
            p = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(p), 4096):
                cells, sent = ball.sent(p[i : i + 4096])
                yield shared.batch(_SENT, cells, sent.view(np.int64))

    def meet(batches):
        cells, prints = np.zeros(0, np.int32), np.zeros(0, np.uint64)
        for b in batches:
            cells = np.concatenate([cells, b.column(0).to_numpy()])
            prints = np.concatenate([prints, b.column(1).to_numpy().view(np.uint64)])
            if len(cells) >= 1 << 15:  # all cells but the last are complete
                cut = int(np.searchsorted(cells, cells[-1]))
                if cut:
                    pairs = ball.links(cells[:cut], prints[:cut])
                    yield shared.batch(_EDGE, pairs[:, 0].copy().view(np.int64), pairs[:, 1].copy().view(np.int64))
                    cells, prints = cells[cut:], prints[cut:]
        pairs = ball.links(cells, prints)
        yield shared.batch(_EDGE, pairs[:, 0].copy().view(np.int64), pairs[:, 1].copy().view(np.int64))

    sent = prints.select("fingerprint").mapInArrow(send, "cell int, fingerprint long")
    dealt = sent.repartition(shared.parallelism(spark), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(shared.lean(meet), "a long, b long")


def _least_of_components(distinct: DataFrame) -> DataFrame:
    """(fingerprint, least): the smallest ``first`` of the component, for a table (fingerprint, first) of distinct fingerprints."""
    label = shared.materialise(graph.components(links(distinct)))
    linked = label.join(distinct, label["node"] == distinct["fingerprint"]).select("node", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = label.join(least, "root").select(F.col("node").alias("fingerprint"), "least")
    of = distinct.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("least", "first").alias("least"))
    return shared.materialise(of)  # so that a join of all rows stands alone and Spark can split those of a common fingerprint


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id reachable by links of 3 bits."""
    rows = shared.materialise(fingerprints(docs, words))
    distinct = shared.materialise(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    rows = rows.join(_least_of_components(distinct), "fingerprint")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))
