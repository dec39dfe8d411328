"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut. Packing looks
at the *histogram* of piece lengths, which has at most ``capacity`` rows however large the corpus is:

1. Reduction. For each length, longest first, among the sets of remaining pieces that fit with it, a
   set that dominates all the others (it can take their place in any solution) is fixed for good:
   the piece alone; the piece and its largest partner; or the piece and two partners.
   A step fixes as many equal sets at once as there are pieces.
2. Best fit. What is left goes, longest first, to the fullest sequence that still has room.

The result is a list of patterns (lengths in a sequence, number of such sequences). Then every piece
takes, by its number among pieces of the same length, a place in the patterns. The numbers come from
counts of (length, salt), so equal lengths never meet in one task.

Defined results: a null text is empty (one piece with the end id); a null doc_id and repeated rows are
documents of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .tokens import BLOCK, encoder

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

Pattern = tuple[tuple[int, ...], int]


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fixed patterns and the lengths that remain, with their counts."""
    left = {s: n for s, n in counts.items() if n > 0}
    fixed: list[Pattern] = []
    changed = True
    while changed and left:
        changed = False
        for size in sorted(left, reverse=True):
            while left.get(size):
                found = _dominating(size, left, capacity)
                if found is None:
                    break
                need = Counter(found)
                times = min(left[s] // k for s, k in need.items())
                fixed.append((found, times))
                for s, k in need.items():
                    left[s] -= k * times
                    if not left[s]:
                        del left[s]
                changed = True
    return fixed, left


def _dominating(size: int, left: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """A set with ``size`` that dominates every other feasible one, if sets of up to three show it."""
    room = capacity - size
    have = lambda s: left[s] - (s == size)  # noqa: E731  what is left beside the piece itself
    fit = sorted((s for s in left if s <= room and have(s) > 0), reverse=True)
    if not fit:
        return (size,)
    best = fit[0]
    if best == room:
        return (size, best)
    small = [s for s in reversed(fit) for _ in range(min(have(s), 3))][:3]
    if len(small) < 2 or small[0] + small[1] > room:
        return (size, best)  # one partner at most: the largest
    if len(small) > 2 and sum(small) <= room:
        return None  # more than two partners may fit
    pair, second = 0, 0  # the largest sum of two partners; the largest smaller one of two
    top = None
    j = len(fit) - 1
    for a in fit:  # partners a >= b: as a falls, the largest b that fits rises
        while j > 0 and fit[j - 1] + a <= room:
            j -= 1
        b = fit[j] if fit[j] + a <= room else None
        if b is not None and b >= a:
            b = a if have(a) > 1 and 2 * a <= room else next((s for s in fit if s < a and s + a <= room), None)
        if b is None:
            continue
        if a + b > pair:
            pair, top = a + b, (a, b)
        second = max(second, b)
    if top is None or best >= pair:
        return (size, best)
    if top[0] == best and second <= top[1]:
        return (size, *top)
    return None


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts; equal sequences are handled together."""
    open_: dict[int, list[list]] = {}  # room left: [lengths, number of sequences]
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            room = min((r for r in open_ if r >= size), default=None)
            if room is None:
                groups, room = [[(), -(-n // (capacity // size))]], capacity
            else:
                groups = open_.pop(room)
            rest = []
            for lengths, many in groups:
                each = room // size
                full = min(many, n // each)
                if full:
                    open_.setdefault(room - each * size, []).append([(*lengths, *[size] * each), full])
                    n -= full * each
                over = many - full
                if over and n:  # fewer than ``each`` pieces are left
                    open_.setdefault(room - n * size, []).append([(*lengths, *[size] * n), 1])
                    over, n = over - 1, 0
                if over and lengths:
                    rest.append([lengths, over])
            if rest:
                open_.setdefault(room, []).extend(rest)
    return [(lengths, many) for groups in open_.values() for lengths, many in groups]


def pack_lengths(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns (lengths, number of sequences) that hold all pieces."""
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first piece number, first sequence, offset, pieces in a row of the same sequence.

    Entry i covers piece numbers from ``first[i]`` on; each of its sequences holds one piece at ``offset[i]``.
    """
    out: dict[int, list[tuple[int, int, int]]] = {}
    number: Counter = Counter()
    sequence = 0
    for lengths, many in patterns:
        at = 0
        for s in lengths:
            out.setdefault(s, []).append((number[s], sequence, at))
            number[s] += many
            at += s
        sequence += many
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for s, rows in out.items()}


def split_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 0, capacity: int = 2048, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): pieces of whole texts; ids as little-endian u4."""

    shared.ship(docs.sparkSession)

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            doc, text = b.column(0).to_pylist(), b.column(1)
            _, offsets = shared.utf8(text)
            for i, k in shared.blocks(offsets, BLOCK):
                ids, cuts = enc.encode_block([t or "" for t in text[i:k].to_pylist()])
                if end_id is not None:
                    ids, cuts = np.insert(ids, cuts[1:], end_id), cuts + np.arange(len(cuts))
                rows = []
                for d, first, last in zip(doc[i:k], cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    for p, at in enumerate(range(first, last, capacity)):
                        part = ids[at : min(at + capacity, last)]
                        rows.append((d, p, at - first, len(part), zlib.crc32(part), part.tobytes() if with_ids else None))
                if rows:
                    yield shared.batch(_PIECES, *zip(*rows, strict=True))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(shared.lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (any columns, with a ``length`` from 1 to ``capacity``); own columns of these names are replaced.

    ``pieces`` must be a table that reads the same way each time: pieces are told apart by their place in the scan.
    """
    spark = pieces.sparkSession
    salts = 4 * shared.parallelism(spark)
    pieces = pieces.drop("sequence_id", "offset")
    kept = pieces.columns
    uid, salt, n, number = (shared.fresh(pieces, c) for c in ("uid", "salt", "n", "number"))
    salted = pieces.withColumn(uid, F.monotonically_increasing_id()).withColumn(salt, F.pmod(F.xxhash64(uid), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", salt).agg(F.count("*").alias(n))
    histogram = {int(r["length"]): int(r["n"]) for r in groups.groupBy("length").agg(F.sum(n).alias("n")).collect()}  # at most ``capacity`` rows
    at = places(pack_lengths(histogram, capacity))
    ahead = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", salt, F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(n))
    in_group = Window.partitionBy("length", salt).orderBy(uid)
    numbered = salted.withColumn(number, F.row_number().over(in_group) - 1).join(groups, ["length", salt])
    numbered = numbered.select((F.col(number) + F.col(n)).alias(number), *kept)

    def place(batches):
        for b in batches:
            length, number = b.column(1 + kept.index("length")).to_numpy(), b.column(0).to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                mine = length == s
                first, sequence, offset = at[int(s)]
                i = np.searchsorted(first, number[mine], "right") - 1
                seq[mine], off[mine] = sequence[i] + number[mine] - first[i], offset[i]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(seq), pa.array(off)], names=[*kept, "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(place, schema)
