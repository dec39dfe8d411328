"""Exact removal of repeated substrings: suffix arrays over the places where documents can repeat.

A byte goes if a string of LENGTH bytes that covers it also starts earlier in the corpus: in a smaller
doc_id or earlier in the same document. Every window of LENGTH bytes has an anchor, its GRAM-byte string of
smallest hash (the first, if several), which depends on the window's bytes only. So equal windows meet at
equal anchors, and one position in about 39 is an anchor.

1. Each task reduces its texts to anchors: the run of windows that share it, hashes of the bytes those windows
   span (their *context*), and of the bytes on either side. Of equal contexts in a task only the earliest goes
   on; the windows of the others are repeats already.
2. By anchor hash: of equal contexts the earliest stays and the others are repeats. An anchor whose contexts are
   all alike, or that stands once, is done with. Different contexts can share a window only if they agree on
   half the bytes beside the anchor, to the left or to the right; those that do are fetched. An anchor that has many
   contexts is never gathered: a task that finds more than ``hot`` of them in its texts sends them by context instead, so that equal
   ones still meet, and one mark by anchor, so that contexts from other tasks follow. Contexts of such anchors, and
   of any with more than ``crowd`` to fetch, meet again by anchor and left side and by anchor and right side.
3. The fetched contexts are sorted: a suffix array by two-stage sorting for each bundle of whole anchors (or anchors and sides), then
   common prefixes of neighbours. Runs of neighbours that share LENGTH bytes are equal windows; all but the
   earliest are repeats. A bundle of more than ``crowd`` contexts is dealt out by window instead, equal windows
   to the same task, after the same reduction to the earliest in each task, and then sorted the same way.
4. The repeats of a document are joined to its text and cut out.

Most repeats of exact copies and long passages are found in steps 1 and 2, by equal contexts; the suffix array tells the
windows that differing contexts share, which are compared byte by byte. That contexts, or windows of a bundle
dealt out, are equal is decided by two independent 64-bit hashes of all their bytes.

Rows are known by their place in the scan, so ``docs`` must be a table that reads the same way each time.
Defined results: a null text is empty; a null doc_id comes before all others; rows that repeat a doc_id
are documents of their own, the first in the scan the earliest; texts shorter than LENGTH lose nothing; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, suffix
from .words import mix, span_hashes

LENGTH, GRAM = 100, 24
#: Windows that share an anchor start at most REACH - 1 bytes before it; HALF: bytes on a side that two contexts must agree on.
REACH = LENGTH - GRAM + 1
HALF = REACH // 2
_PLACE = np.uint64((1 << 30) - 1)
_VALUES = [np.random.default_rng(s).integers(1, 2**63, 256, dtype=np.uint64) for s in (21, 22)]
#: Kinds of rows: a repeat; a context; a context of an anchor that is not gathered; the mark of such an anchor.
SPAN, ANCHOR, CROWD, MARK = range(4)
_ANCHORS = pa.schema([("key", pa.int64()), ("kind", pa.int8()), ("doc", pa.int64()), ("uid", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("context", pa.int64()), ("other", pa.int64()), ("left", pa.int32()), ("right", pa.int32()), ("anchor", pa.int64())])
_ANCHOR_DDL = "key long, kind byte, doc long, uid long, start int, end int, context long, other long, left int, right int, anchor long"
_FOUND = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("doc", pa.int64()), ("uid", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("left", pa.int32()), ("right", pa.int32())])
_FOUND_DDL = "kind byte, key long, doc long, uid long, start int, end int, left int, right int"
_ASKED = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("uid", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("crowded", pa.bool_())])
_ASKED_DDL = "key long, doc long, uid long, start int, end int, crowded boolean"
_CONTEXTS = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("doc", pa.int64()), ("uid", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("bytes", pa.binary())])
@dataclass(frozen=True)
class Limits:
    """What bounds a task's memory; results do not depend on them.

    hot: contexts of an anchor in one reduction from which it is not gathered; crowd: contexts in a bundle from which it is dealt
    out; held: rows of one key that a task holds; reduce: bytes of text whose anchors are reduced together; sort: bytes of
    contexts that one suffix array sorts; chunk: bytes of text in one vectorised step.
    """

    hot: int = 2000
    crowd: int = 2000
    held: int = 1 << 18
    reduce: int = 12 << 20
    sort: int = 1 << 20
    chunk: int = shared.CHUNK_BYTES


_SPANS = pa.schema([("uid", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring keys."""
    n = len(keys) - width + 1
    size = -(-len(keys) // width) * width
    whole = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    whole[: len(keys)] = keys
    whole = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(whole, axis=1).reshape(-1)
    behind = np.minimum.accumulate(whole[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor, in pieces of text that end at ``ends``.

    (first window, last window, anchor, hashes of anchor, context, context again, left side, right side); places are in ``data``.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64, np.int32, np.int32))
    if len(data) < LENGTH:
        return none
    one, two = (v[data] for v in _VALUES)
    at = np.arange(len(data) - GRAM + 1)
    grams = span_hashes(one, at, at + GRAM)
    least = _least(grams & ~_PLACE | at.astype(np.uint64), REACH)
    starts = np.r_[0, ends[:-1]]
    piece = np.repeat(np.arange(len(ends)), ends - starts)[: len(least)]
    good = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends[piece])
    if not len(good):
        return none
    anchor = (least[good] & _PLACE).astype(np.int64)
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1] + 1)]
    first = good[new]
    last = good[np.r_[np.flatnonzero(new)[1:] - 1, len(good) - 1]]
    anchor = anchor[new]
    low, high = starts[piece[first]], ends[piece[first]]
    context, other = (span_hashes(values, first, last + LENGTH) for values in (two, one))
    context = mix(context + (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (last - first).astype(np.uint64))
    sides = []
    for a, b in ((anchor - HALF, anchor), (anchor + GRAM, anchor + GRAM + HALF)):
        there = (a >= low) & (b <= high)
        side = np.zeros(len(anchor), np.int32)  # 0: the text ends before
        side[there] = (span_hashes(two, a[there], b[there]) >> np.uint64(34)).astype(np.int32) | 1
        sides.append(side)
    return first, last, anchor, grams[anchor], context, other, *sides


def _earliest(same: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which rows are the first, by ``order``, of those equal in ``same``."""
    n = len(same[0])
    keep = np.ones(n, bool)
    by = np.argsort(same[0], kind="stable")
    tied = np.zeros(n, bool)
    equal = same[0][by][1:] == same[0][by][:-1]
    tied[1:] |= equal
    tied[:-1] |= equal
    some = by[tied]
    if len(some):
        some = some[np.lexsort([c[some] for c in (*order[::-1], *same[::-1])])]
        keep[some[1:][np.logical_and.reduce([c[some][1:] == c[some][:-1] for c in same])]] = False
    return keep


def _documents(docs: DataFrame) -> DataFrame:
    """(uid, doc, text): uid is the row's place in the scan; a null doc_id is the smallest."""
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col("text").cast("string").alias("text"))


def _pieces(offsets: np.ndarray, chunk: int):
    """(first row, last row, first byte, end) of blocks; a longer text comes in parts that share LENGTH - 1 bytes."""
    for i, k in shared.blocks(offsets, chunk):
        a, b = int(offsets[i]), int(offsets[k])
        if k > i + 1 or b - a <= chunk + LENGTH:
            yield i, k, a, b
        else:
            for x in range(a, b - LENGTH + 1, chunk):
                yield i, k, x, min(b, x + chunk + LENGTH - 1)


def _read_anchors(batches, limits: Limits):
    held, size = [], 0

    def reduced():
        anchor, doc, uid, start, end, context, other, left, right = (np.concatenate(c) for c in zip(*held, strict=True))
        keep = _earliest((context, other), (doc, uid, start))
        key, kind = anchor.copy(), keep.astype(np.int8)
        names, where, many = np.unique(anchor[keep], return_inverse=True, return_counts=True)
        crowd = np.flatnonzero(keep)[many[where] > limits.hot]
        kind[crowd], key[crowd] = CROWD, mix(context[crowd].view(np.uint64)).view(np.int64)
        span = ~keep
        key[span] = mix(np.arange(len(key), dtype=np.uint64)[span]).view(np.int64)  # repeats only pass through: anywhere
        yield shared.batch(_ANCHORS, key, kind, doc, uid, start, end, context, other, left, right, anchor)
        marks = names[many > limits.hot]
        if len(marks):
            nil = np.zeros(len(marks), np.int64)
            yield shared.batch(_ANCHORS, marks, nil + MARK, *[nil] * 8, marks)

    for b in batches:
        uid, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
        data, offsets = shared.utf8(b.column(2))
        for i, k, x, y in _pieces(offsets, limits.chunk):
            ends = np.minimum(offsets[i + 1 : k + 1], y) - x
            first, last, _, gram, context, other, left, right = anchors(data[x:y], ends)
            row = np.searchsorted(ends, first, "right")
            base = offsets[i:k][row] - x
            held.append((gram.view(np.int64), doc[i:k][row], uid[i:k][row], (first - base).astype(np.int32), (last + LENGTH - base).astype(np.int32), context.view(np.int64), other.view(np.int64), left, right))
            size += y - x
            if size >= limits.reduce:
                yield from reduced()
                held, size = [], 0
    if held:
        yield from reduced()


def _by_key(batches, held_rows: int):
    """(columns, key or None) of rows sorted by the first column, cut between its values; a value with more than
    ``held_rows`` rows comes in several parts, and is named with each."""
    held, n, long = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        n += b.num_rows
        if n < min(held_rows, 1 << 16):
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        long = long if cols[0][0] == long else None
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            yield [c[:cut] for c in cols], long
            cols, long = [c[cut:] for c in cols], None
        if len(cols[0]) >= held_rows:
            long = cols[0][0]
            yield cols, long
            cols = [c[:0] for c in cols]
        held, n = [cols], len(cols[0])
    if n:
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        yield cols, long if cols[0][0] == long else None


def _meet(batches, limits: Limits):
    """Of equal contexts of an anchor the earliest stays; contexts that may share windows are asked for."""
    for (key, kind, doc, uid, start, end, context, other, left, right, anchor), long in _by_key(batches, limits.held):
        gone = kind == SPAN
        some = np.flatnonzero((kind == ANCHOR) | (kind == CROWD))
        keep = _earliest((context[some], other[some]), (doc[some], uid[some], start[some]))
        gone[some[~keep]] = True
        z = np.flatnonzero(gone)
        if len(z):
            nil = np.zeros(len(z), np.int32)
            yield shared.batch(_FOUND, nil.astype(np.int8) + SPAN, key[z], doc[z], uid[z], start[z], end[z], nil, nil)
        some = some[keep]
        hot = (kind[some] == CROWD) | np.isin(key[some], key[kind == MARK])
        if long is not None:
            hot |= key[some] == long
        near = some[~hot]
        wanted = np.zeros(len(near), bool)
        for side in (left[near], right[near]):
            code = mix(key[near].view(np.uint64) * np.uint64(3) + side.astype(np.uint64))
            _, where, many = np.unique(code, return_inverse=True, return_counts=True)
            wanted |= (many[where] > 1) & (side != 0)
        near = near[wanted]
        _, where, many = np.unique(key[near], return_inverse=True, return_counts=True)
        over = many[where] > limits.crowd if len(near) else np.zeros(0, bool)
        for z, k in ((near[~over], ANCHOR), (np.r_[near[over], some[hot]], CROWD)):
            if len(z):
                yield shared.batch(_FOUND, np.full(len(z), k, np.int8), anchor[z], doc[z], uid[z], start[z], end[z], left[z], right[z])


def _by_side(batches):
    """Contexts by anchor and left side, and by anchor and right side."""
    for b in batches:
        key, doc, uid, start, end, left, right = (b.column(c).to_numpy() for c in range(7))
        for turn, side in enumerate((left, right)):
            z = np.flatnonzero(side != 0)
            code = mix(key[z].view(np.uint64) * np.uint64(5) + np.uint64(2) * side[z].astype(np.uint64) + np.uint64(turn))
            yield shared.batch(_ASKED, code.view(np.int64), doc[z], uid[z], start[z], end[z], np.zeros(len(z), bool))


def _sides_met(batches, limits: Limits):
    """The contexts that share a side with another; those of large bundles are marked."""
    for (key, doc, uid, start, end, _), long in _by_key(batches, limits.held):
        _, where, many = np.unique(key, return_inverse=True, return_counts=True)
        many = many[where] if len(key) else many
        crowded = many > limits.crowd
        if long is not None:
            crowded |= key == long
        z = np.flatnonzero((many > 1) | crowded)
        yield shared.batch(_ASKED, key[z], doc[z], uid[z], start[z], end[z], crowded[z])


def _deal(batches, limits: Limits):
    """Contexts of ordinary bundles go on as they are; those of crowded ones as single windows, the earliest of equal ones."""

    def windows(rows):
        rows = list({(r[2], r[3]): r for r in rows}.values())  # a context may come by both of its sides
        data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        size = np.array([len(r[5]) for r in rows])
        base = np.cumsum(size) - size
        n = size - LENGTH + 1
        of = np.repeat(np.arange(len(rows)), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        place = base[of] + at
        key, other = (span_hashes(v[data], place, place + LENGTH) for v in _VALUES[::-1])
        doc, uid, start = (np.array([r[c] for r in rows])[of] for c in (1, 2, 3))
        start = start + at
        keep = _earliest((key, other), (doc, uid, start))
        for mask, kind in ((~keep, SPAN), (keep, ANCHOR)):
            z = np.flatnonzero(mask)
            for a in range(0, len(z), 1 << 14):
                s = z[a : a + (1 << 14)]
                text = [data[p : p + LENGTH].tobytes() if kind == ANCHOR else None for p in place[s].tolist()]
                yield shared.batch(_CONTEXTS, np.full(len(s), kind, np.int8), key[s].view(np.int64), doc[s], uid[s], start[s].astype(np.int32), (start[s] + LENGTH).astype(np.int32), text)

    crowd, size = [], 0
    for b in batches:
        plain = b.filter(pa.array(~b.column(6).to_numpy(zero_copy_only=False), pa.bool_()))
        if plain.num_rows:
            yield shared.batch(_CONTEXTS, np.full(plain.num_rows, ANCHOR, np.int8), *(plain.column(c) for c in range(6)))
        many = b.filter(b.column(6))
        for r in zip(*(many.column(c).to_pylist() for c in range(6)), strict=True):
            crowd.append(r)
            size += len(r[5])
            if size >= limits.sort:
                yield from windows(crowd)
                crowd, size = [], 0
    if crowd:
        yield from windows(crowd)


def repeated_windows(contexts: list[bytes], doc: np.ndarray, uid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, place) of windows of LENGTH bytes that also stand earlier, by suffix array and common prefixes."""
    size = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    of = np.repeat(np.arange(len(contexts)), size)
    text = np.zeros(len(data) + len(contexts), np.int16)
    text[np.arange(len(data)) + of] = data.astype(np.int16) + 1  # 0 parts the contexts
    base = np.cumsum(size + 1) - (size + 1)
    order = suffix.suffix_array(text, LENGTH)
    ctx = np.searchsorted(base, order, "right") - 1
    inside = order - base[ctx]
    valid = inside + LENGTH <= size[ctx]
    order, ctx, inside = order[valid], ctx[valid], inside[valid]
    common = suffix.common_prefixes(text, order, LENGTH)
    group = np.cumsum(common < LENGTH)
    place = start[ctx] + inside
    later = np.lexsort((place, uid[ctx], doc[ctx], group))
    ctx, inside, group, place = ctx[later], inside[later], group[later], place[later]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    first = np.repeat(first, np.diff(np.r_[first, len(group)]))
    again = (place != place[first]) | (uid[ctx] != uid[ctx[first]])  # a context may be given twice
    return ctx[again], inside[again]


def merged(uid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each uid with overlapping and touching ones joined, sorted."""
    by = np.lexsort((start, uid))
    uid, start, end = uid[by], start[by].astype(np.int64), end[by].astype(np.int64)
    if not len(uid):
        return uid, start, end
    number = np.cumsum(np.r_[True, uid[1:] != uid[:-1]])
    top = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * top)  # each uid's places lie above those of the one before
    new = np.r_[True, start[1:] + number[1:] * top > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(uid) - 1]
    return uid[new], start[new], reach[last] - number[last] * top


def _sort(batches, limits: Limits):
    rows, size = [], 0

    def spans(rows):
        ctx, at = repeated_windows([r[4] for r in rows], *(np.array([r[c] for r in rows], np.int64) for c in (1, 2, 3)))
        uid, start = np.array([r[2] for r in rows])[ctx], np.array([r[3] for r in rows])[ctx] + at
        return shared.batch(_SPANS, *(x.astype(t) for x, t in zip(merged(uid, start, start + LENGTH), (np.int64, np.int32, np.int32), strict=True)))

    for b in batches:
        done = b.filter(pa.array(b.column(0).to_numpy() == SPAN))
        if done.num_rows:
            yield shared.batch(_SPANS, *(x.astype(t) for x, t in zip(merged(*(done.column(c).to_numpy() for c in (3, 4, 5))), (np.int64, np.int32, np.int32), strict=True)))
        b = b.filter(pa.array(b.column(0).to_numpy() == ANCHOR))
        for r in zip(*(b.column(c).to_pylist() for c in (1, 2, 3, 4, 6)), strict=True):
            if size >= limits.sort and r[0] != rows[-1][0]:
                yield spans(rows)
                rows, size = [], 0
            rows.append(r)
            size += len(r[4])
    if rows:
        yield spans(rows)


def repeated_spans(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(uid, spans): for each row of ``docs`` that has any, the byte ranges to remove (may overlap)."""
    spark = docs.sparkSession
    parts = shared.parallelism(spark)
    texts = _documents(docs)
    run = lambda step: shared.lean(partial(step, limits=limits))
    found = texts.select("uid", "doc", "text").mapInArrow(run(_read_anchors), _ANCHOR_DDL).repartition(parts, "key").sortWithinPartitions("key")
    found = shared.materialise(found.mapInArrow(run(_meet), _FOUND_DDL))
    shared.release(spark)
    crowd = found.where(f"kind = {CROWD}").select("key", "doc", "uid", "start", "end", "left", "right").mapInArrow(shared.lean(_by_side), _ASKED_DDL)
    crowd = crowd.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run(_sides_met), _ASKED_DDL)
    asked = found.where(f"kind = {ANCHOR}").select("key", "doc", "uid", "start", "end", F.lit(False).alias("crowded")).union(crowd)
    bytes_ = texts.select("uid", F.col("text").cast("binary").alias("b")).where(f"octet_length(b) >= {LENGTH}")
    got = asked.join(bytes_, "uid").select("key", "doc", "uid", "start", "end", F.expr("substring(b, start + 1, end - start)").alias("bytes"), "crowded")
    dealt = got.mapInArrow(run(_deal), "kind byte, key long, doc long, uid long, start int, end int, bytes binary").repartition(parts, "key").sortWithinPartitions("key")
    more = shared.materialise(dealt.mapInArrow(run(_sort), "uid long, start int, end int"))
    shared.release(spark)
    spans = found.where(f"kind = {SPAN}").select("uid", "start", "end").union(more)
    return spans.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left, and the maximal removed runs."""
    if not spans:
        return text, []
    start, end = np.array(spans, np.int64).T
    _, start, end = merged(np.zeros(len(start), np.int64), start, end)
    edges = [0, *np.stack([start, end], 1).reshape(-1).tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), list(zip(start.tolist(), end.tolist(), strict=True))


def _with_spans(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``docs`` and, as the last column, the spans of each row."""
    uid, name = shared.fresh(docs, "uid"), shared.fresh(docs, "spans")
    spans = repeated_spans(docs, limits).select(F.col("uid").alias(uid), F.col("spans").alias(name))
    rows = docs.withColumn(uid, F.monotonically_increasing_id())
    return rows.join(spans, uid, "left").select(*docs.columns, name)


def _pairs(cell) -> list[tuple[int, int]]:
    return [(s["start"], s["end"]) for s in cell.as_py()] if cell.is_valid else []


def digests(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for text, cell in zip(b.column(1), b.column(2), strict=True):
                whole = text.as_buffer().to_pybytes() if text.is_valid else b""
                left, runs = cut(whole, _pairs(cell))
                rows.append((len(whole), len(whole) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
            if rows:
                yield shared.batch(schema, b.column(0), *zip(*rows, strict=True))

    rows = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), limits)
    return rows.mapInArrow(shared.lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeats cut out of ``text``, all columns; a character that loses bytes goes whole."""
    rows = _with_spans(docs.withColumn("text", F.col("text").cast("string")))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = []
            for text, cell in zip(b.column(at), b.column(b.num_columns - 1), strict=True):
                texts.append(None if not text.is_valid else text.as_py() if not cell.is_valid else cut(text.as_buffer().to_pybytes(), _pairs(cell))[0].decode("utf-8", "ignore"))
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return rows.mapInArrow(shared.lean(run), T.StructType(rows.schema.fields[:-1]))
