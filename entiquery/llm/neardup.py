"""Near-duplicate documents: SimHash links by ball hashing, and all that agrees to 0.8 in five-word shingles beyond them.

Two texts are alike if the Jaccard similarity of their five-word shingles is ``least`` or more. Equal texts are one class.

1. SimHash. Each class has the fingerprint of its five-word shingles. Ball hashing finds the fingerprints within 3 bits
   (module ``simhash``); each class is paired with the first one of its fingerprint, and those with each other along
   the links, and verified on all shingles: equal and almost equal texts.
2. The rest. Fingerprints of texts that agree to 0.8 differ in some ten bits, so links of 3 bits alone would lose most
   pairs near that bound. But two sets with that similarity share one of their first n - ceil(least * n) + 1 shingles, in any
   order of all shingles that is the same for every text. The order here is by the number of texts that hold a shingle, rarest
   first, counted over all texts. What stands in one text alone leads nowhere, so a text whose prefix is all its own has
   no partner; the others send the rest of their prefix, texts that share a shingle there meet, and no pair is lost.
   Where the shared shingle stands in both and how many shingles there are bounds what two texts can have in common, and so
   do SIGNATURE parities of each text's shingles: every parity that differs stands for a shingle that one of the two lacks. Pairs that
   cannot reach ``least`` by these bounds go at once, all others are verified on all their shingles (64-bit hashes). First each class
   is paired, at every shingle where it meets others, with its neighbours by size and in a random order; with the links
   of step 1 that makes groups. Then every other pair that meets and is in different groups yet is verified too, and groups are final.
3. Of each group the smallest doc_id stays.

Shingles travel in blocks by hash: 14 bytes each to be counted, and only those of two texts or more come back. A task holds one
block of about HELD shingles, or the classes that meet at one shingle (some 100 bytes each). A shingle at which more than BIG meet (a large
family) is split: first into random parts, others for each order; in the end its largest group is dealt out over parts, and all
others stand in each of them. Nothing is collected.

Defined results: a null text is empty; texts without words are alike; texts of fewer than five words have one
shingle, the whole; a null doc_id comes before all others; an empty table gives no rows; further columns are kept,
whatever their names. ``docs`` must be a table that reads the same way each time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, shared, simhash
from .features import SOLID
from .words import gram_hashes, hash_words

WORDS, SIMILARITY = 5, 0.8
#: Parities of a text's shingles.
SIGNATURE = 512
#: Shingles that a block holds on average, and that a task sorts into blocks at once.
HELD, SORT = 1 << 19, 1 << 19
#: Orders in which neighbours are paired before all pairs are.
ROUNDS = 2
#: Rows that met, and pairs, that are worked through together; rows at one shingle from which they are split.
MEET, BIG = 1 << 16, 1 << 18
_ROWS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("size", pa.int32()), ("print", pa.int64()), ("parity", pa.binary())])
_SENT = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("size", pa.int32()), ("place", pa.int32())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_BLOCK = pa.schema([("bucket", pa.int32()), ("text", pa.binary()), ("gram", pa.binary()), ("held", pa.binary())])
_BLOCK_DDL = "bucket int, text binary, gram binary, held binary"
_MARKS = pa.schema([("id", pa.int64()), ("marks", pa.binary())])


def sketch(words: np.ndarray) -> bytes:
    """The hashes of all distinct shingles, sorted, 8 bytes each."""
    if not len(words):
        return b""
    return np.unique(gram_hashes(words, min(WORDS, len(words)))).tobytes()


def similarity(a: bytes | memoryview, b: bytes | memoryview) -> float:
    """Jaccard similarity of two sketches."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.sort(np.concatenate([x, y]))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def parities(grams: np.ndarray) -> bytes:
    """For each of SIGNATURE classes of distinct shingles whether their number is odd."""
    return np.packbits(np.bincount((grams % np.uint64(SIGNATURE)).astype(np.int64), minlength=SIGNATURE) & 1).tobytes()


def _reach(least: float) -> float:
    """``least`` with room for rounding; the same for prefixes, bounds and verification."""
    return least - 1e-9


def prefix_size(n: np.ndarray, least: float) -> np.ndarray:
    """Of sets of n shingles, how many of the first, in any common order, suffice to share one with all that agree to ``least``."""
    return n - np.ceil(_reach(least) * n).astype(np.int64) + 1


def may_agree(size_a: np.ndarray, place_a: np.ndarray, size_b: np.ndarray, place_b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets whose first shared shingle stands at these places can agree to ``least``."""
    needed = np.ceil(_reach(least) / (1 + _reach(least)) * (size_a.astype(np.int64) + size_b))
    return np.minimum(size_a - place_a, size_b - place_b) >= needed


def parity_allows(parity_a: np.ndarray, parity_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets with these parities (rows of 64-bit words) can agree to ``least``: no more parities differ than shingles may."""
    most = np.floor((1 - _reach(least)) / (1 + _reach(least)) * (size_a.astype(np.int64) + size_b) + 1e-6)
    return np.bitwise_count(parity_a ^ parity_b).sum(1, dtype=np.int64) <= most


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_hashes(text: pa.Array) -> np.ndarray:
    """(n x 2): 128 bits of each whole text."""
    from xxhash import xxh3_128_intdigest

    whole = [xxh3_128_intdigest((t or "").encode()) for t in text.to_pylist()]
    return np.array([(w & (1 << 64) - 1, w >> 64) for w in whole], np.uint64).reshape(-1, 2)


def describe(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, h1, h2, size, print, parity) of every row.

    h1 and h2 hash the whole text, size counts its shingles, print is the SimHash of them all, repeats included.
    """

    def run(batches):
        for b in batches:
            uid, doc, text = b.columns
            for (i, k, hashes, before), (_, _, prints) in zip(hash_words(text, word_bytes=SOLID), simhash.block_prints(text, WORDS), strict=True):
                grams = [np.frombuffer(sketch(hashes[a:c]), np.uint64) for a, c in zip(before, before[1:])]
                whole = text_hashes(text[i:k]).view(np.int64)
                yield shared.batch(_ROWS, uid[i:k], doc[i:k], whole[:, 0].copy(), whole[:, 1].copy(), [len(g) for g in grams], prints.view(np.int64), [parities(g) for g in grams])

    return _texts(docs).mapInArrow(shared.lean(run), "uid long, doc_id long, h1 long, h2 long, size int, print long, parity binary")


def _dealt(bucket: np.ndarray, *columns: np.ndarray):
    """Blocks of rows of one bucket each."""
    by = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[by], [c[by] for c in columns]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    cuts = np.r_[first, len(bucket)].tolist()
    blobs = [[c[i:k].tobytes() for i, k in zip(cuts, cuts[1:])] for c in columns]
    if len(first):
        yield shared.batch(_BLOCK, bucket[first].astype(np.int32), *blobs, *([None] * len(first) for _ in range(3 - len(columns))))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _blocks(batches, kinds: tuple):
    """The rows of each bucket, for blocks sorted by it: the bucket and arrays of ``kinds``, one a column."""
    held, now = [], None
    for b in batches:
        for bucket, *blobs in zip(b.column(0).to_pylist(), *map(shared.views, b.columns[1:]), strict=True):
            if held and bucket != now:
                yield now, *(np.frombuffer(b"".join(c), k) for c, k in zip(zip(*held, strict=True), kinds))
                held = []
            now = bucket
            held.append(blobs)
    if held:
        yield now, *(np.frombuffer(b"".join(c), k) for c, k in zip(zip(*held, strict=True), kinds))


def _short(hashes: np.ndarray) -> np.ndarray:
    """The lower 48 bits, 6 bytes each: what a bucket does not tell of a hash."""
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :6]


def _long(bucket: int, short: np.ndarray) -> np.ndarray:
    """A hash again, equal for equal ones: the lower bits, and the bucket above them."""
    whole = np.zeros((len(short) // 6, 8), np.uint8)
    whole[:, :6] = short.reshape(-1, 6)
    return whole.view(np.uint64).reshape(-1) | np.uint64(bucket << 48 & (1 << 64) - 1)


def shared_shingles(docs: DataFrame, buckets: int) -> DataFrame:
    """Blocks (bucket of the text, text: its h1, gram, held: by how many different texts) of all shingles of two texts or more."""
    parts = shared.parallelism(docs.sparkSession)

    def send(batches):
        texts, grams, many, seen = [], [], 0, set()
        for b in batches:
            for i, k, hashes, before in hash_words(b.column(2), word_bytes=SOLID):
                for t, a, c in zip(text_hashes(b.column(2)[i:k])[:, 0].tolist(), before, before[1:]):
                    if t in seen:  # a copy: the same again
                        continue
                    seen.add(t)
                    found = np.frombuffer(sketch(hashes[a:c]), np.uint64)
                    texts.append(np.full(len(found), t, np.uint64))
                    grams.append(found)
                    many += len(found)
                    if many >= SORT:
                        gram = np.concatenate(grams)
                        yield from _dealt(_bucket(gram, buckets), np.concatenate(texts), _short(gram))
                        texts, grams, many, seen = [], [], 0, set()
        if many:
            gram = np.concatenate(grams)
            yield from _dealt(_bucket(gram, buckets), np.concatenate(texts), _short(gram))

    def count(batches):
        out, many = [], 0
        for bucket, text, gram in _blocks(batches, (np.uint64, np.uint8)):
            gram = _long(bucket, gram)
            by = np.lexsort((text, gram))
            text, gram = text[by], gram[by]
            new = np.r_[True, (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])]
            text, gram = text[new], gram[new]
            first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            n = np.diff(np.r_[first, len(gram)])
            held = np.repeat(n, n)
            out.append([c[held > 1] for c in (text, gram, held)])
            many += len(out[-1][0])
            if many >= SORT:
                text, gram, held = (np.concatenate(c) for c in zip(*out, strict=True))
                yield from _dealt(_bucket(text, buckets), text, gram, held)
                out, many = [], 0
        if many:
            text, gram, held = (np.concatenate(c) for c in zip(*out, strict=True))
            yield from _dealt(_bucket(text, buckets), text, gram, held)

    sent = _texts(docs).mapInArrow(shared.lean(send), _BLOCK_DDL).select("bucket", "text", "gram")
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(shared.lean(count), _BLOCK_DDL)


def prefixes(classes: DataFrame, common: DataFrame, buckets: int, least: float) -> DataFrame:
    """(key, id, size, place): what each class sends of its prefix; ``common``: blocks of ``shared_shingles``."""
    parts = shared.parallelism(classes.sparkSession)

    def send(batches):
        for b in batches:
            h1, ids, size = (c.to_numpy() for c in b.columns)
            yield from _dealt(_bucket(h1.view(np.uint64), buckets), h1.view(np.uint64), ids, -1 - size.astype(np.int64))

    def run(batches):
        for _, text, gram, held in _blocks(batches, (np.uint64, np.uint64, np.int64)):
            own = held < 0  # a class: text, id and -1 - size
            by = np.argsort(text[own])
            texts, ids, size = text[own][by], gram[own][by].view(np.int64), -1 - held[own][by]
            text, gram, held = text[~own], gram[~own], held[~own]
            at = np.searchsorted(texts, text)
            by = np.lexsort((gram, held, at))
            at, gram = at[by], gram[by]
            many = np.bincount(at, minlength=len(texts))
            alone = size - many
            place = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + alone[at]
            some = place < prefix_size(size, least)[at]
            at, gram, place = at[some], gram[some], place[some]
            empty = np.flatnonzero(size == 0)  # texts without words meet at one key
            yield shared.batch(_SENT, np.r_[gram.view(np.int64), np.zeros(len(empty), np.int64)], np.r_[ids[at], ids[empty]], np.r_[size[at], size[empty]].astype(np.int32), np.r_[place, 0 * empty].astype(np.int32))

    own = classes.select("h1", "id", "size").mapInArrow(send, _BLOCK_DDL)
    both = own.union(common).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return both.mapInArrow(shared.lean(run), "key long, id long, size int, place int")


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """(a, b), a > b: each class with the first of its fingerprint, and the first ones of linked fingerprints."""
    centres = shared.materialise(classes.groupBy(F.col("print").alias("fingerprint")).agg(F.min("id").alias("centre")))
    own = classes.join(centres, classes["print"] == centres["fingerprint"]).where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b"))
    of = lambda c: centres.select(F.col("fingerprint").alias(c), F.col("centre").alias(f"id_{c}"))
    linked = simhash.links(centres).join(of("a"), "a").join(of("b"), "b").select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b"))
    return own.union(linked).distinct()


def _whole_keys(batches):
    """Columns of rows sorted by the first one, cut between its values."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        if held[0][0][0] == held[-1][0][-1] or sum(len(h[0]) for h in held) < MEET:
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        yield [c[:cut] for c in cols]
        held = [[c[cut:] for c in cols]]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def meetings(sent: DataFrame) -> DataFrame:
    """The rows (key, id, size, place) of ``sent`` whose key stands in another row too."""

    def meet(batches):
        for cols in _whole_keys(batches):
            same = cols[0][1:] == cols[0][:-1]
            met = np.r_[False, same] | np.r_[same, False]
            yield shared.batch(_SENT, *(c[met] for c in cols))

    sent = sent.repartition(shared.parallelism(sent.sparkSession), "key").sortWithinPartitions("key")
    return sent.mapInArrow(shared.lean(meet), "key long, id long, size int, place int")


def minority(key: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which rows are not of the most common root of their key."""
    by = np.lexsort((root, key))
    k, r = key[by], root[by]
    first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])]) if len(k) else np.zeros(0, np.int64)
    n = np.diff(np.r_[first, len(k)])
    top = np.lexsort((n, k[first]))  # the last of each key is its largest run
    largest = np.zeros(len(first), bool)
    if len(first):
        largest[top[np.r_[k[first][top][1:] != k[first][top][:-1], True]]] = True
    out = np.empty(len(k), bool)
    out[by] = ~np.repeat(largest, n)
    return out


def pairs_between(met: DataFrame, least: float, turn: int | None = None) -> DataFrame:
    """(a, b), a > b, repeats included: those of ``met`` (key, id, size, place, parity, root) that share a key, have different roots and may agree.

    All of them, or for a ``turn`` of each row the pair with the last one before it of another root: by size (0) or in a random order.
    """

    def paired(size, place, parity, ids, at, to):
        good = may_agree(size[at], place[at], size[to], place[to], least)
        at, to = at[good], to[good]
        good = parity_allows(parity[at], parity[to], size[at], size[to], least)
        x, y = ids[at[good]], ids[to[good]]
        return np.stack([np.maximum(x, y), np.minimum(x, y)], 1)

    def run(batches):
        for key, ids, size, place, root, parity in _whole_keys(batches):
            parity = np.frombuffer(b"".join(parity.tolist()), np.uint64).reshape(len(key), -1)
            if turn is not None:
                run_starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (root[1:] != root[:-1])])
                to = np.repeat(run_starts, np.diff(np.r_[run_starts, len(key)])) - 1
                at = np.flatnonzero((to >= 0) & (key[to] == key))
                pairs = np.unique(paired(size, place, parity, ids, at, to[at]), axis=0)
                yield shared.batch(_PAIR, pairs[:, 0].copy(), pairs[:, 1].copy())
                continue
            few, found, many = minority(key, root), [], 0
            for way in (1, -1):  # of two different roots one at least is not the key's most common: from there on, and back to those that are
                at, step = np.flatnonzero(few), 0
                while len(at):
                    step += way
                    at = at[(at + step >= 0) & (at + step < len(key))]
                    to = at + step
                    inside = (key[at] == key[to]) & (np.minimum(size[at], size[to]) >= _reach(least) * np.maximum(size[at], size[to]))  # sizes ascend within a key
                    at, to = at[inside], to[inside]
                    apart = (root[at] != root[to]) & ((way > 0) | ~few[to])
                    found.append(paired(size, place, parity, ids, at[apart], to[apart]))
                    many += len(found[-1])
                    if many >= MEET:
                        pairs = np.unique(np.concatenate(found), axis=0)
                        yield shared.batch(_PAIR, pairs[:, 0].copy(), pairs[:, 1].copy())
                        found, many = [], 0
            if many:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield shared.batch(_PAIR, pairs[:, 0].copy(), pairs[:, 1].copy())

    by = F.xxhash64("id", F.lit(turn)) if turn else F.col("size").cast("long")
    rows = split(met, turn).select("key", "id", "size", "place", "root", "parity", by.alias("by")).repartition(shared.parallelism(met.sparkSession), "key")
    rows = rows.sortWithinPartitions("key", "by", "id").drop("by")
    return rows.mapInArrow(shared.lean(run), "a long, b long")


def split(met: DataFrame, turn: int | None) -> DataFrame:
    """``met`` without keys at which all have one root; keys of more than BIG rows come in parts, as keys of their own.

    For a ``turn``, random parts. Else every two rows of different roots meet in some part, but for those of the largest root only one part each.
    """
    keys = met.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    met = met.join(keys.select("key", F.ceil(F.col("n") / BIG).cast("int").alias("parts")), "key")
    salt = F.pmod(F.xxhash64("id", F.lit(-1 if turn is None else turn)), F.col("parts")).cast("int")
    if turn is not None:
        own = F.array(salt)
    else:
        many = met.where("parts > 1").groupBy("key", "root").agg(F.count("*").alias("n"))
        met = met.join(many.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most")), "key", "left")
        own = F.when((F.col("parts") == 1) | (F.col("root") == F.col("most")), F.array(salt)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    met = met.withColumn("part", F.explode(own))
    return met.withColumn("key", F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", "part")))


def shingle_lists(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, marks): the sorted shingle hashes of the rows of ``docs`` named in ``wanted`` (id)."""

    def marks(batches):
        for b in batches:
            for i, k, hashes, before in hash_words(b.column(1), word_bytes=SOLID):
                yield shared.batch(_MARKS, b.column(0)[i:k], [sketch(hashes[a:c]) for a, c in zip(before, before[1:])])

    texts = _texts(docs).join(wanted.select(F.col("id").alias("uid")), "uid", "left_semi").select("uid", "text")
    return texts.mapInArrow(shared.lean(marks), "id long, marks binary")


def verified_pairs(pairs: DataFrame, lists: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingles, in ``lists`` (id, marks), agree to ``least``."""

    def run(batches):
        for x in batches:
            a, b = shared.views(x.column(2)), shared.views(x.column(3))
            keep = pa.array([similarity(s, t) >= _reach(least) for s, t in zip(a, b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], schema=_PAIR).filter(keep)

    of = lambda c: lists.select(F.col("id").alias(c), F.col("marks").alias(f"marks_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", "marks_a", "marks_b").mapInArrow(shared.lean(run), "a long, b long")


def without_near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs``, all columns, with one row of each group of near duplicates: the smallest doc_id's, the first in the scan."""
    spark = docs.sparkSession
    shared.ship(spark)
    rows = shared.materialise(describe(docs))
    classes = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "uid")).alias("first"), *(F.first(c).alias(c) for c in ("size", "print", "parity")))
    classes = shared.materialise(classes.select("h1", F.col("first.uid").alias("id"), "first", "size", "print", "parity"))
    shared.remove(rows)
    near = shared.materialise(fingerprint_pairs(classes))
    shared.release(spark)
    shingles = classes.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    buckets = max(shared.parallelism(spark), -(-shingles // HELD))
    common = shared.materialise(shared_shingles(docs, buckets))
    shared.release(spark)
    met = shared.materialise(meetings(prefixes(classes, common, buckets, least)).join(classes.select("id", "parity"), "id"))
    shared.release(spark)
    shared.remove(common)
    lists = shared.materialise(shingle_lists(docs, near.select(F.col("a").alias("id")).union(near.select("b")).union(met.select("id")).distinct()))
    tried, label = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, root long")

    def verify(pairs: DataFrame) -> None:
        """Groups grow by those of the pairs that are alike."""
        nonlocal tried, label
        pairs = shared.materialise(pairs.join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            return
        tried = tried.union(pairs)
        links = shared.materialise(verified_pairs(pairs, lists, least))
        if not links.isEmpty():
            label = shared.materialise(graph.components(links.union(label.select(F.col("node").alias("a"), F.col("root").alias("b")))))
        shared.release(spark)

    alone = met.withColumn("root", F.col("id"))
    verify(reduce(DataFrame.union, (pairs_between(alone, least, turn) for turn in range(ROUNDS)), near).distinct())
    grouped = met.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    verify(pairs_between(grouped, least).distinct())
    first = classes.select("id", "first")
    grouped = label.join(first, label["node"] == first["id"]).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.uid").alias("id"))
    lone = first.join(label.select(F.col("node").alias("id")), "id", "left_anti").select("id")
    uid = shared.fresh(docs, "uid")
    kept = shared.materialise(grouped.union(lone).select(F.col("id").alias(uid)))
    return docs.withColumn(uid, F.monotonically_increasing_id()).join(kept, uid, "left_semi").drop(uid)
