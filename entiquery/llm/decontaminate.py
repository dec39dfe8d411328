"""Benchmark decontamination: MinHash containment search by size, verified by exact shingles.

Containment of a short item in a long document says little about the similarity of the two as wholes. So
sizes are partitioned: items are put into classes by their number of shingles (4, 8, 16, ...), and for each
class every document is searched in overlapping windows of twice the class's size. A run of shingles as long as
an item lies wholly in some window, and an item that is contained to 0.8 then has a Jaccard similarity of at
least 0.8 / 4.2 with it. With PERMUTATIONS bands of one row each, such a window is missed with a probability
below 2e-6. Minima of small blocks are made once and combined for the larger classes.

Every candidate is verified against the whole document: the share of the item's distinct shingles
(five words; fewer if the item is shorter) that stand in it, by their words.

Items go to the workers with the scan, each of which builds their index once, in passes of at most PASS shingles; more items mean more passes, none is
left out. Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters.

Defined results: a null text is empty and contains nothing; an item without words is contained nowhere; equal
items are one, under their smallest id; null ids of items are left out, of documents kept; repeated
documents are judged each; empty tables give no rows or no finds; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .licenses import template_words
from .words import gram_hashes, hash_words

WORDS, CONTAINMENT, PERMUTATIONS, SMALLEST, PASS = 5, 0.8, 64, 4, 500_000
_FACTORS = np.random.default_rng(8).integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OUT = pa.schema([("n_items", pa.int32()), ("containment", pa.float64()), ("item_ids", pa.list_(pa.int64()))])


def shingles(text: str | None, k: int) -> set[str]:
    w = template_words(text or "")
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}


class Index:
    """MinHash index of items (id, text), by shingle length and size class."""

    def __init__(self, items: list[tuple[int, str]], threshold: float):
        self.threshold = threshold
        self.items: list[tuple[int, int, set[str], np.ndarray]] = []  # id, k, shingles, their hashes
        self.classes: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        seen: dict[tuple, int] = {}
        for item, text in sorted(items):
            n = len(template_words(text))
            k = min(WORDS, n)
            if not n or seen.setdefault((k, frozenset(shingles(text, k))), item) != item:
                continue
            _, _, words, _ = next(iter(hash_words(pa.array([text]))))
            hashes = np.unique(gram_hashes(words, k))
            size = SMALLEST
            while size < n - k + 1:
                size *= 2
            self.classes[k][size].append(len(self.items))
            self.items.append((item, k, shingles(text, k), hashes))
        self.tables = {}
        for k, sizes in self.classes.items():
            for size, members in sizes.items():
                least = np.stack([_scrambled(self.items[m][3]).min(1) for m in members])  # items x permutations
                near = np.zeros((PERMUTATIONS, 1 << 16), bool)
                near[np.arange(PERMUTATIONS), least >> np.uint32(16)] = True
                found = defaultdict(list)
                for m, row in zip(members, least, strict=True):
                    for j, v in enumerate(row.tolist()):
                        found[j, v].append(m)
                self.tables[k, size] = near, dict(found)

    def candidates(self, k: int, hashes: np.ndarray, n: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs that share a minimum; ``hashes`` are the shingles of all rows, ``n`` of each."""
        sizes = sorted(self.classes[k])
        base = sizes[0]
        count = -(-n // base)
        row = np.repeat(np.arange(len(n)), count)
        if not len(row):
            return set()
        inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        starts = np.repeat(np.cumsum(n) - n, count) + inner * base
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.stack([np.minimum.reduceat(short * f, starts) for f in _FACTORS])
        pairs: set[tuple[int, int]] = set()
        for size in sizes:
            first = np.flatnonzero(inner % (size // base) == 0)
            block, of = (least, row) if size == base else (np.minimum.reduceat(least, first, axis=1), row[first])
            window = block.copy()
            both = of[1:] == of[:-1]
            window[:, :-1][:, both] = np.minimum(block[:, :-1][:, both], block[:, 1:][:, both])
            near, found = self.tables[k, size]
            for j in range(PERMUTATIONS):
                hit = np.flatnonzero(near[j][window[j] >> np.uint32(16)])
                for r, v in zip(of[hit].tolist(), window[j][hit].tolist(), strict=True):
                    pairs.update((r, m) for m in found.get((j, v), ()))
        return pairs

    def search(self, column: pa.Array):
        """Yields (row, [(item id, containment)]) for rows that contain items."""
        for i, _, words, before in hash_words(column):
            n_words = np.diff(before)
            grams = {}
            for k in self.classes:
                n = np.maximum(n_words - k + 1, 0)
                at = np.repeat(before[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                hashes = gram_hashes(words, k)[at]
                grams[k] = self.candidates(k, hashes, n), hashes, np.r_[0, np.cumsum(n)]
            found = defaultdict(list)
            texts: dict[tuple[int, int], set[str]] = {}
            for k, (pairs, hashes, cuts) in grams.items():
                for r, m in sorted(pairs):
                    item, _, wanted, wanted_hashes = self.items[m]
                    if np.isin(wanted_hashes, hashes[cuts[r] : cuts[r + 1]]).sum() < self.threshold * len(wanted) - 1e-9:
                        continue
                    if (r, k) not in texts:
                        texts[r, k] = shingles(column[i + r].as_py(), k)
                    share = len(wanted & texts[r, k]) / len(wanted)
                    if share >= self.threshold - 1e-12:
                        found[r].append((item, share))
            yield from ((i + r, sorted(x)) for r, x in sorted(found.items()))


def _scrambled(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)[None, :] * _FACTORS[:, None]


def _passes(benchmark: DataFrame) -> list[DataFrame]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = -(-total // PASS)
    return [items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i) for i in range(n)]


_built: dict[str, Index] = {}


def _index(key: str, items: list[tuple[int, str]], threshold: float) -> Index:
    """The index of a pass; each worker builds it once, whatever the number of its tasks, and keeps the last one."""
    if key not in _built:
        _built.clear()
        _built[key] = Index(items, threshold)
    return _built[key]


def find_items(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT) -> tuple[DataFrame, tuple[str, str, str]]:
    """All columns of ``docs`` and three more, with their names, which ``docs`` does not have: the number of items, the largest containment, the items' ids."""
    spark = docs.sparkSession
    shared.ship(spark)
    names = tuple(shared.fresh(docs, c) for c in ("n_items", "containment", "item_ids"))
    out = docs.withColumns(dict(zip(names, (F.lit(0), F.lit(0.0), F.array().cast("array<long>")), strict=True)))
    text = docs.columns.index("text")
    for some in _passes(benchmark):
        index = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in some.collect()])  # a pass: at most about PASS shingles
        key = uuid.uuid4().hex

        def run(batches, index=index, key=key):
            here = _index(key, index.value, threshold)
            for b in batches:
                n, most, ids = (b.column(b.num_columns - 3 + c).to_pylist() for c in range(3))
                for row, items in here.search(b.column(text).cast(pa.string())):
                    n[row] += len(items)
                    most[row] = max(most[row], *(s for _, s in items))
                    ids[row] = sorted(ids[row] + [m for m, _ in items])
                yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(n, pa.int32()), pa.array(most, pa.float64()), pa.array(ids, pa.list_(pa.int64()))], names=b.schema.names)

        out = out.mapInArrow(shared.lean(run), out.schema)
    return out, names


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """One row a document: doc_id, n_items, containment (largest, 0 if none), item_ids (comma-joined)."""
    rows, (n, most, ids) = find_items(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, threshold)
    joined = F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")
    return rows.select("doc_id", F.col(n).cast("long").alias("n_items"), F.col(most).alias("containment"), joined.alias("item_ids"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item."""
    rows, (n, _, _) = find_items(docs, benchmark, threshold)
    return rows.where(F.col(n) == 0).select(*docs.columns)


#: The same by exact shingles alone, for items of five words or more.
ORACLE_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents
  UNION ALL
  SELECT 'i', min(item_id), text FROM benchmark WHERE item_id IS NOT NULL GROUP BY text
), split AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM words
), grams AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM split
), item AS (
  SELECT id AS item_id, g, count(*) OVER (PARTITION BY id) AS q FROM grams WHERE kind = 'i'
), found AS (
  SELECT d.id AS doc_id, item_id, count(*) / max(q) AS share FROM grams d JOIN item USING (g) WHERE d.kind = 'd' GROUP BY d.id, item_id HAVING count(*) / max(q) >= 0.8
), each AS (
  SELECT doc_id, count(*) AS n_items, max(share) AS containment, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(containment, 0.0) AS containment, coalesce(item_ids, '') AS item_ids
FROM documents LEFT JOIN each USING (doc_id)
"""
