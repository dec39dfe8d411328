"""Token-id files: frequency-ranked ids, byte-aligned variable-length codes, separate control bytes.

Every id is replaced by its rank in the whole corpus (0: most frequent; ties: smaller id) and written
in 1 to 4 bytes. Two bits for each id, four to a control byte, give the length; control bytes and data
bytes are apart, so that numpy decodes a block with one look-up in a table of 256 x 4 lengths.

A folder holds ``codebook`` (Parquet: rank, id, count) and ``ids``: files of blocks in ascending
doc_id. A block, all integers little-endian:

    4 bytes   b"VCB1"
    3 x u4    documents, ids, data bytes
    i8 each   doc_id           (0 where null)
    u1 each   1 where doc_id is null
    u4 each   number of ids of the document
    control   one byte for four ids
    data      1 to 4 bytes for each id
    1 byte    b"\\n"

Files are written by Spark's own text writer (the bytes of a block are a line), so its committer
keeps them whole when tasks or executors fail, on any file system that Spark writes to. This rests on the writer
passing the bytes of a string column on as they are, which the round-trip tests hold it to. A file has at most
FILE_BLOCKS blocks, a partition about PART_IDS ids, and a block ends with the document that fills it, so that both sides hold
one file at the most, of some 64 MB (more only where single documents have millions of ids).

Defined results: a null text is empty and has only the end id; a null doc_id comes first; rows that
repeat a doc_id stay separate documents, in the order of the scan, and may stand in several files; an empty table gives no
blocks; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .tokens import BLOCK, encoder, vocabulary_size

MAGIC = b"VCB1"
#: Lengths of the four ids of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
BLOCK_IDS, FILE_BLOCKS, PART_IDS = 1 << 18, 96, 1 << 24
_TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_COUNTS = pa.schema([("id", pa.int64()), ("n", pa.int64())])
_LINE = pa.schema([("line", pa.binary())])
_READ = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def encode_ids(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of an array of unsigned 32-bit integers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = length - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    widest = int(length.max()) if len(length) else 1  # columns beyond it hold nothing
    data = ranks.view(np.uint8).reshape(-1, 4)[:, :widest][np.arange(widest, dtype=np.uint8) < length[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ids(control: bytes, data: bytes, n: int) -> np.ndarray:
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    widest = int(length.max()) if n else 1
    out[:, :widest][np.arange(widest, dtype=np.uint8) < length[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def write_block(doc_ids: list[int | None], ranks: list[np.ndarray]) -> bytes:
    n = np.array([len(r) for r in ranks], "<u4")
    control, data = encode_ids(np.concatenate(ranks) if ranks else np.zeros(0, "<u4"))
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([MAGIC, struct.pack("<3I", len(n), int(n.sum()), len(data)), ids.tobytes(), null.tobytes(), n.tobytes(), control, data])


def read_blocks(content: bytes):
    """Yields (doc ids, null flags, ids of each document, all ranks) for each block of a file."""
    at = 0
    view = memoryview(content)
    while at < len(content):
        if content[at : at + 4] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        docs, total, size = struct.unpack_from("<3I", content, at + 4)
        at += 16
        ids, at = np.frombuffer(view[at : at + 8 * docs], "<i8"), at + 8 * docs
        null, at = np.frombuffer(view[at : at + docs], np.uint8), at + docs
        n, at = np.frombuffer(view[at : at + 4 * docs], "<u4"), at + 4 * docs
        control, at = view[at : at + -(-total // 4)], at + -(-total // 4)
        data, at = view[at : at + size], at + size + 1
        yield ids, null, n, decode_ids(control, data, total)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned integers, of 2 bytes if the vocabulary allows, else 4."""
    shared.ship(docs.sparkSession)
    small = max(vocabulary_size(tokenizer), (end_id or 0) + 1) <= 1 << 16
    kind = "<u2" if small else "<u4"

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            doc, text = b.column(0), b.column(1)
            _, offsets = shared.utf8(text)
            for i, k in shared.blocks(offsets, BLOCK):
                ids, cuts = enc.encode_block([t or "" for t in text[i:k].to_pylist()])
                if end_id is not None:
                    ids, cuts = np.insert(ids, cuts[1:], end_id), cuts + np.arange(len(cuts))
                ids = ids.astype(kind)
                yield shared.batch(_TOKENS, doc[i:k], pa.Array.from_buffers(pa.binary(), k - i, [None, pa.py_buffer((cuts * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)]))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(shared.lean(run), "doc_id long, ids binary")


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = None) -> None:
    """Write all documents' ids to ``folder`` in ascending doc_id order.

    The ids are made once and kept in the shared scratch folder, for their counts over the whole corpus
    and for the files. Counts are at most the vocabulary's size, whatever the corpus.
    """
    spark = docs.sparkSession
    kind = "<u2" if max(vocabulary_size(tokenizer), (end_id or 0) + 1) <= 1 << 16 else "<u4"
    tokens = shared.materialise(tokenize(docs, tokenizer, end_id))

    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            _, offsets, data = b.column(0).buffers()
            ends = np.frombuffer(offsets, np.int32)[b.column(0).offset :][[0, b.num_rows]]
            c = np.bincount(np.frombuffer(data, np.uint8)[ends[0] : ends[1]].view(kind)) if ends[1] > ends[0] else total[:0]
            if len(c) > len(total):
                total = np.pad(total, (0, len(c) - len(total)))
            total[: len(c)] += c
        ids = np.flatnonzero(total)
        yield shared.batch(_COUNTS, ids, total[ids])

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = counts.sort_values(["n", "id"], ascending=[False, True])
    ids = counts["id"].to_numpy(np.int64)
    rank = np.zeros(int(ids.max()) + 1 if len(ids) else 0, "<u4")
    rank[ids] = np.arange(len(ids))
    book = [(i, int(a), int(n)) for i, (a, n) in enumerate(zip(ids, counts["n"], strict=True))]
    spark.createDataFrame(book, "rank long, id long, count long").coalesce(1).write.parquet(f"{folder}/codebook")

    def files(batches):
        doc_ids, ranks, size = [], [], 0
        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids.append(d)
                ranks.append(rank[np.frombuffer(x.as_py(), kind)])
                size += len(ranks[-1])
                if size >= BLOCK_IDS:
                    yield shared.batch(_LINE, [write_block(doc_ids, ranks)])
                    doc_ids, ranks, size = [], [], 0
        if doc_ids:
            yield shared.batch(_LINE, [write_block(doc_ids, ranks)])

    parts = max(shared.parallelism(spark), -(-int(counts["n"].sum()) // PART_IDS))
    dealt = tokens.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(parts, "doc_id", "uid").sortWithinPartitions("doc_id", "uid")  # uid parts a common doc_id
    lines = dealt.select("doc_id", "ids").mapInArrow(shared.lean(files), "line binary").select(F.col("line").cast("string").alias("value"))
    lines.write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_BLOCKS).text(f"{folder}/ids")
    shared.remove(tokens)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    book = spark.read.parquet(f"{folder}/codebook").orderBy("rank").toPandas()["id"].to_numpy("<u4")  # at most the vocabulary's size

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at = 0
                for ids, null, n, ranks in read_blocks(content.as_py()):
                    values, ends = book[ranks], np.cumsum(n, dtype=np.int64)
                    crc = [zlib.crc32(values[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                    yield shared.batch(_READ, pa.array(ids, mask=null.astype(bool)), [path] * len(n), at + ends - n, n.astype(np.int64), crc)
                    at += int(ends[-1]) if len(ends) else 0

    content = spark.read.format("binaryFile").load(f"{folder}/ids").select("path", "content")
    rows = shared.materialise(content.mapInArrow(run, "doc_id long, file string, at long, n_tokens long, ids_crc32 long"))
    return _with_starts(rows)


def _with_starts(rows: DataFrame) -> DataFrame:
    """Files hold ranges of doc_id that meet in one doc_id at most, so their smallest and largest order them, and names those of the same one; one small row a file."""
    files = rows.groupBy("file").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("null"), F.sum("n_tokens").alias("total"))
    order = Window.orderBy(F.col("null").desc(), F.col("first").asc_nulls_first(), F.col("last").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("ahead"))
    return rows.join(files, "file").select("doc_id", (F.col("ahead") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
