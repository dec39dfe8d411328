import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from entiquery.llm import packing, shared, token_files, tokens

P = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
ODD = ["", "it's I'LL don't'x", "x<|endoftext|>y", "a\x00b c\x1cd", "İ Σς ﬁ é", "½ ²3 ４５ ª", "日本語 😀", "\t\r\n x\x85y\xa0z", "".join(map(chr, range(0x250))), "ab " * 4000, "Ab, cd. éf .gh ,", "a.,b", "a..b", ". , a"]


def plain_ids(text):
    return tokens.encoder(P).whole.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.text(max_size=40), max_size=5))
@settings(max_examples=60, deadline=None)
def test_encoder_equals_tokenizer(texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.encoder(P).encode(texts + ODD)]
    assert got == [plain_ids(t) for t in texts + ODD]


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 50)
    texts = ["", "word " * 40, "x" * 300 + " y", "日本 " * 60 + "<|endoftext|> z", "a\n" * 200, "short"]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.encoder(P).encode(texts)]
    assert got == [plain_ids(t) for t in texts]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
@settings(max_examples=100, deadline=None)
def test_code_round_trip(values):
    control, data = token_files.encode_ids(np.array(values, "<u4"))
    assert token_files.decode_ids(control, data, len(values)).tolist() == values


DOCS = [(5, "b c"), (None, "null id"), (3, None), (2, "same"), (2, "same"), (9, "long words " * 3000), (7, "")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, line string, length int")


def test_files(spark):
    folder = shared.scratch_dir(spark)
    token_files.write_token_files(frame(spark, DOCS), P, folder, end_id=2)
    got = sorted((tuple(r) for r in token_files.read_token_files(spark, folder).collect()), key=lambda r: r[1])
    at, expected = 0, []
    for d, t in sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*plain_ids(t), 2], "<u4")
        expected.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == expected


def test_files_of_nothing(spark):
    folder = shared.scratch_dir(spark)
    token_files.write_token_files(frame(spark, DOCS).limit(0), P, folder, end_id=2)
    assert token_files.read_token_files(spark, folder).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(spark):
    pieces = shared.materialise(packing.split_documents(frame(spark, DOCS), P, 0, 2048))
    rows = packing.pack(pieces, 2048).collect()
    expected = []
    for d, t in DOCS:
        ids = np.array([*plain_ids(t), 0], "<u4")
        expected += [(d, i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes())) for i in range(0, len(ids), 2048)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r[0], r[1], r[2], r[3], r[4]) for r in rows), key=key) == sorted(expected, key=key)
    assert check_packing(rows, 2048) == -(-sum(r[3] for r in expected) // 2048)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert packing.pack(pieces.limit(0), 2048).count() == 0
    again = packing.pack(pieces, 2048)  # the table of the caller is left as it was
    assert again.columns == [*pieces.columns, "sequence_id", "offset"] and pieces.columns == pieces.schema.names
    assert check_packing(again.collect(), 2048) == check_packing(rows, 2048)


def test_packing_keeps_columns_of_any_name(spark):
    names = ["__uid", "__salt", "__n", "__number", "__ahead", "offset"]
    lengths = [5, 3, 2, 2, 7, 5, 1, 3]
    pieces = shared.materialise(spark.createDataFrame([(None, 0, n, *range(i, i + len(names))) for i, n in enumerate(lengths)], "doc_id long, piece int, length long, " + ", ".join(f"{c} int" for c in names)))
    packed = packing.pack(pieces, 10)
    assert sorted(packed.columns) == sorted({*pieces.columns, "sequence_id"})
    rows = packed.collect()
    assert sorted((r["length"], r["__uid"], r["__ahead"]) for r in rows) == sorted((n, i, i + 4) for i, n in enumerate(lengths))
    assert check_packing(rows, 10) == 3


def optimum(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + sizes[i] <= capacity:
                k = bins.index(b)
                go(i + 1, bins[:k] + [b + sizes[i]] + bins[k + 1 :])
        go(i + 1, bins + [sizes[i]])

    go(0, [])
    return best[0]


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_reduction_loses_nothing(sizes):
    counts = {s: sizes.count(s) for s in set(sizes)}
    fixed, left = packing.reduce_dominated(counts, 20)
    assert all(sum(p) <= 20 for p, _ in fixed)
    used = [s for p, n in fixed for s in p * n]
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sorted(used + rest) == sorted(sizes)
    assert sum(n for _, n in fixed) + (optimum(rest, 20) if rest else 0) == optimum(sizes, 20)
    patterns = packing.pack_lengths(counts, 20)
    assert sorted(s for p, n in patterns for s in p * n) == sorted(sizes)
    assert all(sum(p) <= 20 for p, _ in patterns)


def test_many_small_files_and_a_common_id(spark, monkeypatch):
    for name, value in (("BLOCK_IDS", 20), ("FILE_BLOCKS", 2), ("PART_IDS", 400)):
        monkeypatch.setattr(token_files, name, value)
    docs = [(7 if i % 3 else i, f"text number {i}") for i in range(300)] + [(None, f"null {i}") for i in range(60)]
    folder = shared.scratch_dir(spark)
    token_files.write_token_files(frame(spark, docs).repartition(5), P, folder, end_id=2)
    files = spark.read.format("binaryFile").load(f"{folder}/ids").select("length", "content").collect()
    assert len(files) > 40 and max(r["content"].count(token_files.MAGIC) for r in files) <= 2
    got = sorted((tuple(r) for r in token_files.read_token_files(spark, folder).collect()), key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    crc = lambda t: zlib.crc32(np.array([*plain_ids(t), 2], "<u4").tobytes())
    assert sorted((str(r[0]), r[3]) for r in got) == sorted((str(d), crc(t)) for d, t in docs)
