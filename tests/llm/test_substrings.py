import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from entiquery.llm import shared, substrings


def brute(docs, length=100):
    """docs: (doc_id, text) in scan order."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    first = {}
    order = sorted(range(len(raw)), key=lambda i: (raw[i][0] is not None, raw[i][0] or 0, i))
    gone = [set() for _ in raw]
    for i in order:
        t = raw[i][1]
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if w in first:
                gone[i].update(range(s, s + length))
            else:
                first[w] = i
    out = []
    for (d, t), g in zip(raw, gone, strict=True):
        left = bytes(b for i, b in enumerate(t) if i not in g)
        runs = sum(i - 1 not in g for i in g)
        out.append((d, len(t), len(g), runs, hashlib.sha256(left).hexdigest()))
    return out


RNG = np.random.default_rng(4)
VOCAB = ["the", "of", "and", "é", "ß", "and", "in", *(f"w{i}" for i in range(300))]


def prose(n):
    return " ".join(RNG.choice(VOCAB, n))


def corpus():
    passages = [prose(25) for _ in range(4)] + ["ab" * 90, "=" * 250, "éß" * 70]
    docs = []
    for i in range(70):
        t = prose(int(RNG.integers(1, 120)))
        for _ in range(i % 4):
            p = passages[int(RNG.integers(len(passages)))]
            cut = int(RNG.integers(len(t) + 1))
            t = t[:cut] + p[: int(RNG.integers(60, len(p) + 1))] + t[cut:]
        docs.append((i * 7 % 101, t))
    docs += [(200, docs[3][1]), (2, docs[5][1]), (2, docs[5][1]), (None, docs[8][1]), (201, None), (202, ""), (203, "x" * 99), (204, "y" * 100), (205, "y" * 101), (206, docs[9][1] + docs[9][1])]
    docs.append((300, prose(9000) + docs[11][1] + prose(100)))
    return docs


L = substrings.Limits


@pytest.mark.parametrize(
    "limits",
    [L(), L(crowd=2, sort=4000), L(hot=1, crowd=1), L(hot=3, crowd=2000, reduce=3000, chunk=1500), L(crowd=3, chunk=700, held=5), L(hot=2, crowd=2, held=3, reduce=9000, sort=500)],
)
def test_equals_brute_force(spark, limits):
    docs = corpus()
    frame = shared.materialise(spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, start int, uid string").coalesce(1))
    got = [tuple(r) for r in substrings.digests(frame, limits).collect()]
    assert sorted(got, key=str) == sorted(brute(docs), key=str)
    assert sum(r[2] > 0 for r in got) > 30


def test_parts_of_sorted_rows():
    import pyarrow as pa

    keys = np.sort(RNG.choice([1, 2, 3, 4, 5, 6], 4000, p=[0.02, 0.5, 0.1, 0.3, 0.05, 0.03]))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 37]), pa.array(np.arange(i, min(i + 37, 4000)))], names=["k", "v"]) for i in range(0, 4000, 37)]
    parts = list(substrings._by_key(batches, 300))
    assert np.concatenate([c[1] for c, _ in parts]).tolist() == list(range(4000))
    assert max(len(c[0]) for c, _ in parts) < 800
    where = {}
    for i, (c, long) in enumerate(parts):
        for k in set(c[0].tolist()):
            where.setdefault(k, []).append((i, long))
    for places in where.values():  # a value in several parts is named with each of them
        assert len(places) == 1 or all(long is not None for _, long in places)
    assert all(long is None or long in c[0] for c, long in parts)


def test_one_anchor_with_very_many_contexts(spark):
    """100,000 lines around one common string, few of which share more with another; no task gathers them."""
    anchor = "the most common string of them all"
    mine = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    texts = [f"{mine(i)}{mine(-i - 1)} {anchor} {mine(i + 10**6)}{mine(-i - 10**6)}" for i in range(100_000)]
    for i in range(0, 1000, 10):  # the same from 20 bytes before the string on
        texts[i + 5] = "x" * 50 + texts[i][108:]
    frame = shared.materialise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8))
    rows = {r["doc_id"]: r["n_removed"] for r in substrings.digests(frame, L(held=5000)).where("n_removed > 0").collect()}
    assert rows == {i + 5: len(texts[i]) - 108 for i in range(0, 1000, 10)}


def test_text_column(spark):
    docs = [(1, "é" * 60), (2, "a" + "é" * 60 + "b"), (3, None), (4, "short")]
    frame = shared.materialise(spark.createDataFrame([(*d, "k", d[0], 2) for d in docs], "doc_id long, text string, source string, __uid long, __spans int").coalesce(1))
    kept = substrings.without_repeats(frame)
    assert kept.columns == frame.columns
    assert all(r["__uid"] == r["doc_id"] and r["__spans"] == 2 for r in kept.collect())
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {1: brute_left(docs, 0), 2: brute_left(docs, 1), 3: None, 4: "short"}
    assert substrings.digests(frame.limit(0)).count() == 0


def brute_left(docs, which, length=100):
    seen, out = set(), []
    for d, t in docs:
        raw, gone = (t or "").encode(), set()
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone.update(range(s, s + length))
            seen.add(raw[s : s + length])
        out.append(bytes(b for i, b in enumerate(raw) if i not in gone).decode("utf-8", "ignore"))
    return out[which]


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(1, 9)), max_size=25))
@settings(max_examples=200, deadline=None)
def test_merged(spans):
    uid, start, end = (np.array(x, np.int64) for x in zip(*[(u, s, s + n) for u, s, n in spans], strict=True)) if spans else (np.zeros(0, np.int64),) * 3
    got = list(zip(*(x.tolist() for x in substrings.merged(uid, start, end)), strict=True))
    covered = {(u, i) for u, s, n in spans for i in range(s, s + n)}
    assert {(u, i) for u, a, b in got for i in range(a, b)} == covered
    assert got == sorted(got) and all(x[0] != y[0] or x[2] < y[1] for x, y in zip(got, got[1:]))
