import numpy as np
import pytest

from entiquery.llm import decontaminate as dc
from entiquery.llm import shared

RNG = np.random.default_rng(9)
VOCAB = [f"w{i}" for i in range(400)]


def text(n):
    return " ".join(RNG.choice(VOCAB, n))


def brute(docs, items):
    out = []
    for d, t in docs:
        seen, found = set(), []
        for item, it in sorted((i, x) for i, x in items if i is not None and x is not None):
            k = min(5, len(dc.template_words(it)))
            want = dc.shingles(it, k) if k else set()
            if want and (k, frozenset(want)) not in seen:
                seen.add((k, frozenset(want)))
                share = len(want & dc.shingles(t, k)) / len(want)
                if share >= 0.8:
                    found.append((item, share))
        out.append((d, len(found), max((s for _, s in found), default=0.0), ",".join(str(i) for i, _ in found)))
    return sorted(out, key=str)


def world():
    items = [(i, text(int(RNG.integers(5, 90)))) for i in range(25)] + [(100, "rare pair"), (101, "solo"), (102, ""), (103, None), (None, "x y"), (30, None)]
    items += [(50, items[3][1].upper()), (51, items[4][1] + " " + items[4][1])]
    docs = []
    for i in range(80):
        w = text(int(RNG.integers(1, 700))).split()
        if i % 3 == 0:
            it = items[int(RNG.integers(25))][1].split()
            for _ in range(i % 4):
                it[int(RNG.integers(len(it)))] = "changed"
            at = int(RNG.integers(len(w)))
            w = w[:at] + it + w[at:]
        docs.append((i, ", ".join(w)))
    long = text(30000).split()
    long[15000:15000] = items[7][1].split()
    return docs + [(200, None), (201, ""), (202, "a rare  PAIR of"), (203, "solo"), (0, docs[0][1]), (None, docs[3][1]), (204, " ".join(long))], items


@pytest.mark.parametrize("size", [dc.PASS, 400])
def test_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(dc, "PASS", size)
    docs, items = world()
    frame = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id long, text string, item_ids string, n_items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in dc.contaminated(frame, bench).collect()), key=str)
    assert got == brute(docs, items)
    assert sum(r[1] > 0 for r in got) > 15
    named = frame.selectExpr("*", "doc_id AS __n_items", "7 AS __containment", "text AS __item_ids")
    kept = dc.without_contaminated(named, bench)
    assert kept.columns == named.columns and kept.count() == sum(r[1] == 0 for r in got)
    assert all(r["__n_items"] == r["doc_id"] and r["__containment"] == 7 and r["__item_ids"] == r["text"] for r in kept.collect())


def test_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert dc.contaminated(frame.limit(0), bench).count() == 0
    assert [tuple(r) for r in dc.contaminated(frame, bench.limit(0)).collect()] == [(1, 0, 0.0, "")]
    assert [tuple(r) for r in dc.contaminated(shared.materialise(frame), bench).collect()] == [(1, 1, 1.0, "1")]


def test_a_worker_builds_an_index_once(monkeypatch):
    built = []
    monkeypatch.setattr(dc, "Index", lambda items, threshold: built.append(items) or items)
    assert dc._index("k", [1], 0.8) is dc._index("k", [1], 0.8) and dc._index("other", [2], 0.8) == [2]
    assert built == [[1], [2]] and len(dc._built) == 1
