import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from entiquery.llm import graph, simhash


def brute_print(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(values, near):
    root = list(range(len(values)))
    for i in range(len(values)):
        for k in range(i):
            if near(values[i], values[k]):
                a, b = root[i], root[k]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 40), st.sets(st.integers(0, 63), max_size=4)), max_size=40))
@settings(max_examples=60, deadline=None)
def test_ball_finds_all_links(seeds, moves):
    values = list(seeds)
    for i, flips in moves:
        values.append(values[i % len(values)] ^ sum(1 << f for f in flips))
    values = sorted(set(values))
    ball = simhash.Ball(4)
    cells, sent = ball.sent(np.array(values, np.uint64))
    order = np.argsort(cells, kind="stable")
    pairs = ball.links(cells[order], sent[order]).tolist()
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    linked = {frozenset(p) for p in pairs}
    assert brute_roots(values, lambda a, b: frozenset((a, b)) in linked) == brute_roots(values, lambda a, b: (a ^ b).bit_count() <= 3)


def test_crowded_cell(monkeypatch):
    monkeypatch.setattr(simhash, "SORT", 1000)
    rng = np.random.default_rng(0)
    values = np.unique(np.bitwise_or.reduce(np.uint64(1) << rng.integers(8, 32, (40, 4)).astype(np.uint64), axis=1))
    ball = simhash.Ball(4)
    cells, sent = ball.sent(values)
    linked = {frozenset(p) for p in ball.links(cells, sent).tolist()}
    assert brute_roots(values.tolist(), lambda a, b: frozenset((a, b)) in linked) == brute_roots(values.tolist(), lambda a, b: (a ^ b).bit_count() <= 3)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (35, 2))] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    linked = {frozenset(e) for e in edges}
    expected = brute_roots(nodes, lambda a, b: frozenset((a, b)) in linked)
    assert got == {n: nodes[r] for n, r in zip(nodes, expected, strict=True)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def corpus():
    rng = np.random.default_rng(2)
    base = [" ".join(rng.choice(WORDS, 300)) for _ in range(4)]
    docs = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        w = base[i % 4].split()
        for _ in range(i % 3):
            w[int(rng.integers(300))] = "other"
        docs.append((10 + i, " ".join(w).upper() if i % 5 == 0 else "\t".join(w)))
    return [*docs, (90, None), (91, ""), (92, " \n"), (93, "One"), (94, "one"), (95, "a b"), (3, docs[3][1]), (96, base[0] + " " + base[1] * 20)]


def test_near_duplicates(spark):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id long, text string, fingerprint string, component_id int")
    got = sorted(tuple(r) for r in simhash.near_duplicates(frame).collect())
    prints = [brute_print(t) for _, t in docs]
    root = brute_roots(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {r: min(d for (d, _), x in zip(docs, root, strict=True) if x == r) for r in root}
    assert got == sorted((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(docs, prints, root, strict=True))
    assert len(set(root)) < len(docs) - 20
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_long_texts(monkeypatch):
    rng = np.random.default_rng(7)
    for words in (1, 3, 5):
        for n in (1, 2, 3, 4, 60, 400):
            text = "  ".join(rng.choice(WORDS, n)) + " É\tZ" * (n % 2)
            whole = simhash.majority_bits([simhash.shingle_hashes(text, words)])[0]
            for size in (1, 7, 40, 5000):
                monkeypatch.setattr(simhash.shared, "CHUNK_BYTES", size)
                assert simhash.long_print(np.frombuffer(text.encode(), np.uint8), words) == whole


def test_null_id(spark):
    frame = spark.createDataFrame([(None, "x y z"), (4, "x y z"), (None, "q")], "doc_id long, text string")
    assert sorted((str(r[0]), str(r[2])) for r in simhash.near_duplicates(frame).collect()) == [("4", "4"), ("None", "4"), ("None", "None")]
