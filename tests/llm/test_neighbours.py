import numpy as np
import pytest

from entiquery.llm import neighbours

RNG = np.random.default_rng(6)


def brute(rows, every, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q, v in ok.items():
        if q % every == 0:
            near = sorted((-float((v * x).sum()), i) for i, x in ok.items() if i != q and len(x) == len(v))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_recall(spark):
    centres = RNG.normal(size=(12, 16))
    rows = [(i, [float(x) for x in np.float32((centres[i % 12] + 0.7 * RNG.normal(size=16)) * RNG.uniform(0.5, 1.5))]) for i in range(3000)]
    got = result(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 50, 10, shard_rows=900))
    expected = brute(rows, 50, 10)
    assert set(got) == set(expected)
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in expected[q]}) for q in got) / (10 * len(got))
    assert hits > 0.97
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(s == pytest.approx(float(np.dot(rows[q][1], rows[i][1]))) for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)


def test_copies_ties_and_odd_rows(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 400)] + [(1000 + i, [float(x) for x in RNG.normal(size=3)]) for i in range(200)]
    rows += [(2000, None), (2020, [0.0, 0.0, 0.0]), (2040, [1.0, None, 0.0]), (2060, [1.0, float("nan"), 0.0]), (2080, [float("inf"), 0.0, 0.0]), (None, [1.0, 2.0, 3.0]), (3000, [1.0, 2.0]), (3020, [2.0, 1.0]), (4000, [5.0])]
    frame = spark.createDataFrame([(*r, i, 0.0) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, rank int, score double")
    got = result(neighbours.nearest(frame, 20, 20, shard_rows=100))
    expected = {q: v for q, v in brute(rows, 20, 20).items() if v}
    assert {q: [(i, pytest.approx(s)) for _, i, s in v] for q, v in got.items()} == expected
    assert neighbours.nearest(frame.limit(0), 20, 20).count() == 0


def test_every_node_can_be_reached():
    points = RNG.normal(size=(1500, 8)).astype(np.float32)
    graph = neighbours.Graph.build(points)
    near, _ = graph.search(points, 20)
    assert (near[:, 0] == np.arange(1500)).mean() > 0.995
    assert ((graph.edges >= 0).sum(1) <= neighbours.DEGREE + neighbours.LONG).all()


def test_a_crowd_of_nearly_equal_vectors_traps_no_search():
    crowd = RNG.normal(size=48) + 0.05 * RNG.normal(size=(600, 48))
    x = np.concatenate([crowd, RNG.normal(size=(2500, 48))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = neighbours.Graph.build(neighbours.even_length(x))
    q = x[::15]
    near, _ = graph.search(np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32), neighbours.BEAM)
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a[:20]) & set(b)) / 20 for a, b in zip(near, best)]) > 0.93


def test_the_smallest_of_repeated_vectors_asks(spark):
    rows = [(20, [0.0, 1.0]), (20, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [5.0, 0.0])]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(3)
        got = result(neighbours.nearest(frame, 20, 2))
        assert {q: [(i, pytest.approx(s)) for _, i, s in v] for q, v in got.items()} == {20: [(2, 1.0), (1, 0.1)]}
