"""Approximate nearest neighbours by largest inner product: robust-pruned directed graphs, one a shard.

Equal vectors are one node (with its smallest ids), so copies cannot crowd a neighbourhood. Distinct vectors
are dealt to shards by hash. Inner product becomes Euclidean distance by one more coordinate that brings all
vectors of a shard to the same length.

Building: nodes are put in by batches of growing size. A greedy search from the medoid proposes the nodes it saw
as neighbours; pruning goes through them by distance and drops whatever lies nearer (by a factor ALPHA) to a kept
one than to the node, which keeps long edges in many directions. Edges are also put in backwards, and lists
that grow over DEGREE are pruned again. A second round does the same on the whole graph. Every node also keeps LONG
random edges: in a crowd of nearly equal vectors all pruned edges end within the crowd, and a search that
came into it would not find out again.

Searching: every query goes to every shard of its dimension, with a beam of BEAM nodes; the beam is scored in
double precision on the original vectors, and the best of all shards are the result. Every valid vector is
in an index.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do null
ids; only vectors of the query's dimension are candidates; rows that share the query's vec_id are its own, and the smallest of their vectors (number by number) asks; with
fewer candidates all are returned; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

DEGREE, LONG, BEAM, ALPHA, SHARD_ROWS, QUERY_ROWS, AT_ONCE, BATCH = 32, 4, 72, 1.2, 8192, 8192, 4, 256
SALTS = 64
_INDEX = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("members", pa.list_(pa.list_(pa.int64()))), ("vectors", pa.binary()), ("edges", pa.binary()), ("entry", pa.int32())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Graph:
    """A directed graph over the rows of ``points`` (float32), for greedy search by Euclidean distance."""

    def __init__(self, points: np.ndarray, edges: np.ndarray | None = None, entry: int = 0):
        self.points = np.ascontiguousarray(points, np.float32)
        self.square = np.einsum("nd,nd->n", self.points, self.points)
        if edges is None:  # the last LONG columns are random edges that pruning leaves alone
            edges = np.full((len(points), DEGREE + LONG), -1, np.int32)
            edges[:, DEGREE:] = np.random.default_rng(1).integers(0, max(len(points), 1), (len(points), LONG))
        self.edges = edges
        self.entry = entry

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances) of each query's beam, nearest first; -1 where fewer were reached."""
        n, rows = len(queries), np.arange(len(queries))[:, None]
        node = np.full((n, beam), -1, np.int32)
        dist = np.full((n, beam), np.inf, np.float32)
        done = np.ones((n, beam), bool)
        node[:, 0], done[:, 0] = self.entry, False
        dist[:, 0] = self._distances(queries, node[:, :1])[:, 0]
        seen = np.zeros((n, len(self.points) + 1), bool)  # the last column is for -1
        seen[:, self.entry] = seen[:, -1] = True
        while not done.all():
            order = np.argsort(done, axis=1, kind="stable")[:, :AT_ONCE]  # the nearest that are not expanded
            fresh = ~done[rows, order]
            done[rows, order] = True
            around = np.where(fresh[:, :, None], self.edges[node[rows, order]], -1).reshape(n, -1)
            around.sort(axis=1)
            around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
            around[seen[rows, around]] = -1
            seen[rows, around] = True
            far = self._distances(queries, around)
            node, dist, done = np.concatenate([node, around], 1), np.concatenate([dist, far], 1), np.concatenate([done, around < 0], 1)
            best = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(dist, best, 1), axis=1, kind="stable"), 1)
            node, dist, done = (np.take_along_axis(x, best, 1) for x in (node, dist, done))
        return node, dist

    def _distances(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        dots = np.einsum("bd,bkd->bk", queries, self.points[nodes])
        return np.where(nodes < 0, np.inf, self.square[nodes] - 2 * dots + np.einsum("bd,bd->b", queries, queries)[:, None])

    def prune(self, owners: np.ndarray, around: np.ndarray) -> None:
        """Give each owner at most DEGREE diverse neighbours out of ``around`` (-1: none)."""
        around = np.sort(around, axis=1)
        around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
        around[around == owners[:, None]] = -1
        dist = self._distances(self.points[owners], around)
        by = np.argsort(dist, axis=1, kind="stable")
        around, dist = np.take_along_axis(around, by, 1), np.take_along_axis(dist, by, 1)
        width = int((around >= 0).sum(1).max(initial=0))
        around, dist = around[:, :width], dist[:, :width]
        kept = np.full((len(owners), DEGREE), -1, np.int32)
        if width:
            vectors, square = self.points[around], self.square[around]
            alive = around >= 0
            rows = np.arange(len(owners))
            for k in range(DEGREE):
                pick = alive.argmax(1)
                some = alive[rows, pick]
                if not some.any():
                    break
                kept[some, k] = around[some, pick[some]]
                chosen = vectors[rows, pick]
                apart = square - 2 * np.einsum("bd,bkd->bk", chosen, vectors) + square[rows, pick][:, None]
                alive &= (ALPHA**2 * apart > dist) | ~some[:, None]
                alive[rows, pick] = False
        self.edges[owners, :DEGREE] = kept

    def add(self, nodes: np.ndarray) -> None:
        seen, _ = self.search(self.points[nodes], BEAM)
        self.prune(nodes, np.concatenate([seen, self.edges[nodes, :DEGREE]], 1))
        ends, starts = self.edges[nodes, :DEGREE].reshape(-1), np.repeat(nodes, DEGREE)
        ends, starts = ends[ends >= 0], starts[ends >= 0]
        by = np.argsort(ends, kind="stable")
        ends, starts = ends[by], starts[by]
        owners, first, many = np.unique(ends, return_index=True, return_counts=True)
        for i in range(0, len(owners), BATCH):
            own, n = owners[i : i + BATCH], many[i : i + BATCH]
            back = np.full((len(own), int(n.max())), -1, np.int32)
            row = np.repeat(np.arange(len(own)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            back[row, at] = starts[np.repeat(first[i : i + BATCH], n) + at]
            near = self.edges[own, :DEGREE]
            back[(back[:, :, None] == near[:, None, :]).any(2)] = -1
            room = (near >= 0).sum(1) + (back >= 0).sum(1) <= DEGREE
            both = np.concatenate([near, back], 1)
            self.edges[own[room], :DEGREE] = -np.sort(-both[room], axis=1)[:, :DEGREE]
            if not room.all():
                self.prune(own[~room], both[~room])

    @classmethod
    def build(cls, points: np.ndarray, seed: int = 0) -> Graph:
        graph = cls(points)
        n = len(points)
        graph.entry = int(np.argmin(((graph.points - graph.points.mean(0)) ** 2).sum(1))) if n else 0
        order = np.random.default_rng(seed).permutation(n)
        order = np.r_[graph.entry, order[order != graph.entry]] if n else order
        for _ in range(2):
            at = 1
            while at < n:
                size = min(BATCH, max(1, at // 2))
                graph.add(order[at : at + size])
                at += size
        return graph


def even_length(vectors: np.ndarray) -> np.ndarray:
    """One more coordinate, so that the nearest by distance to (query, 0) has the largest inner product."""
    square = np.einsum("nd,nd->n", vectors, vectors)
    return np.concatenate([vectors, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]], 1).astype(np.float32)


def valid_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, dim, v): v is an array of double."""
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0)).select("vec_id", F.size("v").alias("dim"), "v")


def build_indexes(vectors: DataFrame, members: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(dim, shard, members, vectors, edges, entry): a graph for each shard of distinct vectors, with each one's smallest ids."""
    smallest = lambda ids: F.slice(F.sort_array(ids), 1, members)
    salted = vectors.groupBy("dim", "v", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")).agg(smallest(F.collect_set("vec_id")).alias("ids"))
    nodes = shared.materialise(salted.groupBy("dim", "v").agg(smallest(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids")))
    shards = nodes.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("int").alias("shards"))  # a row for each dimension
    dealt = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))
    tasks = max(shared.parallelism(vectors.sparkSession), 2 * (shards.agg(F.sum("shards")).first()[0] or 0))  # else small shards are put into one task

    def build(found: pa.Table) -> pa.Table:
        found = found.combine_chunks()
        x = np.array(found["v"].to_pylist(), np.float64)
        order = np.lexsort(x.T[::-1])
        x = x[order]
        graph = Graph.build(even_length(x))
        ids = found["ids"].to_pylist()
        return pa.table([[found["dim"][0].as_py()], [found["shard"][0].as_py()], [[ids[i] for i in order]], [x.tobytes()], [graph.edges.tobytes()], [graph.entry]], schema=_INDEX)

    ddl = "dim int, shard int, members array<array<long>>, vectors binary, edges binary, entry int"
    return shared.materialise(dealt.select("dim", "shard", "v", "ids").repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, ddl))


def search(queries: DataFrame, indexes: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of ``queries`` (vec_id, dim, v)."""
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    asked = queries.select(F.col("vec_id").alias("query_id"), "dim", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    names = indexes.select(F.col("dim").alias("of"), F.col("shard").alias("shard"))
    asked = asked.join(names, asked["dim"] == names["of"]).drop("of")  # every shard of the query's dimension
    spread = indexes.withColumnsRenamed({"dim": "own_dim", "shard": "own_shard"}).withColumn("own_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(asked: pa.Table, index: pa.Table) -> pa.Table:
        if not asked.num_rows or not index.num_rows:
            return _FOUND.empty_table()
        row = index.to_pylist()[0]
        x = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["own_dim"])
        graph = Graph(even_length(x), np.frombuffer(row["edges"], np.int32).reshape(len(x), -1), row["entry"])
        ids = asked["query_id"].to_numpy()
        q = np.array(asked["v"].to_pylist(), np.float64)
        out: list[tuple[int, int, float]] = []
        for i in range(0, len(q), BATCH):
            part = q[i : i + BATCH]
            nodes, _ = graph.search(np.concatenate([part, np.zeros((len(part), 1))], 1).astype(np.float32), max(beam, k + 1))
            for query, own, near in zip(ids[i : i + BATCH].tolist(), part, nodes, strict=True):
                near = near[near >= 0]
                scores = (x[near] * own).sum(1)
                best = sorted(((-s, m) for s, n in zip(scores.tolist(), near.tolist(), strict=True) for m in row["members"][n] if m != query))[:k]
                out += [(query, m, -s) for s, m in best]
        return pa.table(list(zip(*out, strict=True)) or [[], [], []], schema=_FOUND)

    tasks = max(shared.parallelism(queries.sparkSession), 2 * blocks * indexes.count())
    asked, spread = asked.repartition(tasks, "dim", "shard", "block"), spread.repartition(tasks, "own_dim", "own_shard", "own_block")
    found = asked.groupBy("dim", "shard", "block").cogroup(spread.groupBy("own_dim", "own_shard", "own_block")).applyInArrow(run, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, every: int, k: int, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """The k nearest rows of each row whose vec_id is divisible by ``every``, itself left out."""
    vectors = valid_vectors(table)
    indexes = build_indexes(vectors, k + 1, shard_rows)
    asked = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("one"))
    return search(asked.select("vec_id", "one.dim", "one.v"), indexes, k, beam)
