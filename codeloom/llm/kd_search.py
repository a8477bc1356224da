"""Exact top-k by inner product of quantised vectors, with a KD-tree for each shard.

A tree splits its points at the median of their widest component and keeps a
tight box for each node. A query's score with any point of a box is at most the
sum over components of the larger of q * low and q * high. Nodes are visited
best bound first; a visit ends when the best bound left is below the k-th score
so far. Queries first search one shard (their home); the k-th score found there
goes with them to all other shards, so most of those trees are cut near the top.

Components become floor(256 * x); scores are exact integers (in doubles where
all sums stay below 2 ** 53, else in Python's integers, which a score outside
64 bits bounds to the nearest long). Defined results: as ``anisotropic``, but a
zero vector takes part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vector_blocks
from .common import read, stored

LEAF = 128
SCALE = 256


class Tree:
    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.span, self.kids, low, high = [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = points[self.order[a:b]]
            node = len(self.span)
            self.span.append((a, b))
            self.kids.append([])
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            if parent >= 0:
                self.kids[parent].append(node)
            width = high[-1] - low[-1]
            wide = int(np.argmax(width))
            if b - a > leaf and width[wide] > 0:
                half = (b - a) // 2
                by = np.argpartition(own[:, wide], half) if own.dtype != object else np.argsort(own[:, wide], kind="stable")
                self.order[a:b] = self.order[a:b][by]
                todo += [(a, a + half, node), (a + half, b, node)]
        self.low, self.high = np.array(low, own.dtype), np.array(high, own.dtype)
        self.points = points[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): no point of the node scores higher."""
        zero = queries * 0
        return np.maximum(queries, zero) @ self.high.T + np.minimum(queries, zero) @ self.low.T

    def best(self, ids: np.ndarray, query: np.ndarray, bound: np.ndarray, own: int, k: int, floor) -> list[tuple]:
        """The ``k`` best (score, id) for one query, or fewer where ``floor`` shows that others can't matter; ties to smaller ids."""
        heap, found = [(-bound[0], 0)], []
        while heap:
            top, node = heapq.heappop(heap)
            if floor is not None and -top < floor:
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    if floor is None or bound[kid] >= floor:
                        heapq.heappush(heap, (-bound[kid], kid))
                continue
            a, b = self.span[node]
            score = self.points[a:b] @ query
            near = np.flatnonzero(score >= floor) if floor is not None else np.arange(b - a)
            if not len(near):
                continue
            names = ids[self.order[a:b][near]]
            found += [(-s, i) for s, i in zip(score[near].tolist(), names.tolist()) if i != own]
            if len(found) > k:
                found = heapq.nsmallest(k, found)
            if len(found) == k:
                worst = -max(found)[0]
                floor = worst if floor is None else max(floor, worst)
        return [(-s, i) for s, i in sorted(found)]


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        rows, asked = vector_blocks.split(table)
        ids, qids = np.asarray(rows["vec_id"]), np.asarray(asked["vec_id"])
        out_q, out_v, out_s = [], [], []
        if len(ids) and len(qids):
            x, queries = np.floor(vector_blocks.matrix(rows) * SCALE), np.floor(vector_blocks.matrix(asked) * SCALE)
            if x.shape[1] * max(np.abs(x).max(), 1) * max(np.abs(queries).max(), 1) >= 2**53:
                x, queries = (np.array([[int(c) for c in r] for r in y], object) for y in (x, queries))
            tree = Tree(x)
            floors = asked["floor"].to_pylist()
            bounds = tree.bounds(queries)
            for q, name in enumerate(qids.tolist()):
                for score, i in tree.best(ids, queries[q], bounds[q], name, k, floors[q]):
                    out_q.append(name)
                    out_v.append(i)
                    out_s.append(max(-(2**63), min(2**63 - 1, int(score))))
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.int64())})

    return run


def search(embeddings: DataFrame, step: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of ``embeddings`` (vec_id, embedding) for every row whose id is divisible by ``step``."""
    schema = "query_id long, vec_id long, score long"
    rows = vector_blocks.usable(embeddings)
    queries = vector_blocks.every(rows, step)
    deal = vector_blocks.Deal(rows, queries)
    floor = F.lit(None).cast("long")
    first = deal.met(rows, queries.withColumn("floor", floor), F.array(deal.home())).applyInArrow(_search(k), schema)
    if deal.shards == 1:
        return vector_blocks.best(first, k)
    first = stored(first, "home-shards")
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor")).withColumnRenamed("query_id", "vec_id")
    others = F.array_except(F.sequence(F.lit(0), F.lit(deal.shards - 1)), F.array(deal.home()))
    rest = deal.met(rows, queries.join(floors, "vec_id", "left"), others).applyInArrow(_search(k), schema)
    return vector_blocks.best(first.unionByName(rest), k)


def op4_kd_search(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), step=50, k=5)


OP4_SQL = """
WITH e AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
