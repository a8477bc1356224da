"""Connected components of edges that no machine holds whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored


def _forest(batches):
    """Union-find over the edges of one partition: each node with the least node it is tied to."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for batch in batches:
        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, r) for x in list(parent) if (r := root(x)) != x]
    cols = np.array(rows, np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(cols[:, 0]), pa.array(cols[:, 1])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long edges to (node, root): every node of an edge with the least node it reaches.

    Each round contracts the edges of a hash partition by union-find, then ties
    each node's neighbours to the least of them (a node of many neighbours is
    dealt to many tasks). Rounds end when the edges are
    stars: one root for each node, and no root has a root.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        local = stored(now.repartition("u").mapInArrow(_forest, "u long, v long"), "forest")
        both = local.unionByName(local.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("r"))
        tied = salted_join(both, least, "u", "v").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("r").alias("v")), F.struct("u", F.col("r").alias("v")))).alias("e")).select("e.*").where("u <> v")
        now = stored(tied.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        counts = now.agg(F.count("*"), F.count_distinct("u")).first()
        if counts[0] == counts[1] and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
