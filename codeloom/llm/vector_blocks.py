"""Queries against all rows in blocks: shards of candidates meet blocks of queries.

Both sides are dealt by hash into pieces of bounded size, so a vector that fills
a third of the table is dealt like any other. Every (shard, query block) is one
group, and what a group returns for a query is its own best rows only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import vectors

SHARD_ROWS = 16_384
QUERY_ROWS = 1_024


def usable(rows: DataFrame, vector=None) -> DataFrame:
    """(vec_id, v array<double>, dim) of the rows with an id and only finite components; ``vector`` maps the cast array."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), (v if vector is None else vector(v)).alias("v"), F.size("embedding").alias("dim"))


def every(rows: DataFrame, step: int) -> DataFrame:
    """The queries: rows whose id is divisible by ``step``; of rows with one id, the one with the least vector."""
    return rows.where(F.col("vec_id") % step == 0).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))


class Deal:
    """How many shards and query blocks there are, and the groups they make."""

    def __init__(self, rows: DataFrame, queries: DataFrame, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS):
        self.shards = max(1, math.ceil(rows.count() / shard_rows))
        self.blocks = max(1, math.ceil(queries.count() / query_rows))

    def home(self) -> F.Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(self.shards)).cast("int")

    def met(self, rows: DataFrame, queries: DataFrame, shards) -> DataFrame:
        """Union of both sides, grouped; ``shards`` is the array of shards that a query goes to. Other columns of either side come along."""
        left = rows.withColumns({"shard": F.pmod(F.xxhash64("vec_id"), F.lit(self.shards)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))), "is_query": F.lit(False)})
        right = queries.withColumns({"shard": F.explode(shards), "block": F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(self.blocks)).cast("int"), "is_query": F.lit(True)})
        return left.unionByName(right, allowMissingColumns=True).groupBy("dim", "shard", "block")


def split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    return table.filter(pa.compute.invert(table["is_query"])), table.filter(table["is_query"])


def matrix(table: pa.Table, column: str = "v") -> np.ndarray:
    flat, _ = vectors(table[column])
    return flat.reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of highest score for each query (query_id, vec_id, score), ties to the smaller id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
