"""Upkeep of a chunk table from a stream of file states.

An extension: runs are batches elsewhere. Every micro-batch of states (path,
content_hash, content) is classified against what is known, chunks of unchanged
files stay, others are made anew. Batches are applied once: the tables of batch
n are written to their own folder before its mark, so a repeated batch
overwrites the same folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import incremental, retrieval


def apply_batch(spark: SparkSession, states: DataFrame, folder: str, batch: int, before: int | None, size: int = 2000, overlap: int = 200) -> None:
    """Write the file states and chunks that hold after ``states``, the changed files of a batch (deleted: content_hash null)."""
    states = states.groupBy("path").agg(F.max_by(F.struct("content_hash", "content"), "seen").alias("s")).select("path", "s.*")
    if before is None:
        known = spark.createDataFrame([], "path string, content_hash string")
        chunks = spark.createDataFrame([], "path string, chunk int, text string")
    else:
        known = spark.read.parquet(f"{folder}/files/batch={before}")
        chunks = spark.read.parquet(f"{folder}/chunks/batch={before}")
    rest = known.join(states, "path", "left_anti")
    now = rest.unionByName(states.where("content_hash is not null").select("path", "content_hash"))
    statuses = incremental.classify(now, known)
    fresh = retrieval.chunks(states.where("content_hash is not null").select(F.col("path").alias("source"), F.col("content").alias("text")), size, overlap)
    kept = incremental.keep_and_append(chunks, fresh.withColumnRenamed("source", "path"), statuses)
    kept.write.mode("overwrite").parquet(f"{folder}/chunks/batch={batch}")
    now.write.mode("overwrite").parquet(f"{folder}/files/batch={batch}")


def follow(stream: DataFrame, folder: str, checkpoint: str):
    """Start a query that applies each micro-batch of ``stream`` (path, content_hash, content, seen)."""

    def each(states: DataFrame, batch: int) -> None:
        apply_batch(states.sparkSession, states, folder, batch, batch - 1 if batch else None)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
