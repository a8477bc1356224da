"""Tables written between rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder (a temporary one only where none is set on a local master)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and read it again.

    ``by`` parts the table into folders by a column of few values, so that readers of some values open only theirs.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


def grows(df: DataFrame) -> DataFrame:
    """``df``, joined by sorting however small Spark takes it for.

    Spark judges a stored table by its files. Tables of names and of bits repeat themselves and are up to a
    hundred times larger in memory, so by their files they would be broadcast, that is gathered by the driver.
    """
    return df.hint("merge")


def kept(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``stored`` for a table that grows with the input, and is joined as such."""
    return grows(stored(df, name, by))
