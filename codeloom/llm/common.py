"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word rule ``[^\x20\x09-\x0D]+``: six code points, no others.
WORD = r"[^\x20\x09-\x0D]+"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder.

    Only where that is unset on a local master (tests on one machine) a
    temporary folder is made and set as the checkpoint folder; a cluster must
    name one, as its machines share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            base = tempfile.mkdtemp(prefix="spark-checkpoint-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts the
    lineage, and a lost executor costs a read instead of a recomputation."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, in which each ``key`` occurs once; a key may fill most of ``left``.

    Rows of a frequent key are dealt by the hash of ``by`` to as many tasks as
    they need, and its row of ``right`` goes to each of them. Keys are frequent
    from a thousand rows and a 100,000th of all rows on, so the broadcast list
    of them (two numbers each) has at most 100,000 rows.
    """
    counts = left.groupBy(key).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    bound = max(1000, total // 100_000)
    heavy = F.broadcast(counts.where(F.col("count") > bound).select(F.col(key).alias("_hk"), F.ceil(F.col("count") / bound).cast("int").alias("_times")))
    spread = left.join(heavy, left[key] == heavy["_hk"], "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_times")), F.lit(0)).cast("int")).drop("_hk", "_times")
    copied = right.join(heavy, right[key] == heavy["_hk"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_times", F.lit(1)) - 1))).drop("_hk", "_times")
    return spread.join(copied, [key, "_salt"], how).drop("_salt")


def text_key(text="text") -> F.Column:
    """64 bits of a text; with the id it names a row, as ids may be null or repeat."""
    return F.xxhash64(F.col(text))


def met_by_row(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, ...) that ``plan`` names by ``_id`` and ``_th`` (``text_key``), with its other columns.

    ``plan`` has one row for each name. Of rows with equal id and text one is
    returned; ``_times`` of ``plan`` says how many there are.
    """
    keyed = docs.withColumn("_key", text_key())
    met = keyed.join(plan, keyed["doc_id"].eqNullSafe(plan["_id"]) & (keyed["_key"] == plan["_th"])).drop("_id", "_th")
    if plan.where("_times > 1").isEmpty():
        return met.drop("_key")
    return met.where("_times = 1").unionByName(met.where("_times > 1").dropDuplicates(["doc_id", "_key"])).drop("_key")


def release() -> None:
    """Give memory that a task no longer needs back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Hand texts to Python in batches of at most ``rows``, here and in the JVM: whole texts can be long."""
    if int(spark.conf.get(BATCH_ROWS)) > rows:
        spark.conf.set(BATCH_ROWS, str(rows))


def pack(docs: DataFrame, *own: str) -> DataFrame:
    """The ``own`` columns of ``docs`` and all others in one column ``_rest``, so that no name of theirs can clash."""
    small_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`").alias(f"r{k}") for k, c in enumerate(c for c in docs.columns if c not in own)]
    return docs.select(*own, F.struct(*rest, F.lit(0).alias("z")).alias("_rest"))


def unpack(packed: DataFrame, docs: DataFrame, own: tuple[str, ...], without: tuple[str, ...] = (), **new) -> DataFrame:
    """The columns of ``docs`` again, less ``without``, then the ``new`` ones, which take the place of columns of their names."""
    rest = {c: F.col(f"_rest.r{k}") for k, c in enumerate(c for c in docs.columns if c not in own)}
    kept = [(F.col(c) if c in own else rest[c]).alias(c) for c in docs.columns if c not in new and c not in without]
    return packed.select(*kept, *(v.alias(n) for n, v in new.items()))


def schema_of(df: DataFrame, without: tuple[str, ...] = (), **new: str) -> T.StructType:
    """The fields of ``df`` less ``without``, then new ones (name to type)."""
    kept = [f for f in df.schema.fields if f.name not in without]
    return T.StructType([*kept, *(T.StructField(n, T.DataType.fromDDL(t)) for n, t in new.items())])


def in_training(doc_id="doc_id"):
    """The rows whose labels may be learnt: crc32 of the id as text, mod 3, is not 1 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without a copy of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), ends * 0
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    return raw, ends - ends[0]


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values float64 flat, offsets) of a list<number> column without null rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().cast(pa.float64())
    lengths = np.asarray(column.value_lengths())
    return np.asarray(flat), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
