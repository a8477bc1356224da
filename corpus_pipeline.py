"""Corpus pipeline: stages over ``documents``, each one operator of ``codeloom.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs`` and work on all that the stage before kept.
``run`` writes what a stage returns as Parquet in the shared folder and reads it
again as the next stage's input.

1. toxicity: documents scored THRESHOLD or more go.
2. near_dedup: one row of each group of near copies stays, the one of smallest
   id (null last) and, of rows with that id, of least text hash. Rows without
   words group with nothing; of those equal in id and text one stays.
3. suffix_dedup: strings of 200 bytes that occur again are removed from the
   texts; a character cut in part goes whole; n_chars follows.
4. mixing: documents are left out, kept and repeated so that sources come near
   their target weights; the last document of a source may come in part.
5. bpe: one row for each row of the mix, with its ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, common, mixing, near_dedup, suffix_dedup, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs.select("doc_id", "text"), common.read(spark, sf_dir, "labels"))
    slim = common.pack(docs, "text")
    scored = toxicity.score(slim, model).where(F.col("toxicity") < toxicity.THRESHOLD)
    return common.unpack(scored, docs, ("text",))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    first = near_dedup.groups(docs.select("doc_id", "text")).where("first").groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.count("*").alias("_times"))
    slim = common.pack(docs, "doc_id", "text")
    return common.unpack(common.met_by_row(slim, common.stored(first, "first")), docs, ("doc_id", "text"))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.clean_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs, mixing.mix(docs.select("doc_id", "text", "source")))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: No SQL can express a trained classifier or a suffix index.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
