"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Targets share ``share`` times all words by weight. A source is clamped at
``cap`` times its own words and its excess goes to the others by weight. The
fixed point needs no loop: with sources in order of cap per weight, the first
whose even share fits under its cap sets the level for all after it.

A target of e.g. 1.37 times a source means every document once, and documents
in seeded order a second time until the rest is used up; the last of those is
repeated in part, so the words taken are the rounded target. The running sum
behind that order has two levels (4096 hash buckets for each source, then the
documents of a bucket), so no task holds a whole source.

Defined results: a null source is a source of its own, last in order; null text
has size 0; a source without words has target 0; ids may be null or repeat: a row
is named by its id and text, and rows equal in both are interchangeable; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, met_by_row, pack, read, stored, text_key, unpack

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"


def word_count(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row for each source of ``sizes`` (source, size): source, source_size, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    per = per.withColumns({"weight": weight, "limit": F.lit(cap) * F.col("source_size")})
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.lit(share) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumns({"at": F.row_number().over(order), "level": level})
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("at", "level"))
    per = per.withColumn("final", F.min(fits).over(everything)["level"])
    target = F.least("limit", F.coalesce(F.col("final") * F.col("weight"), F.col("limit")))
    return per.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source) as doc_id, source, size, source_size, target, taken, ``_h`` (the seeded hash) and ``_th`` (``text_key``)."""
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sizes = stored(docs.select("doc_id", "source", word_count().alias("size"), place.alias("_h"), text_key().alias("_th")), "mix-sizes")
    targets = source_targets(sizes, weights, share, cap)
    slim = sizes.withColumn("_bucket", F.substring("_h", 1, 3))
    buckets = slim.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    run = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_start", F.coalesce(F.sum("_sum").over(run), F.lit(0))).withColumnRenamed("source", "_s").withColumnRenamed("_bucket", "_b").drop("_sum")
    inner = Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id", "size", "_th").rowsBetween(Window.unboundedPreceding, -1)
    slim = slim.withColumn("_within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    slim = slim.join(buckets, slim["source"].eqNullSafe(buckets["_s"]) & (slim["_bucket"] == buckets["_b"])).drop("_s", "_b")
    targets = targets.withColumnRenamed("source", "_t")
    slim = slim.join(targets, slim["source"].eqNullSafe(targets["_t"])).drop("_t")
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    quota = F.round("target").cast("long") - times * F.col("source_size")
    extra = F.greatest(F.lit(0), F.least("size", quota - F.col("_start") - F.col("_within")))
    taken = (times * F.col("size") + extra).cast("long")
    return slim.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "_h", "_th")


def repeat_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix as rows of ``docs``: a document taken 1.4 times its size comes once whole and once as its first 40 % of words; taken 0 times it goes.

    A document in part keeps its white space up to the last word taken, and its
    ``n_chars`` follows. ``docs`` and ``mixed`` meet by id and text; what rows
    equal in both take is added up and comes from one of them.
    """
    own = ("doc_id", "text")
    plan = mixed.groupBy(F.col("doc_id").alias("_id"), "_th").agg(F.max("size").alias("_size"), F.sum("taken").alias("_taken"), F.count("*").alias("_times"))
    joined = met_by_row(pack(docs, *own), plan)
    whole = F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size"))).otherwise(F.col("_times")).cast("int")
    rest = F.when(F.col("_size") > 0, F.col("_taken") % F.col("_size")).otherwise(0).cast("int")
    parts = F.flatten(F.array(F.array_repeat(F.lit(None).cast("int"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>"))))
    rows = joined.withColumn("_part", F.explode(parts))
    words = F.split(F.col("text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("_part").isNull(), F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.col("_part")), ""))
    out = rows.withColumn("text", text)
    if "n_chars" not in docs.columns:
        return unpack(out, docs, own)
    before = F.col(f"_rest.r{[c for c in docs.columns if c not in own].index('n_chars')}")
    after = F.when(F.col("_part").isNull(), before).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return unpack(out, docs, own, n_chars=after).select(*[f"`{c}`" for c in docs.columns])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source", "_h", "_th")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat('mix-1:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST([5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1] AS DOUBLE) AS weight,
         CAST(2.0 AS DOUBLE) * source_size AS cap FROM s0),
s2 AS (SELECT *, row_number() OVER o AS nth,
         (CAST(1.5 AS DOUBLE) * (SELECT sum(source_size) FROM s0) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
       FROM s1 WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)),
f AS (SELECT arg_min(level, nth) AS level FROM s2 WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM f) * weight, cap)) AS target FROM s2),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CAST(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS BIGINT) AS times,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(times * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - times * source_size - before)) AS BIGINT) AS taken
FROM j
"""
