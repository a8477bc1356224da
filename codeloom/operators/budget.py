"""Filling a budget, by running state over ordered rows of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import kept, stored


#: Items of a group that one round folds.
ROUND = 1000  # Spark cuts windows to so many rows before it moves them


def greedy_fill(rows: DataFrame, group: str, order: str, key: str, size: str, budget: int, limit: int | None = None) -> DataFrame:
    """(``group``, taken): keys in order; one that is empty or no longer fits is skipped, and later ones may still fit.

    A skipped item uses no budget, so a running sum would be wrong; the state is
    folded over the group's ordered items (key and size only), of which ``limit``
    are looked at. A round folds the first ROUND items of each group and hands on
    what they left of the budget; items that no longer fit in that go, wherever they
    stand, and the next round begins with the first that still does. What is
    gathered is ROUND items of a group, and its taken keys, at most ``budget`` of
    them, however long the group is; there are few rounds, as each leaves only
    items that fit in what is left.
    """
    rows = rows.where(F.col(size).isNotNull())
    if limit is not None:
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(order, key, size))).where(F.col("_place") <= limit)
    rows = rows.select(F.col(group).alias("_g"), F.col(order).alias("_o"), F.col(key).alias("_k"), F.col(size).cast("long").alias("_s"))
    groups = rows.select("_g").distinct()
    left = kept(rows.where(F.col("_s").between(1, budget)).withColumn("_m", F.monotonically_increasing_id()), "fill")
    kind = left.schema["_k"].dataType.simpleString()
    item = ("_o", "_k", "_s", "_m")  # the last tells equal ones apart
    used, taken, nth = left.select("_g").distinct().withColumn("_used", F.lit(0).cast("long")), [], 0
    while not left.isEmpty():
        nth += 1
        place = F.row_number().over(Window.partitionBy("_g").orderBy(*item))
        first = left.withColumn("_place", place).where(F.col("_place") <= ROUND).groupBy("_g").agg(F.array_sort(F.collect_list(F.struct(*item))).alias("items"))
        first = first.join(used.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h"))).drop("_h")
        start = F.struct(F.col("_used").alias("used"), F.array().cast(f"array<{kind}>").alias("taken"))

        def step(state, one):
            fits = state["used"] + one["_s"] <= budget
            return F.struct(F.when(fits, state["used"] + one["_s"]).otherwise(state["used"]).alias("used"), F.when(fits, F.array_append(state["taken"], one["_k"])).otherwise(state["taken"]).alias("taken"))

        folded = first.select("_g", F.aggregate("items", start, step).alias("state"), F.element_at("items", -1).alias("last"))
        folded = kept(folded.select("_g", F.col("state.used").alias("_used"), F.col("state.taken").alias("taken"), "last"), "fill")
        taken.append(folded.select("_g", F.struct(F.lit(nth).alias("nth"), "taken").alias("some")))
        used = folded.select("_g", "_used")
        behind = folded.select(F.col("_g").alias("_h"), (F.lit(budget) - F.col("_used")).alias("_room"), "last")
        met = left.join(behind, F.col("_g").eqNullSafe(F.col("_h")))
        left = kept(met.where((F.col("_s") <= F.col("_room")) & (F.struct(*item) > F.col("last"))).select(*left.columns), "fill")
    found = groups.withColumn("some", F.lit(None).cast(f"struct<nth:int,taken:array<{kind}>>"))
    for some in taken:
        found = found.unionByName(some)
    whole = F.flatten(F.transform(F.array_sort(F.collect_list("some")), lambda x: x["taken"]))
    return found.groupBy("_g").agg(whole.alias("taken")).select(F.col("_g").alias(group), "taken")


def running_cut(rows: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """``rows`` with ``before`` and ``kept`` (of its size): whole while the sum fits, the one that crosses cut to what is left, none after."""
    # the running sum has two levels, so that no task holds a whole group: ranges of the order, then rows of a range
    ranged = stored(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.sum(size).alias("_sum"))
    earlier = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_g", "_r", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("_within", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    out = within.join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    kept = F.greatest(F.lit(0), F.least(F.col(size), F.lit(budget) - F.col("before")))
    return out.withColumn("before", F.col("_start") + F.col("_within")).withColumn("kept", kept).select(*rows.columns, "before", "kept")


def cut_at_line(text, budget):
    """A text over ``budget`` (a number or column) characters, cut after its last whole line within it."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    head = F.substring(text, F.lit(1), budget)
    return F.when(F.length(text) <= budget, text).otherwise(F.concat(F.regexp_replace(head, r"[^\n]*$", ""), F.lit("... (cut off)")))


def _anchor(line):
    """The longest word of a line that has blanks on both sides in it; so a text that holds the line has it as a word. Null if there is none."""
    words = F.split(line, " ")
    inner = F.filter(F.slice(words, F.lit(2), F.greatest(F.lit(0), F.size(words) - 2)), lambda w: w != "")
    return F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def drop_repeats(chunks: DataFrame, excerpts: DataFrame) -> DataFrame:
    """``chunks`` (source, text) that hold the first line of no excerpt (source, text) of their source.

    A line is looked for only in chunks that have its anchor, one of its inner
    words, which source and word find in a join; lines without inner words, of
    two words at most, are looked for in all chunks of their source.
    """
    first = excerpts.select(F.col("source").alias("_source"), F.element_at(F.split(F.trim("text"), "\n"), 1).alias("_line")).where("_line <> ''").distinct()
    lines = stored(first.withColumn("_anchor", _anchor(F.col("_line"))), "lines")
    held = stored(chunks.withColumn("_m", F.monotonically_increasing_id()), "chunks")
    words = held.select(F.col("source").alias("_source"), "_m", F.explode(F.array_distinct(F.split("text", " "))).alias("_anchor"))
    wanted = lines.where("_anchor is not null")
    words = words.join(wanted.select("_source", "_anchor").distinct(), ["_source", "_anchor"], "left_semi")
    near = words.join(wanted, ["_source", "_anchor"]).select("_m", "_line")
    found = held.select("_m", "text").join(near, "_m").where(F.contains(F.col("text"), F.col("_line"))).select("_m")
    short = lines.where("_anchor is null")
    if not short.isEmpty():
        plain = held.join(short, (F.col("source") == F.col("_source")) & F.contains(F.col("text"), F.col("_line"))).select("_m")
        found = found.unionByName(plain)
    return held.join(found.distinct(), "_m", "left_anti").select(*[f"`{c}`" for c in chunks.columns])


def assemble(excerpts: DataFrame, chunks: DataFrame, group: str, budget: int) -> DataFrame:
    """(``group``, taken): excerpts first, then chunks that repeat none and fit; without excerpts all chunks, uncut.

    Both: (``group``, ord, source, text).
    """
    fresh = drop_repeats(chunks, excerpts)
    both = excerpts.withColumn("rank", F.struct(F.lit(0).alias("side"), "ord")).unionByName(fresh.withColumn("rank", F.struct(F.lit(1).alias("side"), "ord")))
    both = both.withColumns({"size": F.length("text"), "any": F.bool_or(F.col("rank.side") == 0).over(Window.partitionBy(group))})
    cut = greedy_fill(both.where("any"), group, "rank", "text", "size", budget)
    whole = both.where("not any").groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("taken"))
    return cut.unionByName(whole)


def labelled(chunks: DataFrame, group: str) -> DataFrame:
    """(``group``, context): chunks (ord, source, text) under a header of their source, parted by rules."""
    text = F.concat_ws("\n", F.when(F.col("source") != "", F.concat(F.lit("# "), F.col("source"))), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", text.alias("t"))))
    return chunks.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n---\n\n").alias("context"))
