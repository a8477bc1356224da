"""Shards of near equal bytes by sampled splitters, in DataFrame functions only.

Law: ``bytes``. A row's size is the UTF-8 bytes of its text plus 16.

1. Units. Rows of equal text are a group. A group of at most one shard's share is
   a unit and stays whole; in a larger one every row is a unit, so that a text that
   fills a third of the table is cut where needed. Units above a ``GRAIN``-th of a
   share are heavy: at most GRAIN * shards of them, whatever the table's size.
2. Heavy units are dealt, largest first, each to the shard with least so far. What
   room that leaves below one common level is each shard's room for the rest.
3. Keys. Every row gets a 63-bit key: heavy units by their number and then by row,
   the rest by a hash of the text (and of the row, in a group that is cut).
4. Splitters. Keys are drawn with a chance in proportion to the row's size, one for
   each INTERVALS-th of a share; they bound ranges. A range that holds more than
   OVERFULL times what a sample stands for is subdivided by keys drawn in it, until
   none is left. The splitters, a few thousand at most, are a constant of the plan;
   a row finds its range by binary search.
5. Each range is one window group: running bytes in it plus the bytes of the ranges
   before it give a unit's place, and the place its shard. Row numbers alike give
   slots. No task holds more than a range.

The sizes of two shards differ by the size of a unit that is not heavy (a GRAIN-th
of a share) at most, except that a heavy unit may be larger than the level.

Defined results: null text has size 16, crc 0, and is grouped with empty text; ids
may be null or repeat, each row is placed; equal rows are interchangeable; with
fewer rows than shards some shards are empty; an empty table gives an empty result.
A second run over the same files gives the same shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pack, read, stored, unpack

SHARDS = 40
GRAIN = 32
INTERVALS = 64
OVERFULL = 8
ROW_BYTES = 16
_UNIT_BITS, _ROW_BITS, _COPY_BITS = 31, 31, 12


def measured(docs: DataFrame, row=None) -> DataFrame:
    """``docs`` (doc_id, text) as slim rows: doc_id, size, text_crc32, ``_g`` (hash of the text), ``_m`` (names the row: ``row``, if given)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_g"),
        (F.monotonically_increasing_id() if row is None else row).alias("_m"),
    )


def _bits(column, n: int):
    """The upper ``n`` bits of a hash as a number from 0 on."""
    return F.shiftrightunsigned(column, 64 - n)


def heavy_units(slim: DataFrame, share: float) -> DataFrame:
    """Heavy units, at most GRAIN * shards rows, numbered by size: ``_hg`` (group), ``_hm`` (row, null for a whole group), ``_unit``, ``_size``."""
    groups = slim.groupBy("_g").agg(F.sum("size").alias("_size")).where(F.col("_size") > share / GRAIN)
    whole = groups.where(F.col("_size") <= share).select(F.col("_g").alias("_hg"), F.lit(None).cast("long").alias("_hm"), "_size")
    rows = slim.where(F.col("size") > share / GRAIN).join(F.broadcast(groups.where(F.col("_size") > share).select("_g")), "_g", "left_semi")
    units = whole.unionByName(rows.select(F.col("_g").alias("_hg"), F.col("_m").alias("_hm"), F.col("size").alias("_size")))
    return units.withColumn("_unit", F.row_number().over(Window.orderBy(F.desc("_size"), "_hg", "_hm")).cast("long"))


def deal_heavy(units: DataFrame, shards: int) -> DataFrame:
    """One row: ``load`` (bytes of each shard so far) and ``at`` (the shard of unit 1, 2, ...). Largest first, each to the least loaded."""
    sizes = units.agg(F.transform(F.array_sort(F.collect_list(F.struct("_unit", "_size"))), lambda u: u["_size"]).alias("sizes"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("at"))

    def place(state, size):
        least = (F.array_position(state["load"], F.array_min(state["load"])) - 1).cast("int")
        load = F.transform(state["load"], lambda bytes_, k: F.when(k == least, bytes_ + size).otherwise(bytes_))
        return F.struct(load.alias("load"), F.array_append(state["at"], least).alias("at"))

    return sizes.select(F.aggregate("sizes", start, place).alias("s")).select("s.load", "s.at")


def room(loads: list[int], rest: int) -> list[float]:
    """Bytes that each shard takes of ``rest``, so that all stand at one level, but for those above it already."""
    total, level = float(rest), 0.0
    for n, load in enumerate(sorted(loads), 1):
        total += load
        if n == 1 or total / n > load:
            level = total / n
    return [max(0.0, level - load) for load in loads]


def numbers(values) -> F.Column:
    """Numbers as one constant array; Spark folds the cast when it plans."""
    return F.split(F.lit(",".join(str(v) for v in values)), ",").cast("array<bigint>")


def last_not_above(values: list[int], key) -> F.Column:
    """How many of the sorted ``values`` are at most ``key``, by binary search."""
    bounds, n = numbers(values), len(values)
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
    inside = lambda at: at <= n
    take = lambda at, step: F.when(inside(at + step) & (F.element_at(bounds, F.least(at + step, F.lit(n))) <= key), at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), take)


def drawn(keyed: DataFrame, interval: float, seed: int) -> DataFrame:
    """Keys drawn with a chance of size / ``interval``, about total / interval of them."""
    chance = _bits(F.xxhash64("_m", F.lit(seed)), 53) / F.lit(float(1 << 53))
    return keyed.where(chance < F.col("size") / F.lit(interval)).select("_key")


def splitters(keyed: DataFrame, interval: float) -> list[int]:
    """Sorted keys at which ranges begin; no range holds more than OVERFULL intervals but one that is a single key."""
    found = {r["_key"] for r in drawn(keyed, interval, 0).distinct().collect()}
    seed = 0
    while found:
        bounds, seed = sorted(found), seed + 1
        per = keyed.groupBy(last_not_above(bounds, F.col("_key")).alias("_range")).agg(F.sum("size").alias("_bytes"), F.min("_key").alias("_from"), F.max("_key").alias("_to"))
        over = per.where((F.col("_bytes") > OVERFULL * interval) & (F.col("_from") < F.col("_to"))).select("_from", "_to").collect()
        if not over:
            return bounds
        edges = sorted(k for r in over for k in (r["_from"], r["_to"] + 1))  # an end may be the next one's begin: both count
        inner = keyed.where(last_not_above(edges, F.col("_key")) % 2 == 1)
        for r in drawn(inner, interval, seed).distinct().collect():
            found |= {r["_key"], r["_key"] + 1}  # both sides, so that one large key comes to stand alone
    return []


def assign(slim: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows of ``measured`` as doc_id, size, text_crc32, shard (0 to shards - 1), slot (from 0 without gaps) and ``_m``."""
    slim = stored(slim, "shard-sizes")
    total = slim.agg(F.sum("size")).first()[0] or 0
    share = max(total / shards, 1.0)
    units = stored(heavy_units(slim, share), "shard-units")
    dealt = deal_heavy(units, shards).first()
    loads, at = dealt["load"], dealt["at"]
    bounds, reached = [], 0.0
    for r in room(loads, total - sum(loads)):
        reached += r
        bounds.append(reached)

    cut = slim.groupBy("_g").agg(F.sum("size").alias("_bytes")).where(F.col("_bytes") > share).select("_g", F.lit(True).alias("_cut"))  # fewer than shards
    heavy = F.broadcast(units.select("_hg", "_hm", "_unit"))  # at most GRAIN * shards
    met = slim.join(heavy, (F.col("_g") == F.col("_hg")) & F.coalesce(F.col("_hm") == F.col("_m"), F.lit(True)), "left").drop("_hg", "_hm").join(F.broadcast(cut), "_g", "left")
    group = _bits(F.xxhash64("_g", F.lit("unit")), _UNIT_BITS)
    row = F.shiftleft(_bits(F.xxhash64("doc_id"), _ROW_BITS - _COPY_BITS), _COPY_BITS) + _bits(F.xxhash64("_m"), _COPY_BITS)
    upper = F.coalesce(F.lit(1 << _UNIT_BITS) + F.col("_unit"), group)
    key = F.shiftleft(upper, _ROW_BITS) + F.when(F.col("_unit").isNotNull() | F.col("_cut").isNotNull(), row).otherwise(0)
    keyed = stored(met.select("doc_id", "size", "text_crc32", "_g", "_m", "_unit", key.cast("long").alias("_key")), "shard-keys")

    begins = splitters(keyed, share / INTERVALS)
    ranged = keyed.withColumn("_range", last_not_above(begins, F.col("_key")) if begins else F.lit(0))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    per = ranged.groupBy("_range").agg(F.sum(F.when(F.col("_unit").isNull(), F.col("size")).otherwise(0)).alias("_b"), F.count("*").alias("_n"))
    per = per.select("_range", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_bytes_before"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"))
    by_key = Window.partitionBy("_range").orderBy("_key")
    light = F.when(F.col("_unit").isNull(), F.col("size")).otherwise(0)
    placed = ranged.withColumns({"_end": F.sum(light).over(by_key), "_own": F.sum(light).over(Window.partitionBy("_range", "_key")), "_nth": F.row_number().over(Window.partitionBy("_range").orderBy("_key", "doc_id", "_g", "_m"))})
    placed = placed.join(F.broadcast(per), "_range")  # as many rows as ranges
    middle = F.col("_bytes_before") + F.col("_end") - F.col("_own") / 2
    light_shard = F.least(last_not_above([int(b) for b in bounds], F.floor(middle)), F.lit(shards - 1))
    heavy_shard = F.element_at(numbers(at), F.col("_unit").cast("int")).cast("int") if at else F.lit(None).cast("int")
    placed = placed.select("doc_id", "size", "text_crc32", "_m", "_unit", F.coalesce(heavy_shard, light_shard).cast("int").alias("shard"), (F.col("_rows_before") + F.col("_nth")).cast("long").alias("_at"))
    placed = stored(placed, "shard-places")

    # rows of one unit, and of what is light in one shard, follow each other; so each such run needs one number
    runs = placed.groupBy("shard", F.coalesce("_unit", F.lit(0)).alias("_run")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("shard").alias("_s"), "_run", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    final = placed.join(F.broadcast(runs), (F.col("shard") == F.col("_s")) & (F.coalesce("_unit", F.lit(0)) == F.col("_run")))  # at most (GRAIN + 1) * shards
    return final.select("doc_id", "size", "text_crc32", "shard", (F.col("_at") + F.col("_shift")).cast("long").alias("slot"), "_m")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 1) -> None:
    """Write ``docs`` below ``path`` in folders shard=0, shard=1, ..., rows in order of slot, in ``files`` files a shard.

    The columns of ``docs`` and ``slot`` are kept; one of ``docs`` named shard or slot gives way.
    """
    own = ("doc_id", "text")
    rows = stored(pack(docs, *own).withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    places = assign(measured(rows, F.col("_row")), shards).select("_m", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    met = unpack(rows.join(places, F.col("_row") == F.col("_m")), docs, own, ("shard", "slot"), shard=F.col("_shard"), slot=F.col("_slot"))
    met.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: not the law ``key``)."""
    placed = assign(measured(read(spark, sf_dir, "documents")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
