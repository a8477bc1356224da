"""Suffix-array dedup: mark every byte inside a string of ``window`` bytes that
also starts anywhere else in the corpus, by a run-length index.

Plan, with nothing held whole anywhere:

1. ``pieces``: each text is cut by content-defined anchors (see ``anchors``).
   Pieces whose anchor occurs once go at once. The others meet by
   ``(anchor, fp)``, summed before the shuffle, so a text with a million copies
   costs a row for each task.
2. Pieces that meet often name two places, the first and the last. Neighbours
   with the same two documents are put together (``regions``), the bytes of both
   places are fetched, the first ones of a block get a run-compressed
   Burrows-Wheeler transform (``run_index``), and the last ones are streamed
   through its runs. What is found there is marked at every place.
3. Anchors with several *different* pieces may share only a part: their distinct
   pieces are gathered by anchor in blocks of bounded size, each block gets its
   transform, and matching statistics mark long matches.
4. An anchor with more than ``hot`` different pieces would make a block without
   a bound. Its windows meet by digest, with a map-side sum; two places of each
   that occurs again go through the index as in step 2.
5. Marked pieces go back to their documents, ranges become bytes.

Hashes only name candidates; bytes are removed where the index finds them. Two
places that share 128 bits of hashes but not their bytes would stay.

Defined results: null text counts as empty; a text under ``window`` bytes loses
nothing; two rows with equal text match each other, whatever their ids; an id
may be null or repeat; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import anchors
from .common import pack, read, release, schema_of, small_batches, stored, text_bytes, unpack
from .run_index import RunIndex

WINDOW = 200
HOT = 2048
BLOCK = 1 << 20
SPAN = 1024  # window starts in a region at most
SLICED = 1 << 21  # bytes of pieces that a task holds at once, beside its texts

_KEY = ["_id", "_th"]
_PIECE = "_id long, _th int, first int, last int, off int, anchor long, fp long"


def _keyed(docs: DataFrame) -> DataFrame:
    """A row's key follows from its content: id (for a null id 64 bits of the text's hash) and 31 bits of the text's hash. Rows of equal key and text get equal marks."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("null id"), text)), "_th": F.xxhash64(text).bitwiseAND(0x7FFFFFFF).cast("int")})


def _cut(window: int):
    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch["text"])
            found = anchors.pieces(raw, offsets, window)
            doc = pa.array(found.pop("doc"))
            names = {k: v.astype(np.int32) for k, v in found.items() if k in ("first", "last", "off")}
            yield pa.RecordBatch.from_arrays(
                [batch["_id"].take(doc), batch["_th"].take(doc), *map(pa.array, (names["first"], names["last"], names["off"], found["anchor"], found["fp"]))],
                names=["_id", "_th", "first", "last", "off", "anchor", "fp"],
            )
        release()

    return run


def pieces(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    small_batches(keyed.sparkSession)
    return keyed.select("_id", "_th", F.col("text").cast("binary").alias("text")).mapInArrow(_cut(window), _PIECE)


def _blocks(batches, size: int):
    """Rows sorted by anchor, in blocks of whole anchors of about ``size`` bytes."""
    held, held_bytes = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        held_bytes += batch["piece"].nbytes
        if held_bytes < size:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        anchor = np.asarray(table["anchor"].combine_chunks() if table["anchor"].num_chunks > 1 else table["anchor"].chunk(0))
        lengths = np.asarray(pa.compute.binary_length(table["piece"].combine_chunks() if table["piece"].num_chunks > 1 else table["piece"].chunk(0)))
        ends = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        total, begin = np.cumsum(lengths), 0
        while len(ends):
            start = total[begin - 1] if begin else 0
            cut = ends[min(int(np.searchsorted(total[ends - 1], start + size, "left")), len(ends) - 1)]
            if total[-1] - start < size:
                break
            yield table.slice(begin, cut - begin)
            begin = int(cut)
            ends = ends[ends > begin]
        rest = table.slice(begin).combine_chunks()
        held = rest.to_batches() if rest.num_rows else []
        held_bytes = int(total[-1] - (total[begin - 1] if begin else 0))
    if held:
        yield pa.Table.from_batches(held)


def _index_block(table: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, from, to): runs of window starts, counted from the piece's first, with a match elsewhere."""
    raw, offsets = text_bytes(table["piece"])
    lengths = np.diff(offsets)
    where = np.arange(len(raw)) + np.repeat(np.arange(len(lengths)), lengths)
    symbols = np.full(len(raw) + len(lengths), 256, np.uint64)  # 256 ends each piece and equals no byte
    symbols[where] = raw
    starts = offsets[:-1] + np.arange(len(lengths))
    left = np.repeat(starts + lengths, lengths + 1) - np.arange(len(symbols))
    long = (RunIndex(symbols).matching_statistics() >= window) & (left >= window)
    edge = np.diff(np.concatenate([[False], long, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    piece = np.searchsorted(starts, begin, "right") - 1
    return piece, begin - starts[piece], end - starts[piece]


def _match(window: int, size: int):
    def run(batches):
        for table in _blocks(batches, size):
            piece, begin, end = _index_block(table, window)
            rows = pa.array(piece)
            yield pa.RecordBatch.from_arrays(
                [table["anchor"].take(rows).combine_chunks(), table["fp"].take(rows).combine_chunks(), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))],
                names=["anchor", "fp", "lo", "hi"],
            )
        release()

    return run


def _slices(batches, size: int = SLICED):
    """Bytes of the listed pieces of each text, in batches of about ``size`` bytes."""
    for batch in batches:
        raw, offsets = text_bytes(batch["text"])
        wanted = batch["wanted"].flatten()
        ask = lambda name: np.asarray(pa.compute.struct_field(wanted, name)).astype(np.int64)  # noqa: E731,B023
        base = offsets[np.asarray(pa.compute.list_parent_indices(batch["wanted"]))]
        begin, lengths = base + ask("first"), ask("last") + ask("extra") - ask("first")
        total, a = np.cumsum(lengths), 0
        while a < len(begin):
            b = max(int(np.searchsorted(total, (total[a - 1] if a else 0) + size, "right")), a + 1)
            n = lengths[a:b]
            ends = np.cumsum(n)
            piece = raw[np.repeat(begin[a:b] - (ends - n), n) + np.arange(ends[-1])]
            column = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(piece)])
            rest = [pa.compute.struct_field(wanted.slice(a, b - a), name) for name in ("anchor", "fp", "side")]
            yield pa.RecordBatch.from_arrays([*rest, column], names=["anchor", "fp", "side", "piece"])
            a = b
    release()


def regions(places: DataFrame, by: list[str]) -> DataFrame:
    """``places`` (``by``, first, last, member) that follow each other under equal ``by``, put together up to SPAN window starts: region, ``by``, first, last, members."""
    inside = Window.partitionBy(*by, F.expr(f"first div {SPAN}").alias("_part")).orderBy("first")
    fresh = F.coalesce((F.lag("last").over(inside) + 1 != F.col("first")).cast("int"), F.lit(1))
    island = places.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(inside))
    met = island.groupBy(*by, F.expr(f"first div {SPAN}").alias("_part"), "_island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.collect_list("member").alias("members"))
    return stored(met.drop("_part", "_island").withColumn("region", F.monotonically_increasing_id()), "regions")


def _found(batches):
    """Regions whose last place (b) the index of the first places (a) finds."""
    for batch in batches:
        raw, offsets = text_bytes(batch["a"])
        lengths = np.diff(offsets)
        symbols = np.full(len(raw) + len(lengths), 256, np.uint64)  # 256 ends each string and equals no byte
        symbols[np.arange(len(raw)) + np.repeat(np.arange(len(lengths)), lengths)] = raw
        again = RunIndex(symbols).occur(*text_bytes(batch["b"]))
        yield pa.RecordBatch.from_arrays([batch["region"].filter(pa.array(again))], names=["region"])
    release()


def _windows(window: int, flush: int = 1 << 17):
    """Every window of a piece, by its distance from the anchor."""

    def batch_of(pieces, digests):
        anchor, fp, off, n = (np.array(c, np.int64) for c in zip(*pieces))
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        columns = [np.repeat(anchor, n), np.repeat(fp, n), at.astype(np.int32), (at - np.repeat(off, n)).astype(np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(digests, pa.binary())], names=["anchor", "fp", "at", "rel", "digest"])

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch["piece"])
            anchor, fp, off = (np.asarray(batch[c]) for c in ("anchor", "fp", "off"))
            pieces, digests = [], []
            for k in range(batch.num_rows):
                piece = raw[offsets[k] : offsets[k + 1]].tobytes()
                n = len(piece) - window + 1
                pieces.append((anchor[k], fp[k], off[k], n))
                digests += [hashlib.blake2b(piece[i : i + window], digest_size=16).digest() for i in range(n)]
                if len(digests) >= flush:
                    yield batch_of(pieces, digests)
                    pieces, digests = [], []
            if pieces:
                yield batch_of(pieces, digests)
        release()

    return run


def marks(keyed: DataFrame, window: int = WINDOW, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(_id, _th, spans array<struct<a int, b int>>): byte ranges [a, b) to remove, one row for each key with any; ranges may overlap."""
    if not anchors.K <= window:
        raise ValueError(f"window must be {anchors.K} bytes at least")
    cut = pieces(keyed, window)
    # stored, so that the join below has two plain shuffles, whose skewed partitions Spark can split
    often = stored(cut.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "anchors")
    met = stored(cut.join(often, "anchor", "left_semi"), "met")
    place = F.struct("_id", "_th", "first", "last", "off")
    distinct = met.groupBy("anchor", "fp").agg(F.count("*").alias("n"), F.min(place).alias("at"), F.max(place).alias("to"))
    kinds = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"))
    known = stored(distinct.join(kinds, "anchor").where("n > 1 or kinds > 1").select("anchor", "fp", "n", "kinds", "at.*", "to"), "repeats")
    again = known.where("n > 1").select(*_KEY, F.col("to._id").alias("_id2"), F.col("to._th").alias("_th2"), (F.col("to.first") - F.col("first")).alias("shift"), "first", "last", F.struct("anchor", "fp").alias("member"))
    pairs = regions(again, [*_KEY, "_id2", "_th2", "shift"])
    partial = known.where("kinds > 1")

    # all bytes that the index needs, fetched at once; side -1 is a piece, 0 and 1 the two places of a region
    ask = lambda anchor, fp, first, last, side: F.struct(F.expr(anchor).alias("anchor"), F.expr(fp).alias("fp"), F.expr(first).alias("first"), F.expr(last).alias("last"), F.lit(window).alias("extra"), F.lit(side).alias("side"))
    asked = partial.select(*_KEY, ask("anchor", "fp", "first", "last", -1).alias("w"))
    asked = asked.unionByName(pairs.select(*_KEY, ask("region", "0L", "first", "last", 0).alias("w")))
    asked = asked.unionByName(pairs.select(F.col("_id2").alias("_id"), F.col("_th2").alias("_th"), ask("region", "0L", "first + shift", "last + shift", 1).alias("w")))
    wanted = asked.groupBy(*_KEY).agg(F.collect_set("w").alias("wanted"))
    texts = keyed.select(*_KEY, F.col("text").cast("binary").alias("text"))
    fetched = stored(texts.join(wanted, _KEY).select("text", "wanted").mapInArrow(_slices, "anchor long, fp long, side int, piece binary"), "strings")

    sides = fetched.where("side >= 0").groupBy(F.col("anchor").alias("region")).agg(F.max(F.when(F.col("side") == 0, F.col("piece"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("piece"))).alias("b"))
    sure = pairs.join(sides.mapInArrow(_found, "region long"), "region").select(F.explode("members").alias("m")).select("m.*")
    places = met.join(sure, ["anchor", "fp"], "left_semi")
    whole = places.select(*_KEY, F.col("first").alias("a"), (F.col("last") + window).alias("b"))

    strings = fetched.where("side < 0").drop("side").dropDuplicates(["anchor", "fp"])
    ordinary = strings.join(partial.where(F.col("kinds") <= hot).select("anchor", "fp"), ["anchor", "fp"], "left_semi")
    once = ordinary.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_match(window, block), "anchor long, fp long, lo int, hi int")
    many = partial.where(F.col("kinds") > hot).select("anchor", "fp", "off")
    if not many.isEmpty():
        once = once.unionByName(_hot_matches(stored(strings.join(many, ["anchor", "fp"]), "hot"), window))
    # a piece that occurs once is marked where it stands, one that occurs more often at every place
    single = known.where("n = 1").join(once, ["anchor", "fp"]).select(*_KEY, (F.col("first") + F.col("lo")).alias("a"), (F.col("first") + F.col("hi") + window).alias("b"))
    return single.unionByName(whole).groupBy(*_KEY).agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _hot_matches(strings: DataFrame, window: int) -> DataFrame:
    """(anchor, fp, lo, hi) of the windows of ``strings`` (anchor, fp, off, piece) that stand at one distance from the anchor in several pieces."""
    every = strings.mapInArrow(_windows(window), "anchor long, fp long, at int, rel int, digest binary")
    place = F.struct("fp", "at")
    twice = every.groupBy("anchor", "rel", "digest").agg(F.count("*").alias("k"), F.min(place).alias("x"), F.max(place).alias("y")).where("k > 1")
    twice = twice.select("anchor", F.col("x.fp").alias("fp"), F.col("y.fp").alias("fp2"), (F.col("y.at") - F.col("x.at")).alias("shift"), F.col("x.at").alias("first"), F.col("x.at").alias("last"), F.struct("rel", "digest").alias("member"))
    pairs = regions(twice, ["anchor", "fp", "fp2", "shift"])
    piece = strings.select("anchor", "fp", "piece")
    size = F.col("last") - F.col("first") + window
    sides = pairs.join(piece, ["anchor", "fp"]).withColumn("a", F.substring("piece", F.col("first") + 1, size)).drop("piece")
    sides = sides.join(piece.withColumnRenamed("fp", "fp2"), ["anchor", "fp2"]).select("region", "a", F.substring("piece", F.col("first") + F.col("shift") + 1, size).alias("b"))
    sure = pairs.join(sides.mapInArrow(_found, "region long"), "region").select("anchor", F.explode("members").alias("m")).select("anchor", "m.*")
    return every.join(sure, ["anchor", "rel", "digest"], "left_semi").select("anchor", "fp", F.col("at").alias("lo"), F.col("at").alias("hi"))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _remove(batches):
    for batch in batches:
        raw, offsets = text_bytes(batch["text"])
        kept, removed, count = [], [], []
        for k, spans in enumerate(batch["spans"].to_pylist()):
            text, spans, at, parts = raw[offsets[k] : offsets[k + 1]], _merged(spans), 0, []
            for a, b in spans:
                parts.append(text[at:a].tobytes())
                at = b
            parts.append(text[at:].tobytes())
            kept.append(b"".join(parts))
            removed.append(sum(b - a for a, b in spans))
            count.append(len(spans))
        rest = [batch[c] for c in batch.schema.names if c not in ("text", "spans")]
        names = [c for c in batch.schema.names if c not in ("text", "spans")]
        size = np.diff(offsets)
        yield pa.RecordBatch.from_arrays([*rest, pa.array(kept, pa.binary()), pa.array(size), pa.array(removed, pa.int64()), pa.array(count, pa.int64())], names=[*names, "_kept", "_size", "_removed", "_spans"])
    release()


_OWN = ("doc_id", "text")


def remove_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id, text, ...) without its repeated strings: its columns but for text, then
    ``kept`` binary, ``n_bytes``, ``n_removed`` and ``n_spans`` long (bytes before, bytes and
    maximal runs removed)."""
    keyed = _keyed(pack(docs, *_OWN))
    spans = marks(keyed.select(*_KEY, "text"), window, hot, block)
    joined = keyed.withColumn("text", F.col("text").cast("binary")).join(spans, _KEY, "left").drop(*_KEY)
    left = joined.mapInArrow(_remove, schema_of(joined, ("text", "spans"), _kept="binary", _size="long", _removed="long", _spans="long"))
    return unpack(left, docs, _OWN, without=("text",), kept=F.col("_kept"), n_bytes=F.col("_size"), n_removed=F.col("_removed"), n_spans=F.col("_spans"))


def _clean(batches):
    for batch in batches:
        text = [b.decode("utf-8", "ignore") for b in batch["_kept"].to_pylist()]
        names = [c for c in batch.schema.names if c != "_kept"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(text, pa.string())], names=[*names, "_text"])
    release()


def clean_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the texts that ``remove_repeats`` leaves: a character that a cut splits goes
    whole, ``n_chars`` (if there) follows, null texts stay null, and a text may end up empty."""
    slim = pack(docs, *_OWN)
    out = remove_repeats(slim.withColumn("_null", F.col("text").isNull()), window).select("doc_id", "_rest", "_null", F.col("kept").alias("_kept"), F.col("n_removed").alias("_removed"))
    out = out.mapInArrow(_clean, schema_of(out, ("_kept",), _text="string")).withColumn("text", F.when(~F.col("_null"), F.col("_text")))
    if "n_chars" not in docs.columns:
        return unpack(out, docs, _OWN)
    before = F.col(f"_rest.r{[c for c in docs.columns if c not in _OWN].index('n_chars')}")
    after = F.when(F.col("_removed") > 0, F.length("text")).otherwise(before).cast(docs.schema["n_chars"].dataType)
    return unpack(out, docs, _OWN, n_chars=after).select(*[f"`{c}`" for c in docs.columns])


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
