"""MinHash near-dedup: SuperMinHash signatures, banding, verification, union-find.

Documents with equal shingle sets fall into one class before anything else, so
a text with a million copies is one node. Classes meet in bands (32 bands of 4
rows: a pair of similarity 0.75 misses all bands with probability 5e-6). In a
band each class is first compared with the bucket's centre only. Most buckets
are then one component. In the others, every class outside its centre's
component is compared with all classes of the bucket that are not yet tied to
it, in blocks of at most BLOCK classes; a block holds the sets of its classes
and yields links only, so no list of pairs is made and none that could still
link is left out. A pair is looked at in the first band it shares, and its sets
are compared where the signatures agree in ALIKE slots (a pair of similarity
0.75 agrees in fewer with probability 1e-7).
Links are confirmed on the full sets of 64-bit shingle hashes.

Defined results: null text, and text without words, links with nothing; equal
rows share a component; a null id stays null and is kept only where its
component has no other id; extra columns stay out of the result of ``groups``.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, salted_join, small_batches, stored, text_bytes, text_key
from .components import components
from .shingles import band_keys, mix, shingle_sets, super_minhash

WIDTH, SLOTS, BANDS = 5, 128, 32
NUMERATOR, DENOMINATOR = 75, 100
ALIKE = 71
BLOCK = 2048


def _class(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 63-bit name for each set, from the sum of its mixed hashes and its size."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)))])
    size = np.diff(ends)
    return (mix((total[ends[1:]] - total[ends[:-1]]) * np.uint64(2) + np.uint64(1) + mix(size.astype(np.uint64))) >> np.uint64(1)).astype(np.int64)


def _sketch(batches):
    for batch in batches:
        raw, offsets = text_bytes(batch["text"])
        for d0, d1, hashes, ends in shingle_sets(raw, offsets, WIDTH):
            keys = band_keys(super_minhash(hashes, ends, SLOTS), BANDS).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (d1 - d0 + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(d0, d1 - d0), batch["th"].slice(d0, d1 - d0), pa.array(np.diff(ends)), pa.array(_class(hashes, ends)), bands], names=["doc_id", "th", "n", "cls", "bands"])
    release()


def _sets(batches):
    """Set, band keys and the low bytes of the signature of each text."""
    for batch in batches:
        raw, offsets = text_bytes(batch["text"])
        for _, _, hashes, ends in shingle_sets(raw, offsets, WIDTH):
            signature = super_minhash(hashes, ends, SLOTS)
            columns = [_binary(hashes, ends), _binary(band_keys(signature, BANDS), np.arange(len(ends)) * BANDS), _binary(signature.astype(np.uint8), np.arange(len(ends)) * SLOTS)]
            yield pa.RecordBatch.from_arrays([pa.array(_class(hashes, ends)), *columns], names=["cls", "set", "bands", "sig"])


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(values).reshape(-1)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * data.itemsize).astype(np.int32)), pa.py_buffer(data.tobytes())])


def _confirm(batches):
    """Pairs of sets that are similar enough."""
    for batch in batches:
        u, v, left, right = (batch[c] for c in ("u", "v", "a", "b"))
        keep = np.zeros(batch.num_rows, bool)
        for k in range(batch.num_rows):
            a, b = np.frombuffer(left[k].as_buffer(), np.uint64), np.frombuffer(right[k].as_buffer(), np.uint64)
            if len(a) > len(b):
                a, b = b, a
            both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            keep[k] = DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)
        yield pa.RecordBatch.from_arrays([u, v, pa.array(keep)], names=["u", "v", "linked"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with ``linked``."""
    a, b = sets.select(F.col("cls").alias("u"), F.col("set").alias("a")), sets.select(F.col("cls").alias("v"), F.col("set").alias("b"))
    return salted_join(pairs, a, "u", "v", "inner").join(b, "v").select("u", "v", "a", "b").mapInArrow(_confirm, "u long, v long, linked boolean")


def _blocks(batches):
    """Tables of whole groups (key, bx, by) from rows in their order, as (table, first rows of the groups)."""
    held = []
    for batch in chain(batches, [None]):
        if batch is not None:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) < BLOCK:
                continue
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        name = np.stack([np.asarray(table[c]) for c in ("key", "bx", "by")])
        first = np.flatnonzero(np.concatenate([[True], (name[:, 1:] != name[:, :-1]).any(axis=0)]))
        if batch is None:
            yield table, np.concatenate([first, [table.num_rows]])
            return
        if first[-1]:
            yield table.slice(0, first[-1]), first
        held = table.slice(first[-1]).combine_chunks().to_batches()


def _block_links(batches):
    for table, ends in _blocks(batches):
        key, cls, n, root = (np.asarray(table[c]) for c in ("key", "cls", "n", "r"))
        as_x, as_y, odd = (np.asarray(table[c]) for c in ("as_x", "as_y", "odd"))
        sets, bands, sig = (text_bytes(table[c]) for c in ("set", "bands", "sig"))
        elements, cut = np.frombuffer(sets[0].tobytes(), np.uint64), sets[1] // 8
        bands = np.frombuffer(bands[0].tobytes(), np.int64).reshape(-1, BANDS)
        sig = sig[0].reshape(-1, SLOTS)
        found = []
        for a, b in zip(ends[:-1], ends[1:]):
            here, ys = key[a], a + np.flatnonzero(as_y[a:b])
            for x in a + np.flatnonzero(as_x[a:b]):
                fits = (root[ys] != root[x]) & (~odd[ys] | (cls[ys] > cls[x])) & (DENOMINATOR * np.minimum(n[ys], n[x]) >= NUMERATOR * np.maximum(n[ys], n[x]))
                some = ys[fits]
                if not len(some):
                    continue
                same = bands[some] == bands[x]
                some = some[bands[x][same.argmax(axis=1)] == here]
                some = some[(sig[some] == sig[x]).sum(axis=1) >= ALIKE]
                if not len(some):
                    continue
                own, sizes = elements[cut[x] : cut[x + 1]], n[some]
                of = np.repeat(np.arange(len(some)), sizes)
                values = elements[np.arange(len(of)) + np.repeat(cut[some] - np.cumsum(sizes) + sizes, sizes)]
                both = np.bincount(of[own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values], minlength=len(some))
                linked = some[DENOMINATOR * both >= NUMERATOR * (n[x] + sizes - both)]
                # one link for each component
                _, one = np.unique(root[linked], return_index=True)
                found += [(cls[x], cls[y]) for y in linked[one]]
        cols = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(cols[:, 0]), pa.array(cols[:, 1])], names=["u", "v"])


def _size_fits(n, m):
    return F.lit(DENOMINATOR) * F.least(n, m) >= F.lit(NUMERATOR) * F.greatest(n, m)


def class_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, set) of the ``wanted`` classes (cls), from the text of each one's least document."""
    at = rows.groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(wanted, "cls", "left_semi")
    keys = at.select("doc_id").distinct()
    texts = docs.select("doc_id", "text").join(keys, docs["doc_id"].eqNullSafe(keys["doc_id"]), "left_semi")
    found = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(_sets, "cls long, set binary, bands binary, sig binary")
    return found.join(wanted, "cls", "left_semi").dropDuplicates(["cls"])


def groups(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, th (``text_key``), n_shingles, component_id, kept and first.

    ``kept`` goes by id, ``first`` by row: of each component only the rows of
    least id (null last) and, of those, of least text hash are first; rows
    equal in both are alike.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_key().alias("th"), F.col("text").cast("binary").alias("text"))
    rows = stored(texts.mapInArrow(_sketch, f"doc_id {kind}, th long, n long, cls long, bands array<long>"), "sketches")
    classes = rows.where("n > 0").groupBy("cls", "n").agg(F.first("bands").alias("bands"))
    members = classes.select("cls", "n", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("cls", "n")).alias("centre")).where("size > 1")
    shared = stored(members.join(buckets.select("key", F.col("centre.cls").alias("c"), F.col("centre.n").alias("cn")), "key"), "buckets")

    stars = shared.where((F.col("cls") != F.col("c")) & _size_fits(F.col("n"), F.col("cn"))).select(F.col("c").alias("u"), F.col("cls").alias("v")).distinct()
    sets = stored(class_sets(docs, rows, shared.select("cls").distinct()), "sets")
    links = stored(_verified(stars, sets.select("cls", "set")).where("linked").select("u", "v"), "links")
    roots = components(links)

    named = shared.join(roots.withColumnsRenamed({"node": "cls", "root": "r"}), "cls", "left").withColumn("r", F.coalesce("r", "cls"))
    central = roots.withColumnsRenamed({"node": "c", "root": "cr"})
    named = named.join(central, "c", "left").withColumn("odd", F.col("r") != F.coalesce("cr", "c"))
    mixed = stored(named.select("key", "cls", "n", "r", "odd"), "named")
    open_ = mixed.groupBy("key").agg(F.count("*").alias("size"), F.bool_or("odd").alias("any")).where("any").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    left = mixed.join(open_, "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    single = left.where("blocks = 1").select("key", F.lit(0).alias("bx"), F.lit(0).alias("by"), "cls", "n", "r", "odd", F.col("odd").alias("as_x"), F.lit(True).alias("as_y"))
    xs = left.where("blocks > 1 and odd").select("key", F.col("own").alias("bx"), others.alias("by"), "cls", "n", "r", "odd", F.lit(True).alias("as_x"), F.lit(False).alias("as_y"))
    ys = left.where("blocks > 1").select("key", others.alias("bx"), F.col("own").alias("by"), "cls", "n", "r", "odd", F.lit(False).alias("as_x"), F.lit(True).alias("as_y"))
    rest = single.unionByName(xs).unionByName(ys).join(sets, "cls")
    rest = rest.repartition("key", "bx", "by").sortWithinPartitions("key", "bx", "by").mapInArrow(_block_links, "u long, v long")
    more = stored(rest.distinct(), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    # least row of each class, then of each component; copies and components may hold most rows
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    of_class = rows.where("n > 0").groupBy("cls").agg(F.min(name).alias("least"))
    of_class = of_class.join(roots.withColumnsRenamed({"node": "cls", "root": "r"}), "cls", "left").withColumn("r", F.coalesce("r", "cls"))
    of_class = stored(of_class, "classes")
    least = salted_join(of_class.select("cls", "r"), of_class.groupBy("r").agg(F.min("least").alias("least")), "r", "cls")
    nobody = F.xxhash64("doc_id").bitwiseOR(F.lit(-(1 << 63)))  # below zero as no class is, and not the same for all
    out = salted_join(rows.select("doc_id", "th", "n", F.when(F.col("n") > 0, F.col("cls")).otherwise(nobody).alias("cls")), least.select("cls", "least"), "cls", "doc_id")
    component = F.when(F.col("n") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id"))
    first = F.when(F.col("n") > 0, F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("th") == F.col("least.th"))).otherwise(F.lit(True))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), first.alias("first"))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return groups(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("th", "first")
