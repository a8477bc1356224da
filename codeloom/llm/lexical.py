"""Ranked lexical search over a length-stratified index.

Terms are runs of ASCII letters and digits and of all other signs beyond ASCII;
only A-Z are lower-cased. N documents hold L terms; one with n terms has the
normaliser m = 100 - 50 + (50 n N) div L; a term that occurs tf times in it counts
w * ((1000000000 tf) div (1000 tf + 20 m)) with w = floor(1000 ln((2N + 2) / (2 df + 1))).

Index. Documents are dealt to segments as they stand in the input, up to
SEGMENT_DOCS documents or SEGMENT_BYTES of text (a longer text has one to itself).
In a segment documents are numbered by (m, id): those of one m are a stratum, and
stand together. A row of ``postings`` is a term of a segment: its documents by
stratum, then by tf. A row of ``segments`` has its documents' ids and m.

Search. Items are dealt to blocks of BLOCK_ITEMS; a posting row meets the items of a
block that hold its term, and (segment, block) is one unit of work, so no task holds
all items or all postings of a term. In it the impact of each tf of a stratum is
computed once. A stratum's bound for an item is the sum of its terms' best impacts
times their weights; strata are visited from the highest bound down until the bound
is below the item's k-th score. Every SAMPLE-th segment goes first; the k-th scores
found there go along to the others, which then visit few strata and return few
documents. The bounds are exact, so nothing is lost.

Defined results: a null or empty text has no terms, as have texts of other signs
only, and stands in no ranking; items of equal id count as one with all their terms;
rows of equal doc_id are documents of their own, equal scores then by text hash; null
ids come first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, release, stored, text_bytes

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
SEGMENT_DOCS = 4096
SEGMENT_BYTES = 16 << 20
BLOCK_ITEMS = 256
SAMPLE = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SIGN = np.ones(256, bool)
_SIGN[:128] = [chr(k).isalnum() for k in range(128)]

_POSTINGS = "segment long, term string, docs array<int>, tfs array<int>"
_SEGMENTS = "segment long, ids array<long>, hashes array<long>, m array<int>"


def _places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, where terms begin in them, and where texts begin and end."""
    raw, ends = text_bytes(column)
    inside = _SIGN[raw]
    # a term begins where a sign follows none, or another text begins
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[ends] = True
    begins = inside & fresh[:-1]
    begins[1:] |= inside[1:] & ~inside[:-1]
    return raw, np.flatnonzero(begins), ends


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts one after another, and the text each is from."""
    raw, begins, ends = _places(column)
    inside = _SIGN[raw]
    kept = np.cumsum(inside)
    offsets = np.concatenate([kept[begins] - 1, kept[-1:] if len(raw) else [0]]).astype(np.int32) if len(begins) else np.zeros(1, np.int32)
    words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]]))
    return words, np.searchsorted(ends, begins, side="right") - 1


def _invert(segment: int, ids: list, hashes: np.ndarray, texts: pa.Array, documents: int, words: int):
    """The rows of one segment."""
    terms, doc = terms_of(texts)
    n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    m = 50 + 50 * n * documents // max(words, 1)
    none = np.array([i is None for i in ids])
    number = np.array([0 if i is None else i for i in ids], np.int64)
    order = np.lexsort((hashes, number, ~none, m))
    order = order[n[order] > 0]
    rank = np.empty(len(texts), np.int64)
    rank[order] = np.arange(len(order))
    coded = terms.dictionary_encode()
    pair, tf = np.unique(np.asarray(coded.indices).astype(np.int64) * len(texts) + rank[doc], return_counts=True)
    term, place = pair // len(texts), pair % len(texts)
    order2 = np.lexsort((place, tf, m[order][place], term))
    term, place, tf = term[order2], place[order2], tf[order2]
    starts = np.flatnonzero(np.diff(term, prepend=-1)).astype(np.int32)
    offsets = pa.array(np.append(starts, len(term)).astype(np.int32))
    posting = pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(starts), segment)), coded.dictionary.take(pa.array(term[starts])), pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))],
        names=["segment", "term", "docs", "tfs"],
    )
    return posting, [ids[k] for k in order], hashes[order], m[order]


def _segments(documents: int, words: int):
    """Postings of each segment, and under a null term its documents: ids and hashes in ``ids``, m in ``docs``."""

    def run(batches):
        part, count = TaskContext.get().partitionId(), 0
        held, docs, size = [], 0, 0

        def close():
            table = pa.Table.from_batches(held)
            segment = part << 32 | count
            posting, ids, hashes, m = _invert(segment, table["doc_id"].to_pylist(), np.asarray(table["hash"]), table["text"].combine_chunks(), documents, words)
            lists = lambda: pa.nulls(len(posting), pa.list_(pa.int64()))
            for at in range(0, len(posting), 4096):
                piece = posting.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([*piece.columns, lists()[: len(piece)], lists()[: len(piece)]], names=[*piece.schema.names, "ids", "hashes"])
            row = [pa.array([segment]), pa.array([None], pa.string()), pa.array([m.astype(np.int32)], pa.list_(pa.int32())), pa.array([None], pa.list_(pa.int32())), pa.array([ids], pa.list_(pa.int64())), pa.array([hashes], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(row, names=["segment", "term", "docs", "tfs", "ids", "hashes"])

        for batch in batches:
            ends = np.cumsum(np.asarray(pc.binary_length(batch.column("text")).fill_null(0)), dtype=np.int64)
            at = 0
            while at < len(batch):
                base = ends[at - 1] if at else 0
                fit = int(np.searchsorted(ends, base + max(SEGMENT_BYTES - size, 0), side="right")) - at
                take = min(max(fit, 0 if docs else 1), SEGMENT_DOCS - docs, len(batch) - at)
                if take:
                    held.append(batch.slice(at, take))
                    docs, size, at = docs + take, size + int(ends[at + take - 1] - base), at + take
                if docs == SEGMENT_DOCS or at < len(batch):
                    yield from close()
                    held, docs, size, count = [], 0, 0, count + 1
        if held:
            yield from close()
        release()

    return run


class Index:
    """``postings`` (segment, term, docs, tfs) and ``segments`` (segment, ids, hashes, m), with N and L of the documents."""

    def __init__(self, postings: DataFrame, segments: DataFrame, documents: int, words: int):
        self.postings, self.segments, self.documents, self.words = postings, segments, documents, words


def _lengths(batches):
    """For each batch: texts with terms, and their terms."""
    for batch in batches:
        _, begins, ends = _places(batch.column("text"))
        n = np.diff(np.searchsorted(begins, ends))
        yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([len(begins)])], names=["documents", "words"])


def build(docs: DataFrame) -> Index:
    """The index of ``docs`` (doc_id, text), stored in the shared folder."""
    sums = docs.select("text").mapInArrow(_lengths, "documents long, words long").agg(F.sum("documents"), F.sum("words")).first()
    documents, words = (s or 0 for s in sums)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    rows = stored(slim.mapInArrow(_segments(documents, words), f"{_POSTINGS}, ids array<long>, hashes array<long>"), "lexical-index")
    segments = rows.where("term is null").select("segment", "ids", "hashes", F.col("docs").alias("m"))
    return Index(rows.where("term is not null").select("segment", "term", "docs", "tfs"), segments, documents, words)


def weighted_terms(items: DataFrame, index: Index) -> DataFrame:
    """(item, term, w) of ``items`` (item_id, text); terms that no document holds go."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select(F.col("item_id").cast("long").alias("item"), F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))).alias("term")).distinct()
    df = index.postings.select("term", F.size("docs").alias("n")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1))).cast("long")
    return terms.join(df.select("term", w.alias("w")), "term").where("w > 0")


def _best(scores: np.ndarray, ids: list, hashes: np.ndarray, none: np.ndarray, number: np.ndarray, found: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` of ``found`` by score down, then id, then hash."""
    if len(found) > k:
        cut = np.partition(scores[found], len(found) - k)[len(found) - k]
        found = found[scores[found] >= cut]
    return found[np.lexsort((hashes[found], number[found], ~none[found], -scores[found]))][:k]


def score_unit(ids: list, hashes: np.ndarray, m: np.ndarray, terms: list, floors: dict, k: int):
    """(item, document's place, score) of the best ``k`` of a segment for each item of a block.

    ``terms`` has (docs, tfs, [(item, w)]) of each term; ``floors`` a score for an
    item below which no document is asked for.
    """
    none = np.array([i is None for i in ids])
    number = np.array([0 if i is None else i for i in ids], np.int64)
    stratum = np.cumsum(np.diff(m, prepend=m[0]) != 0)
    strata = int(stratum[-1]) + 1
    impacts, best, uses = [], [], {}
    for t, (docs, tfs, users) in enumerate(terms):
        at = stratum[docs]
        change = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(tfs, prepend=-1) != 0))
        tf = tfs[change].astype(np.int64)
        once = 1_000_000_000 * tf // (1000 * tf + 20 * m[docs[change]])  # one for each stratum and tf
        impacts.append(np.repeat(once, np.diff(np.append(change, len(docs)))))
        top = np.zeros(strata, np.int64)
        np.maximum.at(top, at[change], once)
        best.append(top)
        for item, w in users:
            uses.setdefault(item, []).append((t, w))
    for item, used in uses.items():
        bound = np.zeros(strata, np.int64)
        for t, w in used:
            bound += w * best[t]
        need = max(floors.get(item, 1), 1)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] >= need]
        sizes = np.bincount(stratum, minlength=strata)
        scores = np.zeros(len(m), np.int64)
        kept = np.zeros(0, np.int64)
        while len(order):
            # as many strata as hold 4 k documents, then twice as many: each wave may raise the k-th score
            wave = int(np.searchsorted(np.cumsum(sizes[order]), 4 * k + len(kept))) + 1
            visit = np.zeros(strata, bool)
            visit[order[:wave]] = True
            for t, w in used:
                docs = terms[t][0]
                hit = visit[stratum[docs]]
                scores[docs[hit]] += w * impacts[t][hit]
            inside = np.flatnonzero(visit[stratum] & (scores >= need))
            kept = np.concatenate([kept, inside])
            if len(kept) >= k:
                kept = _best(scores, ids, hashes, none, number, kept, k)
                need = max(need, int(scores[kept[-1]]))
            order = order[wave:]
            order = order[bound[order] >= need]
        kept = _best(scores, ids, hashes, none, number, kept, k)
        for d in kept:
            yield item, int(d), int(scores[d])


def _search(k: int):
    fields = [("item", pa.int64()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("score", pa.int64())]

    def unit(head, terms):
        ids, m = head["ids"], np.array(head["docs"], np.int64)
        floors = {u["item"]: u["w"] for u in head["uses"]}
        hashes = np.array(head["hashes"], np.int64)
        rows = list(score_unit(ids, hashes, m, terms, floors, k)) if len(m) and terms else []
        items, places, scores = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array([ids[p] for p in places], pa.int64()), pa.array([int(hashes[p]) for p in places], pa.int64()), pa.array(scores, pa.int64())], schema=pa.schema(fields))

    def run(batches):
        head, terms = None, []
        for batch in batches:
            docs, tfs, is_head = batch.column("docs"), batch.column("tfs"), batch.column("term").is_null().to_pylist()
            for r in range(len(batch)):
                if is_head[r]:
                    if head is not None:
                        yield unit(head, terms)
                    head, terms = batch.slice(r, 1).to_pylist()[0], []
                else:
                    terms.append((np.asarray(docs[r].values), np.asarray(tfs[r].values), [(u["item"], u["w"]) for u in batch.column("uses")[r].as_py()]))
        if head is not None:
            yield unit(head, terms)
        release()

    return run


def _visit(index: Index, segments: DataFrame, terms: DataFrame, floors: DataFrame, blocks: int, k: int) -> DataFrame:
    """Best documents of ``segments`` for each item: ``terms`` has (block, term, uses), ``floors`` (block, uses) with an item's least score."""
    heads = segments.select("segment", F.lit(None).cast("string").alias("term"), F.col("m").alias("docs"), F.lit(None).cast("array<int>").alias("tfs"), "ids", "hashes")
    heads = heads.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(floors, "block")
    posted = index.postings.join(segments.select("segment"), "segment", "left_semi").join(terms, "term")
    none = F.lit(None).cast("array<long>")
    columns = ["segment", "block", "term", "docs", "tfs", "ids", "hashes", "uses"]
    both = heads.select(*columns).unionByName(posted.withColumns({"ids": none, "hashes": none}).select(*columns))
    grouped = both.repartition("segment", "block").sortWithinPartitions("segment", "block", F.col("term").asc_nulls_first())
    return grouped.mapInArrow(_search(k), "item long, doc_id long, hash long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first(), "hash")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` best documents of each of ``items`` (item_id, text): item_id, rank (from 1), doc_id, score (above 0)."""
    terms = stored(weighted_terms(items, index), "lexical-terms")
    count = terms.agg(F.approx_count_distinct("item", 0.01)).first()[0]
    blocks = max(1, -(-count // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")
    uses = terms.groupBy(block, "term").agg(F.collect_list(F.struct("item", "w")).alias("uses"))
    sampled = F.pmod(F.xxhash64("segment", F.lit("first")), F.lit(SAMPLE)) == 0
    nothing = terms.groupBy(block).agg(F.collect_set(F.struct("item", F.lit(1).cast("long").alias("w"))).alias("uses"))
    first = stored(_ranked(_visit(index, index.segments.where(sampled), uses, nothing, blocks, k), k), "lexical-first")
    kth = first.where(F.col("rank") == k).select("item", F.col("score").alias("w"))
    known = terms.select("item", block).distinct().join(kth, "item", "left").groupBy("block").agg(F.collect_list(F.struct("item", F.coalesce("w", F.lit(1)).alias("w"))).alias("uses"))
    rest = _visit(index, index.segments.where(~sampled), uses, known, blocks, k)
    found = _ranked(first.drop("rank").unionByName(rest), k)
    return found.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_lexical(spark, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for each benchmark item: item_id, rank, doc_id, score."""
    index = build(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return search(index, read(spark, sf_dir, "benchmark").select("item_id", "text"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT n_docs FROM s) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p WHERE term IN (SELECT term FROM q) GROUP BY term),
r AS (
  SELECT q.item_id, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + (50 * d.n * s.n_docs) // s.n_words)))) AS BIGINT) AS score
  FROM q JOIN p ON q.term = p.term JOIN w ON w.term = p.term JOIN d ON d.doc_id = p.doc_id, s
  GROUP BY q.item_id, p.doc_id)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER o <= 50
"""
