"""Chunks, vectors and retrieval: fixed windows, similarity, threshold, MMR."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def windows(docs: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, chunk, text): windows of ``size`` characters, ``overlap`` of them shared with the one before."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - size) / step)).cast("int")
    rows = docs.where(F.length("text") > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("doc_id", "chunk", F.substring(F.col("text"), F.col("chunk") * step + 1, F.lit(size)).alias("text"))


SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int = 2000, overlap: int = 200, separators=SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at paragraphs, else lines, else blanks, else anywhere; neighbours share up to ``overlap``."""
    if len(text) <= size:
        return [text] if text.strip() else []
    mark, rest = next((s, separators[k + 1 :]) for k, s in enumerate(separators) if s in text)
    parts = [p for p in (text.split(mark) if mark else list(text)) if p or mark]
    out, held, length = [], [], 0
    for part in parts:
        if len(part) > size:
            if held:
                out.append(mark.join(held))
                held, length = [], 0
            out += split_text(part, size, overlap, rest)
            continue
        if held and length + len(mark) + len(part) > size:
            out.append(mark.join(held))
            while held and (length > overlap or length + len(mark) + len(part) > size):
                length -= len(held.pop(0)) + (len(mark) if held else 0)
        length += len(part) + (len(mark) if held else 0)
        held.append(part)
    if held:
        out.append(mark.join(held))
    return [o for o in out if o.strip()]


def chunks(docs: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """``docs`` (source, text) as (source, chunk, text) by ``split_text``."""

    def run(batches):
        for pdf in batches:
            rows = [(s, k, c) for s, t in zip(pdf["source"], pdf["text"]) for k, c in enumerate(split_text(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["source", "chunk", "text"])

    return docs.select("source", "text").mapInPandas(run, "source string, chunk int, text string")


def hashing_embedder(dim: int = 64):
    """A deterministic stand-in for an embedding model: signed hashed words, unit length."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), dim))
        for k, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                out[k, h[0] % dim] += 1 if h[1] & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.Series(list(out / np.where(norm == 0, 1, norm)))

    return embed


SHARD_ROWS = 16_384
BLOCK_QUESTIONS = 4_096


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, their lengths, which of them count): a vector of another size, or with null, not finite or only zero components, does not count."""
    at = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(column), -1)) == dim)
    out = np.zeros((len(column), dim))
    out[at] = np.asarray(column.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(at), dim)
    norm = np.sqrt((out * out).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    out[~good], norm[~good] = 0, 1
    return out, norm, good


def _best(k: int, threshold: float | None):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rows, asked = table.filter(pc.invert(table["asked"])), table.filter(table["asked"])
        v, q = (c.combine_chunks() for c in (rows["v"], asked["q"]))
        place = np.asarray(pc.rank(rows["vec_id"].combine_chunks(), null_placement="at_start", tiebreaker="dense")).astype(np.int64)
        sizes = np.asarray(pc.fill_null(pc.list_value_length(q), 0))
        found_q, found_v, found_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for dim in np.unique(sizes) if len(place) else ():
            x, x_norm, x_good = _matrix(v, int(dim))
            unit = (x / x_norm[:, None]).T
            mine = np.flatnonzero(sizes == dim)
            y, y_norm, y_good = _matrix(q.take(pa.array(mine)), int(dim))
            for a in range(0, len(mine), 128):
                part = (y[a : a + 128] / y_norm[a : a + 128, None]) @ unit
                part[:, ~x_good] = -np.inf
                part[~y_good[a : a + 128]] = -np.inf
                for line, j in zip(part, range(a, len(mine))):
                    # all that may round to the k-th score, then their scores in one order of addition
                    near = np.flatnonzero(line >= np.partition(line, -k)[-k] - 3e-9) if len(line) > k else np.arange(len(line))
                    score = np.where(line[near] > -np.inf, np.round((x[near] * y[j]).sum(axis=1) / (x_norm[near] * y_norm[j]), 9), -np.inf)
                    if threshold:
                        near, score = near[score >= threshold], score[score >= threshold]
                    top = np.lexsort([place[near], -score])[:k]
                    found_q.append(np.full(len(top), mine[j]))
                    found_v.append(near[top])
                    found_s.append(score[top])
        at, score = pa.array(np.concatenate(found_v)), np.concatenate(found_s)
        score = pa.array(score, mask=np.isneginf(score))
        return pa.table({"query_id": asked["query_id"].take(pa.array(np.concatenate(found_q))), "vec_id": rows["vec_id"].take(at), "score": score, "v": rows["v"].take(at)})

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score, v): for each of ``queries`` (query_id, q) the ``k`` most similar ``rows`` (vec_id, v), ties to smaller ids.

    Rows are dealt to shards and questions to blocks, both of bounded size; a
    shard returns the ``k`` best of its own for each question of a block. Vectors
    that can't be compared (null, of other sizes, zero, with null or not finite
    components) score null and come last. A threshold of 0 counts as none.
    """
    shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
    blocks = max(1, math.ceil(queries.count() / BLOCK_QUESTIONS))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "v", dealt(shards, "vec_id", "v").alias("shard"), each(blocks).alias("block"), F.lit(False).alias("asked"))
    right = queries.select("query_id", "q", each(shards).alias("shard"), dealt(blocks, "query_id", "q").alias("block"), F.lit(True).alias("asked"))
    schema = T.StructType([T.StructField(n, kind) for n, kind in (("query_id", queries.schema["query_id"].dataType), ("vec_id", rows.schema["vec_id"].dataType), ("score", T.DoubleType()), ("v", rows.schema["v"].dataType))])
    found = left.unionByName(right, allowMissingColumns=True).groupBy("shard", "block").applyInArrow(_best(k, threshold), schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "v")


def mmr(found: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """(query_id, rank, vec_id): of each query's ``found`` (nearest, fetched), ``k`` picked one by one for weight * score - (1 - weight) * likeness to those picked.

    The scores of a query are at most those fetched (tens of rows), so a group is bounded.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        v = np.stack(pdf["v"].to_numpy()).astype(float)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        like, score, picked = v @ v.T, pdf["score"].to_numpy(), []
        while len(picked) < min(k, len(v)):
            value = weight * score - (1 - weight) * (like[:, picked].max(axis=1) if picked else 0)
            value[picked] = -np.inf
            picked.append(int(np.argmax(np.round(value, 9))))
        return pd.DataFrame({"query_id": key[0], "rank": range(1, len(picked) + 1), "vec_id": pdf["vec_id"].to_numpy()[picked]})

    return found.groupBy("query_id").applyInPandas(run, "query_id long, rank int, vec_id long")
