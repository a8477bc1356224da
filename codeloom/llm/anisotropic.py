"""Maximum inner product search by score-aware quantisation and four-bit tables.

Codes: a vector is its nearest of at most CENTRES coarse centres plus a
length times a unit residual; pairs of the residual's components have 16
centroids each (four bits). So vectors of one tight cluster have codes as
different as those of a wide one. Centroids and codes minimise |r|^2 + (eta - 1)
(r . x / |x|)^2 over what is left, r: the part of the error parallel to the
vector, which moves its score with well-matched queries, costs eta times as
much (Guo et al., 2020). Search: for each query a table of its products with
all centroids; two codes make one byte, so a scan adds one entry of 256 for each
byte. The ``shortlist`` best of every shard, and all that tie with the last of
them, are scored exactly. Then so are all others whose estimate could still
reach the k-th exact score: within BOUND standard deviations of an error of
their |r| in a direction that has nothing to do with the query. So the list grows
where codes can't tell vectors apart; it has no fixed size. The best of all
shards win. Equal vectors are scanned as one, which carries its ``k`` + 1 least
ids (one of them may be the query's), and only the winners' ids are listed.

Codebooks are fitted in tasks, one for each length of vectors with more than
SMALL different ones, on the TRAIN of least hash (a bounded sample); vectors of
rarer lengths are scored exactly. Every distinct vector is encoded and scanned.
Shards meet blocks of QUERY_ROWS queries, so a vector moves once for each block.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without an id take no part; a query meets vectors of its
own length only, and no row of its own id; of a query id that repeats, the least
vector is the query; a candidate id that repeats is found as often as it occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vector_blocks
from .common import read, stored, vectors

TRAIN, SMALL = 4096, 1024
CENTRES = 64
PARALLEL_FROM = 0.2
SHORTLIST = 200
BOUND = 4.0
QUERY_ROWS = 4096


def eta(dim: int, threshold: float = PARALLEL_FROM) -> float:
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def _halves(x: np.ndarray) -> np.ndarray:
    """Rows as pairs of components (n, m, 2); an even number of pairs, padded with zeros."""
    n, d = x.shape
    m = -(-d // 4) * 2
    out = np.zeros((n, m * 2))
    out[:, :d] = x
    return out.reshape(n, m, 2)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def _centres(x: np.ndarray, rng) -> np.ndarray:
    """Lloyd's rounds from vectors drawn far from those drawn before."""
    n = min(CENTRES, max(1, len(x) // 32))
    found = x[[rng.integers(len(x))]]
    gap = ((x - found[0]) ** 2).sum(1)
    while len(found) < n and gap.sum() > 0:
        found = np.concatenate([found, x[[rng.choice(len(x), p=gap / gap.sum())]]])
        gap = np.minimum(gap, ((x - found[-1]) ** 2).sum(1))
    for _ in range(8):
        near = _nearest(x, found)
        size = np.bincount(near, minlength=len(found))
        total = np.zeros_like(found)
        np.add.at(total, near, x)
        found = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], found)
    return found


class Codebook:
    def __init__(self, centres: np.ndarray, centroids: np.ndarray, weight: float):
        self.centres, self.centroids, self.weight = centres, centroids, weight

    def _split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Centre, length of the residual, unit residual and direction of each vector, the last two in pairs."""
        near = _nearest(x, self.centres)
        rest = x - self.centres[near]
        length = np.linalg.norm(rest, axis=1)
        direction = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
        return near, length, _halves(rest / np.maximum(length, 1e-300)[:, None]), _halves(direction)

    @classmethod
    def fit(cls, sample: np.ndarray, rounds: int = 3, seed: int = 7) -> Codebook:
        """Lloyd's rounds for each pair, then rounds that assign and solve under the score-aware loss."""
        rng = np.random.default_rng(seed)
        book = cls(_centres(sample, rng), np.zeros(0), eta(sample.shape[1]) - 1)
        _, _, x, unit = book._split(sample)
        n, m, _ = x.shape
        centroids = np.stack([x[rng.choice(n, 16, replace=n < 16), k] for k in range(m)])
        for _ in range(8):
            near = ((x[:, :, None] - centroids[None]) ** 2).sum(-1).argmin(-1)
            for k in range(m):
                size = np.bincount(near[:, k], minlength=16)
                for c in range(2):
                    mean = np.bincount(near[:, k], x[:, k, c], minlength=16) / np.maximum(size, 1)
                    centroids[k, :, c] = np.where(size > 0, mean, centroids[k, :, c])
        book.centroids = centroids
        for _ in range(rounds):
            codes = book.assign(x, unit)
            # normal equations over all centroids at once: the parallel part ties pairs together
            place = np.arange(m) * 16 + codes
            rows = np.zeros((n, m * 16, 2))
            np.put_along_axis(rows, place[:, :, None].repeat(2, 2), unit, 1)
            rows = rows.reshape(n, -1)
            along = (unit * x).sum((1, 2))
            left = book.weight * (rows.T @ rows)
            size = np.bincount(place.reshape(-1), minlength=m * 16)
            left[np.diag_indices(m * 32)] += np.repeat(size, 2) + 1e-6 * n
            right = book.weight * (rows.T @ along)
            for c in range(2):
                right[c::2] += np.bincount(place.reshape(-1), x[:, :, c].reshape(-1), minlength=m * 16)
            right += 1e-6 * n * book.centroids.reshape(-1)
            book.centroids = np.linalg.solve(left, right).reshape(m, 16, 2)
        return book

    def assign(self, x: np.ndarray, unit: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (n, m) of residuals ``x`` of vectors of direction ``unit``, by coordinate descent from the nearest centroids."""
        n, m, _ = x.shape
        codes = np.empty((n, m), np.int64)
        for k in range(m):
            codes[:, k] = ((x[:, k, None] - self.centroids[k]) ** 2).sum(-1).argmin(-1)
        chosen = self.centroids[np.arange(m), codes]
        parallel = (unit * (x - chosen)).sum((1, 2))
        for _ in range(rounds):
            for k in range(m):
                rest = parallel - (unit[:, k] * (x[:, k] - self.centroids[k][codes[:, k]])).sum(-1)
                gap = x[:, k, None] - self.centroids[k]
                along = rest[:, None] + (unit[:, k, None] * gap).sum(-1)
                codes[:, k] = ((gap**2).sum(-1) + self.weight * along**2).argmin(-1)
                parallel = along[np.arange(n), codes[:, k]]
        return codes

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes (n, m / 2) of two codes each, centre, length of the residual and length of what is left of each vector."""
        codes, near, length, left = [np.zeros((0, self.centroids.shape[0] // 2), np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        for a in range(0, len(vectors), 4096):
            at, size, x, unit = self._split(vectors[a : a + 4096])
            four = self.assign(x, unit)
            codes.append((four[:, 0::2] * 16 + four[:, 1::2]).astype(np.uint8))
            near.append(at)
            length.append(size)
            gap = x - self.centroids[np.arange(x.shape[1]), four]
            left.append(size * np.linalg.norm(gap.reshape(len(gap), -1), axis=1))
        return tuple(map(np.concatenate, (codes, near, length, left)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(m / 2, 256, queries): each query's product with both centroids of a byte."""
        four = np.einsum("qmc,mkc->mkq", _halves(queries), self.centroids).astype(np.float32)
        return (four[0::2, :, None] + four[1::2, None, :]).reshape(len(four) // 2, 256, len(queries))

    def estimates(self, queries: np.ndarray, codes: np.ndarray, near: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(queries, n) estimated products."""
        tables = self.tables(queries)
        total = np.zeros((len(codes), len(queries)), np.float32)
        for j in range(codes.shape[1]):
            total += tables[j][codes[:, j]]
        total *= length[:, None].astype(np.float32)
        total += (self.centres @ queries.T).astype(np.float32)[near]
        return np.ascontiguousarray(total.T)


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """(vec_id, v, dim, ids, times): each vector once, its ``k`` + 1 least ids in order, how often each occurs (``k`` at most), and the least as vec_id.

    The row numbers are limited before rows move, so a vector that fills a
    third of the table brings few rows of every partition to one task.
    """
    counted = rows.groupBy("dim", "v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    place = F.row_number().over(Window.partitionBy("dim", "v").orderBy("vec_id"))
    least = counted.withColumn("place", place).where(F.col("place") <= k + 1)
    held = least.groupBy("dim", "v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("held"))
    return held.select(F.col("held.vec_id")[0].alias("vec_id"), "v", "dim", F.col("held.vec_id").alias("ids"), F.col("held.n").alias("times"))


def _encoder(books: dict[int, Codebook]):
    """Codes, centre and lengths of vectors whose length has a book, else nulls."""

    def run(batches):
        for batch in batches:
            flat, offsets = vectors(batch["v"])
            dims = np.asarray(batch["dim"])
            cols = [np.full(batch.num_rows, None, object) for _ in range(4)]
            for d in np.unique(dims):
                if int(d) not in books:
                    continue
                at = np.flatnonzero(dims == d)
                codes, *rest = books[int(d)].encode(flat[offsets[at][:, None] + np.arange(d)])
                cols[0][at] = [c.tobytes() for c in codes]
                for col, values in zip(cols[1:], rest):
                    col[at] = values
            types = [pa.binary(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c.tolist(), t) for c, t in zip(cols, types))], names=[*batch.schema.names, "code", "near", "length", "left"])

    return run


def _scan(books: dict[int, Codebook], k: int, shortlist: int):
    def run(table: pa.Table) -> pa.Table:
        rows, asked = vector_blocks.split(table)
        qids = np.asarray(asked["vec_id"])
        found_q, found_v, found_s = [], [], []
        if rows.num_rows and len(qids):
            x, queries = vector_blocks.matrix(rows), vector_blocks.matrix(asked)
            ids, times = (np.asarray(rows[c].combine_chunks().flatten()) for c in ("ids", "times"))
            size = np.asarray(rows["ids"].combine_chunks().value_lengths()).astype(np.int64)
            start = np.cumsum(size) - size
            first, second = ids[start], ids[start + (size > 1)]
            book = books.get(x.shape[1])
            if book is not None:
                codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(x), -1)
                near_, length, left = (np.asarray(rows[c]) for c in ("near", "length", "left"))
                reach = BOUND / np.sqrt(x.shape[1]) * left
            for a in range(0, len(qids), 256):
                lines = book.estimates(queries[a : a + 256], codes, near_, length) if book is not None else queries[a : a + 256] @ x.T
                for q, line in enumerate(lines, a):
                    alone = (size == 1) & (first == qids[q])
                    line[alone] = -np.inf
                    # equal codes may have equal sums: all that tie with the last of the shortlist are scored
                    near = np.flatnonzero(line >= np.partition(line, -shortlist)[-shortlist]) if book is not None and len(x) > shortlist else np.arange(len(x))
                    near = near[~alone[near]]
                    score = (x[near] * queries[q]).sum(axis=1)
                    if book is not None and len(x) > len(near) >= k:
                        least = np.partition(score, -k)[-k]
                        open_ = line + reach * np.linalg.norm(queries[q]) >= least
                        open_[near] = False
                        more = np.flatnonzero(open_ & ~alone)
                        near, score = np.concatenate([near, more]), np.concatenate([score, (x[more] * queries[q]).sum(axis=1)])
                    least = np.where(first[near] == qids[q], second[near], first[near])
                    order = np.lexsort([least, -score])[:k]
                    near, score = near[order], score[order]
                    # the ids of these vectors, each as often as it occurs
                    at = np.repeat(start[near] - (np.cumsum(size[near]) - size[near]), size[near]) + np.arange(size[near].sum())
                    often = np.where(ids[at] == qids[q], 0, times[at])
                    held, value = np.repeat(ids[at], often), np.repeat(np.repeat(score, size[near]), often)
                    top = np.lexsort([held, -value])[:k]
                    found_q.append(np.full(len(top), qids[q]))
                    found_v.append(held[top])
                    found_s.append(value[top])
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table({"query_id": join(found_q, np.int64), "vec_id": join(found_v, np.int64), "score": join(found_s, np.float64)})

    return run


def _fitted(table: pa.Table) -> pa.Table:
    book = Codebook.fit(vector_blocks.matrix(table))
    return pa.table({"dim": pa.array([table["dim"][0].as_py()], pa.int32()), "centres": [book.centres.reshape(-1).tolist()], "centroids": [book.centroids.reshape(-1).tolist()]})


def codebooks(rows: DataFrame, train: int = TRAIN, small: int = SMALL) -> dict[int, Codebook]:
    """A codebook for each length of more than ``small`` of the distinct ``rows`` (vec_id, v, dim), fitted by one task each. What is broadcast and collected has one row for each such length."""
    often = rows.groupBy("dim").count().where(F.col("count") > small).withColumn("share", F.lit(1.5 * train) / F.col("count"))
    place = F.xxhash64("vec_id", F.lit(4))
    thin = rows.join(F.broadcast(often), "dim").where((F.shiftrightunsigned(place, 11) / F.lit(float(1 << 53))) < F.col("share"))
    order = Window.partitionBy("dim").orderBy(place, "vec_id")
    sample = thin.select("dim", "v", F.row_number().over(order).alias("k")).where(F.col("k") <= train).select("dim", "v")
    found = sample.groupBy("dim").applyInArrow(_fitted, "dim int, centres array<double>, centroids array<double>").collect()  # one row for each length
    out = {}
    for r in found:
        d = r["dim"]
        out[d] = Codebook(np.array(r["centres"]).reshape(-1, d), np.array(r["centroids"]).reshape(-1, 16, 2), eta(d) - 1)
    return out


def search(embeddings: DataFrame, step: int, k: int, shortlist: int = SHORTLIST, train: int = TRAIN, shard_rows: int = vector_blocks.SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of ``embeddings`` (vec_id, embedding) for every row whose id is divisible by ``step``."""
    rows = vector_blocks.usable(embeddings).where(F.exists("v", lambda x: x != 0))
    queries = vector_blocks.every(rows, step)
    rows = stored(distinct(rows, k), "mips")
    books = codebooks(rows, train)
    deal = vector_blocks.Deal(rows, queries, shard_rows, QUERY_ROWS)
    coded = rows.mapInArrow(_encoder(books), "vec_id long, v array<double>, dim int, ids array<long>, times array<int>, code binary, near int, length double, left double")
    groups = deal.met(coded, queries, F.sequence(F.lit(0), F.lit(deal.shards - 1)))
    return vector_blocks.best(groups.applyInArrow(_scan(books, k, shortlist), "query_id long, vec_id long, score double"), k)


def op1_mips(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), step=20, k=20)
