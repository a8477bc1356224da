"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) and unlabelled text (U) give a risk estimate that
needs no negative labels: pi * E_P[loss(+)] + max(0, E_U[loss(-)] - pi *
E_P[loss(-)]), with class prior pi; where the bracket falls below zero the step
goes the other way (Kiryo et al., 2017). The classifiers are linear in the
presence of words and of word beginnings.

P is the P_ROWS confirmed documents of least hash (a bounded sample of labelled
rows). U is every document: the frequencies of P's features are counted over
all of U, and the FEATURES most tied to P are kept. Then U is dealt into blocks
of about BLOCK documents, each block trains one classifier in numpy on P and its
own part of U, and the classifiers' weights are averaged (for a convex risk the
average is about as good as one fit on everything). So the work grows with the
corpus and no sample of U is taken. Every document is scored in full.

Word beginnings of 4, 5 and 6 letters stand for stems: inflected languages have
many forms of one insult, each of them rare. Levels (1, 2 or 4 different words
with one beginning) tell a text full of such forms from a chance hit.

The prior, unless given, comes from P and U alone: the share of U that has any
of the STRONG features most tied to P is at least pi times that share of P, and
about that where hardly a clean text has one, so their ratio estimates pi.

Defined results: null, empty or wordless text gets the score of the bias alone;
equal texts get equal scores; labels that are null say nothing, and of several
labels of a document one toxic label counts; a null id has no label; without any
confirmed toxic document, or any feature tied to P, every score is 0.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import _power_tables, mix
from .common import in_training, pack, read, release, schema_of, small_batches, stored, unpack

P_ROWS, BLOCK, FEATURES, STRONG = 4096, 12_288, 768, 10
#: Features of P that are counted in U: those in most of P's documents.
CANDIDATES = 1 << 16
THRESHOLD = 0.7
STEPS, RATE, DECAY = 400, 0.05, 1e-5
CHUNK = 1 << 20
_SIZES = (4, 5, 6)
_LEVELS = (1, 2, 4)
_LOW = np.uint64(3)


@lru_cache(maxsize=1)
def _word_signs() -> np.ndarray:
    """Which code points are part of a word: letters, numbers and the underscore."""
    return np.array([chr(x).isalnum() or x == 0x5F for x in range(sys.maxunicode + 1)])


def _stretches(texts: list[str | None]):
    """(documents, code points) of lower-case texts, about CHUNK at a time; a longer text is parted between words."""
    inside = _word_signs()
    held, doc, size = [], [], 0
    for k, text in enumerate(texts):
        codes = np.frombuffer(f"{text or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        while len(codes):
            take = len(codes)
            if take > CHUNK:
                gaps = np.flatnonzero(~inside[codes[:CHUNK]])
                take = int(gaps[-1]) + 1 if len(gaps) else CHUNK + int(np.argmin(inside[codes[CHUNK:]])) + 1
            held.append(codes[:take])
            doc.append(np.full(take, k))
            size += take
            codes = codes[take:]
            if size >= CHUNK:
                yield np.concatenate(doc), np.concatenate(held)
                held, doc, size = [], [], 0
    if held:
        yield np.concatenate(doc), np.concatenate(held)


def _bases(codes: np.ndarray):
    """(first sign, end) of each word and, for the whole word and each beginning, (which words, hash)."""
    inside = _word_signs()[codes]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(codes) + 1)
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes + np.uint64(1)) * up[: len(codes)], out=prefix[1:])
    shift = down[start]
    whole = mix((prefix[end] - prefix[start]) * shift + (end - start).astype(np.uint64))
    out = [(np.arange(len(start)), whole & ~_LOW)]
    for n in _SIZES:
        long = np.flatnonzero(end - start >= n)
        first = start[long]
        out.append((long, mix((prefix[first + n] - prefix[first]) * shift[long] ^ np.uint64(n << 40)) & ~_LOW))
    return start, whole, out


class Lookup:
    """Sorted features, each a hash whose two low bits name its level."""

    def __init__(self, features: np.ndarray):
        self.features = np.sort(features.astype(np.uint64))
        self.bases = np.unique(self.features & ~_LOW)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._slot(self.bases)] = True

    @staticmethod
    def _slot(bases: np.ndarray) -> np.ndarray:
        return (bases >> np.uint64(44)).astype(np.int64)

    def wanted(self, bases: np.ndarray) -> np.ndarray:
        """Numbers of the ``bases`` that belong to a feature."""
        some = np.flatnonzero(self.seen[self._slot(bases)])
        at = np.minimum(np.searchsorted(self.bases, bases[some]), len(self.bases) - 1)
        return some[self.bases[at] == bases[some]]

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.features, keys), len(self.features) - 1)
        return np.flatnonzero(self.features[at] == keys), at


def text_features(texts: list[str | None], lookup: Lookup | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of all features that ``texts`` have, or of those of ``lookup`` (then their places in it)."""
    parts = []
    for doc, codes in _stretches(texts):
        start, whole, kinds = _bases(codes)
        for which, base in kinds:
            if lookup is not None:
                some = lookup.wanted(base)
                which, base = which[some], base[some]
            parts.append((doc[start[which]], base, whole[which]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, base, word = (np.concatenate(c) for c in zip(*parts))
    by = np.lexsort([word, base, doc])
    doc, base, word = doc[by], base[by], word[by]
    group = np.concatenate([[True], (doc[1:] != doc[:-1]) | (base[1:] != base[:-1])])[: len(doc)]
    new = group.copy()
    new[1:] |= word[1:] != word[:-1]
    first = np.flatnonzero(group)
    count = np.add.reduceat(new.astype(np.int64), first) if len(first) else first
    doc, base = doc[first], base[first]
    have = [np.flatnonzero(count >= n) for n in _LEVELS]
    doc, keys = np.concatenate([doc[h] for h in have]), np.concatenate([base[h] | np.uint64(k) for k, h in enumerate(have)])
    if lookup is None:
        return doc, keys
    known, at = lookup.places(keys)
    return doc[known], at[known]


# --- counts over all documents -----------------------------------------------------


def _named(batches):
    for batch in batches:
        _, keys = text_features(batch["text"].to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["f"])
    release()


def _counted(features: np.ndarray):
    """One row (feature, documents that have it) for each feature met in a partition, and -1 for all its documents."""

    def run(batches):
        lookup, total, rows = Lookup(features), np.zeros(len(features), np.int64), 0
        for batch in batches:
            _, at = text_features(batch["text"].to_pylist(), lookup)
            total += np.bincount(at, minlength=len(features))
            rows += batch.num_rows
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *met.tolist()], pa.int64()), pa.array([rows, *total[met].tolist()], pa.int64())], names=["k", "n"])
        release()

    return run


def _patterns(features: np.ndarray, strong: np.ndarray):
    """The features of each text, as places in 16 bits, and whether any is ``strong``."""

    def run(batches):
        lookup = Lookup(features)
        for batch in batches:
            doc, at = text_features(batch["text"].to_pylist(), lookup)
            by = np.lexsort([at, doc])
            ends = np.searchsorted(doc[by], np.arange(batch.num_rows + 1)) * 2
            data = at[by].astype("<u2").tobytes()
            any_ = np.bincount(doc[strong[at]], minlength=batch.num_rows) > 0
            yield pa.RecordBatch.from_arrays([pa.array(any_), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])], names=["any", "f"])
        release()

    return run


# --- the risk ---------------------------------------------------------------------


def _distinct(patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pattern, feature) of the different patterns, and the share of documents that each stands for."""
    kinds, times = np.unique(np.array(patterns, object), return_counts=True)
    owner = np.repeat(np.arange(len(kinds)), [len(p) // 2 for p in kinds])
    return owner, np.frombuffer(b"".join(kinds), "<u2").astype(np.int64), times / len(patterns)


def risk(theta: np.ndarray, p, u, prior: float) -> tuple[float, float, np.ndarray]:
    """(positive part, negative part, gradient of the step) of the non-negative risk with the logistic loss.

    ``theta`` are weights, then the bias. The gradient is that of both parts
    where the negative part is zero or more, and minus the negative part's
    where it is below: the estimate overfits there, and the step undoes it.
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    (po, pf, pw), (uo, uf, uw) = p, u
    zp = np.bincount(po, theta[pf], len(pw)) + theta[-1]
    zu = np.bincount(uo, theta[uf], len(uw)) + theta[-1]
    positive = prior * float(pw @ np.logaddexp(0, -zp))
    negative = float(uw @ np.logaddexp(0, zu)) - prior * float(pw @ np.logaddexp(0, zp))
    sp, su = sigmoid(zp) * pw, sigmoid(zu) * uw
    cp, cu = (prior * (sp - pw) - prior * sp, su) if negative >= 0 else (prior * sp, -su)
    slope = np.bincount(pf, cp[po], len(theta) - 1) + np.bincount(uf, cu[uo], len(theta) - 1)
    return positive, negative, np.append(slope, cp.sum() + cu.sum())


def fit(p, u, prior: float, n: int, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> np.ndarray:
    """Weights of ``n`` features and the bias, by full gradient steps (Adam)."""
    theta = np.zeros(n + 1)
    theta[-1] = -2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = risk(theta, p, u, prior)[2]
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        np.maximum(theta[:-1], 0, out=theta[:-1])  # chosen features only speak for toxicity
    return theta


def _trained(p: list[bytes], prior: float, n: int):
    """One classifier for the block that a partition is: (place, weight times documents, documents)."""

    def run(batches):
        u = [f for batch in batches for f in batch["f"].to_pylist()]
        if u:
            theta = fit(_distinct(p), _distinct(u), prior, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), pa.array(theta * len(u)), pa.array(np.full(n + 1, len(u)))], names=["k", "w", "n"])

    return run


class Model:
    """Weights of chosen features and a bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.lookup, self.weights, self.bias = Lookup(features), weights, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        doc, at = text_features(texts, self.lookup)
        by = np.lexsort([at, doc])
        z = np.bincount(doc[by], self.weights[at[by]], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def choose(n_p: np.ndarray, p: int, n_u: np.ndarray, u: int, most: int = FEATURES) -> np.ndarray:
    """Places of the features that are more frequent in P than chance explains, by the z of their share, best first."""
    share_p, share_u = n_p / p, (n_u + 1) / (u + 2)
    z = (share_p - share_u) / np.sqrt(share_u * (1 - share_u) / p)
    keep = np.flatnonzero((n_p >= max(3, 0.01 * p)) & (z > 4) & (share_p > 2 * share_u))
    return keep[np.argsort(-z[keep], kind="stable")[:most]]


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, p_rows: int = P_ROWS, block: int = BLOCK) -> Model | None:
    """Fit on the toxic labels of training rows and on all text of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    texts = docs.select("text")
    toxic = labels.where((F.col("toxic") == 1) & in_training()).select("doc_id").distinct()
    toxic = toxic.orderBy(F.xxhash64(F.col("doc_id"), F.lit(5)), "doc_id").limit(p_rows)
    p_docs = stored(docs.join(F.broadcast(toxic), "doc_id", "left_semi").select("text"), "toxic")  # p_rows ids at most
    p = p_docs.count()
    found = p_docs.mapInArrow(_named, "f long").groupBy("f").count().where(F.col("count") >= max(3, 0.01 * p))
    found = found.orderBy(F.desc("count"), "f").limit(CANDIDATES).collect() if p else []
    if not found:
        return None
    found.sort(key=lambda r: r["f"] & (2**64 - 1))
    candidates, n_p = np.array([r["f"] for r in found], np.int64).view(np.uint64), np.array([r["count"] for r in found])
    counts = {r["k"]: r["n"] for r in texts.mapInArrow(_counted(candidates), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}  # a row for each candidate
    n_u, u = np.array([counts.get(k, 0) for k in range(len(candidates))]), counts[-1]
    best = choose(n_p, p, n_u, u)
    if not len(best):
        return None
    features = np.sort(candidates[best])
    deal = _patterns(features, np.isin(features, candidates[best[:STRONG]]))
    of_p = p_docs.mapInArrow(deal, "any boolean, f binary").collect()  # p_rows times FEATURES numbers at most
    patterns, share = sorted(bytes(r["f"]) for r in of_p), np.mean([r["any"] for r in of_p])
    of_u = stored(texts.mapInArrow(deal, "any boolean, f binary"), "patterns")
    if prior is None:
        prior = float(np.clip(of_u.agg(F.avg(F.col("any").cast("int"))).first()[0] / max(share, 1 / p), 0.001, 0.5))
    dealt = of_u.select("f").repartition(max(1, round(u / block)))
    fitted = dealt.mapInArrow(_trained(patterns, prior, len(features)), "k long, w double, n long").groupBy("k").agg((F.sum("w") / F.sum("n")).alias("w"))
    theta = np.zeros(len(features) + 1)
    for r in fitted.collect():  # a row for each feature
        theta[r["k"]] = r["w"]
    return Model(features, theta[:-1], float(theta[-1]))


def _scores(model: Model | None):
    def run(batches):
        for batch in batches:
            scores = model.scores(batch["text"].to_pylist()) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "_score"])
        release()

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``toxicity`` double."""
    slim = pack(docs, "text")
    scored = slim.mapInArrow(_scores(model), schema_of(slim, _score="double"))
    return unpack(scored, docs, ("text",), toxicity=F.col("_score"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    predicted = F.when(F.col("toxicity") >= THRESHOLD, 1).otherwise(0)
    return score(docs, model).select("doc_id", (~in_training()).alias("held_out"), F.col("toxicity").alias("score"), predicted.alias("predicted"))
