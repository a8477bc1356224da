"""Language identification by interpolated Kneser-Ney character models.

One model for each language, of order ORDER, from the ROWS documents of least
hash of that language (a bounded sample of labelled rows; whole texts). A fifth
of them sets the temperature of the scores and the bar of rejection. Models are
stored as sorted hash arrays: for each order the hashes of its n-grams over all
languages with one column of log-probabilities for each language, and the
hashes of its contexts with the logarithms of their backoff weights. A language
that lacks an n-gram gets its value by backing off when the arrays are built,
so a lookup by binary search serves all languages at once.

Text is lower-cased and every run of other signs than letters becomes one
blank. The language of least cross-entropy per character wins, ties to the
first by name. Defined results: null text and text without a letter is ``und``
with score 0; without any labelled text everything is ``und``; rows with a null
language teach nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .anchors import mix
from .common import in_training, pack, read, schema_of, small_batches, stored, unpack

ORDER = 5
ROWS = 400
UND = "und"
REJECTED = 0.005  # share of calibration texts that the bar of rejection would turn away
CHUNK = 1 << 19
_OTHER = re.compile(r"[\W\d_]+")
_TURN = np.uint64(0x9E6C63D0876A9A47)


def symbols(text: str | None) -> str:
    """Letters in lower case, parted by single blanks, with a blank at either end; empty if there is no letter."""
    plain = _OTHER.sub(" ", (text or "").lower()).strip()
    return f" {plain} " if plain else ""


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """For each order n: hash of the n symbols that end at each position; positions below n - 1 hold a shorter one's."""
    one = mix(codes.astype(np.uint64) + np.uint64(1))
    out = [one]
    for _ in range(ORDER - 1):
        longer = one.copy()
        longer[1:] = mix(out[-1][:-1] * _TURN + one[1:])
        out.append(longer)
    return out


def fit(texts: list[str]) -> dict[str, np.ndarray]:
    """Arrays of one language: for each order n ``key``, ``logp``, ``tail`` (hash without the first symbol) and ``ctx`` (without the last), and the contexts ``bctx``, ``bow``."""
    codes = np.frombuffer("".join(symbols(t) for t in texts).encode("utf-32-le"), np.uint32)
    model: dict[str, np.ndarray] = {}
    if len(codes) < ORDER:
        codes = np.frombuffer((" " * ORDER).encode("utf-32-le"), np.uint32)
    levels = grams(codes)
    at = {}
    for n in range(ORDER, 0, -1):
        keys, first, count = np.unique(levels[n - 1][n - 1 :], return_index=True, return_counts=True)
        at[n] = (keys, first + n - 1, count)
    for n in range(1, ORDER + 1):
        keys, first, count = at[n]
        if n < ORDER:  # in how many different symbols' company it is seen, not how often
            longer = at[n + 1][1]
            tails, count_t = np.unique(levels[n - 1][longer], return_counts=True)
            place = np.minimum(np.searchsorted(tails, keys), len(tails) - 1)
            count = np.where(tails[place] == keys, count_t[place], 1)
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = ones / max(ones + 2 * twos, 1) if ones else 0.5
        ctx = levels[n - 2][first - 1] if n > 1 else np.zeros(len(keys), np.uint64)
        names, owner = np.unique(ctx, return_inverse=True)
        total, kinds = np.bincount(owner, count), np.bincount(owner)
        weight = np.clip(discount * kinds / total, 1e-9, 1.0)
        tail = levels[n - 2][first] if n > 1 else np.zeros(len(keys), np.uint64)
        if n > 1:
            below = np.exp(model[f"logp{n - 1}"])[np.searchsorted(model[f"key{n - 1}"], tail)]
        else:
            below = np.full(len(keys), 1 / (len(keys) + 1))
        p = np.maximum(count - discount, 0) / total[owner] + weight[owner] * below
        model |= {f"key{n}": keys, f"logp{n}": np.log(p), f"tail{n}": tail, f"ctx{n}": ctx, f"bctx{n}": names, f"bow{n}": np.log(weight)}
    return model


class Models:
    """Models of several languages, joined for lookups."""

    def __init__(self, models: dict[str, dict[str, np.ndarray]]):
        self.names = sorted(models)
        own = [models[n] for n in self.names]
        unseen = np.array([m["bow1"][0] - np.log(len(m["key1"]) + 1) for m in own])
        self.unseen, self.keys, self.logp, self.contexts, self.bow = unseen, [], [], [], []
        for n in range(1, ORDER + 1):
            contexts = np.unique(np.concatenate([m[f"bctx{n}"] for m in own]))
            bow = np.zeros((len(contexts), len(own)))
            for k, m in enumerate(own):
                bow[np.searchsorted(contexts, m[f"bctx{n}"]), k] = m[f"bow{n}"]
            keys, first = np.unique(np.concatenate([m[f"key{n}"] for m in own]), return_index=True)
            if n > 1:
                tail, ctx = (np.concatenate([m[f"{c}{n}"] for m in own])[first] for c in ("tail", "ctx"))
                logp = self.logp[-1][np.searchsorted(self.keys[-1], tail)].astype(np.float64) + bow[np.searchsorted(contexts, ctx)]
            else:
                logp = np.tile(unseen, (len(keys), 1))
            for k, m in enumerate(own):
                logp[np.searchsorted(keys, m[f"key{n}"]), k] = m[f"logp{n}"]
            self.keys.append(keys)
            self.logp.append(logp.astype(np.float32))
            self.contexts.append(contexts)
            self.bow.append(bow.astype(np.float32))
        self.temperature, self.bar = 1.0, np.inf

    def _chars(self, codes: np.ndarray) -> np.ndarray:
        """Log-probability of each symbol after the ones before it, one column for each language."""
        levels = grams(codes)
        out = np.zeros((len(codes), len(self.names)), np.float32)
        open_ = np.arange(len(codes))
        for n in range(ORDER, 0, -1):
            long = open_ >= n - 1
            todo = open_[long]
            key = levels[n - 1][todo]
            place = np.minimum(np.searchsorted(self.keys[n - 1], key), len(self.keys[n - 1]) - 1)
            hit = self.keys[n - 1][place] == key
            out[todo[hit]] += self.logp[n - 1][place[hit]]
            miss = todo[~hit]
            if n > 1 and len(miss):
                before = levels[n - 2][miss - 1]
                place = np.minimum(np.searchsorted(self.contexts[n - 1], before), len(self.contexts[n - 1]) - 1)
                known = self.contexts[n - 1][place] == before
                out[miss[known]] += self.bow[n - 1][place[known]]
            elif n == 1:
                out[miss] += self.unseen.astype(np.float32)
            open_ = np.concatenate([open_[~long], miss])
        return out

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Cross-entropy per symbol of each text under each language; not a number for texts without letters."""
        plain = [symbols(t) for t in texts]
        out = np.full((len(texts), len(self.names)), np.nan)
        a = 0
        while a < len(plain):
            b, size = a, 0
            while b < len(plain) and (b == a or size < CHUNK):
                size += len(plain[b])
                b += 1
            lengths = np.array([len(p) for p in plain[a:b]])
            some = np.flatnonzero(lengths)
            if len(some):
                flat = np.frombuffer("".join(plain[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32)
                ends = np.cumsum(lengths[some])
                total = np.zeros((len(some), len(self.names)))
                # a long text is read in stretches that overlap by the symbols a model looks back on
                for x in range(0, len(flat), CHUNK):
                    y, back = min(x + CHUNK, len(flat)), min(x, ORDER - 1)
                    values = self._chars(flat[x - back : y])[back:].astype(np.float64)
                    of = np.searchsorted(ends, np.arange(x, y), "right")
                    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                    total[of[first]] += np.add.reduceat(values, first, axis=0)
                out[a + some] = -total / lengths[some][:, None]
            a = b
        return out

    def calibrate(self, entropies: np.ndarray, languages: list[str]) -> None:
        """Set temperature and bar from the ``entropies`` of texts (a row each) of known ``languages``."""
        right = np.array([self.names.index(n) for n in languages])
        if not len(right):
            return
        losses = {t: -np.log(self._shares(entropies, t)[np.arange(len(right)), right] + 1e-12).mean() for t in (1, 2, 4, 8, 16, 32, 64)}
        self.temperature = min(losses, key=losses.get)
        self.bar = float(np.quantile(entropies.min(axis=1), 1 - REJECTED))

    @staticmethod
    def _shares(entropies: np.ndarray, temperature: float) -> np.ndarray:
        z = np.exp(-temperature * (entropies - entropies.min(axis=1, keepdims=True)))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (its calibrated share) and whether the text is as usual for that language as the bar asks."""
        if not self.names:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        entropies = self.entropies(texts)
        good = np.isfinite(entropies[:, 0])
        safe = np.where(good[:, None], entropies, 0.0)
        win = safe.argmin(axis=1)
        names = [self.names[k] if g else UND for k, g in zip(win, good)]
        return names, np.where(good, self._shares(safe, self.temperature).max(axis=1), 0.0), good & (safe.min(axis=1) <= self.bar)


def _chosen(docs: DataFrame, rows: int) -> DataFrame:
    """(lang, text, k): the ``rows`` training rows of least hash of each language, numbered.

    Rows are first thinned by hash to about 1.5 times as many, so that neither
    texts nor rows of a language that holds most of the table move to one task.
    The shares are broadcast: two numbers for each language, which gets a model.
    """
    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & in_training())
    share = taught.groupBy("lang").agg((F.lit(1.5 * rows) / F.count("*")).alias("share"))
    place = F.xxhash64(F.col("doc_id"), F.lit(6))
    near = taught.join(F.broadcast(share), "lang").where((F.shiftrightunsigned(place, 11) / F.lit(float(1 << 53))) < F.col("share"))
    order = Window.partitionBy("lang").orderBy(place, "doc_id", "text")
    return near.select("lang", "text", F.row_number().over(order).alias("k")).where(F.col("k") <= rows)


def train(docs: DataFrame, rows: int = ROWS) -> Models:
    """Models from the training rows of ``docs`` (doc_id, text, lang)."""
    small_batches(docs.sparkSession)
    some = stored(_chosen(docs, rows), "lang-sample")

    def learn(table: pa.Table) -> pa.Table:
        held = [t for t, k in zip(table["text"].to_pylist(), table["k"].to_pylist()) if k % 5]
        model = fit(held or table["text"].to_pylist())
        names = sorted(model)
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(names)), "name": names, "data": pa.array([model[n].tobytes() for n in names], pa.binary())})

    parts: dict[str, dict[str, np.ndarray]] = {}
    for r in some.groupBy("lang").applyInArrow(learn, "lang string, name string, data binary").collect():
        kind = np.float64 if r["name"].startswith(("logp", "bow")) else np.uint64
        parts.setdefault(r["lang"], {})[r["name"]] = np.frombuffer(r["data"], kind)
    if not parts:
        empty = Models.__new__(Models)
        empty.names = []
        return empty
    models = Models(parts)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def measure(batches):
        for batch in batches:
            found = shared.value.entropies(batch["text"].to_pylist())
            good = np.isfinite(found[:, 0])
            yield pa.RecordBatch.from_arrays([batch["lang"].filter(pa.array(good)), pa.array(found[good].tolist(), pa.list_(pa.float64()))], names=["lang", "e"])

    check = some.where("k % 5 = 0").select("lang", "text").mapInArrow(measure, "lang string, e array<double>").collect()  # a fifth of ``rows`` for each language
    check.sort(key=lambda r: (r["lang"], r["e"]))
    models.calibrate(np.array([r["e"] for r in check]).reshape(len(check), -1), [r["lang"] for r in check])
    shared.unpersist()
    return models


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``lang_usual`` in place of ``text``. The models are broadcast: their size is bounded by ROWS texts a language."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            names, score, usual = shared.value.predict(batch["text"].to_pylist())
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(names), pa.array(score), pa.array(usual)], names=[*rest, "lang_pred", "lang_score", "lang_usual"])

    slim = pack(docs, "text")
    new = {"lang_pred": "string", "lang_score": "double", "lang_usual": "boolean"}
    return unpack(slim.mapInArrow(run, schema_of(slim, ("text",), **new)), docs, ("text",), without=("text",), **{c: F.col(c) for c in new})


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", (~in_training()).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_usual").alias("usual"))
