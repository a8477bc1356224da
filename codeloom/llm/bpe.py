"""BPE encoding and decoding in batched numpy merge rounds.

For tokenizer files (``tokenizers`` JSON) of the word kind: NFC, white space to
blanks, lower case, a pattern that parts letters, single digits and other
signs, bytes as characters, and ``</w>`` on the last symbol of a word. Such a
pattern never matches across white space, so a text is a list of white-space
words, and only words not met before are encoded: all their symbols in one flat
array, where each round merges in every word the pair of lowest rank, found by
binary search over the sorted pair keys.

Defined results: null text has no tokens and decodes to an empty text; the
file's added tokens are matched in the raw text, as the library does.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pack, read, release, schema_of, unpack

#: Words held by a worker before it starts anew: bounds its memory.
CACHE_WORDS = 150_000
_NONE = np.iinfo(np.int64).max
#: White space to Python but not to the tokenizers' patterns.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BLANK = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else extra))
        extra += b not in shown
    return out


class WordBpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.tokens = pa.array([names.get(i, "") for i in range(max(names) + 1)])
        characters = byte_characters()
        self.inner = np.array([vocab[c] for c in characters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in characters], np.int64)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])], np.int64)
        keys = (pairs[:, 0] << 32) | pairs[:, 1]
        self.rank = np.argsort(keys, kind="stable")
        self.keys, self.merged = keys[self.rank], pairs[self.rank, 2]
        # equal pairs of a word may merge in one round only if no pair ranks before the merge that makes a part of it
        made = np.full(max(names) + 1, -1)
        made[pairs[::-1, 2]] = np.arange(len(pairs))[::-1]
        self.whole_rounds = bool((made[pairs[:, 0]] < np.arange(len(pairs))).all() and (made[pairs[:, 1]] < np.arange(len(pairs))).all())
        self.known: dict[str, bytes] = {}

    def _ranks(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place in ``keys`` of the pair that each symbol starts."""
        rank, at = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            pair = (symbols[:-1] << 32) | symbols[1:]
            place = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            found = (self.keys[place] == pair) & (word[:-1] == word[1:])
            rank[:-1][found] = self.rank[place[found]]
            at[:-1] = place
        return rank, at

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their words (ascending) after all merges."""
        done_s, done_w = [], []
        while len(symbols):
            rank, at = self._ranks(symbols, word)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.concatenate([first, [len(word)]]))
            least = np.repeat(np.minimum.reduceat(rank, first), sizes)
            ended = least == _NONE
            if ended.any():
                done_s.append(symbols[ended])
                done_w.append(word[ended])
                symbols, word, rank, at, least = symbols[~ended], word[~ended], rank[~ended], at[~ended], least[~ended]
                if not len(symbols):
                    break
            hit = rank == least
            place = np.flatnonzero(hit)
            if self.whole_rounds:
                # overlapping equal pairs (a a a): every other one of a run, from the left
                start = np.concatenate([[True], (place[1:] != place[:-1] + 1) | (word[place[1:]] != word[place[:-1]])])
                run = np.maximum.accumulate(np.where(start, np.arange(len(place)), 0))
                place = place[(np.arange(len(place)) - run) % 2 == 0]
            else:
                place = place[np.concatenate([[True], word[place[1:]] != word[place[:-1]]])]
            symbols[place] = self.merged[at[place]]
            stay = np.ones(len(symbols), bool)
            stay[place + 1] = False
            symbols, word = symbols[stay], word[stay]
        if not done_s:
            return symbols, word
        symbols, word = np.concatenate(done_s), np.concatenate(done_w)
        by = np.argsort(word, kind="stable")
        return symbols[by], word[by]

    def learn(self, words: list[str]) -> None:
        """Encode ``words`` and hold their ids as little-endian 32-bit integers."""
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known.clear()
        owner, parts = [], []
        for k, w in enumerate(words):
            found = self.pattern.findall(w)
            owner.extend([k] * len(found))
            parts.extend(found)
        raw = [p.encode("utf-8") for p in parts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[flat]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.final[flat[last]]
        symbols, part = self.merge(symbols, np.repeat(np.arange(len(raw)), sizes))
        word = np.asarray(owner, np.int64)[part]
        ends = np.searchsorted(word, np.arange(len(words)), "right") * 4
        data, begin = symbols.astype("<i4").tobytes(), 0
        for w, end in zip(words, ends.tolist()):
            self.known[w] = data[begin:end]
            begin = end

    def words(self, text: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # a capital sigma is lowered by itself, not by its place in the word
        text = (text.replace("Σ", "σ") if "Σ" in text else text).lower()
        return [w for w in _BLANK.split(text) if w] if _SEPARATORS.search(text) else text.split()

    def encode(self, texts: list[str | None], group: int = 1 << 21) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; texts are taken in groups of about ``group`` characters."""
        out, a = [], 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size < group):
                size += len(texts[b] or "")
                b += 1
            out += self._encode(texts[a:b])
            a = b
        return out

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        split, special = [], {}
        for k, text in enumerate(texts):
            text = text or ""
            if self.split_added and self.split_added.search(text):
                special[k] = [t if t in self.added else self.words(t) for t in self.split_added.split(text)]
                split.append([w for t in special[k] if not isinstance(t, str) for w in t])
            else:
                split.append(self.words(text))
        distinct = set(chain.from_iterable(split))
        if len(self.known) + len(distinct) > CACHE_WORDS:
            self.known.clear()
        if new := sorted(distinct.difference(self.known)):
            self.learn(new)
        get = self.known.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for k, parts in special.items():
            out[k] = b"".join(np.array([self.added[t]], "<i4").tobytes() if isinstance(t, str) else b"".join(map(get, t)) for t in parts)
        return out

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids: their tokens, parted by blanks."""
        sizes = np.asarray(pc.fill_null(pc.list_value_length(ids), 0)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat, out, a = ids.flatten(), [], 0
        while a < len(sizes):
            b = max(int(np.searchsorted(ends, ends[a] + (1 << 24), "right")) - 1, a + 1)
            own = self.tokens.take(flat.slice(ends[a], ends[b] - ends[a]))
            out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), own), " "))
            a = b
        return pa.concat_arrays(out) if out else pa.array([], pa.string())


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _encoder(path: str):
    def run(batches):
        bpe = load(path)
        for batch in batches:
            encoded = bpe.encode(batch["text"].to_pylist())
            ends = np.cumsum([0, *map(len, encoded)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(encoded), "<i4")))
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), ids], names=[*rest, "ids"])
        release()

    return run


def _decoder(path: str):
    def run(batches):
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, bpe.decode(batch["ids"])], names=[*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids`` array<int> in place of ``text``. ``path``: the tokenizer's file, on every machine."""
    slim = pack(docs, "text")
    encoded = slim.mapInArrow(_encoder(path), schema_of(slim, ("text",), ids="array<int>"))
    return unpack(encoded, docs, ("text",), without=("text",), ids=F.col("ids"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded`` string, the text of ``ids``."""
    slim = pack(encoded, "ids")
    return unpack(slim.mapInArrow(_decoder(path), schema_of(slim, decoded="string")), encoded, ("ids",), decoded=F.col("decoded"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``docs`` (doc_id, text)."""
    both = decode(encode(docs.select("doc_id", "text"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
