"""Token ids in files: canonical length-limited Huffman codes from global counts.

Files below a folder:

* ``codes``: Parquet rows (id, length), the code lengths; codes are canonical
  (by length, then id), so the lengths say all.
* ``kind``: no rows; its schema has the type of the ids of documents.
* ``blocks``: Parquet rows of whole documents, in ascending order of ``start``:
  ``start`` (ids before the block), ``doc_ids``, ``sizes`` (ids of each
  document), ``bits`` (the codes, from the highest bit) and ``checkpoints``
  (the bit offset of every STRIDE-th id). A block stands alone. Folders
  ``part=0, 1, ...`` are in that order too.

Decoding is table-driven: LIMIT bits index a table of (id, length). All
stretches between checkpoints of some blocks advance together, one id each step.

Defined results: a null text is a document of no ids but the end id; null ids
come first, equal ids stay side by side in order of their texts.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import byte_characters
from .common import read, release, small_batches, stored, text_bytes, work_dir

LIMIT = 16
STRIDE = 256
BLOCK_IDS = 1 << 18
#: Pieces, and bytes of pieces, held by a worker before it starts anew: bounds its memory.
CACHE_PIECES, HELD_BYTES = 600_000, 64 << 20
END_ID = 0

# --- ids of texts -------------------------------------------------------------

#: First bytes of what surely isn't white space to any pattern: a blank is a cut only before these.
_VISIBLE = np.ones(256, bool)
_VISIBLE[[*range(0x00, 0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
#: Texts of these signs alone have the same letters, numbers and white space in all versions of Unicode.
_PLAIN = r"^[\n\r\t -~\x{A1}-\x{24F}\x{2010}-\x{2027}\x{2030}-\x{205E}]*$"
#: An apostrophe, or white space beside white space: the pattern looks around there.
_LOOKS = r"'|\s\s"
_SPACE, _SIGN = 0, 3


class _Pool:
    """Runs of ids by number, held in one flat array."""

    def __init__(self):
        self.flat, self.start, self.size, self.used, self.rows = np.zeros(1 << 12, np.uint32), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0, 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[self.rows : self.rows + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.rows : self.rows + len(sizes)] = sizes
        self.used += len(flat)
        self.rows += len(sizes)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these runs one after another, and each run's size."""
        sizes = self.size[rows]
        at = np.repeat(self.start[rows] - (np.cumsum(sizes) - sizes), sizes)
        at += np.arange(len(at))
        return self.flat[at], sizes


def _objects(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


def _cut(raw: np.ndarray, start: np.ndarray) -> pa.DictionaryArray:
    """The stretches of ``raw`` that begin at ``start``, as a dictionary."""
    ends = np.append(start, len(raw)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()


class PieceEncoder:
    """The library's ids of texts, piece by piece.

    The pattern of a byte-level file always parts a text before a blank that a
    visible sign follows. Texts are cut there, the different pieces of a batch
    are found by Arrow's dictionary, and only pieces not met before are encoded:
    those of plain signs are parted where the kind of sign changes (by the
    file's pattern, where that looks around), and the library's model gets each
    different part once; all others go to the library as they are. A text with
    an added token is one piece. Held ids are gathered by numpy.
    """

    def __init__(self, path: str, most: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.parts = regex.compile(public_tokenizers.PATTERN).findall
        kinds = [regex.compile(k) for k in (r"\s", r"\p{L}", r"\p{N}", r".")]
        self.kind = np.array([next((k for k, c in enumerate(kinds) if c.match(chr(x))), _SIGN) for x in range(0x205F)], np.int8)
        self.characters = dict(enumerate(byte_characters()))
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.known_parts: dict[bytes, int] = {}
        self.pool, self.part_pool = _Pool(), _Pool()
        self.pool.add(np.array([END_ID]), np.array([1]))  # run 0 ends a document
        self.held = 0

    def _whole(self, pieces: list[bytes]) -> None:
        for a in range(0, len(pieces), 256):
            found = [e.ids for e in self.library.encode_batch_fast([p.decode() for p in pieces[a : a + 256]], add_special_tokens=False)]
            self._name(pieces[a : a + 256])
            self.pool.add(np.fromiter(chain.from_iterable(found), np.uint32), np.array(list(map(len, found)), np.int64))

    def _name(self, pieces: list[bytes]) -> None:
        self.known.update(zip(pieces, range(self.pool.rows, self.pool.rows + len(pieces))))

    def _plain(self, pieces: pa.Array) -> None:
        """Encode ``pieces`` (large_binary) of plain signs."""
        raw, offsets = text_bytes(pieces)
        signs = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.cumsum(1 + (signs >= 0x80) + (signs >= 0x800)) - 1 - (signs >= 0x80) - (signs >= 0x800)  # first byte of each sign
        kind = self.kind[signs]
        begin = np.ones(len(signs), bool)
        begin[1:] = (kind[1:] != kind[:-1]) & ((signs[:-1] != 0x20) | (kind[1:] == _SPACE))
        ends = np.append(np.searchsorted(place, offsets[:-1]), len(signs))
        begin[ends[:-1]] = True
        for k in np.flatnonzero(pc.match_substring_regex(pieces.cast(pa.large_string()), _LOOKS)):
            sizes = list(map(len, self.parts(raw[offsets[k] : offsets[k + 1]].tobytes().decode())))
            begin[ends[k] : ends[k + 1]] = False
            begin[ends[k] + np.cumsum([0, *sizes[:-1]])] = True
        first = np.flatnonzero(begin)
        coded = _cut(raw, place[first])
        parts = _objects(coded.dictionary)
        if len(self.known_parts) + len(parts) > self.most:
            self.known_parts, self.part_pool = {}, _Pool()
        new = [p for p in parts if p not in self.known_parts]
        ids, sizes = [], []
        for shown in b"\0".join(new).decode("latin-1").translate(self.characters).split(self.characters[0]) if new else ():
            found = [t.id for t in self.library.model.tokenize(shown)]
            ids += found
            sizes.append(len(found))
        self.known_parts.update(zip(new, range(self.part_pool.rows, self.part_pool.rows + len(new))))
        self.part_pool.add(np.array(ids, np.uint32), np.array(sizes, np.int64))
        rows = np.fromiter(map(self.known_parts.__getitem__, parts), np.int64, len(parts))[np.asarray(coded.indices)]
        ids, sizes = self.part_pool.take(rows)
        at = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(first, ends)]
        self._name(_objects(pieces))
        self.pool.add(ids, np.diff(at))

    def _rows(self, dictionary: pa.Array) -> np.ndarray:
        """The run of each piece, new ones encoded first."""
        pieces = _objects(dictionary)
        if len(self.known) + len(pieces) > self.most or self.held > HELD_BYTES:
            self._clear()
        fresh = np.array([p not in self.known for p in pieces], bool)
        if fresh.any():
            new = dictionary.filter(pa.array(fresh))
            self.held += new.nbytes
            text = new.cast(pa.large_string())
            plain = pc.match_substring_regex(text, _PLAIN)
            for token in self.added:
                plain = pc.and_not(plain, pc.match_substring(text, token))
            own = new.filter(plain)
            if len(own):
                self._plain(own)
            self._whole(_objects(new.filter(pc.invert(plain))))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and how many each has."""
        raw, offsets = text_bytes(texts)
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        begin = np.zeros(len(raw) + 1, bool)
        if len(raw):
            begin[: len(raw) - 1] = (raw[:-1] == 0x20) & _VISIBLE[raw[1:]]
        for token in self.added:
            for k in np.flatnonzero(pc.fill_null(pc.match_substring(texts, token), False)):
                begin[offsets[k] : offsets[k + 1]] = False
        begin[offsets[:-1]] = True
        begin[len(raw)] = False  # where empty texts at the end begin
        start = np.flatnonzero(begin)
        coded = _cut(raw, start)
        rows = self._rows(coded.dictionary)[np.asarray(coded.indices)] if len(start) else np.zeros(0, np.int64)
        # a document's pieces, then the end
        last = np.searchsorted(start, offsets[1:])
        ids, sizes = self.pool.take(np.insert(rows, last, 0))
        ends = np.cumsum(sizes)[last + np.arange(len(last))]
        return ids, np.diff(ends, prepend=0)


_encoders: dict[str, PieceEncoder] = {}


def _let_go() -> None:
    """Give up the encoder: workers outlive their tasks and would hold its pieces through the later stages."""
    if _encoders:
        _encoders.clear()
        release()


def _groups(texts: pa.Array, size: int = 1 << 22):
    """(first, end) of stretches of about ``size`` bytes."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
    a = 0
    while a < len(ends):
        b = min(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "left")) + 1, len(ends))
        yield a, b
        a = b


def _tokenize(path: str):
    """Documents of one partition, in order: their ids as little-endian integers of 16 bits where all ids fit, and how many came before in the partition."""

    def run(batches):
        encoder = _encoders.setdefault(path, None) or PieceEncoder(path)
        _encoders[path] = encoder
        narrow, before = encoder.library.get_vocab_size() <= 1 << 16, 0
        for batch in batches:
            for a, b in _groups(batch["text"]):
                flat, sizes = encoder.encode(batch["text"].slice(a, b - a))
                width, flat = (2, flat.astype("<u2")) if narrow else (4, flat.astype("<u4"))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                column = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), column, pa.array(sizes), pa.array(before + ends[:-1])], names=["doc_id", "ids", "n", "local"])
                before += int(ends[-1])
        release()

    return run


# --- codes ----------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    by = used[np.argsort(counts[used], kind="stable")]
    weight = counts[by].astype(np.int64)
    levels, row = [], (weight, np.ones(len(by), bool))
    for _ in range(limit - 1):
        levels.append(row)
        pairs = len(row[0]) // 2 * 2
        packed = row[0][0:pairs:2] + row[0][1:pairs:2]
        both = np.concatenate([weight, packed])
        order = np.argsort(both, kind="stable")
        row = (both[order], (order < len(by)))
    levels.append(row)
    # the first 2n - 2 items of the last level; packages open into pairs of the level before
    take, n = 2 * len(by) - 2, np.zeros(len(by), np.int64)
    for _, leaf in reversed(levels):
        own = int(leaf[:take].sum())
        n[:own] += 1
        take = 2 * (take - own)
    lengths[by] = n
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    order = np.lexsort([np.arange(len(lengths)), lengths])
    order = order[lengths[order] > 0]
    out = np.zeros(len(lengths), np.uint64)
    # in this order a code starts where the one before ends, as fractions of 2 ** LIMIT
    deep = int(lengths.max(initial=0))
    span = np.left_shift(1, deep - lengths[order])
    out[order] = (np.concatenate([[0], np.cumsum(span)[:-1]]) >> (deep - lengths[order])).astype(np.uint64) if len(order) else 0
    return out


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, offset of the code of every STRIDE-th id). As many codes as fit 64 bits are joined first."""
    deep, n = int(lengths.max(initial=1)), len(ids)
    group = 1 << ((64 // deep).bit_length() - 1)
    both = (codes << np.uint64(6)) | lengths.astype(np.uint64)
    filled = np.zeros(-(-n // group) * group, np.uint64)
    np.take(both, ids, out=filled[:n])
    size, code = (filled & np.uint64(63)).astype(np.int64), filled >> np.uint64(6)
    for _ in range(group.bit_length() - 1):
        code = (code[0::2] << size[1::2].astype(np.uint64)) | code[1::2]
        size = size[0::2] + size[1::2]
    ends = np.cumsum(size)
    offsets = ends - size
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros((total + 63) // 64 + 1, np.uint64)
    word = offsets >> 6
    room = 64 - (offsets & 63) - size  # bits left of the word, negative if the codes go on in the next
    high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    if len(word):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.bitwise_or.reduceat(high, first)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (total + 7) // 8], offsets[:: STRIDE // group]


class Decoder:
    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=1)))
        codes = canonical_codes(lengths)
        used = np.flatnonzero(lengths)
        order = used[np.argsort(codes[used] << (self.bits - lengths[used]).astype(np.uint64), kind="stable")]
        span = np.left_shift(1, self.bits - lengths[order])
        table = np.zeros(1 << self.bits, np.int64)
        filled = np.repeat((order << 6) | lengths[order], span)
        table[: len(filled)] = filled
        self.table = table

    def unpack(self, bits: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Ids of the stretches that begin at bit ``at`` and hold ``count`` ids, one stretch after another."""
        padded = np.concatenate([bits, np.zeros(8, np.uint8)])
        # the 32 bits from each byte on
        wide = np.zeros(len(padded) - 3, np.int64)
        for k in range(4):
            wide = (wide << 8) | padded[k : len(padded) - 3 + k]
        order = np.argsort(-count, kind="stable")
        at, left = at[order].astype(np.int64), count[order]
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])[order]
        out = np.empty(int(count.sum()), np.uint32)
        shift, mask = 32 - self.bits, (1 << self.bits) - 1
        live = np.searchsorted(-left, -np.arange(1, int(left.max(initial=0)) + 1), "right")
        for step, n in enumerate(live.tolist()):
            now = at[:n]
            entry = self.table[(wide[now >> 3] >> (shift - (now & 7))) & mask]
            out[begin[:n] + step] = entry >> 6
            now += entry & 63
        return out


_BLOCK = "start long, doc_ids array<{kind}>, sizes array<long>, bits binary, checkpoints array<long>, part int"

# --- files ----------------------------------------------------------------------


def _counts(batches):
    _let_go()
    total = np.zeros(1, np.int64)
    for batch in batches:
        ids = _flat(batch)
        if len(ids):
            own = np.bincount(ids)
            if len(own) > len(total):
                own[: len(total)] += total
                total = own
            else:
                total[: len(own)] += own
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "count"])


def _flat(batch) -> np.ndarray:
    """All ids of a batch of (ids, n)."""
    column = batch["ids"]
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    n = int(pc.sum(batch["n"]).as_py() or 0)
    if not n:
        return np.zeros(0, np.int64)
    width = (int(offsets[-1]) - int(offsets[0])) // n
    return np.frombuffer(column.buffers()[2], f"<u{width}", n, int(offsets[0]))


def _pack_blocks(lengths: np.ndarray):
    def run(batches):
        _let_go()
        codes = canonical_codes(lengths)
        for batch in batches:
            ids, n, part = _flat(batch), np.asarray(batch["n"]), np.asarray(batch["part"])
            ends = np.concatenate([[0], np.cumsum(n)])
            a = 0
            while a < len(n):
                b = max(int(np.searchsorted(ends, ends[a] + BLOCK_IDS, "right")) - 1, a + 1)
                b = min(b, a + int(np.searchsorted(part[a:b], part[a], "right"))) if part[b - 1] != part[a] else b
                bits, offsets = pack(ids[ends[a] : ends[b]], codes, lengths)
                yield pa.RecordBatch.from_arrays(
                    [batch["start"].slice(a, 1), pa.array([batch["doc_id"].slice(a, b - a).to_pylist()], pa.list_(batch["doc_id"].type)), pa.array([n[a:b].tolist()], pa.list_(pa.int64())), pa.array([bits], pa.binary()), pa.array([offsets.tolist()], pa.list_(pa.int64())), batch["part"].slice(a, 1)],
                    names=["start", "doc_ids", "sizes", "bits", "checkpoints", "part"],
                )
                a = b

    return run


def write_ids(docs: DataFrame, tokenizer: str, path: str, limit: int = LIMIT) -> None:
    """Encode ``docs`` (doc_id, text) and write their ids below ``path``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    small_batches(spark)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    tokens = stored(ordered.mapInArrow(_tokenize(tokenizer), f"doc_id {kind}, ids binary, n long, local long").withColumn("part", F.spark_partition_id()), "ids")
    # one row for each partition: few, whatever the size of the table
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = tokens.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    counts = tokens.select("ids", "n").mapInArrow(_counts, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).collect()  # at most the vocabulary
    table = np.zeros(max((r["id"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        table[r["id"]] = r["count"]
    lengths = code_lengths(table, limit)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id long, length int").coalesce(1).write.parquet(f"{path}/codes")
    placed = tokens.join(F.broadcast(before), "part").select("doc_id", "ids", "n", (F.col("base") + F.col("local")).alias("start"), "part")
    docs.select("doc_id").limit(0).coalesce(1).write.parquet(f"{path}/kind")
    blocks = placed.mapInArrow(_pack_blocks(lengths), _BLOCK.format(kind=kind))
    blocks.write.option("compression", "none").partitionBy("part").parquet(f"{path}/blocks")


def _unpack_blocks(lengths: np.ndarray):
    def run(batches):
        _let_go()
        decoder = Decoder(lengths)
        for batch in batches:
            for a in range(0, batch.num_rows, 8):
                some = batch.slice(a, 8)
                bits, at, count, sizes, base = [], [], [], [], 0
                for k in range(some.num_rows):
                    raw = np.frombuffer(some["bits"][k].as_buffer(), np.uint8)
                    own = np.asarray(some["sizes"][k].values)
                    points = np.asarray(some["checkpoints"][k].values)
                    n = np.full(len(points), STRIDE)
                    if len(n):
                        n[-1] = own.sum() - STRIDE * (len(n) - 1)
                    bits.append(raw)
                    at.append(points + base)
                    count.append(n)
                    sizes.append(own)
                    base += len(raw) * 8
                ids = decoder.unpack(np.concatenate(bits), np.concatenate(at), np.concatenate(count))
                ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                starts = np.concatenate([np.cumsum(np.concatenate([[s.as_py()], o[:-1]])) for s, o in zip(some["start"], sizes)])
                data = ids.astype("<u4").tobytes()
                column = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype(np.int64)), pa.py_buffer(data)])
                yield pa.concat_arrays([d.values for d in some["doc_ids"]]), starts, ends, column

    return run


def _as_rows(lengths: np.ndarray):
    def run(batches):
        for doc, starts, ends, column in _unpack_blocks(lengths)(batches):
            yield pa.RecordBatch.from_arrays([doc, pa.array(starts), pa.array(np.diff(ends)), column.cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return run


def _as_checks(lengths: np.ndarray):
    def run(batches):
        for doc, starts, ends, column in _unpack_blocks(lengths)(batches):
            data, cut = memoryview(column.buffers()[2]), (ends * 4).tolist()
            crc = [zlib.crc32(data[a:b]) for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([doc, pa.array(starts), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def _opened(spark, path: str) -> tuple[DataFrame, np.ndarray]:
    rows = spark.read.parquet(f"{path}/codes").collect()  # at most the vocabulary
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        lengths[r["id"]] = r["length"]
    kind = spark.read.parquet(f"{path}/kind").schema["doc_id"].dataType.simpleString()
    blocks = spark.read.schema(_BLOCK.format(kind=kind)).parquet(f"{path}/blocks")
    return blocks.select("start", "doc_ids", "sizes", "bits", "checkpoints"), lengths


def read_ids(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian unsigned 32-bit) of every document below ``path``."""
    blocks, lengths = _opened(spark, path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(_as_rows(lengths), f"doc_id {kind}, start long, n_tokens long, ids binary")


def read_checks(spark, path: str) -> DataFrame:
    """As ``read_ids``, with ids_crc32 in place of the ids."""
    blocks, lengths = _opened(spark, path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(_as_checks(lengths), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = work_dir(spark, "token-files")
    write_ids(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_checks(spark, path)
