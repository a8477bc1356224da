"""Content-defined anchors: cut texts into pieces whose equal windows meet.

Any two equal windows of ``window`` bytes hold the same k-grams, so both pick
the same *anchor*: the leftmost k-gram with the least hash (winnowing). A
*piece* is a longest run of window starts with one anchor position. Equal
windows therefore lie in pieces with the same anchor hash, at the same distance
from the anchor, and it is enough to compare pieces that share an anchor.
"""

from __future__ import annotations

import numpy as np

K = 64
CHUNK = 1 << 20
_POS = np.uint64((1 << 22) - 1)

_rng = np.random.Generator(np.random.PCG64(20260101))
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        _tables["up"], _tables["down"] = _powers(_P, n), _powers(_INV, n)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each position, by doubling."""
    h, width = BYTE[raw], 1
    for step in _STEP[: K.bit_length() - 1]:
        h = h[:-width] * step + h[width:]
        width *= 2
    return mix(h)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from each position."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _chunks(offsets: np.ndarray, window: int):
    """(first byte, end byte, documents) of stretches of at most about CHUNK bytes; a longer document is cut into overlapping stretches."""
    doc, n = 0, len(offsets) - 1
    while doc < n:
        if offsets[doc + 1] - offsets[doc] > CHUNK:
            a = offsets[doc]
            while a + window <= offsets[doc + 1]:
                yield a, min(a + CHUNK, offsets[doc + 1]), doc, doc + 1
                a += CHUNK - window + 1
            doc += 1
        else:
            end = int(np.searchsorted(offsets, offsets[doc] + CHUNK, "right")) - 1
            end = min(max(end, doc + 1), n)
            yield offsets[doc], offsets[end], doc, end
            doc = end


def pieces(raw: np.ndarray, offsets: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Columns of all pieces: doc (index), first and last window start (bytes from
    the document's start), off (anchor minus first), anchor and fp (hash of the
    piece's bytes with off and length)."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("doc", "first", "last", "off", "anchor", "fp")}
    for a, b, d0, d1 in _chunks(offsets, window):
        if b - a < window:
            continue
        text = raw[a:b]
        grams = gram_hashes(text)
        key = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
        at = (sliding_least(key, window - K + 1) & _POS).astype(np.int64)
        starts = np.clip(offsets[d0:d1], a, b) - a
        ends = np.clip(offsets[d0 + 1 : d1 + 1], a, b) - a
        # first windows of runs: the anchor changes, or a document begins
        change = np.flatnonzero(at[1:] != at[:-1]) + 1
        whole = ends - starts >= window
        s0, s1 = starts[whole], ends[whole] - window
        if not len(s0):
            continue
        first = np.unique(np.concatenate([change, s0]))
        owner = np.searchsorted(s0, first, "right") - 1
        keep = (owner >= 0) & (first <= s1[np.maximum(owner, 0)])
        first, owner = first[keep], owner[keep]
        last = np.concatenate([first[1:], [len(text)]]) - 1
        last = np.minimum(last, s1[owner])
        up, down = _power_tables(max(CHUNK, len(text)) + 1)
        prefix = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(BYTE[text] * up[: len(text)], out=prefix[1:])
        off = at[first] - first
        fp = (prefix[last + window] - prefix[first]) * down[first]
        shape = (off.astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64)
        doc = np.flatnonzero(whole)[owner] + d0
        begin = a - offsets[doc] + first
        out["doc"].append(doc)
        out["first"].append(begin)
        out["last"].append(begin + (last - first))
        out["off"].append(off)
        out["anchor"].append(grams[at[first]].view(np.int64))
        out["fp"].append(mix(fp ^ mix(shape)).view(np.int64))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
