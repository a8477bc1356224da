"""Word and shingle hashes of many texts at once, from their bytes."""

from __future__ import annotations

import numpy as np

from .anchors import BYTE, CHUNK, _power_tables, mix

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TURN = np.uint64(0xD1342543DE82EF95)


def stretches(offsets: np.ndarray, size: int = CHUNK):
    """(first, end) document numbers of stretches of about ``size`` bytes, whole documents."""
    doc, n = 0, len(offsets) - 1
    while doc < n:
        end = int(np.searchsorted(offsets, offsets[doc] + size, "right")) - 1
        end = min(max(end, doc + 1), n)
        yield doc, end
        doc = end


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Texts must be parted by white space."""
    low = _LOWER[raw]
    inside = ~_GAP[low]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(low) + 1)
    prefix = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(BYTE[low] * up[: len(low)], out=prefix[1:])
    value = (prefix[end] - prefix[start]) * down[start]
    return start, mix(value + mix((end - start).astype(np.uint64)))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5):
    """For each stretch of texts: (first document, end document, hashes, ends), the
    sorted distinct shingle hashes of its documents one after another. A text of
    fewer words than ``width`` has one shingle, all its words; one without words has none."""
    for d0, d1 in stretches(offsets):
        n = d1 - d0
        # texts parted by one blank each, so that words don't run together
        sizes = np.diff(offsets[d0 : d1 + 1])
        begin = offsets[d0:d1] - offsets[d0] + np.arange(n)
        spaced = np.full(int(sizes.sum()) + n, 0x20, np.uint8)
        spaced[np.arange(int(sizes.sum())) + np.repeat(np.arange(n), sizes)] = raw[offsets[d0] : offsets[d1]]
        start, words = word_hashes(spaced)
        first = np.searchsorted(start, begin)
        last = np.concatenate([first[1:], [len(words)]])
        count = last - first
        rolled = words.copy()
        for k in range(1, width):
            rolled[: len(words) - k] = rolled[: len(words) - k] * _TURN + words[k:] if len(words) > k else rolled[:0]
        hashes = mix(rolled)
        out, ends = [], np.zeros(n + 1, np.int64)
        for k in range(n):
            a, c = first[k], count[k]
            if c >= width:
                own = np.unique(hashes[a : a + c - width + 1])
            elif c:
                value = np.uint64(c)
                for w in words[a : a + c]:
                    value = np.uint64((int(value) * int(_TURN) + int(w)) & 0xFFFFFFFFFFFFFFFF)
                own = mix(np.array([value], np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
            else:
                own = hashes[:0]
            out.append(own)
            ends[k + 1] = ends[k] + len(own)
        yield d0, d1, np.concatenate(out) if out else hashes[:0], ends


def super_minhash(hashes: np.ndarray, ends: np.ndarray, slots: int, group: int = 1 << 16) -> np.ndarray:
    """SuperMinHash signatures, one row of ``slots`` uint64 for each set ``hashes[ends[k]:ends[k+1]]``.

    Each element walks a random permutation of the slots; its value in the slot
    of step j is j plus a uniform fraction. Step j runs for all elements of the
    sets whose largest slot value is still j or more: no later step can lower
    the others, so large sets stop after one step. Sets are taken in groups of
    about ``group`` elements, which bounds the permutations held.
    """
    n = len(ends) - 1
    signature = np.full((n, slots), np.iinfo(np.uint64).max, np.uint64)
    a = 0
    while a < n:
        b = min(max(int(np.searchsorted(ends, ends[a] + group, "right")) - 1, a + 1), n)
        part = signature[a:b]
        _walk(hashes[ends[a] : ends[b]], np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])), part, slots)
        a = b
    return signature


def _walk(hashes: np.ndarray, owner: np.ndarray, signature: np.ndarray, slots: int) -> None:
    flat, order = signature.reshape(-1), None
    for step in range(slots):
        if not len(hashes):
            return
        value = mix(hashes + np.uint64((0xA0761D6478BD642F * (step + 1)) & 0xFFFFFFFFFFFFFFFF))
        pick = step + (((value & np.uint64(0xFFFFFFFF)) * np.uint64(slots - step)) >> np.uint64(32)).astype(np.int64)
        rows = np.arange(len(hashes))
        if step == 0:
            slot = pick
        else:
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, step]
            order[:, step] = slot
        np.minimum.at(flat, owner * slots + slot, (np.uint64(step) << np.uint64(32)) | (value >> np.uint64(32)))
        open_ = signature.max(axis=1) >= (np.uint64(step + 1) << np.uint64(32))
        keep = open_[owner]
        hashes, owner = hashes[keep], owner[keep]
        if step == 0:
            order = np.tile(np.arange(slots, dtype=np.uint16), (len(hashes), 1))
            slot = slot[keep]
            rows = np.arange(len(hashes))
            order[rows, slot] = 0
            order[:, 0] = slot
        else:
            order = order[keep]


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of rows of a signature; the band's number is part of it."""
    n, slots = signature.shape
    rows = slots // bands
    grid = signature.reshape(n, bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    for k in range(rows):
        key = mix(key * _TURN + grid[:, :, k])
    return key
