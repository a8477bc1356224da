"""Run-length index: a run-compressed Burrows-Wheeler transform of one text.

The suffix array is made by prefix doubling (numpy sorts) and given up once the
transform is run-compressed. What stays is one head and one length for each run,
and for each run end the text position there (the sample) with the length of the
match to its neighbour in suffix order. Matching statistics stream from the
samples: between two samples in text order the match to the neighbour gets one
symbol shorter for each position, because a position that is not at a run end
has the same neighbour as the position before it. Other strings are streamed
through the runs themselves (``occur``), by backward steps.
"""

from __future__ import annotations

import numpy as np

_WORD = 7  # symbols of nine bits in one key


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``symbols`` (values 0 to 256; the end counts as less than any)."""
    n = len(symbols)
    padded = np.zeros(n + _WORD, np.uint64)
    padded[:n] = symbols + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for k in range(_WORD):
        key = (key << np.uint64(9)) | padded[k : k + n]
    order = np.argsort(key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    active, slots, group, width = order.copy(), np.arange(n), key[order], _WORD
    while True:
        # rank of a suffix: one more than the first slot of its group
        new = np.empty(len(active), bool)
        new[0] = True
        np.not_equal(group[1:], group[:-1], out=new[1:])
        heads = slots[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        rank[active] = heads + 1
        single = new.copy()
        single[:-1] &= new[1:]
        rest = ~single
        if not rest.any() or width > n:
            return order
        active, slots = active[rest], slots[rest]
        behind = np.minimum(active + width, n)
        group = (rank[active] << 32) | rank[behind]
        by = np.argsort(group)
        active, group = active[by], group[by]
        order[slots] = active
        width *= 2


def _common(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and at b."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(16, symbols.dtype)])
    words = np.zeros(n + 8, np.uint64)
    for k in range(_WORD):
        words = (words << np.uint64(9)) | padded[k : k + n + 8].astype(np.uint64)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    x, y = a.copy(), b.copy()
    while len(live):
        inside = (np.maximum(x, y) + _WORD <= n)
        differ = words[x] ^ words[y]
        same = inside & (differ == 0)
        d = differ[~same]
        first = np.full(len(d), _WORD, np.int64)
        for k in range(_WORD - 1, -1, -1):
            field = (d >> np.uint64(9 * (_WORD - 1 - k))) & np.uint64(511)
            first = np.where(field != 0, k, first)
        room = n - np.maximum(x[~same], y[~same])
        out[live[~same]] += np.minimum(first, room)
        live = live[same]
        out[live] += _WORD
        x, y = x[same] + _WORD, y[same] + _WORD
    return out


class RunIndex:
    """Run-compressed transform of ``symbols`` with sampled run ends."""

    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        if n == 0:
            self.heads = self.lengths = self.first_at = self.last_at = self.first_match = self.last_match = np.zeros(0, np.int64)
            return
        order = suffix_array(symbols)
        before = np.where(order > 0, symbols[order - 1].astype(np.int64), -1)
        starts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        ends = np.concatenate([starts[1:], [n]]) - 1
        self.heads, self.lengths = before[starts], ends - starts + 1
        self.first_at, self.last_at = order[starts], order[ends]
        self.first_match = np.zeros(len(starts), np.int64)
        self.last_match = np.zeros(len(starts), np.int64)
        # the run before ends where the next begins: one comparison serves both samples
        between = _common(symbols, order[ends[:-1]], order[starts[1:]])
        self.first_match[1:] = between
        self.last_match[:-1] = between

    @property
    def runs(self) -> int:
        return len(self.heads)

    def _stream(self, at: np.ndarray, match: np.ndarray) -> np.ndarray:
        reach = np.full(self.n, -1, np.int64)
        reach[at] = match + at
        known = np.where(reach >= 0, np.arange(self.n), 0)
        positions = np.arange(self.n)
        return np.maximum(reach[np.maximum.accumulate(known)] - positions, 0)

    def matching_statistics(self) -> np.ndarray:
        """For each position of the text: length of the longest match that starts at another position."""
        if self.n == 0:
            return np.zeros(0, np.int64)
        return np.maximum(self._stream(self.first_at, self.first_match), self._stream(self.last_at, self.last_match))

    def occur(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each of some strings (symbols up to 255, back to back in ``raw``): does it occur in the text?

        All strings are streamed together, last symbol first; one step maps the
        rows that a suffix matches through heads and lengths of the runs. Rows
        inside one run with the right head stay side by side, so that most
        steps look up one run.
        """
        sizes = np.diff(offsets)
        if self.n == 0 or not len(sizes):
            return sizes == 0
        runs = self.runs
        starts = np.cumsum(self.lengths) - self.lengths
        by = np.argsort(self.heads, kind="stable")
        keys = self.heads[by] * runs + by
        # rows whose suffixes begin with lesser symbols, or come from earlier runs of the symbol; the run of -1 is no suffix
        ahead = np.concatenate([[0], np.cumsum(self.lengths[by])]) - 1
        target = np.empty(runs, np.int64)
        target[by] = ahead[:-1]

        def rank(symbol, row):
            run = np.searchsorted(starts, row, "right") - 1
            part = np.where(self.heads[run] == symbol, row - starts[run], 0)
            return ahead[np.searchsorted(keys, symbol * runs + run)] + part

        order = np.argsort(-sizes, kind="stable")
        ends, sizes = offsets[1:][order], sizes[order]
        low, high = np.zeros(len(order), np.int64), np.full(len(order), self.n)
        live = order[:0]
        for step in range(int(sizes[0])):
            count = int(np.searchsorted(-sizes, -step, "left"))
            if step == 0 or count != len(live):
                live = np.arange(count)
            symbol = raw[ends[:count] - 1 - step].astype(np.int64)
            at, to = low[:count], high[:count]
            run = np.searchsorted(starts, np.minimum(at, self.n - 1), "right") - 1
            inside = (self.heads[run] == symbol) & (to <= starts[run] + self.lengths[run])
            new = target[run] + at - starts[run]
            width = to - at
            split = live[~inside & (width > 0)]
            if len(split):
                new[split] = rank(symbol[split], at[split])
                width[split] = rank(symbol[split], to[split]) - new[split]
            low[:count], high[:count] = np.where(width > 0, new, 0), np.where(width > 0, new + width, 0)
        found = np.empty(len(order), bool)
        found[order] = high > low
        return found
