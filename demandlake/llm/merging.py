"""Greedy pair merging of many symbol strings at once.

A merge-type vocabulary merges, again and again, the best adjacent pair of a
string (the lowest place; on ties the leftmost) until no pair is left.  Here
the agendas of all strings of one length form a matrix with a column per
adjacent pair.  One round takes the best column of every row and merges it,
after which each row is one symbol shorter and joins the rows that had that
length from the start.  So the whole set takes as many rounds as its longest
string has symbols.  Strings over ``LONG`` symbols use a heap instead.
"""

from __future__ import annotations

import heapq

import numpy as np

LONG = 64
NEVER = np.int32(2 ** 31 - 1)
_FREE = np.uint64(2 ** 64 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left symbol, right symbol) -> (place, merged symbol), held in an open
    hash table that is looked up for whole arrays."""

    def __init__(self, left, right, place, merged):
        keys = np.asarray(left, np.uint64) << np.uint64(32) | np.asarray(right, np.uint64)
        bits = max(4, int(4 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._keys = np.full((1 << bits) + 1, _FREE, np.uint64)
        self.place = np.full((1 << bits) + 1, NEVER, np.int32)    # the last slot stands for "no such pair"
        self.merged = np.full((1 << bits) + 1, -1, np.int32)
        self.none = np.int32(1 << bits)
        slot, left_over = self._home(keys), np.arange(len(keys))
        while len(left_over):
            free = self._keys[slot] == _FREE
            first = np.zeros(len(slot), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            at, who = slot[put], left_over[put]
            self._keys[at] = keys[who]
            self.place[at] = np.asarray(place, np.int32)[who]
            self.merged[at] = np.asarray(merged, np.int32)[who]
            slot, left_over = (slot[~put] + 1) & self._mask, left_over[~put]
        self._dict: dict[int, tuple[int, int]] | None = None

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _SPREAD >> self._shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs (``none`` where a pair cannot be merged)."""
        keys = (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)).ravel()
        slot = self._home(keys)
        held = self._keys[slot]
        out = np.where(held == keys, slot, self.none).astype(np.int32)
        open_ = np.flatnonzero((held != keys) & (held != _FREE))
        while len(open_):
            slot_open = (slot[open_] + 1) & self._mask
            slot[open_] = slot_open
            held = self._keys[slot_open]
            hit = held == keys[open_]
            out[open_[hit]] = slot_open[hit]
            open_ = open_[~hit & (held != _FREE)]
        return out.reshape(left.shape)

    def pairs(self) -> dict[int, tuple[int, int]]:
        if self._dict is None:
            used = np.flatnonzero(self._keys[:-1] != _FREE)
            self._dict = dict(zip(self._keys[used].tolist(), zip(self.place[used].tolist(), self.merged[used].tolist())))
        return self._dict

    def merge_one(self, symbols: list[int]) -> list[int]:
        """One string of any length, by a heap over its pairs."""
        find = self.pairs().get
        symbol: list[int | None] = list(symbols)
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r[0], i, i + 1, symbol[i], symbol[i + 1], r[1]) for i in range(n - 1)
                  if (r := find(symbol[i] << 32 | symbol[i + 1]))]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, a, b, both = heapq.heappop(agenda)
            if symbol[left] != a or after[left] != right or symbol[right] != b:
                continue  # one of the two has been merged since
            symbol[left], symbol[right] = both, None
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                if r := find(both << 32 | symbol[nxt]):
                    heapq.heappush(agenda, (r[0], left, nxt, both, symbol[nxt], r[1]))
            prev = before[left]
            if prev >= 0 and (r := find(symbol[prev] << 32 | both)):
                heapq.heappush(agenda, (r[0], prev, left, symbol[prev], both, r[1]))
        return [s for s in symbol if s is not None]

    def merge_rows(self, rows: np.ndarray, who: np.ndarray, slots: np.ndarray):
        """One round for rows of one length: (finished numbers and rows, the
        numbers, rows and slots that go on)."""
        place = self.place[slots]
        at = place.argmin(1)
        line = np.arange(len(rows))
        going = place[line, at] != NEVER
        done = (who[~going], rows[~going])
        rows, who, slots, at = rows[going], who[going], slots[going], at[going]
        m, n = rows.shape
        line = np.arange(m)
        rows[line, at] = self.merged[slots[line, at]]
        keep = np.ones((m, n), bool)
        keep[line, at + 1] = False
        rows = rows[keep].reshape(m, n - 1)
        keep = np.ones((m, n - 1), bool)
        keep[line, at] = False
        slots = slots[keep].reshape(m, n - 2)
        has = at > 0
        slots[line[has], at[has] - 1] = self.find(rows[line[has], at[has] - 1], rows[line[has], at[has]])
        has = at < n - 2
        slots[line[has], at[has]] = self.find(rows[line[has], at[has]], rows[line[has], at[has] + 1])
        return done, who, rows, slots

    def merge_all(self, symbols: np.ndarray, lengths: np.ndarray):
        """Strings laid end to end in ``symbols``: yields (numbers of the
        strings, matrix of their symbols once nothing more can be merged)."""
        symbols, lengths = np.asarray(symbols, np.int32), np.asarray(lengths, np.int64)
        starts = np.cumsum(lengths) - lengths
        for i in np.flatnonzero(lengths > LONG).tolist():
            out = self.merge_one(symbols[starts[i]:starts[i] + lengths[i]].tolist())
            yield np.array([i]), np.array([out], np.int32)
        order = np.argsort(lengths, kind="stable")
        cut = np.searchsorted(lengths[order], np.arange(LONG + 2))
        who, rows, slots = np.zeros(0, np.int64), np.zeros((0, LONG + 1), np.int32), np.zeros((0, LONG), np.int32)
        for n in range(LONG, 0, -1):
            rows, slots = (rows, slots) if len(rows) else (np.zeros((0, n), np.int32), np.zeros((0, max(n - 1, 0)), np.int32))
            own = order[cut[n]:cut[n + 1]]
            if len(own):
                new = symbols[starts[own][:, None] + np.arange(n)]
                who, rows = np.concatenate([who, own]), np.concatenate([rows, new])
                slots = np.concatenate([slots, self.find(new[:, :-1], new[:, 1:])])
            if not len(who):
                continue
            if n == 1:
                yield who, rows
                return
            (numbers, finished), who, rows, slots = self.merge_rows(rows, who, slots)
            if len(numbers):
                yield numbers, finished


def packed_rows(numbers: np.ndarray, rows: np.ndarray):
    """(number, little-endian unsigned 32-bit ids) of each row."""
    width = rows.shape[1] * 4
    data = np.ascontiguousarray(rows, "<u4").tobytes()
    return zip(numbers.tolist(), [data[i:i + width] for i in range(0, len(data), width)])
