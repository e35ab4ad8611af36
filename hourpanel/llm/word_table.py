"""Ids of words, computed once for each worker and found again by hash, for whole batches of texts at a time.

Words are told apart by two 64-bit hashes (each a sum of random numbers of
their characters times random numbers of the places), in an open-addressed
table of numpy arrays; only a word that is new to the table becomes a string.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from .common import splitmix

LONGEST = 64  # longer words are encoded each time they occur
LIMIT = 1 << 20
BATCH_CHARS = 1 << 20


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def ragged(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches ``values[begin:begin + size]``, end to end."""
    stop = np.cumsum(size)
    return values[np.repeat(begin - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]


class WordTable:
    """``encode(words)`` yields (places in ``words``, ids end to end, numbers of ids) for every word once.

    ``cuts(points, starts)`` gives, for the code points of some texts and where
    these start, the places at which words begin (a text's start among them).
    """

    def __init__(self, encode: Callable, cuts: Callable, limit: int = LIMIT, batch_chars: int = BATCH_CHARS):
        self.encode, self.cuts, self.limit, self.batch_chars = encode, cuts, limit, batch_chars
        self.of_char = splitmix(np.arange(0x110000, dtype=np.uint64))
        self.of_place = splitmix(np.arange(1 << 32, (1 << 32) + 2 * LONGEST, dtype=np.uint64)).reshape(2, -1) | np.uint64(1)
        self.bits = max(4, (2 * limit - 1).bit_length())
        self._clear()

    def _clear(self):
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.count = np.zeros((2, self.limit), np.uint64), 0
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.ends = np.zeros(self.limit + 1, np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each word, or -1."""
        out = np.full(h.shape[1], -1, np.int64)
        todo, at = np.arange(h.shape[1]), (h[0] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            k = self.slot[at]
            held = k >= 0
            todo, at, k = todo[held], at[held], k[held]
            same = (self.keys[0, k] == h[0, todo]) & (self.keys[1, k] == h[1, todo])
            out[todo[same]] = k[same]
            todo, at = todo[~same], (at[~same] + 1) & ((1 << self.bits) - 1)
        return out

    def _insert(self, h: np.ndarray):
        """New, distinct hashes get the next numbers."""
        n = h.shape[1]
        number = np.arange(self.count, self.count + n)
        self.keys[:, number] = h
        todo, at = number, (h[0] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]  # of several for one slot the last stays
            lost = self.slot[at] != todo
            todo, at = todo[lost], at[lost]
            at = np.where(self.slot[at] >= 0, (at + 1) & ((1 << self.bits) - 1), at)
        self.count += n

    def _append(self, ids: np.ndarray, sizes: np.ndarray):
        need = self.used + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
        self.ids[self.used:need] = ids
        at = self.filled
        self.ends[at + 1:at + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used, self.filled = need, at + len(sizes)

    def batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        group, size = [], 0
        for t in texts:
            if group and size + len(t) > self.batch_chars:
                yield from self._group(group)
                group, size = [], 0
            group.append(t)
            size += len(t)
        if group:
            yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(lengths) - lengths
        points = code_points(joined)
        if not len(points):
            yield from (np.zeros(0, np.int32) for _ in texts)
            return
        begin = self.cuts(points, starts[lengths > 0])
        size = np.diff(np.append(begin, len(points)))
        place = np.arange(len(points)) - np.repeat(begin, size)
        place = np.minimum(place, LONGEST - 1, out=place)
        c = self.of_char[points]
        h = np.stack([np.add.reduceat(c * self.of_place[k][place], begin) for k in (0, 1)])
        h[0] += size.astype(np.uint64)
        short = np.flatnonzero(size <= LONGEST)
        known = np.full(len(begin), -1, np.int64)
        known[short] = self._find(h[:, short])
        new = short[known[short] < 0]
        if len(new):
            _, first = np.unique(h[0, new], return_index=True)
            if self.count + len(first) > self.limit:
                self._clear()
                _, first = np.unique(h[0, short], return_index=True)
                first = short[first]
            else:
                first = new[first]
            first = first[:self.limit]
            words = [joined[b:b + n] for b, n in zip(begin[first].tolist(), size[first].tolist())]
            self.filled = self.count
            order = []
            for places, ids, sizes in self.encode(words):
                order.append(np.asarray(places))
                self._append(ids, sizes)
            self._insert(h[:, first[np.concatenate(order)]])
            known[short] = self._find(h[:, short])
        ids, begins, sizes = self.ids, self.ends[known], self.ends[known + 1] - self.ends[known]
        rest = np.flatnonzero(known < 0)  # long words, and what the table has no room for
        if len(rest):
            words = [joined[b:b + n] for b, n in zip(begin[rest].tolist(), size[rest].tolist())]
            more, at = [ids], len(ids)
            for places, got, n in self.encode(words):
                where = rest[np.asarray(places)]
                begins[where], sizes[where] = at + np.cumsum(n) - n, n
                more.append(got.astype(np.int32))
                at += len(got)
            ids = np.concatenate(more)
        flat = ragged(ids, begins, sizes)
        stops = np.concatenate([[0], np.cumsum(sizes)])
        bounds = stops[np.searchsorted(begin, np.append(starts, len(points)))]
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield flat[a:z]
