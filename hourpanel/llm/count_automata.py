"""Weighted acyclic automata over words: counts of phrases of up to three words.

An automaton reads a phrase word by word; the weight of the state it ends in
is the phrase's count.  Words are numbered in the order of their UTF-8 bytes,
so arcs in the order of their numbers spell phrases in sorted order.  States
after two words with the same arcs and weights are one state (``Register``),
found while sorted phrases are read block by block: a state is closed once
the next prefix begins.

``Counts`` holds phrases as sorted arrays, which automata are built from and
listed into; ``union`` sums weights; ``compose`` intersects an automaton of
asked phrases with one of counts.
"""

from __future__ import annotations

import numpy as np
import zstandard

from .word_table import ragged

BLOCK = 1 << 16


def starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


class Counts:
    """Sorted phrases and their counts.

    words: in byte order; one: count of each word (0: not a phrase here).
    pair: first * len(words) + second, ascending; two: counts.
    triple: (place in pair) * len(words) + third, ascending; three: counts.
    """

    def __init__(self, words: list[bytes], one, pair, two, triple, three):
        self.words, self.one, self.pair, self.two, self.triple, self.three = words, one, pair, two, triple, three

    @classmethod
    def of_words(cls, words: list[bytes], ids: np.ndarray, linked: np.ndarray) -> Counts:
        """Of running words; ``linked[i]``: does word i + 1 follow word i in its piece?"""
        order = sorted(range(len(words)), key=words.__getitem__)
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(len(words))
        ids, n = number[ids], len(words)
        at = np.flatnonzero(linked[:-1]) if len(ids) else np.zeros(0, np.int64)
        pair, where, two = np.unique(ids[at] * n + ids[at + 1], return_inverse=True, return_counts=True)
        follows = np.flatnonzero(np.diff(at) == 1)  # pairs whose second word begins a pair too
        triple, three = np.unique(where[follows] * n + ids[at[follows] + 2], return_counts=True)
        return cls([words[i] for i in order], np.bincount(ids, minlength=n).astype(np.int64), pair, two.astype(np.int64), triple, three.astype(np.int64))

    def __len__(self):
        return int(np.count_nonzero(self.one)) + len(self.pair) + len(self.triple)

    def part(self, pairs: slice, firsts: slice) -> Counts:
        """The phrases of some pairs, and the single words ``firsts``, with only the words they use."""
        n = max(1, len(self.words))
        a, z = pairs.start, pairs.stop
        t = slice(*np.searchsorted(self.triple, [a * n, z * n]))
        pair, triple = self.pair[a:z], self.triple[t]
        used = np.zeros(len(self.words), bool)
        used[pair // n] = used[pair % n] = used[triple % n] = True
        used[firsts] |= self.one[firsts] > 0
        number = np.cumsum(used) - 1
        m = int(used.sum())
        one = np.zeros(len(self.words), np.int64)
        one[firsts] = self.one[firsts]
        return Counts([self.words[i] for i in np.flatnonzero(used).tolist()], one[used], number[pair // n] * m + number[pair % n],
                      self.two[a:z], (triple // n - a) * m + number[triple % n], self.three[t])

    def least(self, count: int) -> Counts:
        """Only the phrases with at least ``count``; a frequent phrase's beginnings are frequent."""
        n = max(1, len(self.words))
        two, three = self.two >= count, self.three >= count
        place = np.cumsum(two) - 1
        kept = Counts(self.words, np.where(self.one >= count, self.one, 0), self.pair[two], self.two[two],
                      place[self.triple[three] // n] * n + self.triple[three] % n, self.three[three])
        return kept.part(slice(0, len(kept.pair)), slice(0, len(self.words)))


class Register:
    """States by their arcs: equal ones get one number.  State 0 has no arcs."""

    def __init__(self):
        self.single: dict[int, int] = {}
        self.other: dict[bytes, int] = {}
        self.size, self.label, self.weight = [np.zeros(1, np.int64)], [], []
        self.count = 1

    def states(self, size: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """A number for each state of a block, given its arcs end to end."""
        out = np.zeros(len(size), np.int64)
        begin = starts(size)
        alone = np.flatnonzero(size == 1)
        if len(alone):
            arcs, first, of = np.unique(label[begin[alone]] << 32 | np.minimum(weight[begin[alone]], 2**32 - 1), return_index=True, return_inverse=True)
            many = weight[begin[alone]] >= 2**32 - 1  # too heavy for the key: below
            numbers, new = np.empty(len(arcs), np.int64), []
            for k, arc in enumerate(arcs.tolist()):
                got = self.single.get(arc)
                if got is None:
                    got = self.single[arc] = self.count
                    self.count += 1
                    new.append(alone[first[k]])
                numbers[k] = got
            self._add(new, begin, size, label, weight)
            out[alone] = numbers[of]
            rest = np.concatenate([np.flatnonzero(size > 1), alone[many]])
        else:
            rest = np.flatnonzero(size > 1)
        raw = np.stack([label, weight], 1).tobytes() if len(rest) else b""
        new = []
        for i in rest.tolist():
            arcs = raw[16 * begin[i]:16 * (begin[i] + size[i])]
            got = self.other.get(arcs)
            if got is None:
                got = self.other[arcs] = self.count
                self.count += 1
                new.append(i)
            out[i] = got
        self._add(new, begin, size, label, weight)
        return out

    def _add(self, new: list[int], begin, size, label, weight):
        new = np.array(new, np.int64)
        self.size.append(size[new])
        self.label.append(ragged(label, begin[new], size[new]))
        self.weight.append(ragged(weight, begin[new], size[new]))


class Automaton:
    """words; one: weights after one word; fan: number of arcs of each word's state; second, two, state: those arcs'
    words, weights and targets; size, third, three: the shared states' arcs."""

    FIELDS = ("one", "fan", "second", "two", "state", "size", "third", "three")

    def __init__(self, words: list[bytes], **arrays):
        self.words = words
        for k in self.FIELDS:
            setattr(self, k, arrays[k])

    @classmethod
    def of(cls, c: Counts, block: int = BLOCK) -> Automaton:
        n = max(1, len(c.words))
        register, state = Register(), []
        for a in range(0, len(c.pair), block):
            z = min(a + block, len(c.pair))
            t = slice(*np.searchsorted(c.triple, [a * n, z * n]))
            size = np.bincount(c.triple[t] // n - a, minlength=z - a)
            state.append(register.states(size, c.triple[t] % n, c.three[t]))
        none = [np.zeros(0, np.int64)]
        return cls(c.words, one=c.one, fan=np.bincount(c.pair // n, minlength=len(c.words)), second=c.pair % n, two=c.two, state=np.concatenate(none + state),
                   size=np.concatenate(register.size), third=np.concatenate(none + register.label), three=np.concatenate(none + register.weight))

    def counts(self) -> Counts:
        """All phrases, in order."""
        n = max(1, len(self.words))
        first = np.repeat(np.arange(len(self.fan)), self.fan)
        size, begin = self.size[self.state], starts(self.size)[self.state]
        place = np.repeat(np.arange(len(self.state)), size)
        return Counts(self.words, self.one, first * n + self.second, self.two, place * n + ragged(self.third, begin, size), ragged(self.three, begin, size))

    def dump(self) -> bytes:
        """Arrays in the least width that holds them, byte by byte of the places of a number, then compressed."""
        parts = [b" ".join(self.words)]
        sizes = [len(self.words), len(parts[0])]
        for k in self.FIELDS:
            x = getattr(self, k)
            width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or x.max() < 1 << 8 * w)
            parts.append(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
            sizes += [len(x), width]
        return zstandard.ZstdCompressor(level=1).compress(np.array(sizes, "<u8").tobytes() + b"".join(parts))

    @classmethod
    def load(cls, blob: bytes) -> Automaton:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        head = np.frombuffer(raw, "<u8", 2 + 2 * len(cls.FIELDS)).tolist()
        at = 8 * len(head)
        words = raw[at:at + head[1]].split(b" ") if head[0] else []
        at += head[1]
        arrays = {}
        for k, n, width in zip(cls.FIELDS, head[2::2], head[3::2]):
            x = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
            arrays[k] = np.ascontiguousarray(x.T).view(f"<u{width}").ravel().astype(np.int64)
            at += n * width
        return cls(words, **arrays)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of their counts, and the place of each key given."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return key, count, key
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    return key[first], np.add.reduceat(count[order], first), place


def union(parts: list[Counts]) -> Counts:
    """All phrases of the parts, with the sums of their weights."""
    if len(parts) == 1:
        return parts[0]
    words = sorted(set().union(*[c.words for c in parts]))
    n = len(words)
    number = dict(zip(words, range(n)))
    one = np.zeros(n, np.int64)
    maps, pairs = [], []
    for c in parts:
        to = np.fromiter(map(number.__getitem__, c.words), np.int64, len(c.words))
        one[to] += c.one
        own = max(1, len(c.words))
        maps.append(to)
        pairs.append(to[c.pair // own] * n + to[c.pair % own])
    pair, two, place = _summed(pairs, [c.two for c in parts])
    triples, at = [], 0
    for c, to in zip(parts, maps):
        own = max(1, len(c.words))
        triples.append(place[at:at + len(c.pair)][c.triple // own] * n + to[c.triple % own])
        at += len(c.pair)
    triple, three, _ = _summed(triples, [c.three for c in parts])
    return Counts(words, one, pair, two, triple, three)


def asked(phrases: list[bytes]) -> tuple[Automaton, np.ndarray]:
    """The automaton of some phrases of one or two words, each weighing its number of times, and each one's place in it.

    A place is a word's number, or the number of words plus that of a pair.
    """
    split = [p.split(b" ") for p in phrases]
    words = sorted({w for p in split for w in p})
    number = dict(zip(words, range(len(words))))
    n = len(words)
    first = np.fromiter((number[p[0]] for p in split), np.int64, len(split))
    second = np.fromiter((number[p[1]] if len(p) > 1 else -1 for p in split), np.int64, len(split))
    lone = second < 0
    pair, where, two = np.unique(first[~lone] * n + second[~lone], return_inverse=True, return_counts=True)
    place = first.copy()
    place[~lone] = n + where
    none = np.zeros(0, np.int64)
    return Automaton.of(Counts(words, np.bincount(first[lone], minlength=n), pair, two, none, none)), place


def compose(question: Automaton, counts: Automaton) -> np.ndarray:
    """The weight in ``counts`` of each phrase of ``question`` (places as ``asked`` has them); 0 if it has none.

    Both automata are walked together, an arc of all states at a time.
    """
    number = dict(zip(counts.words, range(len(counts.words))))
    to = np.fromiter((number.get(w, -1) for w in question.words), np.int64, len(question.words))
    one = np.where(to >= 0, counts.one[to] if len(counts.one) else 0, 0)
    first = np.repeat(to, question.fan)
    second = to[question.second]
    n = max(1, len(counts.words))
    arcs = np.repeat(np.arange(len(counts.fan)), counts.fan) * n + counts.second
    key = first * n + second
    if not len(arcs):
        return np.concatenate([one, np.zeros(len(key), np.int64)])
    at = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
    return np.concatenate([one, np.where((first >= 0) & (second >= 0) & (arcs[at] == key), counts.two[at], 0)])
