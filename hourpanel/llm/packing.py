"""Hierarchical packing of tokenised documents into sequences of several lengths.

A document's ids, with the closing id, are cut: whole windows of the longest
tier go out at once, and the rest is routed to the smallest tier (a power of
two) that holds it.  From the longest tier down, each window takes the rest it
was opened for, fills its gap with the longest rests of shorter tiers that fit
whole, and at last with a cut from a short one, whose remainder is routed
anew.  So every window is full, and none needs padding.  What is left when a
task ends, less than a window, is cut to powers of two; only a remainder
below the shortest tier is padded.

A task packs the rows it reads, holding ``POOL`` rests at a time: no shuffle,
and memory that doesn't grow.  The windows packed from a pool are dealt to step
groups of ``STEP_TOKENS`` tokens so that every group gets a like share of the
attention cost (the sum of squared piece lengths).

Defined cases: a null or empty text is the closing id alone; ids of documents
may be null or repeat (each row is packed); texts of any length are cut;
an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import ship
from .word_table import WordTable

TIERS = (128, 256, 512, 1024)
POOL = 2048
STEP_TOKENS = 1 << 16
CACHE_WORDS = 1 << 20


class WordTokenizer:
    """Ids of texts by a byte-level BPE file of the ``tokenizers`` library, with known words looked up.

    No token of such a vocabulary's pre-tokenizer reaches over the place
    between a character that isn't white space and the blank after it, so a
    text is cut there into words that start with the blank.  Texts that hold a
    special token's string go through the library whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.white = np.fromiter((chr(c).isspace() for c in range(0x110000)), bool, 0x110000)
        self.known = WordTable(self._encode_words, self._word_starts, cache_words)

    def _encode_words(self, words: list[str]):
        got = [x.ids for x in self.lib.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        yield range(len(words)), np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum())), sizes

    def _word_starts(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        begin = points == 0x20
        begin[1:] &= ~self.white[points[:-1]]
        begin[starts] = True
        return np.flatnonzero(begin)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        odd = set(whole)
        out = list(self.known.batch(["" if i in odd else t for i, t in enumerate(texts)]))
        for i in whole:
            out[i] = np.array(self.lib.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return out


class Packer:
    """Packs the documents of one task; ``take`` and ``finish`` return finished windows.

    A piece is (document row, start, length); a window is (size, pieces).
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, pool: int = POOL):
        if any(t & (t - 1) for t in tiers):
            raise ValueError("tiers are powers of two")
        self.tiers, self.pool = tuple(sorted(tiers)), pool
        self.rest: list[tuple[int, int, int]] = []  # (length, document row, start), ascending

    def take(self, doc: int, n: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
        top = self.tiers[-1]
        out = [(top, [(doc, s, top)]) for s in range(0, n - top + 1, top)]
        if n % top:
            insort(self.rest, (n % top, doc, n - n % top))
        if len(self.rest) > self.pool:
            out += self._pack(self.pool // 2)
        return out

    def _largest(self, most: int) -> int:
        """Place of the longest rest of at most ``most`` ids, or -1."""
        return bisect_right(self.rest, (most + 1,)) - 1

    def _pack(self, leave: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
        out = []
        while len(self.rest) > leave:
            length, doc, start = self.rest[-1]
            size = next(t for t in self.tiers if t >= length)
            if len(self.rest) < size and sum(x[0] for x in self.rest) < size:
                break  # less than a window is left
            self.rest.pop()
            pieces, gap = [(doc, start, length)], size - length
            while gap:
                at = self._largest(gap)
                if at >= 0:  # a whole rest of a shorter tier
                    n, d, s = self.rest.pop(at)
                    pieces.append((d, s, n))
                    gap -= n
                else:  # every rest is longer than the gap: cut the shortest, route its remainder anew
                    n, d, s = self.rest.pop(0)
                    pieces.append((d, s, gap))
                    insort(self.rest, (n - gap, d, s + gap))
                    gap = 0
            out.append((size, pieces))
        return out

    def finish(self) -> list[tuple[int, list[tuple[int, int, int]]]]:
        out = self._pack(0)
        left = sum(x[0] for x in self.rest)
        sizes = []
        while left >= self.tiers[0]:
            sizes.append(1 << (left.bit_length() - 1))
            left -= sizes[-1]
        if left:
            sizes.append(left)
        for size in sizes:
            pieces, gap = [], size
            while gap:
                n, d, s = self.rest.pop()
                used = min(n, gap)
                pieces.append((d, s, used))
                if n > used:
                    self.rest.append((n - used, d, s + used))
                gap -= used
            out.append((size, pieces))
        return out


def deal(windows: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step group for each window: about ``step_tokens`` tokens each, attention cost alike.

    Windows are sorted by cost and dealt there and back over the groups.
    """
    groups = max(1, round(sum(w[0] for w in windows) / step_tokens))
    order = sorted(range(len(windows)), key=lambda i: -sum(p[2] * p[2] for p in windows[i][1]))
    out = [0] * len(windows)
    for k, i in enumerate(order):
        turn, place = divmod(k, groups)
        out[i] = place if turn % 2 == 0 else groups - 1 - place
    return out


PIECE = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_id long")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS,
         closing_id: int = 0) -> DataFrame:
    """One row for each piece: its document, place there and in its sequence, CRC-32 of its ids, tier and step group.

    ``sequence_id`` and ``step_id`` have the task's number in their upper bits.
    """
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = _tokenizer(tokenizer_path), Packer(tiers)
        task = TaskContext.get().partitionId() << 40
        named: dict[int, list] = {}  # document row: its id, number of ids, ids after its whole windows, how many are not out
        heads: dict[tuple[int, int], int] = {}  # checksums of whole windows, whose ids aren't kept
        windows: list = []
        sequence = step = row = 0

        def flush():
            nonlocal sequence, step, windows
            groups = deal(windows)
            cols: list[list] = [[] for _ in range(9)]
            for (size, pieces), g in zip(windows, groups):
                offset = 0
                for d, start, n in pieces:
                    doc = named[d]
                    crc = heads.pop((d, start), None)
                    if crc is None:
                        at = start - (doc[1] - len(doc[2]))
                        crc = _crc(doc[2][at:at + n])
                        doc[3] -= n
                    for c, v in zip(cols, (doc[0], start, n, crc, doc[1], task | sequence, offset,
                                           size if size & (size - 1) == 0 else packer.tiers[-1], task | (step + g))):
                        c.append(v)
                    offset += n
                    if not doc[3] and (d, start + n) not in heads:
                        del named[d]
                sequence += 1
            step += max(groups, default=-1) + 1
            windows = []
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:]]], names)

        names = ["id", *[c.split()[0] for c in PIECE.split(", ")]]
        for b in batches:
            id_type = b.schema.field("id").type
            for key, ids in _encoded(b, words, closing_id):
                top, n = packer.tiers[-1], len(ids)
                heads.update({(row, s): _crc(ids[s:s + top]) for s in range(0, n - top + 1, top)})
                tail = ids[n - n % top:].copy()
                named[row] = [key, n, tail, len(tail)]
                windows += packer.take(row, n)
                row += 1
                if len(windows) >= POOL:
                    yield flush()
        if row:
            windows += packer.finish()
            yield flush()

    schema = f"id {slim.schema['id'].dataType.simpleString()}, {PIECE}"
    return ship(slim).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _encoded(batch: pa.RecordBatch, words: WordTokenizer, closing_id: int, rows: int = 256) -> Iterator[tuple]:
    """(id, ids with the closing one) of each row, some rows at a time."""
    for at in range(0, len(batch), rows):
        part = batch.slice(at, rows)
        for key, ids in zip(part["id"].to_pylist(), words.encode_batch([t or "" for t in part["text"].to_pylist()])):
            yield key, np.append(ids, np.int32(closing_id))


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_LOADED: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process, with the words it has met."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
