"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text gets the dummy prefix, blanks become the mark ``▁``, and it is cut into
words before every run of marks; no piece of the vocabulary reaches over such a
place, which loading checks.  Words of equal length advance together: at each
place the hashes of the substrings that end there probe the sorted hashes of
the pieces, and the best-scoring piece is a maximum over a matrix, whose
argument is the backpointer.  Of equal scores the longest last piece is taken.
A character that no piece covers costs the unknown score and comes out as its
UTF-8 bytes.

The ids are those of the highest sum of piece scores, which is what the
library computes for a unigram model with the same pieces and scores.  For a
model trained as BPE (``SentencePieces.merges`` tells) the scores are ranks of
merges, and the library applies the merges instead: its ids are others, as a
rule fewer, and decode to the same text.  A word
is encoded once for each worker and looked up after that, in a cache of
``CACHE_WORDS`` words.

Defined cases: a null text gives null ids, an empty one no ids; a literal mark
is taken for a blank; texts of any length and words of any length are encoded
whole; ids that are no UTF-8 when decoded give U+FFFD; rows that repeat are
each returned; an empty table gives an empty result; other columns pass
through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, small_batches
from .word_table import WordTable, code_points

MARK = "▁"
CACHE_WORDS = 1 << 20
CELLS = 1 << 16  # characters whose substrings are looked up at once
BATCH_CHARS = 1 << 18  # characters whose words are looked up at once
UNKNOWN_PENALTY = 10.0
BASE = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20


class SentencePieces:
    """Pieces and scores of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if not model.trainer_spec.byte_fallback or model.normalizer_spec.name != "identity" or not model.normalizer_spec.add_dummy_prefix:
            raise ValueError("the model must have byte fallback, no normalisation and a dummy prefix")
        self.merges = model.trainer_spec.model_type == pb.TrainerSpec.BPE  # the library's ids then aren't those of the best sum
        kind = pb.ModelProto.SentencePiece
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == kind.NORMAL]
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces) or any(MARK in p.lstrip(MARK) for _, p, _ in normal):
            raise ValueError("user-defined or unused pieces, or pieces that reach over blanks")
        self.byte_ids = np.zeros(256, np.int32)
        self.surface = []  # of each id, when decoded
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.surface.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.surface.append(b"" if p.type == kind.CONTROL else " ⁇ ".encode() if p.type == kind.UNKNOWN
                                    else p.piece.replace(MARK, " ").encode())
        self.unknown = min(s for _, _, s in normal) - UNKNOWN_PENALTY
        self.longest = max(len(p) for _, p, _ in normal)
        chars = np.zeros((len(normal), self.longest), np.uint32)
        sizes = np.array([len(p) for _, p, _ in normal])
        for r, (_, p, _) in enumerate(normal):
            chars[r, :len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
        keys = np.zeros(len(normal), np.uint64)
        for n in range(1, self.longest + 1):
            h = np.zeros((sizes == n).sum(), np.uint64)
            with np.errstate(over="ignore"):
                for j in range(n):
                    h = h * BASE + chars[sizes == n, j].astype(np.uint64) + np.uint64(1)
            keys[sizes == n] = self._key(h, n)
        order = np.argsort(keys)
        self.keys, self.chars, self.sizes = keys[order], chars[order], sizes[order]
        self.ids = np.array([i for i, _, _ in normal], np.int32)[order]
        self.scores = np.array([s for _, _, s in normal])[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    @staticmethod
    def _key(h: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (h ^ np.uint64(n * 0x5851F42D4C957F2D & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            return (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)

    def _matches(self, points: np.ndarray, place: np.ndarray) -> np.ndarray:
        """By place and length - 1: the piece (its number in key order) that ends there, or -1.

        ``place`` is each character's number in its word; no substring starts before its word.
        """
        out = np.full((len(points), self.longest), -1, np.int32)
        at, h = np.arange(len(points)), np.zeros(len(points), np.uint64)
        char = points.astype(np.uint64) + np.uint64(1)
        for n in range(1, self.longest + 1):
            with np.errstate(over="ignore"):
                h[at] = (h[at - 1] * BASE if n > 1 else 0) + char[at]  # the substring one shorter that ends one earlier
            key = self._key(h[at], n)
            maybe = np.flatnonzero(self.filter[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
            good = (self.keys[k] == key[maybe]) & (self.sizes[k] == n)
            maybe, k = at[maybe[good]], k[good]
            same = (self.chars[k, :n] == points[maybe[:, None] + np.arange(1 - n, 1)]).all(1)  # a hash isn't proof
            out[maybe[same], n - 1] = k[same]
            at = at[place[at] >= n]
        return out

    def viterbi(self, chars: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, end to end, of words of equal length, and each word's number of ids.

        A row of code points, and of the pieces that end at each place, for each word.
        """
        rows, length = chars.shape
        best = np.zeros((rows, length + 1))
        back = np.zeros((rows, length + 1), np.int32)  # number of the last piece, or -1
        every = np.arange(rows)
        for end in range(1, length + 1):
            n = min(self.longest, end)
            at = found[:, end - 1, :n][:, ::-1]  # the longest first: the first maximum is taken
            value = np.where(at >= 0, self.scores[at], -np.inf) + best[:, end - n:end]
            lone = at[:, -1] < 0
            value[lone, -1] = best[lone, end - 1] + self.unknown
            top = value.argmax(1)
            best[:, end] = value[every, top]
            back[:, end] = at[every, top]
        place, todo, steps = np.full(rows, length), np.arange(rows), []
        while len(todo):  # backwards, all words a piece at a time
            at = back[todo, place[todo]]
            steps.append((todo, at, chars[todo, place[todo] - 1]))
            place[todo] -= np.where(at >= 0, self.sizes[at], 1)
            todo = todo[place[todo] > 0]
        row, at, char = (np.concatenate(x) for x in zip(*steps[::-1]))
        order = np.argsort(row, kind="stable")
        row, at, char = row[order], at[order], char[order]
        lone = np.flatnonzero(at < 0)
        if not len(lone):
            return self.ids[at], np.bincount(row, minlength=rows)
        spelled = {i: self.byte_ids[list(chr(char[i]).encode("utf-8", "surrogatepass"))] for i in lone.tolist()}
        size = np.ones(len(at), np.int64)
        size[lone] = [len(x) for x in spelled.values()]
        flat = np.repeat(self.ids[at], size)
        for i, stop in zip(lone.tolist(), np.cumsum(size)[lone].tolist()):
            flat[stop - size[i]:stop] = spelled[i]
        return flat, np.bincount(row, size, rows).astype(np.int64)

    def encode_words(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in ``words``, ids end to end, numbers of ids), words of one length at a time."""
        sizes = np.array([len(w) for w in words], np.int64)
        parts = np.split(np.arange(len(words)), np.flatnonzero(np.diff(np.cumsum(sizes) // CELLS)) + 1)
        for part in parts:
            points = code_points("".join([words[i] for i in part.tolist()]))
            size = sizes[part]
            begin = np.cumsum(size) - size
            found = self._matches(points, np.arange(len(points)) - np.repeat(begin, size))
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                cells = begin[rows, None] + np.arange(n)
                yield part[rows], *self.viterbi(points[cells], found[cells])

    def decode(self, ids) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(" ")


def word_starts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where a run of marks begins, and where a text does."""
    mark = points == ord(MARK)
    begin = mark.copy()
    begin[1:] &= ~mark[:-1]
    begin[starts] = True
    return np.flatnonzero(begin)


class Encoder:
    """Encodes texts, looking up the words met before."""

    def __init__(self, pieces: SentencePieces, cache_words: int = CACHE_WORDS):
        self.pieces, self.known = pieces, WordTable(pieces.encode_words, word_starts, cache_words, BATCH_CHARS)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        return list(self.known.batch([MARK + t.replace(" ", MARK) if t else "" for t in texts]))


_PIECES: dict[str, SentencePieces] = {}
_LOADED: dict[str, Encoder] = {}


def pieces_of(path: str) -> SentencePieces:
    """One for each worker process."""
    if path not in _PIECES:
        _PIECES[path] = SentencePieces(path)
    return _PIECES[path]


def encoder(path: str) -> Encoder:
    """One for each worker process that encodes."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(pieces_of(path))
    return _LOADED[path]


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, len(batch), rows))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with ``text_col`` replaced by ``out_col``, an array of ids (as is a column of that name, in either case)."""
    keep = [c for c in docs.columns if c.lower() not in (text_col.lower(), out_col.lower())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for b in (s for x in batches for s in _slices(x)):
            texts = b[text_col].to_pylist()
            got = enc.encode_batch([t or "" for t in texts])
            sizes = [None if t is None else len(g) for t, g in zip(texts, got)]
            stops = np.cumsum([0, *[n or 0 for n in sizes]])
            ids = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *got])),
                                           mask=pa.array([n is None for n in sizes]))
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], ids], [*keep, out_col])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], f"`{out_col}` array<int>"])
    return small_batches(ship(docs.select(*keep, docs[text_col].cast("string").alias(text_col)))).mapInArrow(run, schema)


def decode(coded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``coded`` with ``ids_col`` replaced by ``out_col``, the text (as is a column of that name, in either case)."""
    keep = [c for c in coded.columns if c.lower() not in (ids_col.lower(), out_col.lower())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_path)
        for b in (s for x in batches for s in _slices(x)):
            ids = b[ids_col].flatten().to_numpy(zero_copy_only=False)
            stops = np.cumsum(b[ids_col].value_lengths().fill_null(0).to_numpy()).tolist()
            texts = [pieces.decode(ids[a:z].tolist()) if there else None  # a text's ids as Python numbers, not a batch's
                     for a, z, there in zip([0, *stops], stops, b[ids_col].is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(texts, pa.string())], [*keep, out_col])

    schema = ", ".join([*[f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in keep], f"`{out_col}` string"])
    return small_batches(ship(coded.select(*keep, ids_col))).mapInArrow(run, schema)
