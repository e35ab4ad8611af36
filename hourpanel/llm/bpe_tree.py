"""Byte-level BPE by tree concatenation.

A text is cut at its special tokens and, by the file's own pre-tokenizer, into
words.  A word of up to ``LEAF`` bytes is a leaf: the leaves of a batch are
merged in step, each by its own best pair.  A longer word without a split is
halved until its parts are leaves; then, level by level, neighbouring halves
are joined, all joins of a level at once: a window of the last ids on the left
and the first ids on the right is encoded anew from its bytes, and doubled
until its first id is the left half's and its last id the right half's at
those places (or the window holds the whole half).

Why that is exact: a merge's rank is above the ranks of the merges that made
its parts, and each id is made by one merge (both checked on loading).  Then
ids are the encoding of their bytes if, and only if, each two neighbours are
the encoding of theirs; a crossing merge would already show in the first pair
it crosses.  Inside a half and inside the window neighbours agree because each
is an encoding, and at the window's ends because the ids there are the half's.

Words of up to 64 characters are met once for each worker (``WordTable``).
A text is one row and is encoded within its task; memory grows with the
longest text only.

Defined cases: a null text has null ids, null ids a null text; an empty text
has no ids; a special token's string in a text is that token; ids that the
file doesn't know, and null ones, are left out on decoding, and bytes that are
no UTF-8 become U+FFFD, as in the library; rows may repeat; an empty table
gives an empty result; other columns pass through, but one that has the new
column's name (in either case) is replaced by it, as ``withColumn`` does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship, small_batches
from .word_table import WordTable, code_points, ragged

LEAF = 64
FIRST_WINDOW = 2
CACHE_WORDS = 1 << 19
NEVER = np.int32(2**31 - 1)


def byte_alphabet() -> np.ndarray:
    """The code point that stands for each byte: its own if it is printable Latin-1, else the next one from 256 on."""
    own = np.zeros(256, bool)
    for first, last in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)):
        own[first:last + 1] = True
    out = np.arange(256)
    out[~own] = 256 + np.arange((~own).sum())
    return out


def _starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


class Merges:
    """The merges of a byte-level BPE file, as sorted arrays, and the encoding of bytes by them."""

    def __init__(self, spec: dict):
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        wanted = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
                  "byte_fallback": False, "ignore_merges": False}
        odd = [k for k, v in wanted.items() if (model.get(k) or v) != v]
        if model["type"] != "BPE" or odd or spec["normalizer"] or spec["post_processor"] or spec["decoder"]["type"] != "ByteLevel":
            raise ValueError(f"not a plain byte-level BPE file ({', '.join(odd) or 'model, normalizer, post-processor or decoder'})")
        if pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
            raise ValueError("the pre-tokenizer isn't ByteLevel with its own pattern and without a prefix blank")
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocab[f(p)] for p in pairs], np.int64) for f in (lambda p: p[0], lambda p: p[1], "".join))
        self.byte_of = np.zeros(512, np.uint8)
        alphabet = byte_alphabet()
        self.byte_of[alphabet] = np.arange(256)
        self.base = np.array([vocab[chr(c)] for c in alphabet], np.int32)
        known = {**vocab, **{t["content"]: t["id"] for t in spec["added_tokens"]}}
        self.size = max(known.values()) + 1
        born = np.full(self.size, np.iinfo(np.int64).max)
        born[self.base] = -1
        born[made] = np.arange(len(made))
        if len(np.unique(made)) < len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("some id is made by two merges, or a merge comes before those of its parts")
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made.astype(np.int32)
        raw = [b""] * self.size
        for token, i in known.items():
            points = code_points(token)
            plain = len(points) and points.max() < 512 and (alphabet[self.byte_of[points]] == points).all()
            raw[i] = self.byte_of[points].tobytes() if plain else token.encode()
        self.token_size = np.fromiter(map(len, raw), np.int64, self.size)
        self.token_at = _starts(self.token_size)
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def leaves(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings of byte strings that stand end to end: ids end to end, and how many each has.

        In each round every string merges all places of its best pair, from the left; finished strings leave.
        """
        n = len(size)
        out, out_size = [], np.zeros(n, np.int64)
        ids, count, string = self.base[raw], size.copy(), np.arange(n)
        full = count > 0
        count, string = count[full], string[full]
        of = np.repeat(np.arange(len(count)), count)
        rank = np.full(len(ids), NEVER)  # of the pair that begins here
        inner = np.flatnonzero(of[:-1] == of[1:]) if len(ids) else np.zeros(0, np.int64)
        rank[inner] = self.rank(ids[inner], ids[inner + 1])
        while len(count):
            best = np.minimum.reduceat(rank, _starts(count))
            over = best == NEVER
            if over.any():
                gone = over[of]
                out.append((string[over], ids[gone]))
                out_size[string[over]] = count[over]
                ids, rank = ids[~gone], rank[~gone]
                count, string, best = count[~over], string[~over], best[~over]
                of = np.repeat(np.arange(len(count)), count)
                if not len(count):
                    break
            hit = np.flatnonzero(rank == best[of])
            run = np.empty(len(hit), bool)  # does a run of touching places begin here?
            run[0] = True
            run[1:] = np.diff(hit) > 1
            first = np.flatnonzero(run)
            hit = hit[(np.arange(len(hit)) - first[np.cumsum(run) - 1]) % 2 == 0]
            ids[hit] = self.made[rank[hit]]
            count -= np.bincount(of[hit], minlength=len(count))
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            place = np.cumsum(stay) - 1
            ids, of, rank = ids[stay], of[stay], rank[stay]
            now = place[hit]
            for at in (now, now - 1):
                at = at[at >= 0]
                paired = (at + 1 < len(ids)) & (of[at] == of[np.minimum(at + 1, len(ids) - 1)])
                rank[at[~paired]] = NEVER
                at = at[paired]
                rank[at] = self.rank(ids[at], ids[at + 1])
        if not out:
            return np.zeros(0, np.int32), out_size
        strings, flat = np.concatenate([s for s, _ in out]), np.concatenate([i for _, i in out])
        begin = np.zeros(n, np.int64)
        begin[strings] = _starts(out_size[strings])
        return ragged(flat, begin, out_size), out_size

    def join(self, halves: list[tuple[np.ndarray, np.ndarray]], window: int = FIRST_WINDOW) -> list[np.ndarray]:
        """The encoding of each left half's bytes followed by the right half's."""
        out: list = [None] * len(halves)
        todo = list(range(len(halves)))
        while todo:
            tails = [halves[j][0][-window:] for j in todo]
            heads = [halves[j][1][:window] for j in todo]
            ids = np.concatenate([x for pair in zip(tails, heads) for x in pair])
            ends = np.cumsum([len(a) + len(b) for a, b in zip(tails, heads)])
            width = np.concatenate([[0], np.cumsum(self.token_size[ids])])[ends]
            got, size = self.leaves(self.bytes_of(ids), np.diff(width, prepend=0))
            later = []
            for j, tail, head, new in zip(todo, tails, heads, np.split(got, np.cumsum(size)[:-1])):
                left, right = halves[j]
                left_agrees = len(tail) == len(left) or new[0] == tail[0]
                right_agrees = len(head) == len(right) or new[-1] == head[-1]
                if left_agrees and right_agrees:
                    out[j] = np.concatenate([left[:len(left) - len(tail)], new, right[len(head):]])
                else:
                    later.append(j)
            todo, window = later, window * 2
        return out

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.token_bytes, self.token_at[ids], self.token_size[ids])

    def words(self, raw: np.ndarray, size: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
        """As ``leaves``, with words above ``leaf`` bytes built as trees."""
        parts = np.ones(len(size), np.int64)
        while (wide := size > parts * leaf).any():
            parts[wide] *= 2
        word = np.repeat(np.arange(len(size)), parts)
        k = np.arange(len(word)) - np.repeat(_starts(parts), parts)
        part_size = size[word] * (k + 1) // parts[word] - size[word] * k // parts[word]
        ids, n = self.leaves(raw, part_size)
        tall = np.flatnonzero(parts > 1)
        if not len(tall):
            return ids, n
        at, stop = _starts(n), np.cumsum(n)
        first = _starts(parts)
        trees = {w: [ids[at[p]:stop[p]] for p in range(first[w], first[w] + parts[w])] for w in tall.tolist()}
        open_ = list(trees)
        while open_:  # a level of all trees
            pairs = [(w, p) for w in open_ for p in range(0, len(trees[w]), 2)]
            joined = iter(self.join([(trees[w][p], trees[w][p + 1]) for w, p in pairs]))
            for w in open_:
                trees[w] = [next(joined) for _ in range(len(trees[w]) // 2)]
            open_ = [w for w in open_ if len(trees[w]) > 1]
        total = n[first].copy()
        begin = at[first].copy()
        begin[tall] = len(ids) + _starts(np.array([len(trees[w][0]) for w in tall.tolist()]))
        total[tall] = [len(trees[w][0]) for w in tall.tolist()]
        return ragged(np.concatenate([ids, *[trees[w][0] for w in tall.tolist()]]), begin, total), total


class TreeTokenizer:
    """Ids of texts, and texts of ids, as the ``tokenizers`` library has them for a byte-level BPE file."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec)
        self.split_words = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        added = spec["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("an added token takes in what stands beside it")
        self.special = {t["content"]: t["id"] for t in added}
        longest_first = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(longest_first)})") if added else None
        self.white = np.fromiter((chr(c).isspace() for c in range(0x110000)), bool, 0x110000)
        self.known = WordTable(self._encode, self._word_starts, cache_words)

    def _word_starts(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The pre-tokenizer always splits between a character that isn't white and a blank after it."""
        begin = points == 0x20
        begin[1:] &= ~self.white[points[:-1]]
        begin[starts] = True
        return np.flatnonzero(begin)

    def _encode(self, texts: list[str], rows: int = 1 << 16):
        for at in range(0, len(texts), rows):
            split = [[w for w, _ in self.split_words(t)] for t in texts[at:at + rows]]
            flat = [w for ws in split for w in ws]
            raw = self.merges.byte_of[code_points("".join(flat))]
            ids, n = self.merges.words(raw, np.fromiter(map(len, flat), np.int64, len(flat)))
            stop = np.concatenate([[0], np.cumsum(n)])
            ends = np.cumsum([len(ws) for ws in split])
            yield range(at, at + len(split)), ids, np.diff(stop[ends], prepend=0)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.cut.split(t) if self.cut and any(s in t for s in self.special) else [t] for t in texts]
        plain = iter(list(self.known.batch([p for ps in parts for p in ps[::2]])))
        return [np.concatenate([np.array([self.special[p]], np.int32) if k % 2 else next(plain) for k, p in enumerate(ps)]) for ps in parts]

    def decode_batch(self, ids: np.ndarray, size: np.ndarray) -> list[str]:
        """Texts of ids that stand end to end."""
        known = (ids >= 0) & (ids < self.merges.size)
        kept = ids[known]
        width = np.concatenate([[0], np.cumsum(self.merges.token_size[kept])])
        stop = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(size)])]
        raw = self.merges.bytes_of(kept).tobytes()
        ends = width[stop].tolist()
        return [raw[a:z].decode("utf-8", "replace") for a, z in zip(ends[:-1], ends[1:])]


_LOADED: dict[str, TreeTokenizer] = {}


def tokenizer(path: str) -> TreeTokenizer:
    """One for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = TreeTokenizer(path)
    return _LOADED[path]


def _replaced(df: DataFrame, old: str, new: T.StructField) -> tuple[list[str], T.StructType]:
    """The columns that stay when ``old`` becomes ``new``, and the schema that results."""
    keep = [c for c in df.columns if c.lower() not in (old.lower(), new.name.lower())]
    return keep, T.StructType([*[df.schema[c] for c in keep], new])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, rows) for b in batches for at in range(0, len(b), rows))


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with ``text_col`` replaced by ``out_col``, the array of its ids."""
    keep, schema = _replaced(docs, text_col, T.StructField(out_col, T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in _slices(batches):
            texts = b.column(len(keep))
            got = tok.encode_batch([t or "" for t in texts.to_pylist()])
            stops = np.cumsum([0, *map(len, got)])
            ids = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *got])),
                                           mask=texts.is_null())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], schema.names)

    return small_batches(ship(docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias(text_col)))).mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``coded`` with ``ids_col`` replaced by ``out_col``, the text of its ids."""
    keep, schema = _replaced(coded, ids_col, T.StructField(out_col, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in _slices(batches):
            ids = b.column(len(keep))
            flat = ids.flatten().fill_null(-1).to_numpy()
            size = ids.value_lengths().fill_null(0).to_numpy()
            texts = pa.array(tok.decode_batch(flat, size), pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], schema.names)

    return small_batches(ship(coded.select(*[coded[c] for c in keep], coded[ids_col].cast("array<int>").alias(ids_col)))).mapInArrow(run, schema)
