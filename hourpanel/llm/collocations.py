"""Phrase collocations, counted by weighted acyclic automata.

1. A bounded sample of documents gives bounds that cut the sorted phrases of
   all languages into ranges (they only set how even the ranges are).
2. Each task counts the phrases of one to three words of some ``SHARD_WORDS``
   running words at a time and builds an automaton for each range from the
   sorted phrases: a very common phrase is one arc of each.
3. Each range unites its automata, summing weights; phrases with at least
   ``least`` are kept as the range's automaton.
4. The candidates ask for the counts of their parts: requests go to the range
   that has the part (a range with many requests is copied to several tasks),
   where they are composed, as an automaton of their own, with its counts.
5. The lowest-scoring cut counts; pairs that lie in a longer candidate with at
   least half their count go; the best of each language are reported.

Counts, products and quotients are exact: 64-bit counts, 38-digit decimals.

Words are ``[^\\x20\\x09]+`` of the pieces between ``[.,;:!?\\x0A-\\x0D]``, A-Z in lower case.

Defined cases: a null text is empty, a null language ``und`` (so are rows of
the language 'und' itself); texts of any length, long ones too, are read whole; repeated
rows count each time; an empty table gives an empty result; only the named
columns are read.  A phrase's count must stay below 10^12, for the decimals.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, splitmix, store
from .count_automata import Automaton, Counts, asked, compose, starts, union
from .word_table import ragged

UNKNOWN = "und"
SHARD_WORDS = 1 << 22
BATCH_CHARS = 1 << 20
#: Phrases (with repeats) for each range; the tasks that unite them hold a few times as many numbers.
RANGE_PHRASES = 6_000_000
#: Documents (about) in the sample that cuts the ranges, and the most pairs taken from each: some 500,000 keys at most reach the driver.
SAMPLE_DOCS, SAMPLE_PAIRS, SAMPLE_STRIDE = 2000, 256, 16
#: Requests for one copy of a range's automaton.
REQUESTS = 200_000
#: Phrases waiting to be united, at most.
PENDING = 1 << 22
SALTS = 64

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
# What ends a piece, and what stands between words.
ENDS_PIECE = np.isin(_BYTES, list(b".,;:!?\n\x0b\x0c\r"))
IN_WORD = ~ENDS_PIECE & ~np.isin(_BYTES, list(b" \t"))
_OF_BYTE = splitmix(np.arange(256, dtype=np.uint64))
_OF_PLACE = splitmix(np.arange(1 << 32, (1 << 32) + 256, dtype=np.uint64)) | np.uint64(1)


class Shard:
    """Running words of one language, numbered as they come."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.linked: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[str]):
        raw = np.frombuffer("\n".join(texts).encode(), np.uint8)
        inside = np.concatenate([[False], IN_WORD[raw], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        begin, size = edge[::2], edge[1::2] - edge[::2]
        if not len(begin):
            return
        piece = np.cumsum(ENDS_PIECE[raw])[begin]
        linked = np.zeros(len(begin), bool)
        linked[:-1] = piece[1:] == piece[:-1]
        flat, at = LOWER[raw[inside[1:-1]]], starts(size)
        place = (np.arange(len(flat)) - np.repeat(at, size)) & 255
        key = np.add.reduceat(_OF_BYTE[flat] * _OF_PLACE[place], at) + size.astype(np.uint64)
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        told = first[of]
        text = flat.tobytes()
        if (size[told] == size).all() and (ragged(flat, at[told], size) == flat).all():
            words, where = [text[a:a + n] for a, n in zip(at[first].tolist(), size[first].tolist())], of
        else:  # two words have one hash
            words, where = [text[a:a + n] for a, n in zip(at.tolist(), size.tolist())], np.arange(len(at))
        known = self.number
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
        self.ids.append(ids[where])
        self.linked.append(linked)
        self.size += len(begin)

    def counts(self) -> Counts:
        ids = np.concatenate([np.zeros(0, np.int32), *self.ids])
        return Counts.of_words(list(self.number), ids, np.concatenate([np.zeros(0, bool), *self.linked]))


def _by_language(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[str, list[str]]]:
    """Texts of one language at a time, about ``BATCH_CHARS`` characters."""
    held: dict[str, list] = {}
    for b in batches:
        for at in range(0, len(b), rows):
            part = b.slice(at, rows)
            for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist()):
                group = held.setdefault(lang, [0, []])
                group[0] += len(text) + 1
                group[1].append(text)
                if group[0] >= BATCH_CHARS:
                    yield lang, held.pop(lang)[1]
    for lang, (_, texts) in held.items():
        yield lang, texts


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


# --------------------------------------------------------------------------- ranges
Bound = tuple[str, bytes, bytes]


def range_bounds(texts: DataFrame, range_phrases: int) -> list[Bound]:
    """Sorted (language, word, word) at which ranges begin, from a sample of documents."""
    rows = texts.count()
    share = min(1.0, SAMPLE_DOCS / max(1, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(4)]
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
                shard = Shard()
                shard.add([text])
                if not shard.size:
                    continue
                words, ids, linked = list(shard.number), shard.ids[0], np.flatnonzero(shard.linked[0])
                keys = {(words[ids[i]], words[ids[i + 1]]) for i in linked[::max(SAMPLE_STRIDE, len(linked) // SAMPLE_PAIRS + 1)].tolist()}
                for k, (first, second) in enumerate(sorted(keys) or [(words[0], b"")]):
                    for c, v in zip(cols, (lang, first, second, 0 if k else shard.size)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.binary(), pa.int64()))],
                                             ["lang", "first", "second", "words"])

    got = ship(texts.sample(share, 7)).mapInArrow(run, "lang string, first binary, second binary, words long").collect() if rows else []
    keys = sorted({(r.lang, bytes(r.first), bytes(r.second)) for r in got}, key=_order)
    ranges = int(3 * sum(r.words for r in got) / share / range_phrases) + 1
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}, key=_order) if keys else []


def _order(bound: Bound) -> tuple[bytes, bytes, bytes]:
    return bound[0].encode(), bound[1], bound[2]


class Ranges:
    """Which range a phrase lies in: that of its first two words."""

    def __init__(self, bounds: list[Bound]):
        self.bounds = [_order(b) for b in bounds]

    def of(self, lang: str, first: bytes, second: bytes = b"") -> int:
        return bisect_right(self.bounds, (lang.encode(), first, second))

    def cut(self, lang: str, c: Counts) -> Iterator[tuple[int, Counts]]:
        """The parts of ``c`` by range."""
        key, n = lang.encode(), len(c.words)
        low = bisect_right(self.bounds, (key, b"", b""))
        number, pair_at, word_at = low, 0, 0
        for which, first, second in [*self.bounds[low:], (None, b"", b"")]:
            if which != key:  # the language's last range
                pairs, words = len(c.pair), n
            else:
                i = bisect_right(c.words, first)
                met = i > 0 and c.words[i - 1] == first
                words = i - (met and not second)
                row = i - met
                pairs = int(np.searchsorted(c.pair, row * n + (_below(c.words, second) if met else 0)))
            if pairs > pair_at or words > word_at:
                part = c.part(slice(pair_at, pairs), slice(word_at, words))
                if len(part):
                    yield number, part
            if which != key:
                return
            number, pair_at, word_at = number + 1, pairs, words


def _below(words: list[bytes], word: bytes) -> int:
    """How many words come before ``word``."""
    i = bisect_right(words, word)
    return i - (i > 0 and words[i - 1] == word)


# --------------------------------------------------------------------------- counting
def count_phrases(texts: DataFrame, ranges: Ranges, least: int) -> DataFrame:
    """A row for each range and language: the automaton of its phrases with at least ``least``, and its running words."""
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Shard] = {}

        def out(lang, shard):
            for number, part in ranges.cut(lang, shard.counts()):
                yield pa.RecordBatch.from_pylist([{"range": number, "lang": lang, "automaton": Automaton.of(part).dump()}], kinds)

        for lang, group in _by_language(batches):
            held.setdefault(lang, Shard()).add(group)
            if sum(s.size for s in held.values()) >= SHARD_WORDS:
                most = max(held, key=lambda k: held[k].size)
                yield from out(most, held.pop(most))
        while held:
            yield from out(*held.popitem())

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pending, size = None, [], 0

        def out():
            whole = union(pending)
            return pa.RecordBatch.from_pylist([{"range": key[0], "lang": key[1], "automaton": Automaton.of(whole.least(least)).dump(),
                                                "words": int(whole.one.sum())}], kinds.append(pa.field("words", pa.int64())))

        for b in batches:
            for number, lang, blob in zip(b["range"].to_pylist(), b["lang"].to_pylist(), b["automaton"]):
                if key != (number, lang):
                    if key:
                        yield out()
                    key, pending, size = (number, lang), [], 0
                pending.append(Automaton.load(blob.as_py()).counts())
                size += len(pending[-1])
                if size > PENDING + len(pending[0]):
                    pending = [union(pending)]
                    size = 0
        if key:
            yield out()

    kinds = pa.schema([("range", pa.int64()), ("lang", pa.string()), ("automaton", pa.binary())])
    parts = ship(texts).mapInArrow(shards, "range long, lang string, automaton binary")
    dealt = parts.repartition(len(ranges.bounds) + 1, "range").sortWithinPartitions("range", "lang")
    return dealt.mapInArrow(unite, "range long, lang string, automaton binary, words long")


def _requests(counted: DataFrame, ranges: Ranges) -> DataFrame:
    """The candidates of all automata, a row for each part to look up.

    slot: 'l' or 'r' (the two words of a pair; of three words the first and the last), 'm' (the last two of three).
    head: count of the first two of three words, which lies on the candidate's own path.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, blob in zip(b["lang"].to_pylist(), b["automaton"]):
                c = Automaton.load(blob.as_py()).counts()
                n, w = max(1, len(c.words)), c.words
                found = [((w[p // n], w[p % n]), a, None) for p, a in zip(c.pair.tolist(), c.two.tolist())]
                for t, a in zip(c.triple.tolist(), c.three.tolist()):
                    p = int(c.pair[t // n])
                    found.append(((w[p // n], w[p % n], w[t % n]), a, int(c.two[t // n])))
                for at in range(0, len(found), 20_000):
                    cols: list[list] = [[] for _ in range(7)]
                    for words, a, head in found[at:at + 20_000]:
                        parts = [("l", words[:1]), ("r", words[-1:])] + ([("m", words[1:])] if head else [])
                        for slot, part in parts:
                            for col, v in zip(cols, (ranges.of(lang, *part), lang, b" ".join(words).decode(), a, head, slot, b" ".join(part).decode())):
                                col.append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    names = ["range", "lang", "phrase", "a", "head", "slot", "part"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return ship(counted).mapInArrow(run, "range long, lang string, phrase string, a long, head long, slot string, part string")


def _answers(requests: DataFrame, counted: DataFrame, per_copy: int) -> DataFrame:
    """Requests with the count ``f`` of their part."""
    # one row for each range that is asked: about SAMPLE_DOCS * SAMPLE_PAIRS at most
    copies = F.broadcast(requests.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / per_copy).cast("int").alias("copies")))
    salted = requests.join(copies, "range").withColumn("copy", F.pmod(F.xxhash64("phrase"), F.col("copies")).cast("int")).drop("copies")
    automata = counted.join(copies, "range").select("range", "lang", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "automaton")
    both = salted.withColumn("automaton", F.lit(None).cast("binary")).unionByName(automata, allowMissingColumns=True)
    rows = both.repartition("range", "copy").sortWithinPartitions("range", "copy", "lang", F.col("automaton").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for b in batches:
            keys = list(zip(*[b[c].to_pylist() for c in ("range", "copy", "lang")]))
            loads = b["automaton"].is_valid().to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(loads).tolist(), len(keys)]
            cuts = cuts if cuts[0] == 0 else [0, *cuts]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if loads[a]:
                    counts, a = Automaton.load(b["automaton"][a].as_py()), a + 1
                if z > a:
                    question, place = asked([p.encode() for p in b["part"].slice(a, z - a).to_pylist()])
                    f = compose(question, counts)[place]
                    yield pa.RecordBatch.from_arrays([*[b[c].slice(a, z - a) for c in ("lang", "phrase", "a", "head", "slot")], pa.array(f)],
                                                     ["lang", "phrase", "a", "head", "slot", "f"])

    return ship(rows).mapInArrow(run, "lang string, phrase string, a long, head long, slot string, f long")


def _score(left: Column, right: Column) -> Column:
    whole = [c.cast("decimal(38,0)") for c in (F.lit(1_000_000), F.col("a"), left, right)]
    return F.call_function("div", (whole[0] * whole[1] * whole[1]).cast("decimal(38,0)"), (whole[2] * whole[3]).cast("decimal(38,0)"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, top: int = 2000,
                 range_phrases: int = RANGE_PHRASES, requests_per_copy: int = REQUESTS) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, its count a, the counts l and r of its parts, running words n, score."""
    texts = _texts(docs, text_col, lang_col)
    ranges = Ranges(range_bounds(texts, range_phrases))
    counted = store(count_phrases(texts, ranges, least), "phrase-counts")
    requests = store(_requests(counted, ranges), "phrase-requests")
    answers = _answers(requests, counted.drop("words"), requests_per_copy)
    slots = [F.max(F.when(F.col("slot") == s, F.col("f"))).alias(s) for s in "lrm"]
    told = answers.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("head").alias("head"), *slots)
    first = F.struct(_score(F.col("l"), F.coalesce("m", "r")).alias("score"), F.lit(1).alias("k"), F.col("l").alias("l"), F.coalesce("m", "r").alias("r"))
    second = F.when(F.col("m").isNotNull(), F.struct(_score(F.col("head"), F.col("r")).alias("score"), F.lit(2).alias("k"), F.col("head").alias("l"), F.col("r").alias("r")))
    scored = store(told.select("lang", "phrase", "a", "head", "m", F.least(first, second).alias("cut")), "phrase-scores")

    longer = scored.where(F.col("m").isNotNull())
    inside = F.explode(F.array(F.struct(F.substring_index("phrase", " ", 2).alias("phrase"), F.col("head").alias("f")),
                               F.struct(F.substring_index("phrase", " ", -2).alias("phrase"), F.col("m").alias("f"))))
    swallowed = longer.select("lang", "a", inside.alias("inner")).where(2 * F.col("a") >= F.col("inner.f")).select("lang", "inner.phrase").distinct()
    left = longer.unionByName(scored.where(F.col("m").isNull()).join(swallowed, ["lang", "phrase"], "left_anti"))

    best = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    short = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("place") <= top)
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    running = counted.groupBy("lang").agg(F.sum("words").alias("n"))
    return ranked.join(running, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
