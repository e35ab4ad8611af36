"""Language identification with spans of mixed-language text.

A word is a run of letters.  Its script, by Unicode range, narrows the
languages to those that write at least ``MIN_SCRIPT_SHARE`` of their own words
in the training sample in that script, however few rows they have.  Each
candidate scores the word by the log likelihood of its letter n-grams (one to
three letters, word ends marked, hashed to ``2 ** HASH_BITS`` cells).  Viterbi
over a text's words, with a penalty for every switch of language, labels the
words; runs of one label are the spans, and the text's language is the label
of most letters.  The score is that language's share of the letters.

Training reads a bounded sample: about ``sample_rows`` labelled rows, an equal
quota for each language, chosen by a hash of the id.  The counts are summed by
Spark; the model on the driver has a cell table for each language.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
without labelled rows every text is ``und``; rows without a label aren't
learned from; a word in a script that the sample lacks may be any language;
of equal languages the first in alphabetical order is taken; a null doc_id
hashes like the empty text; rows that repeat are each returned; an empty table
gives an empty result; training reads only the named columns, and ``identify``
passes the others through (``names`` says which it replaces).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, store

HASH_BITS = 17
SAMPLE_ROWS = 20_000
SWITCH_PENALTY = 12.0
SMOOTHING = 0.1
MIN_SCRIPT_SHARE = 0.001
CHUNK_CHARS = 1 << 20  # whose n-grams are taken at once
LABEL_CHARS = 1 << 23  # whose words are labelled at once
BLOCK_CELLS = 1 << 22
UND = "und"

# First and last code points of script blocks (Unicode).
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)), "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F)), "armenian": ((0x530, 0x58F),), "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)), "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),), "gurmukhi": ((0xA00, 0xA7F),), "gujarati": ((0xA80, 0xAFF),),
    "tamil": ((0xB80, 0xBFF),), "telugu": ((0xC00, 0xC7F),), "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),), "thai": ((0xE00, 0xE7F),), "georgian": ((0x10A0, 0x10FF),),
    "ethiopic": ((0x1200, 0x137F),), "kana": ((0x3040, 0x30FF),), "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter (0 if no letter), and the script's number (the last: any other)."""
    lower = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            small = ch.lower()
            lower[c] = ord(small) if len(small) == 1 else c
    script = np.full(0x110000, len(SCRIPTS), np.uint8)
    for i, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            script[first:last + 1] = i
    return lower, script


@dataclass(frozen=True)
class Words:
    """The words of some texts: number of the text, place (code points), script, and n-gram cells of all letters."""
    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    script: np.ndarray
    first: np.ndarray  # each word's first row in cells
    cells: np.ndarray  # letters x 4


def words_of(texts: list[str]) -> Words:
    lower, script = _tables()
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    at = np.cumsum(sizes) - sizes
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    small = lower[raw]
    place = np.flatnonzero(small)
    letter = small[place].astype(np.uint64)
    begins = np.ones(len(place), bool)
    begins[1:] = np.diff(place) > 1
    ends = np.ones(len(place), bool)
    ends[:-1] = begins[1:]
    first = np.flatnonzero(begins)
    zero = np.zeros(1, np.uint64)
    one_back = np.where(begins, 0, np.concatenate([zero, letter[:-1]])[:len(letter)])
    second = begins | np.concatenate([[True], begins[:-1]])[:len(letter)]
    two_back = np.where(second, 0, np.concatenate([zero, zero, letter[:-2]])[:len(letter)])

    def cell(order, *parts):
        with np.errstate(over="ignore"):
            h = np.full(len(letter), order, np.uint64)
            for p in parts:
                h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - HASH_BITS)).astype(np.int32)

    closing = np.where(ends, np.uint64(1), np.uint64(2))
    cells = np.stack([cell(1, letter), cell(2, one_back, letter), cell(3, two_back, one_back, letter),
                      cell(4, closing, one_back, letter)], 1)
    owner = np.searchsorted(at, place[first], "right") - 1
    return Words(owner.astype(np.int32), (place[first] - at[owner]).astype(np.int32),
                 np.diff(np.append(first, len(letter))).astype(np.int32), script[raw[place[first]]], first, cells)


@dataclass(frozen=True)
class Model:
    """Languages in alphabetical order; log likelihoods by cell and language; which languages a script allows."""
    langs: tuple[str, ...]
    logp: np.ndarray  # 2 ** HASH_BITS x languages, float32
    allowed: np.ndarray  # scripts + 1 x languages, bool

    def word_scores(self, w: Words) -> np.ndarray:
        scores = np.zeros((len(w.first), len(self.langs)), np.float32)
        ends = np.append(w.first[1:], len(w.cells))
        block, at = BLOCK_CELLS // max(4, len(self.langs)), 0
        while at < len(scores):  # words of about ``block`` letters at a time
            to = max(at + 1, int(np.searchsorted(w.first, w.first[at] + block)))
            cells = w.cells[w.first[at]:ends[to - 1]]
            letters = self.logp[cells[:, 0]]
            for k in range(1, cells.shape[1]):
                letters += self.logp[cells[:, k]]
            scores[at:to] = np.add.reduceat(letters, w.first[at:to] - w.first[at], axis=0)
            at = to
        scores[~self.allowed[w.script]] = -1e9
        return scores

    def label(self, scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
        """Viterbi labels of the words of many texts at once; ``counts`` has each text's number of words."""
        order = np.argsort(-counts, kind="stable")
        begin = (np.cumsum(counts) - counts)[order]
        left = counts[order]
        steps = int(left[0]) if len(left) else 0
        back = np.zeros(scores.shape, np.int8 if len(self.langs) < 128 else np.int16)
        active = np.searchsorted(-left, -np.arange(steps), "left")  # texts with more than t words stand first
        own = np.arange(len(self.langs))
        best = np.zeros((len(left), len(self.langs)))
        for t in range(steps):
            n = active[t]
            rows, v = begin[:n] + t, best[:n]
            if t:
                top = v.argmax(1)
                switched = v[np.arange(n), top] - penalty
                stay = v >= switched[:, None]
                back[rows] = np.where(stay, own, top[:, None])
                v = np.where(stay, v, switched[:, None])
            best[:n] = v + scores[rows]
        label = np.zeros(len(scores), np.int64)
        now = best.argmax(1) if len(left) else np.zeros(0, np.int64)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            rows = begin[:n] + t
            label[rows] = now[:n]
            if t:
                now[:n] = back[rows, now[:n]]
        return label


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on text and language of rows that aren't held out."""
    rows = docs.select(docs[id_col].alias("id"), docs[lang_col].cast("string").alias("lang"),
                       docs[text_col].cast("string").alias("text")) \
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    per_lang = store(rows.groupBy("lang").agg(F.count("*").alias("n")), "lang-counts")
    quota = sample_rows / max(1, per_lang.count())
    # stored: Spark sees that it is small and sends it to the texts, which don't shuffle
    share = store(per_lang.select(F.col("lang").alias("l"), (F.lit(quota) / F.col("n")).alias("share")), "lang-shares")
    unit = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(share, F.col("lang") == F.col("l")).where(unit < F.col("share")).select("lang", "text")
    scripts = len(SCRIPTS) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, cell, n): cells below 2 ** HASH_BITS are n-grams, those above words by script."""
        for b in batches:
            langs = np.array(b["lang"].to_pylist(), object)
            texts = b["text"].to_pylist()
            for lang in sorted(set(langs)):
                total = np.zeros((1 << HASH_BITS) + scripts, np.int64)
                for part in _chunks([texts[i] for i in np.flatnonzero(langs == lang)]):
                    w = words_of(part)
                    total[:1 << HASH_BITS] += np.bincount(w.cells.ravel(), minlength=1 << HASH_BITS)
                    total[1 << HASH_BITS:] += np.bincount(w.script, minlength=scripts)
                cell = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(cell), "cell": cell, "n": total[cell]})

    got = ship(sample).mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = tuple(sorted(set(got["lang"].to_pylist())))
    counts = np.zeros(((1 << HASH_BITS) + scripts, len(langs)))
    if langs:
        column = {x: i for i, x in enumerate(langs)}
        counts[got["cell"].to_numpy(), [column[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
    grams, words = counts[:1 << HASH_BITS], counts[1 << HASH_BITS:]
    logp = np.log((grams + SMOOTHING) / (grams.sum(0) + SMOOTHING * len(grams)))
    allowed = (words > 0) & (words >= MIN_SCRIPT_SHARE * words.sum(0))
    allowed[~allowed.any(1)] = True
    return Model(langs, logp.astype(np.float32), allowed)


def _chunks(texts: list[str], chars: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Runs of texts of at most ``chars`` together; a longer text is alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _judge(model: Model, texts: list[str], penalty: float):
    """Language, score and spans (start, end, language) of each text."""
    parts, lengths, starts, owners, base = [], [], [], [], 0
    if not model.langs:
        return [(UND, 0.0, [])] * len(texts)
    for part in _chunks(texts):
        w = words_of(part)
        parts.append(model.word_scores(w))
        lengths.append(w.length)
        starts.append(w.start)
        owners.append(w.text + base)
        base += len(part)
    scores, length, start, owner = map(np.concatenate, (parts, lengths, starts, owners))
    counts = np.bincount(owner, minlength=len(texts))
    label = model.label(scores, counts, penalty)
    letters = np.zeros((len(texts), len(model.langs)))
    np.add.at(letters, (owner, label), length)
    total, top = letters.sum(1), letters.argmax(1)
    new = np.ones(len(label), bool)
    new[1:] = (np.diff(owner) != 0) | (np.diff(label) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(label)) - 1
    out = [(model.langs[top[i]], letters[i, top[i]] / total[i], []) if total[i] else (UND, 0.0, []) for i in range(len(texts))]
    for a, z in zip(first, last):
        out[owner[a]][2].append((int(start[a]), int(start[z] + length[z]), model.langs[label[a]]))
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = SWITCH_PENALTY,
             names: tuple[str, str, str] = ("lang_pred", "score", "spans"), keep_text: bool = False, rows: int = 1024) -> DataFrame:
    """``docs`` without ``text_col`` (unless ``keep_text``), with the language, its score, and spans: array of (start, end, lang) in code points.

    ``rows`` texts are judged at a time.  ``names`` are the new columns' names; columns of ``docs`` that have one of them (in either case) are replaced, as
    ``withColumn`` does.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** HASH_BITS cells for each language
    keep = [c for c in docs.columns if c.lower() not in {n.lower() for n in names} and (keep_text or c.lower() != text_col.lower())]
    slim = docs.select(*[docs[c] for c in keep]) if keep_text else docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias(text_col))
    at = [c.lower() for c in slim.columns].index(text_col.lower())
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(names[0], T.StringType()),
                           T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(a, rows) for x in batches for a in range(0, len(x), rows)):
            texts = [t or "" for t in b.column(at).to_pylist()]
            got = [g for part in _chunks(texts, LABEL_CHARS) for g in _judge(shared.value, part, penalty)]
            spans = pa.array([[{"start": s, "end": e, "lang": x} for s, e, x in g[2]] for g in got],
                             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), spans], schema.names)

    return ship(slim).mapInArrow(run, schema)
