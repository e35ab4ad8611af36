"""SentencePiece Viterbi and packing against the libraries and brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hourpanel.llm import packing, sentencepiece_viterbi as sv

from .conftest import LONG, TEXTS, rows_of

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", "  two  blanks ", "line\n\n end", "tab\t\tx", "the theatre", "漢字 😀 x", "naïve — déjà", "▁mark", "a\u00a0 b", "\u2003 x", " <|endoftext|> y", "don't we'll  go 12 345!!", "a \n b\n c  d   e", "x" * 300 + " y", "\x00 z", "\x85 q", "\x1c r"]


@pytest.fixture(scope="module")
def pieces():
    return sv.SentencePieces(PIECES)


def brute_viterbi(pieces, text):
    """Plain dynamic programme over the whole text."""
    if not text:
        return []
    s = "▁" + text.replace(" ", "▁")
    score = {}
    for k, size in enumerate(pieces.sizes):
        score[pieces.chars[k, :size].tobytes()] = (pieces.scores[k], int(pieces.ids[k]))
    raw = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    best = [(0.0, -1, [])] + [None] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - pieces.longest), end):
            hit = score.get(raw[start:end].tobytes())
            if hit or start == end - 1:
                value = best[start][0] + (hit[0] if hit else pieces.unknown)
                if best[end] is None or value > best[end][0]:
                    best[end] = (value, start, [hit[1]] if hit else [int(pieces.byte_ids[b]) for b in s[start].encode()])
    out, at = [], len(s)
    while at:
        out = best[at][2] + out
        at = best[at][1]
    return out


def test_viterbi_equals_brute_force(pieces, small):
    enc = sv.Encoder(pieces, cache_words=50)  # the table overflows again and again
    texts = ODD + [r.text[:400] for r in small.limit(40).collect()]
    got = enc.encode_batch(texts)
    for t, ids in zip(texts, got):
        assert ids.tolist() == brute_viterbi(pieces, t), t
        assert pieces.decode(ids.tolist()) == t.replace("▁", " ")


def test_viterbi_equals_library(pieces, small):
    """The library's n-best search over the same pieces as a unigram model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    model.trainer_spec.model_type = 1
    lib = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    words = sorted({w for r in small.limit(20).collect() for w in r.text.split()})[:300]
    enc = sv.Encoder(pieces)

    def total(ids):
        return sum(lib.get_score(int(i)) for i in ids)

    for w, ids in zip(words, enc.encode_batch(words)):
        assert total(ids) == total(lib.nbest_encode(w, nbest_size=1)[0])
        assert lib.decode(ids.tolist()) == w


def test_merge_model_is_told_apart(pieces):
    """The given model is BPE: the best sum of its scores isn't the library's encoding, and loading says so."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = sv.Encoder(pieces).encode_batch(["government"])[0].tolist()
    assert pieces.merges and ids != lib.encode("government") and lib.decode(ids) == "government"


def test_encode_decode_round_trip(spark, edge):
    coded = sv.encode(edge.withColumn("original", F.col("text")), PIECES)
    assert set(coded.columns) == {*edge.columns, "original", "ids"} - {"text"}
    back = sv.decode(coded.withColumn("n", F.size("ids")), PIECES).collect()
    assert len(back) == edge.count()
    assert all(r.text == r.original and (r.original is None) == (r.text is None) for r in back)
    assert sv.encode(edge.limit(0), PIECES).count() == 0


def test_workers_get_small_batches(spark):
    """Of 32 MB in one partition no worker of the chain holds more than 8 MB at once, nor more than the session allows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    wide = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("ab cdef "), 1000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([len(b)])], ["size", "n"])

    def held():
        coded = sv.encode(wide, PIECES)
        sv.decode(coded, PIECES)
        got = wide.mapInArrow(sizes, "size long, n long").collect()
        assert sum(r.n for r in got) == 4000
        return max(r.size for r in got)

    spark.conf.unset(name)
    try:
        assert held() < 9 << 20
        spark.conf.set(name, "1m")
        assert held() < 2 << 20
    finally:
        spark.conf.unset(name)


def test_decode_without_a_table_of_words(spark):
    """A worker that only decodes makes no table of words; ids in any slice, empty and null ones decode alike."""
    rows = [(i, None if i % 7 == 0 else [] if i % 7 == 1 else [35, 301, 35 + i % 50]) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, ids array<int>").coalesce(1)
    pieces = sv.SentencePieces(PIECES)
    assert {r.id: r.text for r in sv.decode(df, PIECES).collect()} == {i: None if x is None else pieces.decode(x) for i, x in rows}
    sv._LOADED.pop(PIECES, None)
    sv.pieces_of(PIECES)
    assert PIECES not in sv._LOADED and sv.encoder(PIECES).pieces is sv.pieces_of(PIECES)


def test_word_tokenizer_equals_library(small):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    texts = ODD + [t for t in TEXTS if t and t != LONG] + [r.text for r in small.limit(60).collect()]
    for words in (packing.WordTokenizer(BPE), packing.WordTokenizer(BPE, 64)):
        for t, ids in zip(texts, words.encode_batch(texts)):
            assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids, t


def check_pieces(df, tiers=packing.TIERS):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 0], np.uint32)
        want[r.doc_id, ids.tobytes()] += 1
    out = packing.pack(df, BPE, tiers=tiers).collect()
    # rows of one id and number of tokens can't be told apart by the result, so coverage is compared by counts
    covered = defaultdict(Counter)
    by_doc = defaultdict(list)
    for (d, raw), n in want.items():
        by_doc[d, len(raw) // 4].append((np.frombuffer(raw, np.uint32), n))
    for r in out:
        options = by_doc[r.doc_id, r.doc_tokens]
        assert r.ids_crc32 in {zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for ids, _ in options}
        covered[r.doc_id, r.doc_tokens].update(range(r.start, r.start + r.length))
    assert set(covered) == set(by_doc)
    for key, options in by_doc.items():
        n = sum(n for _, n in options)
        assert covered[key] == Counter(dict.fromkeys(range(key[1]), n))
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length, r.tier))
    used = padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= tiers[-1]
        used += at
        padded += at if at & (at - 1) == 0 else tiers[-1]
    return out, padded - used, len(sequences)


def test_pack(edge, small):
    for df in (edge, small):
        tasks = df.rdd.getNumPartitions()
        out, padding, _ = check_pieces(df)
        assert padding <= tasks * packing.TIERS[-1]
    steps = Counter()
    for r in out:
        steps[r.step_id] += r.length
    assert max(steps.values()) < 2 * packing.STEP_TOKENS
    assert packing.pack(edge.limit(0), BPE).count() == 0


def test_packer_fills_windows():
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.geometric(1 / 400, 3000)]
    p = packing.Packer(pool=64)
    windows = [w for d, n in enumerate(sizes) for w in p.take(d, n)] + p.finish()
    covered = defaultdict(list)
    for size, parts in windows:
        assert sum(x[2] for x in parts) == size
        for d, s, n in parts:
            covered[d].append((s, n))
    for d, n in enumerate(sizes):
        at = 0
        for s, k in sorted(covered[d]):
            assert s == at
            at += k
        assert at == n
    assert sum(size & (size - 1) != 0 for size, _ in windows) <= 1
    groups = packing.deal(windows)
    cost = Counter()
    for g, (_, parts) in zip(groups, windows):
        cost[g] += sum(x[2] ** 2 for x in parts)
    assert max(cost.values()) < 1.2 * min(cost.values())
