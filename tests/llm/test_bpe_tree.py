"""BPE by tree concatenation against the tokenizers library and plain merging."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hourpanel.llm import bpe_tree as bt

from .conftest import TEXTS, rows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
R = random.Random(7)
HARD = ["a" * 1003, "ab" * 777, "=-" * 500, " " * 301, "the quick" * 200, "漢字かな交じり文" * 100, "<|endoftext|>",
        "a<|endoftext|>  b<|endoftext|>", "\x1c a\x85 b　c", *["".join(R.choices("aabc=", k=n)) for n in (65, 129, 700, 4001)],
        *["".join(R.choice(["a", "aaaa", "the", "==", "é", "漢", "😀", " ", "\n"]) for _ in range(900)) for _ in range(30)]]


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tok():
    return bt.TreeTokenizer(PATH, cache_words=50)  # the table of words overflows again and again


def plain_merge(m, raw):
    """One merge at a time: the best rank, then the leftmost."""
    ids = [int(m.base[b]) for b in raw]
    rank = {int(k): int(r) for k, r in zip(m.keys, m.ranks)}
    while True:
        best = min(((rank.get(a << 32 | b, bt.NEVER), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))), default=(bt.NEVER, 0))
        if best[0] == bt.NEVER:
            return ids
        ids[best[1]:best[1] + 2] = [int(m.made[best[0]])]


def test_texts_equal_library(tok, lib, small):
    texts = HARD + [t or "" for t in TEXTS] + [r.text for r in small.collect()]
    got = tok.encode_batch(texts)
    for t, ids in zip(texts, got):
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids, t[:60]
    assert tok.decode_batch(np.concatenate(got), np.array([len(g) for g in got])) == texts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab=é漢 \n0", min_size=1, max_size=300), min_size=1, max_size=4), st.sampled_from([1, 2, 5, 64]))
def test_trees_equal_plain_merging(words, leaf):
    m = _merges()
    raw = [w.encode() for w in words]
    ids, n = m.words(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw]), leaf)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [plain_merge(m, r) for r in raw]


def _merges(kept=[]):
    if not kept:
        kept.append(bt.Merges(json.load(open(PATH, encoding="utf-8"))))
    return kept[0]


def test_windows_grow_when_the_join_disagrees():
    m = _merges()
    left, right = (np.array(plain_merge(m, b"a" * n), np.int32) for n in (67, 64))  # the right half's phase shifts to its end
    assert m.join([(left, right)])[0].tolist() == plain_merge(m, b"a" * 131)


def test_decoding_any_ids(tok, lib):
    lists = [[R.randrange(0, 50257) for _ in range(R.randrange(0, 20))] for _ in range(500)]
    flat = np.array([i for x in lists for i in x])
    got = tok.decode_batch(flat, np.array([len(x) for x in lists]))
    assert got == [lib.decode(x, skip_special_tokens=False) for x in lists]
    assert tok.decode_batch(np.array([64, -1, 99_999, 65]), np.array([4])) == [lib.decode([64, 65])]


@pytest.mark.parametrize("path, value", [(("pre_tokenizer", "add_prefix_space"), True), (("pre_tokenizer", "use_regex"), False),
                                         (("model", "dropout"), 0.1), (("model", "byte_fallback"), True), (("normalizer",), {"type": "NFC"})])
def test_other_files_are_refused(path, value):
    spec = json.load(open(PATH, encoding="utf-8"))
    part = spec
    for k in path[:-1]:
        part = part[k]
    part[path[-1]] = value
    with pytest.raises(ValueError):
        bt.Merges(spec)


def test_frames(spark, edge, lib):
    coded = bt.encode(edge.withColumn("IDS", F.lit(1)), PATH)
    assert [c for c in coded.columns if c.lower() == "ids"] == ["ids"] and "text" not in coded.columns and "fp" in coded.columns
    got = sorted(rows_of(coded.select("doc_id", "ids")), key=repr)
    want = sorted(((r.doc_id, None if r.text is None else lib.encode(r.text, add_special_tokens=False).ids) for r in edge.collect()), key=repr)
    assert got == want
    back = bt.decode(coded.withColumn("Text", F.lit("x")), PATH)
    assert sorted(rows_of(back.select("doc_id", "text")), key=repr) == sorted(((r.doc_id, r.text) for r in edge.collect()), key=repr)
    odd = spark.createDataFrame([([64, None, 65],), ([],), (None,)], "ids array<int>")
    assert {r.text for r in bt.decode(odd, PATH).collect()} == {lib.decode([64, 65]), "", None}
    assert bt.decode(bt.encode(edge.limit(0), PATH), PATH).count() == 0


def test_query(spark, lib):
    from hourpanel.llm.queries import QUERIES

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = QUERIES["op13_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_workers_get_small_batches(spark):
    """Encoding and decoding stand in one stage: each task has two workers, and none holds more than 8 MB of rows at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    try:
        wide = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("ab cdef "), 1000).alias("text"))
        bt.decode(bt.encode(wide, PATH), PATH)
        got = wide.mapInArrow(lambda batches: (b.select(["text"]).slice(0, 1) for b in batches), "text string").count()
        assert got >= 4  # 32 MB: a row for each batch
    finally:
        spark.conf.unset(name)
