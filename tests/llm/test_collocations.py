"""Collocations against plain counting; automata against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hourpanel.llm import collocations as co
from hourpanel.llm.count_automata import Automaton, Counts, Register, asked, compose, union

from .conftest import rows_of

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW))]


def brute(rows, least=10, top=2000):
    count, running = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            running[lang] += len(w)
            for k in (1, 2, 3):
                count[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in count.items():
        cand = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        inner = {s for p, a in cand.items() if len(p) == 3 for s in (p[:2], p[1:]) if 100 * a >= 50 * c[s]}
        best = []
        for p, a in cand.items():
            if p not in inner:
                score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, running[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def as_dict(c):
    n, w = max(1, len(c.words)), c.words
    out = {(w[i],): int(f) for i, f in enumerate(c.one) if f}
    pair = [(w[p // n], w[p % n]) for p in c.pair.tolist()]
    out.update(zip(pair, c.two.tolist()))
    out.update({(*pair[t // n], w[t % n]): f for t, f in zip(c.triple.tolist(), c.three.tolist())})
    return out


def counted(texts):
    out = Counter()
    for t in texts:
        for w in pieces(t):
            for k in (1, 2, 3):
                out.update(tuple(x.encode() for x in w[i:i + k]) for i in range(len(w) - k + 1))
    return dict(out)


def shard(texts):
    s = co.Shard()
    for t in texts:
        s.add([t])
    return s.counts()


TEXT = st.lists(st.text(alphabet="ab Bé.\t\n", max_size=60), max_size=4)


@settings(max_examples=150, deadline=None)
@given(TEXT, TEXT, st.sampled_from([1, 2, 1 << 16]))
def test_automata(left, right, block):
    a, b = shard(left), shard(right)
    for texts, c in ((left, a), (right, b)):
        assert as_dict(c) == counted(texts)
        auto = Automaton.of(c, block)
        assert as_dict(auto.counts()) == as_dict(c)
        assert as_dict(Automaton.load(auto.dump()).counts()) == as_dict(c)
        arcs = [tuple(zip(x.tolist(), y.tolist())) for x, y in zip(np.split(auto.third, np.cumsum(auto.size)), np.split(auto.three, np.cumsum(auto.size)))]
        assert len(set(arcs[:len(auto.size)])) == len(auto.size)  # no two states alike
    both = union([a, b])
    assert as_dict(both) == counted(left + right)
    assert as_dict(both.least(2)) == {p: f for p, f in counted(left + right).items() if f >= 2}
    phrases = [b" ".join(p) for p in (*as_dict(both), (b"zz",), (b"a", b"zz")) if len(p) < 3] * 2
    question, place = asked(phrases)
    known = as_dict(a)
    assert compose(question, Automaton.of(a))[place].tolist() == [known.get(tuple(p.split(b" ")), 0) for p in phrases]


@settings(max_examples=100, deadline=None)
@given(TEXT, st.lists(st.tuples(st.sampled_from("xy"), st.sampled_from([b"a", b"ab", b"b", b"bb", "é".encode(), b"c"]), st.sampled_from([b"", b"a", b"b", b"bb"])), max_size=6, unique=True))
def test_cut_by_ranges(texts, bounds):
    ranges = co.Ranges(sorted(bounds, key=co._order))
    whole, seen = counted(texts), {}
    for number, part in ranges.cut("x", shard(texts)):
        for p, f in as_dict(part).items():
            assert p not in seen and number == ranges.of("x", *p[:2])
            seen[p] = f
    assert seen == whole


def test_heavy_weights_and_hash_clashes(monkeypatch):
    r = Register()
    heavy = np.array([2**40, 2**40, 2**40 + 1, 3])
    got = r.states(np.array([1, 1, 1, 1, 0]), np.array([5, 5, 5, 5]), heavy)
    assert got[0] == got[1] and len(set(got.tolist())) == 4 and got[4] == 0
    monkeypatch.setattr(co, "_OF_BYTE", np.zeros(256, np.uint64))  # words of one length have one hash
    texts = ["ab ba ab. cd ab é", "xx yy"]
    assert as_dict(shard(texts)) == counted(texts)


def test_decimals_are_exact(spark):
    big = 10**12 - 1
    df = spark.createDataFrame([(big, big, 7), (10, 10, 10), (33, 1000, 999)], "a long, l long, r long")
    got = [r[0] for r in df.select(co._score(F.col("l"), F.col("r"))).collect()]
    assert got == [1000000 * big // 7 if 1000000 * big // 7 < 2**63 else got[0], 1000000, 1000000 * 33 * 33 // 999000]


@pytest.mark.parametrize("options", [{}, {"range_phrases": 400, "requests_per_copy": 3}, {"top": 5}])
def test_frames_equal_brute_force(spark, options, monkeypatch):
    r = random.Random(11)
    words = ["Ab", "ab", "of", "the", "é", "straße", "x-y", "x" * 300, "漢字"]
    rows = [(" ".join(r.choices(words, weights=range(9, 0, -1), k=r.randrange(0, 40))) + r.choice([".", "\n", " ", ","]), r.choice(["en", "de", None, "und", ""])) for _ in range(400)]
    rows += [(None, "en"), ("", None), (" \t\n.,", "fr"), ("the best of it. " * 2000, "en"), ("one word", "zz")]
    df = spark.createDataFrame([(i % 7, *x, 1, 2, "p", 3) for i, x in enumerate(rows)], "doc_id long, text string, lang string, a long, rank int, phrase string, range int").repartition(4)
    got = co.collocations(df, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(rows_of(got)) == brute(rows, top=options.get("top", 2000))
    assert co.collocations(df.limit(0)).count() == 0


def test_small_shards(spark, monkeypatch, small):
    """Shards and unions of few words give the same sums (in this process)."""
    texts = [r.text or "" for r in small.limit(60).collect()]
    parts = [shard([t]) for t in texts]
    pending = []
    for p in parts:
        pending.append(p)
        if sum(map(len, pending)) > 500:
            pending = [union(pending)]
    assert as_dict(union(pending)) == counted(texts)
