"""Conversation repair against plain dynamic programming and against all edits of short conversations."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourpanel.llm import conversation_repair as cr

from .conftest import rows_of

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, conv long, number long, head string, plan string, cost int, audit int"
OPS = ["conv_id", *cr.COUNTS, "cost", "audit", "repaired_sha256"]


def faults(turns):
    """Contract text, in plain Python: sorted (turn, role, text) and each one's first fault."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, out = set(), []
    for _, role, text in turns:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return turns, out


def best(turns, fault):
    """(cost, audit, repaired) by forward search over (row, last kept role), keeping the least (cost, audit)."""
    states = {"": (0, "", ())}

    def after(c):
        return {"": "su", "s": "u", "u": "a", "a": "u"}[c]

    def relax(states):
        todo = dict(states)
        for _ in range(3):
            new = {}
            for s, (cost, audit, kept) in todo.items():
                r = "a" if s == "u" else "u"
                new[r] = min(new.get(r, (10**9,)), (cost + 3, audit + "I", (*kept, ({"u": "user", "a": "assistant"}[r], ""))))
            for s, v in new.items():
                states[s] = min(states.get(s, (10**9,)), v)
            todo = new
        return states

    for (_, role, text), f in zip(turns, fault):
        out = {}
        for s, (cost, audit, kept) in relax(dict(states)).items():
            ways = [(cost + 4, audit + "D", kept, s)]
            if f not in ("blank", "duplicate"):
                more = 3 * (f == "truncated")
                if role[:1] and role[:1] in after(s):
                    ways.append((cost + more, audit + "K", (*kept, (role, text)), role[0]))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in after(s):
                        ways.append((cost + more + 3, audit + "R", (*kept, (name, text)), r))
            for c, a, k, n in ways:
                out[n] = min(out.get(n, (10**9,)), (c, a, k))
        states = out
    states = relax(dict(states))
    return min(v for s, v in states.items() if s in ("", "a"))


def want(rows):
    """The whole contract for damaged rows (conv, turn, role, text) by conversation."""
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t, " " if role is None else role, " " if text is None else text))
    out = {}
    for c, turns in convs.items():
        turns, fault = faults(turns)
        known = [t for t, _, _ in turns if t is not None]
        legal = {("s", "u"), ("u", "a"), ("a", "u")}
        cost, audit, kept = best(turns, fault)
        out[c] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *[fault.count(f) for f in ("blank", "duplicate", "truncated")],
                  sum((a[1][:1], b[1][:1]) not in legal for a, b in zip(turns, turns[1:])), cost, audit,
                  hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            out += [(c, t, "user" if k == 4 else role, "" if k == 1 else "".join(x for x in text if k != 2 or x not in ".!?"))] * (1 + (k == 3))
    return out


def run(rows):
    plans = cr.plan(rows)
    return {r[0]: tuple(r)[1:] for r in cr.digests(rows, plans).select(*OPS).collect()}


def test_choices_equal_all_edits():
    """Costs and audits of the walk equal those of every string of edits, on all short conversations."""
    for n in range(4):
        for codes in product([0, 1, 4, 6, 8, 9, 12, 15], repeat=n):
            pieces = cr.Pieces([bytes(codes)])
            costs = (pieces.matrices()[0] + cr.END_COST).min(axis=1)
            state, audit = pieces.walk(cr.END_COST[None], np.array([True]))[0][0]
            turns = [(i, ("system", "user", "assistant", "tool")[c >> 2], str(i)) for i, c in enumerate(codes)]
            cost, least, _ = best(turns, [("", "truncated", "blank", "duplicate")[c & 3] for c in codes])
            assert (costs[0], audit + cr.ENDING[state]) == (cost, least), codes


def test_walks_in_step_and_in_blocks():
    r = random.Random(3)
    codes = [bytes(r.choices(range(16), k=n)) for n in (0, 1, 2, 7, 50, 101, 400)]
    whole = cr.Pieces(codes)
    ends = np.array([[r.randrange(20) for _ in range(4)] for _ in codes])
    got = whole.walk(ends, np.zeros(len(codes), bool))
    for c, e, walks, m in zip(codes, ends, got, whole.matrices()):
        alone = cr.Pieces([c])
        assert alone.walk(e[None], np.array([False]))[0] == walks and (alone.matrices()[0] == m).all()
        for s, (to, audit) in enumerate(walks):
            assert sum(x in "DKR" for x in audit) == len(c)
            paid, now = 0, s
            for code, choice in zip(c, "".join(x if x == "I" else x + " " for x in audit).split()):
                a = cr.CHOICES.index(choice)
                paid, now = paid + cr.COST[a, code, now], cr.TO[a, code, now]
            assert now == to and paid + e[to] == (m[s] + e).min()


def conversations(seed, n, most=12):
    r = random.Random(seed)
    texts = ["Well.", "So?", "cut off", "", " \t", "Done!\n", "漢字。", "x.", " . "]
    out = []
    for c in range(n):
        for _ in range(r.randrange(1, most)):
            out.append((c if c else None, r.choice([None, 0, 1, 2, 3, 5, 9]), r.choice(["user", "assistant", "system", "tool", "", None, "unknown"]), r.choice([*texts, None])))
    return out


@pytest.mark.parametrize("bits", [cr.PIECE_BITS, 1])
def test_frames_equal_brute_force(spark, monkeypatch, bits):
    """With pieces of two turns conversations are linked over many pieces."""
    monkeypatch.setattr(cr, "PIECE_BITS", bits)
    rows = conversations(5, 60) + [(77, t, ("user", "assistant")[t % 2], f"turn {t % 300}.") for t in range(700)] + [(78, 4, "user", "same.")] * 90
    df = spark.createDataFrame([(*r, 1, 2, "x", "y", 3, 4) for r in rows], SCHEMA).repartition(5)
    assert run(df) == want(rows)


def test_damage_and_repaired_turns(spark, monkeypatch):
    monkeypatch.setattr(cr, "PIECE_BITS", 2)
    rows = conversations(9, 120)
    df = spark.createDataFrame([(*r, 1, 2, "x", "y", 3, 4) for r in rows], SCHEMA).repartition(4)
    hurt = cr.damage(df)
    assert sorted(rows_of(hurt), key=repr) == sorted(damaged(rows), key=repr)
    plans = cr.with_empty(cr.plan(hurt), df)
    told = {r.conv_id: r for r in plans.collect()}
    assert set(told) == {r[0] for r in rows}
    out = defaultdict(list)
    for r in cr.repaired(hurt, plans).orderBy("conv_id", "place").collect():
        out[r.conv_id].append(r)
    hashes = {r.conv_id: r.repaired_sha256 for r in cr.digests(hurt, plans).collect()}
    for c, r in told.items():
        assert "".join(x.edit for x in out[c]) == r.audit.replace("D", "")
        assert [x.place for x in out[c]] == list(range(len(out[c])))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in out[c]).encode()).hexdigest() == hashes[c]
    gone = set(told) - {r[0] for r in damaged(rows)}
    assert all(tuple(told[c])[1:] == (0, 0, 0, 0, 0, 0, "") for c in gone)


def test_empty_and_one_blank(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert run(df) == {} and cr.repaired(df, cr.plan(df)).count() == 0
    one = spark.createDataFrame([(None, None, None, None, 1, 2, "x", "y", 3, 4)], SCHEMA)
    assert run(one) == {None: (0, 1, 0, 0, 0, 4, "D", hashlib.sha256(b"").hexdigest())}


def test_query(spark):
    from hourpanel.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    expected = want(damaged(rows))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.01")
    assert got.columns == OPS
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {r[0]: expected.get(r[0], none) for r in rows}
