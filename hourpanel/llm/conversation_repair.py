"""Repair of conversation structure by a square-root checkpointed dynamic programme.

A conversation's turns, in order, become ``s?(ua)+`` (roles by their first
letter; or nothing) by the cheapest edits: keep, rerole, delete, insert.  A
state is what the last kept turn was; a turn is a matrix of least costs from
state to state, and costs to the end are vectors that such matrices carry
backward.

* The turns are cut into ranges by (conversation, turn, role, text), so that a
  conversation of any share of the table lies in many tasks, and numbered in
  order; a *piece* is a conversation's part of ``PIECE`` numbers.
* Each piece becomes the product of its turns' matrices; one row for each
  piece is gathered by conversation, and the cost vectors at the pieces' ends
  are found backward: the coarse checkpoints.
* Each piece is then walked forward from each state that it may be entered in
  (the first one from the start alone).  Costs are stored only at every
  square root of its length; a block's costs are computed anew from the next
  checkpoint when the walk gets there.  Of the edits that keep the cost least
  (the tight ones) the ASCII-least is taken.  All pieces of a batch walk in step.
* Gathered again, the walks are linked by the states they end in.

What is gathered for a conversation is a row for each ``PIECE`` turns, and its
audit, a string of a letter for each turn, which is the result itself; texts
travel once, for the repaired turns.

Order: by turn (nulls first); turns with equal numbers by role, then SHA-256 of
the text.  The first fault of a turn counts: blank (no character but
``[\\x20\\x09-\\x0D]``), duplicate (role and text seen earlier in the conversation),
truncated (its last such character isn't one of ``.!?``).

Defined cases: a null role or text is one space; a null conversation id is a
conversation, null turns come first and count in no gap; a conversation whose
turns are all blank or repeated is repaired to nothing; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, ship, store

PIECE_BITS = 13  # 8,192 turns
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
OK, TRUNCATED, BLANK, DUPLICATE = range(4)
# The costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, STAYS_TRUNCATED = 3, 4, 3, 3
NEXT = (USER, USER, ASSISTANT, USER)  # the role that may be inserted or given after each state
NEVER = 1 << 50
#: What can be done with a turn, inserts before it included, in ASCII order; no string begins another one.
CHOICES = sorted("I" * k + last for k in range(3) for last in "DKR")
#: Cost of the inserts that end a conversation in each state, and their letters.
ENDING = ("", "II", "I", "")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Cost and next state of each choice, by code (initial * 4 + fault) and state."""
    cost = np.full((len(CHOICES), 16, 4), NEVER, np.int64)
    to = np.zeros((len(CHOICES), 16, 4), np.int64)
    for a, choice in enumerate(CHOICES):
        for initial in range(4):
            for fault in range(4):
                for state in range(4):
                    now, paid = state, INSERT * (len(choice) - 1)
                    for _ in choice[:-1]:
                        now = NEXT[now]
                    stays = fault in (OK, TRUNCATED)
                    if choice[-1] == "D":
                        paid += DELETE
                    elif choice[-1] == "R" and stays:
                        paid, now = paid + REROLE, NEXT[now]
                    elif choice[-1] == "K" and stays and (initial + 1 == NEXT[now] or (initial, now) == (0, START)):
                        now = initial + 1
                    else:
                        continue
                    if choice[-1] != "D" and fault == TRUNCATED:
                        paid += STAYS_TRUNCATED
                    cost[a, initial * 4 + fault, state], to[a, initial * 4 + fault, state] = paid, now
    return cost, to


COST, TO = _tables()
#: Least cost of a turn of each code from state to state.
STEP = np.full((16, 4, 4), NEVER, np.int64)
for _a in range(len(CHOICES)):
    for _c in range(16):
        np.minimum.at(STEP[_c], (np.arange(4), TO[_a, _c]), COST[_a, _c])
END_COST = np.array([INSERT * len(x) for x in ENDING], np.int64)


class Pieces:
    """The codes of some pieces, which are walked in step, the longest first."""

    def __init__(self, codes: list[bytes]):
        self.order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
        self.size = np.array([len(codes[i]) for i in self.order], np.int64)
        self.flat = np.frombuffer(b"".join(codes[i] for i in self.order), np.uint8)
        self.begin = np.cumsum(self.size) - self.size
        self.longest = int(self.size[0]) if len(codes) else 0

    def active(self, i: int) -> int:
        """How many pieces have a turn ``i``; they come first."""
        return int(np.searchsorted(-self.size, -i, "left"))

    def back(self, i: int, costs: np.ndarray) -> np.ndarray:
        """Costs before turn ``i`` from those after it; a column for each way to go on from the piece's end."""
        m = self.active(i)
        out = costs.copy()
        step = STEP[self.flat[self.begin[:m] + i]]
        out[:m] = np.minimum((step[:, :, :, None] + costs[:m, None]).min(axis=2), NEVER)
        return out

    def matrices(self) -> np.ndarray:
        """Least cost of each piece from state to state."""
        out = np.full((len(self.size), 4, 4), NEVER, np.int64)
        out[:, range(4), range(4)] = 0
        for i in range(self.longest - 1, -1, -1):
            out = self.back(i, out)
        return self._restored(out)

    def _restored(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[self.order] = x
        return out

    def walk(self, ends: np.ndarray, first: np.ndarray) -> list[list[tuple[int, str] | None]]:
        """For each piece and state of entry the state it is left in and the ASCII-least tight choices.

        ``ends``: cost to go on from each state after the piece; ``first``: is it entered from the start alone?
        """
        end = ends[self.order][:, :, None]
        root = max(1, int(np.ceil(np.sqrt(self.longest))))
        marks, costs = {}, end
        for i in range(self.longest - 1, -1, -1):
            costs = self.back(i, costs)
            if i % root == 0:
                marks[i] = costs[:self.active(i)].copy()  # the others' costs are still those of their ends
        entries = [1 if f else 4 for f in first[self.order].tolist()]
        piece = np.repeat(np.arange(len(entries)), entries)
        entry = np.concatenate([np.arange(e) for e in entries]) if entries else np.zeros(0, np.int64)
        state = entry.copy()
        taken = np.full((len(piece), self.longest), -1, np.int8) if self.longest else np.zeros((len(piece), 0), np.int8)
        for low in range(0, self.longest, root):
            high = min(low + root, self.longest)
            block = {high: end.copy()}
            if high in marks:
                block[high][:len(marks[high])] = marks[high]
            for i in range(high - 1, low - 1, -1):
                block[i] = self.back(i, block[i + 1])
            for i in range(low, high):
                k = int(np.searchsorted(piece, self.active(i)))
                p, s = piece[:k], state[:k]
                code = self.flat[self.begin[p] + i]
                to = TO[:, code, s]
                tight = COST[:, code, s] + block[i + 1][p, to, 0] == block[i][p, s, 0]
                choice = tight.argmax(axis=0)
                taken[:k, i] = choice
                state[:k] = to[choice, np.arange(k)]
        out: list[list] = [[None] * 4 for _ in self.order]
        for t, (p, s, e) in enumerate(zip(piece.tolist(), entry.tolist(), state.tolist())):
            out[self.order[p]][s] = (e, "".join([CHOICES[c] for c in taken[t, :self.size[p]].tolist()]))
        return out


def _batches(items: list, weight: list[int], most: int = 1 << 20) -> Iterator[list[int]]:
    """Places in ``items``, in batches of like weights whose padded size is bounded."""
    group: list[int] = []
    for i in sorted(range(len(items)), key=lambda i: -weight[i]):
        if group and (len(group) + 1) * max(1, weight[group[0]]) > most:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


# --------------------------------------------------------------------------- turns
def _last(text: Column) -> Column:
    """The last character that isn't white space; empty if there is none."""
    return F.substring(F.rtrim(text, F.lit(ASCII_SPACE)), -1, 1)


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    told = [F.coalesce(rows[c].cast("string"), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))]
    return rows.select(rows[conv].alias("conv"), rows[turn].cast("long").alias("turn"), *told).withColumn(
        "digest", F.unhex(F.sha2("text", 256)))


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with faults put in by the CRC-32 of ``conv:turn``, modulo 20: dropped, emptied, without end marks, repeated, of role user."""
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(rows[c].cast("string"), F.lit(" ")) for c in (conv, turn)])) % 20
    d = rows.select(rows[conv].alias(conv), rows[turn].alias(turn), F.coalesce(rows[role].cast("string"), F.lit(" ")).alias(role),
                    F.coalesce(rows[text].cast("string"), F.lit(" ")).alias(text), kind.alias("__kind")).where(F.col("__kind") != 0)
    times = F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.select(conv, turn, F.when(F.col("__kind") == 4, "user").otherwise(d[role]).alias(role),
                    F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.translate(text, ".!?", "")).otherwise(d[text]).alias(text),
                    times.alias("__time")).drop("__time")


def _codes(turns: DataFrame) -> DataFrame:
    """Numbered turns (conv, number, turn, code); numbers grow in the turns' order."""
    last = _last(F.col("text"))
    fault = F.when(last == "", BLANK).when(F.instr(F.lit(".!?"), last) > 0, OK).otherwise(TRUNCATED)
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    slim = turns.select("conv", "turn", "role", "digest", fault.alias("fault"),
                        F.when((initial == 0) | (F.col("role") == ""), len(INITIALS)).otherwise(initial - 1).alias("initial"))
    by = ["conv", "turn", "role", "digest", "deal"]  # equal turns are dealt over the ranges too
    slim = slim.withColumn("deal", F.rand(0)).repartitionByRange(*by).sortWithinPartitions(*by).drop("deal")
    numbered = store(slim.withColumn("number", F.monotonically_increasing_id()), "turns")
    met = numbered.where(F.col("fault") != BLANK).groupBy("conv", "role", "digest").agg(F.min("number").alias("number"))
    marked = numbered.drop("role", "digest").join(met.select("number", F.lit(True).alias("new")), "number", "left")
    fault = F.when((F.col("fault") != BLANK) & F.col("new").isNull(), DUPLICATE).otherwise(F.col("fault"))
    return marked.select("conv", "number", "turn", (F.col("initial") * 4 + fault).cast("tinyint").alias("code"))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_SUMMARY = ("n_blank long, n_duplicate long, n_truncated long, n_illegal long, first_initial int, last_initial int, "
            "first_turn long, last_turn long, n_turns long, costs array<long>")


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A piece's codes, counts and matrix, from its list of (number, turn, code)."""
    for b in batches:
        lists = b["turns"]
        size = lists.value_lengths().to_numpy()
        begin = np.cumsum(size) - size
        inner = lists.flatten()
        code = np.ascontiguousarray(inner.field("code").to_numpy())
        known = inner.field("turn").is_valid().to_numpy(zero_copy_only=False)
        turn = inner.field("turn").fill_null(0).to_numpy()
        fault, initial = code & 3, code >> 2
        linked = np.ones(len(code), bool)
        linked[begin] = False  # the first of a piece has no neighbour before it
        pair = np.roll(initial, 1) * 4 + initial
        illegal = linked & ~np.isin(pair, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
        fresh = known & ~(linked & np.roll(known, 1) & (np.roll(turn, 1) == turn))

        def total(x):
            return pa.array(np.add.reduceat(x, begin) if len(x) else [], pa.int64())

        raw = code.astype(np.uint8)
        codes = [raw[a:a + n].tobytes() for a, n in zip(begin.tolist(), size.tolist())]
        costs = np.zeros((len(codes), 16), np.int64)
        for group in _batches(codes, [len(c) for c in codes]):
            costs[group] = Pieces([codes[i] for i in group]).matrices().reshape(-1, 16)
        any_known = np.logical_or.reduceat(known, begin) if len(known) else np.zeros(0, bool)
        first = np.minimum.reduceat(np.where(known, turn, np.iinfo(np.int64).max), begin) if len(code) else turn
        end = begin + size - 1
        cols = [b["conv"], b["head"], pa.array(codes, pa.binary()), *[total(x.astype(np.int64)) for x in (fault == BLANK, fault == DUPLICATE, fault == TRUNCATED, illegal)],
                pa.array(initial[begin], pa.int32()), pa.array(initial[end], pa.int32()),
                pa.array(first, pa.int64(), mask=~any_known), pa.array(turn[end], pa.int64(), mask=~known[end]), total(fresh.astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * len(codes) + 1, 16), pa.int32()), pa.array(costs.ravel()))]
        yield pa.RecordBatch.from_arrays(cols, ["conv", "head", "codes", *[x.split()[0] for x in _SUMMARY.split(", ")]])


def _conversation(pieces: list[dict]) -> tuple[list[int], int, list[np.ndarray]]:
    """Counts, least cost, and the costs to go on after each piece."""
    turns, gap_of = 0, [None, None]
    illegal, before = 0, None
    for p in pieces:
        illegal += p["n_illegal"]
        if before and (before["last_initial"], p["first_initial"]) not in ((0, 1), (1, 2), (2, 1)):
            illegal += 1
        turns += p["n_turns"]
        if p["first_turn"] is not None:
            if gap_of[0] is None:
                gap_of[0] = p["first_turn"]
            elif p["first_turn"] == gap_of[1]:
                turns -= 1
            gap_of[1] = p["last_turn"]
        before = p
    gaps = 0 if gap_of[0] is None else gap_of[1] - gap_of[0] + 1 - turns
    ends, costs = [], END_COST
    for p in reversed(pieces):
        ends.append(costs)
        costs = np.minimum((np.array(p["costs"]).reshape(4, 4) + costs).min(axis=1), NEVER)
    counts = [gaps, *[sum(p[f"n_{k}"] for p in pieces) for k in COUNTS[1:4]], illegal]
    return counts, int(costs[START]), ends[::-1]


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in range(9)]
        for pieces in b["pieces"].to_pylist():
            counts, cost, ends = _conversation(pieces)
            for k, (p, end) in enumerate(zip(pieces, ends)):
                for c, v in zip(cols, (p["head"], k == 0, end.tolist(), *counts, cost)):
                    c.append(v)
        kinds = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["head", "first", "ends", *COUNTS, "cost"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = b["codes"].to_pylist()
        ends = b["ends"].flatten().to_numpy().reshape(-1, 4)
        first = b["first"].to_numpy(zero_copy_only=False)
        walks: list = [None] * len(codes)
        for group in _batches(codes, [len(c) for c in codes], 1 << 18):
            for i, w in zip(group, Pieces([codes[i] for i in group]).walk(ends[group], first[group])):
                walks[i] = [{"state": x[0], "audit": x[1]} if x else None for x in w]
        kind = pa.list_(pa.struct([("state", pa.int32()), ("audit", pa.string())]))
        yield pa.RecordBatch.from_arrays([*[b[c] for c in ("conv", "head", *COUNTS, "cost")], pa.array(walks, kind)],
                                         ["conv", "head", *COUNTS, "cost", "walks"])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        audits = []
        for pieces in b["pieces"].to_pylist():
            state, out = START, []
            for p in pieces:
                out.append(p["walks"][state]["audit"])
                state = p["walks"][state]["state"]
            audits.append("".join(out) + ENDING[state])
        yield pa.RecordBatch.from_arrays([*[b[c] for c in ("conv", *COUNTS, "cost")], pa.array(audits, pa.string())],
                                         ["conv", *COUNTS, "cost", "audit"])


def plan(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: its faults, the least cost, and the edits' letters (D, I, K, R) in order."""
    kind = rows.schema[conv].dataType
    numbered = _codes(_turns(rows, conv, turn, role, text))
    listed = numbered.groupBy("conv", F.shiftright("number", PIECE_BITS).alias("piece")).agg(
        F.min("number").alias("head"), F.sort_array(F.collect_list(F.struct("number", "turn", "code"))).alias("turns"))

    def schema(*parts):
        fields = T._parse_datatype_string(", ".join(parts)).fields
        return T.StructType([T.StructField("conv", kind), *fields])

    longs = [f"{c} long" for c in (*COUNTS, "cost")]
    pieces = store(ship(listed.select("conv", "head", "turns")).mapInArrow(_summarise, schema("head long", "codes binary", _SUMMARY)), "pieces")
    gathered = pieces.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("head", *[x.split()[0] for x in _SUMMARY.split(", ")]))).alias("pieces"))
    marks = gathered.select("pieces").mapInArrow(_checkpoints, ", ".join(["head long, first boolean, ends array<long>", *longs]))
    walked = pieces.select("conv", "head", "codes").join(marks, "head").mapInArrow(
        _walk, schema("head long", *longs, "walks array<struct<state:int,audit:string>>"))
    linked = walked.groupBy("conv").agg(*[F.first(c).alias(c) for c in (*COUNTS, "cost")],
                                        F.sort_array(F.collect_list(F.struct("head", "walks"))).alias("pieces"))
    return linked.mapInArrow(_link, schema(*longs, "audit string")).withColumnRenamed("conv", conv)


# --------------------------------------------------------------------------- repaired turns
def _stream(rows: DataFrame, plans: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
    """Each conversation's plan, then its turns in order; a conversation lies in one task, row after row."""
    t = _turns(rows, *names)
    named = [c for c in plans.columns if c != names[0]]
    told = F.struct(*[plans[c] for c in named])
    plan_rows = plans.select(plans[names[0]].alias("conv"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"),
                             F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit("").alias("text"), told.alias("plan"))
    turn_rows = t.select("conv", F.lit(1).alias("kind"), "turn", "role", "digest", "text", F.lit(None).cast(plan_rows.schema["plan"].dataType).alias("plan"))
    both = plan_rows.unionByName(turn_rows)
    return both.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest").select("conv", "kind", "turn", "role", "text", "plan")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, its plan or None, letter, turn, role, text) of each edit; a plan comes before its edits.

    Holds one turn at a time.
    """
    audit, at, state, conv = "", 0, START, None
    names = ("user", "assistant")

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, NEXT[state]
            yield conv, None, "I", None, names[state - USER], ""

    for b in batches:
        for c, kind, turn, role, text, told in zip(*[b[x].to_pylist() for x in ("conv", "kind", "turn", "role", "text", "plan")]):
            if kind == 0:
                yield from inserts()  # those that end the conversation before
                audit, at, state, conv = told["audit"], 0, START, c
                yield conv, told, "", None, "", ""
                continue
            yield from inserts()
            letter = audit[at]
            at += 1
            if letter == "R":
                state = NEXT[state]
                role = names[state - USER]
            elif letter == "K":
                state = INITIALS.index(role[0]) + 1
            yield conv, None, letter, turn, role, text
    yield from inserts()


def repaired(rows: DataFrame, plans: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired turns: conversation, place (from 0), edit (I, K or R), turn (null if inserted), role and text."""
    kind, names = rows.schema[conv].dataType, [conv, "place", "edit", turn, role, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out = 0, []

        def flush():
            cols = zip(*out) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for b in batches:
            conv_type = b.schema.field("conv").type
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            break
        else:
            return
        for c, told, letter, number, who, said in _edited(_chained(b, batches)):
            if told is not None:
                place = 0
            elif letter != "D":
                out.append((c, place, letter, number, who, said))
                place += 1
            if len(out) >= 4096:
                yield flush()
                out = []
        yield flush()

    schema = T.StructType([T.StructField(conv, kind), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()),
                           T.StructField(turn, T.LongType()), T.StructField(role, T.StringType()), T.StructField(text, T.StringType())])
    return ship(_stream(rows, plans, (conv, turn, role, text))).mapInArrow(run, schema)


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def digests(rows: DataFrame, plans: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``plans`` with ``repaired_sha256``: SHA-256 of the repaired turns as ``role:text``, joined by line feeds.

    The turns pass through the hash one by one: SHA-256 is sequential, so a conversation is hashed in one task,
    which holds one batch of it at a time.
    """
    named = [c for c in plans.columns if c != conv]
    schema = T.StructType([plans.schema[conv], *[plans.schema[c] for c in named], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, told, sha, key, any_turn = [], None, None, None, False

        def flush(conv_type, plan_type):
            keys, plans_, hashes = zip(*done) if done else ((), (), ())
            cols = [pa.array([p[c] for p in plans_], plan_type.field(c).type) for c in named]
            return pa.RecordBatch.from_arrays([pa.array(keys, conv_type), *cols, pa.array(hashes, pa.string())], schema.names)

        for b in batches:
            conv_type, plan_type = b.schema.field("conv").type, b.schema.field("plan").type
            break
        else:
            return
        for c, new, letter, _, who, said in _edited(_chained(b, batches)):
            if new is not None:
                if told is not None:
                    done.append((key, told, sha.hexdigest()))
                key, told, sha, any_turn = c, new, hashlib.sha256(), False
                if len(done) >= 4096:
                    yield flush(conv_type, plan_type)
                    done = []
            elif letter != "D":
                sha.update(f"{chr(10) if any_turn else ''}{who}:{said}".encode())
                any_turn = True
        if told is not None:
            done.append((key, told, sha.hexdigest()))
        yield flush(conv_type, plan_type)

    return ship(_stream(rows, plans, (conv, turn, role, text))).mapInArrow(run, schema)


def with_empty(plans: DataFrame, original: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``plans`` with a row of zeros and an empty audit for every conversation of ``original`` that has no turn left."""
    zero = original.select(original[conv].alias(conv), *[F.lit(0).cast("long").alias(c) for c in (*COUNTS, "cost")], F.lit("").alias("audit"))
    held = [c for c in plans.columns if c != conv]
    both = plans.withColumn("__held", F.lit(1)).unionByName(zero.distinct().withColumn("__held", F.lit(0)))
    best = both.groupBy(conv).agg(F.max(F.struct("__held", *held)).alias("__best"))
    return best.select(conv, *[F.col("__best")[c].alias(c) for c in held])
