"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints that differ in at most d of 64 bits share at least 8 - d of
their 8 positional bytes.  A posting list of one positional byte holds 1/256
of the corpus, so the index lists each distinct fingerprint under every
combination of 8 - d positions with their bytes (70 lists for d = 4):
fingerprints meet in a list exactly if they share that many positional bytes.
The count is so met by construction: the tally of shared positional bytes
filters no pair of a list, and the bit distance is verified.  A pair may meet in
several lists; equal edges are made one.  A list of up to ``LIST_BLOCK``
fingerprints is searched where it is read.  A longer one is cut into blocks of
that size, and each pair of its blocks is searched as a group of its own, so
that the memory and time of a task stay bounded; the work of a list is still
quadratic in its distinct fingerprints.

A list or block is searched from one fingerprint at a time and only among those that
the search hasn't reached yet, which leaves a spanning forest of its links:
at most one edge for each fingerprint, however many pairs link.  Copies of one
fingerprint are one entry.  Components come from the forests.

Defined cases: a null or blank text has fingerprint zero, which links like any
other; a null doc_id takes part, but doesn't name a component unless all its
ids are null; rows that repeat are each returned; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship, store
from .components import components

SHINGLE = 4
MAX_BITS = 4
CHUNK = 1 << 15  # shingles hashed at a time
LIST_BLOCK = 1 << 14  # fingerprints of a list that one task searches; longer lists are cut


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set if it is set in over half the hashes of the text's word shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        size = min(CHUNK, n - at)
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), 42) for i in range(at, at + size)),
                        np.uint64, size)
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, text_key, fp) of each row: a hash that tells texts of one id apart, and the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b["text"]), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b["id"], b["text_key"], pa.array(fp.view(np.int64))], ["id", "text_key", "fp"])

    text = docs[text_col].cast("string")
    slim = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return ship(slim).mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, text_key long, fp long")


def index_entries(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(list, fp): every distinct fingerprint under each combination of 8 - max_bits positional bytes."""
    if not 0 <= max_bits < 8:
        raise ValueError("the byte index needs a distance below 8 bits")
    masks = []
    for subset in combinations(range(8), 8 - max_bits):
        mask = sum(0xFF << (8 * p) for p in subset)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    lists = F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.struct(
        m.alias("mask"), F.col("fp").bitwiseAND(m).alias("bytes")))
    return fps.select(F.explode(lists).alias("l"), "fp").select("l.mask", "l.bytes", "fp")


def _shared(a: np.ndarray, b: np.uint64) -> np.ndarray:
    """The tally: positional bytes each of ``a`` shares with ``b``."""
    return (((a ^ b).view(np.uint8).reshape(-1, 8)) == 0).sum(1)


def _near(rest: np.ndarray, x: np.uint64, max_bits: int) -> np.ndarray:
    near = _shared(rest, x) >= 8 - max_bits
    near[near] = np.bitwise_count(rest[near] ^ x) <= max_bits
    return near


def _forest(fps: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links among the fingerprints of one list or block."""
    rest = fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = _near(rest, x, max_bits)
            for y in rest[near]:
                yield x, y
            queue.extend(rest[near])
            rest = rest[~near]


def _cross_forest(a: np.ndarray, b: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links that lead from one block to another."""
    rest = [a, b]
    while len(rest[0]) and len(rest[1]):
        queue, rest[0] = [(0, rest[0][0])], rest[0][1:]
        while queue:
            side, x = queue.pop()
            other = rest[1 - side]
            near = _near(other, x, max_bits)
            for y in other[near]:
                yield x, y
            queue.extend((1 - side, y) for y in other[near])
            rest[1 - side] = other[~near]


def _search_lists(entries: DataFrame, max_bits: int, block: int) -> DataFrame:
    """Of entries sorted by list: (u, v) edges of short lists; (u, mask, bytes, block) for each entry of a longer one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)
        key, held, sent = None, none, 0  # the list being read, its fingerprints in hand, its blocks handed on
        edges, cut = [], []

        def close():
            if sent:
                cut.append((key, sent, held))
            elif len(held) > 1:
                edges.extend(_forest(held, max_bits))

        def flush():
            pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            sizes = [len(f) for _, _, f in cut]
            fill = pa.nulls(len(pairs), pa.int64())

            def per_block(values):
                return pa.concat_arrays([fill, pa.array(np.repeat(np.array(values, np.int64), sizes))])

            u = np.concatenate([pairs[:, 0], *[f.view(np.int64) for _, _, f in cut]])
            v = pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(sum(sizes), pa.int64())])
            out = [pa.array(u), v, per_block([k[0] for k, _, _ in cut]), per_block([k[1] for k, _, _ in cut]),
                   per_block([n for _, n, _ in cut])]
            edges.clear()
            cut.clear()
            return pa.RecordBatch.from_arrays(out, ["u", "v", "mask", "bytes", "block"])

        for b in batches:
            if not len(b):
                continue
            mask, own, fp = (b[c].to_numpy(zero_copy_only=False) for c in ("mask", "bytes", "fp"))
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (own[1:] != own[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
            for i in sorted({0, len(starts) - 1} | set(np.flatnonzero(ends - starts > 1))):
                own_key = (int(mask[starts[i]]), int(own[starts[i]]))
                if own_key != key:
                    close()
                    key, held, sent = own_key, none, 0
                held = np.concatenate([held, fp[starts[i]:ends[i]]])
                while len(held) > block:
                    cut.append((key, sent, held[:block]))
                    held, sent = held[block:], sent + 1
            if edges or cut:
                yield flush()
        close()
        if edges or cut:
            yield flush()

    return ship(entries).mapInArrow(run, "u long, v long, mask long, bytes long, block long")


def _search_blocks(cut: DataFrame, max_bits: int) -> DataFrame:
    """Edges (u, v) of long lists: each pair of a list's blocks is a group of its own, of at most two blocks."""
    def run(pair: pa.Table) -> pa.Table:
        i, j = pair["i"][0].as_py(), pair["j"][0].as_py()
        block, fp = pair["block"].to_numpy(), pair["u"].to_numpy().view(np.uint64)
        found = _forest(fp, max_bits) if i == j else _cross_forest(fp[block == i], fp[block == j], max_bits)
        out = np.array(list(found), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"u": out[:, 0], "v": out[:, 1]})

    lists = cut.groupBy("mask", "bytes").agg(F.max("block").alias("last"))
    met = cut.join(lists, ["mask", "bytes"]).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    pairs = met.select("mask", "bytes", F.least("block", "t").alias("i"), F.greatest("block", "t").alias("j"), "block", "u")
    return ship(pairs).groupBy("mask", "bytes", "i", "j").applyInArrow(run, "u long, v long")


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = LIST_BLOCK) -> DataFrame:
    """Edges (u, v) whose components are those of all links between the distinct fingerprints ``fps``."""
    entries = index_entries(fps, max_bits).repartition("mask", "bytes").sortWithinPartitions("mask", "bytes")
    found = store(_search_lists(entries, max_bits, block), "simhash-lists")
    edges = found.where("v is not null").select("u", "v")
    cut = found.where("v is null").select("mask", "bytes", "block", "u")
    if not cut.isEmpty():  # else no list is longer than a block
        edges = edges.unionByName(_search_blocks(cut, max_bits))
    return edges.distinct()


def _classes(docs, id_col, text_col, shingle, max_bits):
    """Stored (id, text_key, fp) of each row, and fp -> component_id and the text_key of the row that stays."""
    named = store(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = store(named.groupBy("fp").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "text_key"))).alias("least")), "simhash-nodes")
    roots = store(components(links(nodes.select("fp"), max_bits)), "simhash-roots")
    linked = nodes.join(roots, nodes["fp"] == roots["node"], "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = store(linked, "simhash-linked")
    names = store(linked.groupBy("root").agg(F.min("least").alias("keep")), "simhash-names") \
        .withColumnRenamed("root", "r")
    return named, store(linked.join(names, F.col("root") == F.col("r")).select(
        F.col("fp").alias("f"), F.col("keep.id").alias("component_id"), F.col("keep.text_key").alias("keep_key")), "simhash-classes")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                           max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``docs``: its id, fingerprint (hexadecimal), component_id."""
    named, classes = _classes(docs, id_col, text_col, shingle, max_bits)
    return named.join(classes, F.col("fp") == F.col("f")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with the row of the smallest id of each component; of several texts under that id, one.

    Equal texts under one id all stay (exact dedup removes them).  Rows without an id can't stand for a group or be named for removal; they stay.
    """
    named, classes = _classes(docs, id_col, text_col, shingle, max_bits)
    g, k = fresh(docs, "gone", "gone_key")
    gone = store(named.join(classes, F.col("fp") == F.col("f")).where("id != component_id or text_key != keep_key")
                 .select(F.col("id").alias(g), F.col("text_key").alias(k)).distinct(), "simhash-gone")
    return docs.join(gone, (docs[id_col] == gone[g]) & (F.xxhash64(docs[text_col].cast("string")) == gone[k]), "left_anti")
