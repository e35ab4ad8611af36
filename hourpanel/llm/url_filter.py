"""URL filters by a Bloom filter cascade.

A list of keys is encoded exactly over the complete key universe of a corpus:
level one is a Bloom filter of the listed keys; level two one of the unlisted
keys of the universe that pass level one; level three one of the listed keys
that pass level two; and so on, until a level lets nothing false through.  For
a key of the universe the first level that rejects it tells whether it is
listed, so urls are judged by looking up bits, without a join.

Keys are compared by 128 bits of hash.  A cascade is built in slices of the
key space, each of at most ``SLICE_KEYS`` listed keys; a slice is what one
broadcast holds, and longer lists take more slices, not larger ones.

Defined cases: a null url, or one without ``://``, has an empty host and path,
which no rule fits and no list holds; rows that repeat are each judged; an empty
list or table gives empty filters and results; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship, splitmix, store

SLICE_KEYS = 1 << 21
FALSE_SHARE = 0.01  # of each level


def url_host(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?>(?s:.*?)://)[^/?#]*(/[^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and all that it is a subdomain of; none of an empty host."""
    labels = F.split(host, r"\.", -1)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))


def key_hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


@dataclass(frozen=True)
class Level:
    """A Bloom filter: ``bits`` 64-bit words, a probe for each of ``probes``."""
    number: int
    probes: int
    bits: np.ndarray

    def cells(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        size = np.uint64(64 * len(self.bits))
        for i in range(self.probes):
            with np.errstate(over="ignore"):
                yield splitmix(a + splitmix(b + np.uint64(1000 * self.number + i))) % size

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for c in self.cells(a, b):
            out &= (self.bits[(c >> np.uint64(6)).astype(np.int64)] >> (c & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def _listed(levels: Sequence[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact membership of keys of the universe."""
    alive = np.ones(len(a), bool)
    for n, level in enumerate(levels):
        alive[alive] = level.holds(a[alive], b[alive])
        if n == 0:
            member = alive.copy()  # what the first level rejects isn't listed
        else:  # a rejection by an even level (n odd) proves a listed key, one by an odd level an unlisted one
            member[reached & ~alive] = n % 2 == 1
            member[alive] = n % 2 == 0
        reached = alive.copy()
    return member if levels else np.zeros(len(a), bool)


@dataclass(frozen=True)
class Cascade:
    slices: tuple[tuple[Level, ...], ...]

    @property
    def bytes(self) -> int:
        return sum(x.bits.nbytes for s in self.slices for x in s)


def _slice_of(b: np.ndarray, slices: int) -> np.ndarray:
    return splitmix(b ^ np.uint64(0x5151515151515151)) % np.uint64(slices)


def _hash_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch[c].to_numpy(zero_copy_only=False).view(np.uint64) for c in ("a", "b"))


def build_cascade(universe: DataFrame, listed: DataFrame, false_share: float = FALSE_SHARE, slice_keys: int = SLICE_KEYS) -> Cascade:
    """Encode ``listed`` over ``universe`` (both: column ``key``).  Listed keys outside the universe don't matter.

    Spark marks the universe with one shuffle of 16-byte hashes and sums the
    bits of each level; the driver gets finished filters, of a bounded size.
    """
    def hashed(df, mark):
        return df.where("key is not null").select(key_hashes(F.col("key")).alias("h"), F.lit(mark).alias("m"))

    marked = hashed(universe, 1).unionByName(hashed(listed, 2)).groupBy("h.a", "h.b").agg(F.bit_or("m").alias("m"))
    keys = store(marked.where("m != 2").select("a", "b", (F.col("m") == 3).alias("listed")), "cascade-keys")
    total = keys.where("listed").count()
    n_slices = max(1, -(-total // slice_keys))
    return Cascade(tuple(_build_slice(keys, s, n_slices, false_share) for s in range(n_slices)))


def _build_slice(keys: DataFrame, s: int, n_slices: int, false_share: float) -> tuple[Level, ...]:
    levels: list[Level] = []
    while True:
        want, so_far = len(levels) % 2 == 0, tuple(levels)

        def survivors(batches, want=want, so_far=so_far):
            for batch in batches:
                batch = batch.filter(pa.compute.equal(batch["listed"], want))
                a, b = _hash_arrays(batch)
                keep = _slice_of(b, n_slices) == s
                for level in so_far:
                    keep[keep] = level.holds(a[keep], b[keep])
                yield a[keep], b[keep]

        def count(batches, survivors=survivors):
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(a) for a, _ in survivors(batches))], pa.int64())})

        n = ship(keys).mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
        if not n:
            return so_far
        probes = max(1, round(-np.log2(false_share)))
        words = max(1, int(np.ceil(n * probes / np.log(2) / 64)))
        shape = Level(len(levels) + 1, probes, np.zeros(words, np.uint64))

        def fill(batches, survivors=survivors, number=shape.number, probes=probes, words=words):
            level = Level(number, probes, np.zeros(words, np.uint64))
            for a, b in survivors(batches):
                for c in level.cells(a, b):
                    np.bitwise_or.at(level.bits, (c >> np.uint64(6)).astype(np.int64), np.uint64(1) << (c & np.uint64(63)))
            at = np.flatnonzero(level.bits)
            yield pa.RecordBatch.from_pydict({"word": pa.array(at, pa.int64()), "bits": pa.array(level.bits[at].view(np.int64))})

        got = ship(keys).mapInArrow(fill, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        shape.bits[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
        levels.append(shape)


def _lookup(shared, s: int, n: int):
    @F.pandas_udf("array<boolean>")
    def look(a: pd.Series, b: pd.Series) -> pd.Series:
        sizes = a.map(len).to_numpy()
        if not sizes.sum():
            return pd.Series([[]] * len(a))
        x, y = (np.concatenate(c.to_list()).astype(np.int64).view(np.uint64) for c in (a, b))
        hit = _listed(shared.value, x, y) & (_slice_of(y, n) == s)
        return pd.Series(np.split(hit, np.cumsum(sizes)[:-1]))

    return look


def is_listed(df: DataFrame, hashes: str, cascade: Cascade, out: str) -> DataFrame:
    """Adds ``out``: for the array ``hashes`` of key hashes, an array that tells which are listed.

    One broadcast and one lookup for each slice of the cascade.
    """
    n, df = len(cascade.slices), ship(df)
    parts = [_lookup(df.sparkSession.sparkContext.broadcast(levels), s, n)(F.col(f"{hashes}.a"), F.col(f"{hashes}.b"))
             for s, levels in enumerate(cascade.slices)]
    whole = parts[0]
    for p in parts[1:]:
        whole = F.zip_with(whole, p, lambda x, y: x | y)
    return df.withColumn(out, whole)


def judge_urls(pages: DataFrame, rules: DataFrame, blocked_hosts: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict.

    ``rules`` (host, path, verdict) fit a host and its subdomains where the path
    starts with theirs; the longest decides.  Where none fits, a url is blocked
    if its host is, or is a subdomain of, one of ``blocked_hosts`` (host).
    """
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null").distinct()
    # distinct lengths of paths: bounded by the longest rule
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    host, path, keys, tagged, hit = fresh(pages, "host", "path", "keys", "tagged", "hit")
    out = pages.withColumns({host: url_host(pages[url_col]), path: url_path(pages[url_col])})
    prefixes = F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: F.when(
        F.length(path) >= n, F.left(F.col(path), n))), lambda p: p.isNotNull())
    suffixes = host_suffixes(F.col(host))
    out = out.withColumn(keys, F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))))

    def tag(name, values):
        return F.transform(values, lambda v: F.concat(F.lit(f"{name} "), v))

    # one list holds the rules of either verdict and the hosts, told apart by a tag
    out = out.withColumn(tagged, F.concat(tag("allow", F.col(keys)), tag("block", F.col(keys)), tag("host", suffixes)))
    universe = out.select(F.explode(tagged).alias("key")).distinct()
    listed = rules.select(F.concat("verdict", F.lit(" "), "host", "path").alias("key")).unionByName(
        blocked_hosts.select(F.concat(F.lit("host "), "host").alias("key")))
    out = is_listed(out.withColumn(tagged, F.transform(tagged, key_hashes)), tagged, build_cascade(universe, listed), hit)
    n = F.size(keys)
    fit = F.filter(F.zip_with(keys, F.sequence(F.lit(0), n), lambda k, i: F.struct(
        F.length(k).alias("n"), k.alias("k"), F.get(F.col(hit), i).alias("x"), F.get(F.col(hit), i + n).alias("y"))),
        lambda e: e["x"] | e["y"])
    # all fitting rules are a suffix and a prefix of one host and path: the longest rule is the longest key
    best = F.get(F.sort_array(fit, asc=False), F.lit(0))
    host_hit = F.array_contains(F.slice(hit, 2 * n + 1, F.size(hit) - 2 * n), True)
    verdict = F.when(best["k"].isNotNull(), F.when(best["y"], "block").otherwise("allow")) \
        .otherwise(F.when(host_hit, "block").otherwise("allow"))
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*[pages[c] for c in names], F.col(host).alias("host"), F.col(path).alias("path"),
                      best["k"].alias("rule"), verdict.alias("verdict"))
