"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v.

    Large: each node links its larger neighbours to the smallest node it knows.
    Small: it links its smaller neighbours, and itself, to the smallest.
    The minima are stored, so that the join back is a plain one, which Spark
    can broadcast by size or split at a hot node.
    """
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = store(least.select(F.col("u").alias("w"), (F.least("u", "m") if large else F.col("m")).alias("m")), "cc-least")
    met = pairs.join(least, F.col("u") == F.col("w"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return store(out.distinct(), "cc-edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v; any direction, repeats and loops allowed).

    Root is the component's smallest node.  Alternating star steps until
    nothing moves: a chain of n nodes takes about log n rounds.  Only a count
    and a checksum of each round reach the driver.
    """
    edges = store(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")

    def mark(e):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    before, now = None, mark(edges)
    while before != now:
        edges = _star(_star(edges, large=True), large=False)
        before, now = now, mark(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
