"""Join and set operators (all hash equi-joins).

A side is hinted only if its keys have a literal domain (``domain``: hours,
weekdays); else adaptive execution picks broadcast or sort-merge from the
measured shuffle size and splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Key combinations up to which a literal domain's table is broadcast.
BROADCAST_DOMAIN = 10_000


def bounded(side: DataFrame, domain: int | None) -> DataFrame:
    """``side`` with a broadcast hint if its keys can have only ``domain`` combinations: without it, the other side of a
    join on 24 hours would be shuffled onto 24 keys."""
    return F.broadcast(side) if domain is not None and domain <= BROADCAST_DOMAIN else side


def join_group_mean(df: DataFrame, keys: Sequence[str], value: str, suffix: str = "_hour_day_avg", domain: int | None = None) -> DataFrame:
    """Inner-merge the mean of ``value`` per key combination back onto the rows; ``domain``: how many combinations there can be."""
    means = df.groupBy(*keys).agg(F.avg(value).alias(f"{value}{suffix}"))
    return df.join(bounded(means, domain), list(keys), "inner")


def outer_align(left: DataFrame, right: DataFrame, key: str, lcol: str, rcol: str, diff: str = "diff") -> DataFrame:
    """Full outer join of two keyed results; difference where both exist."""
    out = left.join(right, key, "full_outer")
    return out.withColumn(diff, F.col(lcol) - F.col(rcol))


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys present in both frames (set intersection)."""
    return a.select(key).distinct().intersect(b.select(key).distinct())


def keep_common(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Filter both frames to the keys they share (left-semi joins)."""
    keys = common_keys(a, b, key)
    return a.join(keys, key, "left_semi"), b.join(keys, key, "left_semi")


def keep_in(df: DataFrame, keys_df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a (top) list: left-semi join."""
    return df.join(keys_df.select(key), key, "left_semi")


def map_back(df: DataFrame, values: DataFrame, key: Sequence[str], value: str, fallback: str,
             out: str | None = None) -> DataFrame:
    """Left-join per-row values by row key; rows without one keep ``fallback``."""
    v = values.select(*key, F.col(value).alias("__mb"))
    res = df.join(v, list(key), "left")
    return res.withColumn(out or value, F.coalesce(F.col("__mb"), F.col(fallback))).drop("__mb")


def stack(frames: Sequence[DataFrame], tags: Sequence | None = None, tag_col: str = "source") -> DataFrame:
    """Union by column name, optionally tagging each input."""
    out = None
    for i, f in enumerate(frames):
        g = f.withColumn(tag_col, F.lit(tags[i])) if tags is not None else f
        out = g if out is None else out.unionByName(g, allowMissingColumns=True)
    return out


def distinct_union(frames: Sequence[DataFrame], col: str) -> DataFrame:
    out = None
    for f in frames:
        g = f.select(col)
        out = g if out is None else out.union(g)
    return out.distinct()


def one_hot_columns(df: DataFrame, col: str, values: Sequence, prefix: str | None = None) -> DataFrame:
    """Append 0/1 dummy columns for a known category domain (no positional join)."""
    p = prefix or col
    return df.withColumns({f"{p}_{v}": (F.col(col) == F.lit(v)).cast("int") for v in values})
