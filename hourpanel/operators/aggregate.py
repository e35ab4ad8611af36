"""Grouped summaries, pivots, value counts and effect tables.

Every operator is one (or a few) partial/final hash aggregates: the map
side combines before the shuffle, so a hot group costs one row per task in
the exchange, never a whole group in one task.  Several conditions are
answered by a single pass (conditional aggregates or an ``unpivot`` of the
condition labels) instead of one scan per condition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._util import col_of
from .quantiles import quantiles_with

STAT_FUNCS = {
    "count": lambda c: F.count(c).cast("long"),
    "mean": F.avg,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
}


def describe(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """count, mean, std, min, 25%, 50%, 75%, max per column, long format.

    One aggregate over all columns, which also starts the search of the exact
    quartiles (``exact=False`` takes those of a sketch).
    """
    probs = [0.25, 0.5, 0.75]
    stats = [e for c in cols for e in (F.count(c), F.avg(c), F.stddev_samp(c), F.min(c).cast("double"), F.max(c).cast("double"))]
    if exact:
        quartiles, got = quantiles_with(df, {c: probs for c in cols}, stats)
    else:
        got = list(df.agg(*[e.alias(f"a{i}") for i, e in enumerate(stats + [F.percentile_approx(c, probs, 100000).cast("array<double>") for c in cols])]).first())
        quartiles = {c: q or [None] * 3 for c, q in zip(cols, got[len(stats):])}
    rows = []
    for i, c in enumerate(cols):
        n, mean, std, low, high = got[5 * i:5 * i + 5]
        rows.append((c, n, *[None if v is None else float(v) for v in (mean, std, low, *quartiles[c], high)]))
    return df.sparkSession.createDataFrame(rows, "variable string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")


def group_stats(df: DataFrame, keys: Sequence[str | Column], value: str,
                stats: Sequence[str] = ("count", "mean", "std", "min", "max"), prefix: str = "") -> DataFrame:
    return df.groupBy(*keys).agg(*[STAT_FUNCS[s](F.col(value)).alias(f"{prefix}{s}") for s in stats])


def group_mean(df: DataFrame, keys: Sequence[str | Column], value: str, alias: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(alias or f"mean_{value}"))


def label_ranges(df: DataFrame, label: str, value: str) -> DataFrame:
    """min/max/mean/count of a value per its own label (check of a binning)."""
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
        F.count(value).cast("long").alias("count"))


def pivot_mean(df: DataFrame, index: Sequence[str], column: str, value: str,
               column_values: Sequence | None = None, fill: float | None = None, agg: str = "mean") -> DataFrame:
    """Wide table index x column values.

    Pass ``column_values`` (the known domain, e.g. 0..6) so Spark does not
    run an extra job to discover them; columns come out in that order.
    """
    g = df.groupBy(*index).pivot(column, list(column_values) if column_values is not None else None)
    fn = {"mean": "avg", "count": "count", "sum": "sum"}[agg]
    out = getattr(g, fn)(value) if agg != "count" else g.count()
    if fill is not None:
        out = out.fillna(fill)
    return out


def value_counts(df: DataFrame, col: str | Column, name: str = "value") -> DataFrame:
    """Frequency per value including missing, with share of all rows.

    The total is a scalar subquery over the counts, so no task holds all values.
    """
    counts = df.groupBy(col_of(col).alias(name)).agg(F.count(F.lit(1)).cast("long").alias("count"))
    return counts.withColumn("share", F.col("count") / counts.select(F.sum("count")).scalar())


def rate(df: DataFrame, conds: Mapping[str, Column]) -> DataFrame:
    """Count and share of rows meeting each predicate, one pass."""
    aggs = [F.count(F.lit(1)).cast("long").alias("rows")]
    for name, c in conds.items():
        aggs += [F.count_if(c).cast("long").alias(f"{name}_count"),
                 F.avg(F.coalesce(c.cast("int"), F.lit(0))).alias(f"{name}_share")]
    return df.agg(*aggs)


def peak_values(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Per column: key at the max / min of the column's per-key mean, and the values.

    One grouped mean, then ``max_by``/``min_by`` over the (small) grouped result.
    """
    means = df.groupBy(key).agg(*[F.avg(c).alias(c) for c in cols])
    parts = [F.struct(F.lit(c).alias("variable"), F.col(c).alias("v")) for c in cols]
    long = means.select(key, F.inline(F.array(*parts)))
    # tie-break on the key so the arg-max is deterministic
    return long.groupBy("variable").agg(
        F.max_by(F.col(key), F.struct(F.col("v"), -F.col(key))).alias(f"max_{key}"),
        F.max("v").alias("max_value"),
        F.min_by(F.col(key), F.struct(F.col("v"), F.col(key))).alias(f"min_{key}"),
        F.min("v").alias("min_value"))


def reindex(df: DataFrame, key: str, domain: Sequence, fill: Mapping[str, object] | None = None) -> DataFrame:
    """Left-join a grouped result onto its full key domain; absent -> fill.

    The domain is a literal array (bounded by construction), exploded in one row.
    """
    spark = df.sparkSession
    dom = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in domain])).alias(key))
    out = dom.join(df, key, "left")
    return out.fillna(dict(fill)) if fill else out


def effect_table(df: DataFrame, y: str, labels: Mapping[str, Column]) -> DataFrame:
    """Mean of ``y`` per condition value and % change from the overall mean.

    All condition kinds are unpivoted into (kind, value) and averaged in one
    aggregate; the overall mean is a second tiny aggregate joined as a scalar.
    """
    parts = [F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in labels.items()]
    long = df.select(F.col(y), F.inline(F.array(*parts))).filter(F.col("value").isNotNull())
    means = long.groupBy("kind", "value").agg(F.avg(y).alias("mean"), F.count(y).cast("long").alias("n"))
    overall = df.select(F.avg(y)).scalar()
    return means.withColumn("overall", F.lit(overall).cast("double")).withColumn(
        "pct_change", (F.col("mean") - F.col("overall")) / F.col("overall") * 100)


def conditional_means(df: DataFrame, y: str, conds: Mapping[str, Column]) -> DataFrame:
    """One row: mean of y under each condition plus the overall mean."""
    aggs = [F.avg(y).alias("overall")]
    aggs += [F.avg(F.when(c, F.col(y))).alias(n) for n, c in conds.items()]
    return df.agg(*aggs)


def split_mean_diff(df: DataFrame, key: str, y: str, cond: Column, a: str = "rainy", b: str = "dry") -> DataFrame:
    """Per key: mean y when cond, when not cond, difference and % (one aggregate)."""
    out = df.groupBy(key).agg(F.avg(F.when(cond, F.col(y))).alias(f"{a}_mean"),
                              F.avg(F.when(~cond, F.col(y))).alias(f"{b}_mean"))
    return out.withColumns({
        "diff": F.col(f"{a}_mean") - F.col(f"{b}_mean"),
        "pct": (F.col(f"{a}_mean") - F.col(f"{b}_mean")) / F.col(f"{b}_mean") * 100,
    })


def support_filter(df: DataFrame, key: str | Column, y: str, min_count: int) -> DataFrame:
    """Mean per key kept only where the key has more than ``min_count`` rows (HAVING)."""
    return (df.groupBy(col_of(key).alias("key") if not isinstance(key, str) else key)
            .agg(F.count(F.lit(1)).cast("long").alias("n"), F.avg(y).alias("mean"))
            .filter(F.col("n") > min_count))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k: ``orderBy().limit()`` plans as TakeOrderedAndProject
    (per-partition top-k, then a k-row merge), never a full sort."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    from pyspark.sql import Window
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__rk", F.row_number().over(w)).filter(F.col("__rk") <= k).drop("__rk")
