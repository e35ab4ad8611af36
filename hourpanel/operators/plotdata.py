"""Data behind charts: histograms on one and two axes and box statistics.

Rendering is out of scope; these are the aggregates a chart needs, so the
same chart can be drawn from a cluster-size table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the column's min and max (two scalar
    aggregates, then one grouped count); the max falls in the last bin."""
    lo, hi = df.select(F.min(col), F.max(col)).first()
    width = (hi - lo) if hi is not None and hi != lo else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width) * bins).cast("long"), F.lit(bins - 1))
    out = df.filter(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).cast("long").alias("n"))
    return out.withColumn("x_left", F.lit(lo) + F.lit(width) * F.col("bin") / bins)


def box_stats(df: DataFrame, col: str) -> DataFrame:
    q = exact_quantiles(df, {col: [0.25, 0.5, 0.75]})[col]
    return df.sparkSession.createDataFrame(list(zip(("box_q1", "box_median", "box_q3"), q)), "kind string, x double")


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Row counts on an equal-width grid over the range of two columns: the
    data of a scatter chart, over all rows.  Rows with a missing value have no
    place in the chart; the max falls in the last bin of its axis."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    row = d.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()

    def axis(c, lo, hi):
        width = (hi - lo) if hi is not None and hi != lo else 1.0
        return F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(width) * bins).cast("long"), F.lit(bins - 1)).alias(f"{c}_bin")
    return d.groupBy(axis(x, *row[:2]), axis(y, *row[2:])).agg(F.count(F.lit(1)).cast("long").alias("n"))


def kde_binned(df: DataFrame, col: str, bins: int = 512, grid: int = 100, bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density on a grid, from a fine histogram (binned KDE).

    The data pass is one grouped count into ``bins`` bins; the kernel sum runs
    over the (bins x grid) small table built by exploding the literal grid on
    each bin row, so the cost of the second step does not grow with the rows.
    Bandwidth defaults to Scott's rule (std * n^(-1/5)).
    """
    st = df.select(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(col).alias("n"),
                   F.stddev_samp(col).alias("sd")).first()
    lo, hi, n, sd = st["lo"], st["hi"], st["n"], st["sd"]
    h = bandwidth or sd * n ** (-0.2)
    width = (hi - lo) / bins if hi != lo else 1.0
    hist = histogram(df, col, bins).withColumn("c", F.lit(lo) + (F.col("bin") + 0.5) * F.lit(width))
    g0, g1 = lo - 3 * h, hi + 3 * h
    points = [g0 + (g1 - g0) * i / (grid - 1) for i in range(grid)]
    pairs = hist.select("c", "n", F.explode(F.array(*[F.lit(p) for p in points])).alias("x"))
    z = (F.col("x") - F.col("c")) / F.lit(h)
    dens = pairs.groupBy("x").agg(F.sum(F.col("n") * F.exp(-0.5 * z * z)).alias("s"))
    return dens.select("x", (F.col("s") / F.lit(n * h * (2 * 3.141592653589793) ** 0.5)).alias("density"))
