"""Imputation operators that need no ordering (series fills live in ``series``).

Fill values come from one aggregate over the frame (or a grouped aggregate
joined back), then a ``coalesce`` projection.  Exact medians come from ranks
of counted values (``quantiles``), with bounded memory; ``exact=False`` takes
a sketch alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import bounded
from .quantiles import counted_quantiles

FLAG_PREFIXES = ("extreme_", "is_", "no_", "light_", "heavy_", "strong_", "calm_")
INTERACTION_MARKERS = ("interaction", "apparent_temp", "wind_chill")


def column_stats(df: DataFrame, cols: Sequence[str], how: str = "median", exact: bool = True) -> dict:
    """Mean or median per column.  Medians are exact with bounded memory; ``exact=False`` takes a sketch alone."""
    if not cols:
        return {}
    if how == "median" and exact:
        # counts by digit: no value is shuffled, however many distinct ones a column has
        return {c: v[0] for c, v in counted_quantiles(df, {c: [0.5] for c in cols}).items() if v[0] is not None}
    if how == "mean":
        aggs = [F.avg(c).alias(c) for c in cols]
    elif how == "median":
        aggs = [F.percentile_approx(c, 0.5, 100000).cast("double").alias(c) for c in cols]
    else:
        raise ValueError(how)
    row = df.agg(*aggs).first().asDict()
    return {k: v for k, v in row.items() if v is not None}


def impute(df: DataFrame, cols: Sequence[str], how: str = "mean", exact: bool = True) -> DataFrame:
    """Fill NULLs with the column mean or exact median."""
    return df.fillna(column_stats(df, cols, how, exact))


def impute_group_mean(df: DataFrame, cols: Sequence[str], by: Sequence[str], suffix: str = "", domain: int | None = None) -> DataFrame:
    """Fill NULLs with the mean of the row's group.

    A grouped aggregate (map-side combined) joined back on the group key:
    no window, so a hot group never lands in one task.  ``domain``: how many
    groups there can be (a literal domain's table is broadcast); else adaptive
    execution chooses the join from the measured size of the group table.
    """
    stats = df.groupBy(*by).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    out = df.join(bounded(stats, domain), list(by), "left")
    out = out.withColumns({f"{c}{suffix}": F.coalesce(F.col(c), F.col(f"__m_{c}")) for c in cols})
    return out.drop(*[f"__m_{c}" for c in cols])


def mode_values(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent non-null value per column; ties -> smallest value.

    All columns in one pass: unpivot to (variable, value), count per pair
    (map-side combined), arg-max per variable on the small count table.
    """
    if not cols:
        return {}
    types = dict(df.dtypes)
    parts = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in cols]
    counts = (df.select(F.inline(F.array(*parts))).filter(F.col("value").isNotNull())
              .groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n")))
    rows = counts.groupBy("variable").agg(
        # ties: numerically smallest for numeric columns, lexically smallest for text
        F.min_by(F.col("value"), F.struct(-F.col("n"), F.col("value").try_cast("double"), F.col("value"))).alias("m")
    ).collect()
    out = {}
    for r in rows:
        t = types[r["variable"]]
        v = r["m"]
        out[r["variable"]] = v if t == "string" else (float(v) if t in ("double", "float") else int(float(v)))
    return out


def impute_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.fillna(mode_values(df, cols))


def flag_columns(df: DataFrame, prefixes: Sequence[str] = FLAG_PREFIXES) -> list[str]:
    return [c for c in df.columns if c.startswith(tuple(prefixes))]


def impute_zero_flags(df: DataFrame, prefixes: Sequence[str] = FLAG_PREFIXES) -> DataFrame:
    cols = flag_columns(df, prefixes)
    return df.fillna(0, subset=cols) if cols else df


def interaction_columns(df: DataFrame, markers: Sequence[str] = INTERACTION_MARKERS) -> list[str]:
    return [c for c in df.columns if any(m in c for m in markers)]


def impute_interactions(df: DataFrame, markers: Sequence[str] = INTERACTION_MARKERS, exact: bool = True) -> DataFrame:
    return impute(df, interaction_columns(df, markers), "median", exact)


def impute_rain_zero(df: DataFrame, col: str = "rn_hr1", out: str = "rn_hr1_filled") -> DataFrame:
    return df.withColumn(out, F.coalesce(F.col(col), F.lit(0.0)))
