"""Cleaning expressions: coded missing values, range gates, clipping.

All are row expressions; thresholds that depend on the data (IQR fences)
come from one aggregate and are applied as literals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._util import col_of
from ..operators.quantiles import exact_quantiles

# ---------------------------------------------------------------------------
# Coded missing values used by the weather source.
SENTINEL = [-99]
SENTINELS_ALL = [-99, -9999, 999, -999, 9999, -88, -77]
# Valid ranges (inclusive) of the weather measures.
VALID_RANGES = {"ta": (-50.0, 60.0), "hm": (0.0, 100.0), "ws": (0.0, None), "rn_hr1": (0.0, None)}
NIGHT_HOURS = [0, 1, 2, 3, 4, 5, 6, 19, 20, 21, 22, 23]
WEATHER_COLUMNS = ["ta", "ws", "rn_hr1", "hm", "si"]
# ---------------------------------------------------------------------------


def null_if_in(c: str | Column, values: Sequence[float]) -> Column:
    x = col_of(c)
    return F.when(~x.isin([float(v) for v in values]) & ~F.isnan(x), x)


def null_sentinels(df: DataFrame, cols: Sequence[str], values: Sequence[float] = SENTINEL) -> DataFrame:
    """Sentinel (and NaN) -> NULL for each column."""
    return df.withColumns({c: null_if_in(c, values) for c in cols if c in df.columns})


def sentinel_counts(df: DataFrame, cols: Sequence[str], values: Sequence[float] = SENTINEL) -> DataFrame:
    """One row: per column, how many rows carry a coded missing value."""
    return df.agg(*[F.count_if(F.col(c).isin([float(v) for v in values])).cast("long").alias(f"{c}_sentinels")
                    for c in cols])


def null_negative(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in cols})


def null_out_of_range(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]] = VALID_RANGES
                      ) -> DataFrame:
    """Values outside an inclusive [lo, hi] (either side optional) -> NULL."""
    out = {}
    for c, (lo, hi) in ranges.items():
        if c not in df.columns:
            continue
        x = F.col(c)
        ok = F.lit(True)
        if lo is not None:
            ok = ok & (x >= F.lit(float(lo)))
        if hi is not None:
            ok = ok & (x <= F.lit(float(hi)))
        out[c] = F.when(ok, x)
    return df.withColumns(out)


def clean_weather(df: DataFrame, cols: Sequence[str] = WEATHER_COLUMNS,
                  sentinels: Sequence[float] = SENTINELS_ALL,
                  ranges: Mapping[str, tuple] = VALID_RANGES) -> DataFrame:
    """Sentinels (and NaN) and out-of-range values -> NULL, in one expression per column.

    Same result as ``null_sentinels`` followed by ``null_out_of_range``, but a
    single CASE level: when a later filter (e.g. ``dropna``) is pushed below
    this projection, the optimizer inlines the expression, and nested levels
    would multiply the copies of the input expression and fall out of
    whole-stage codegen.
    """
    out = {}
    for c in list(dict.fromkeys([*cols, *ranges])):
        if c not in df.columns:
            continue
        x = F.col(c)
        bad = F.lit(False)
        if c in cols:
            bad = bad | x.isin([float(v) for v in sentinels]) | F.isnan(x)
        if c in ranges:
            lo, hi = ranges[c]
            if lo is not None:
                bad = bad | (x < F.lit(float(lo)))
            if hi is not None:
                bad = bad | (x > F.lit(float(hi)))
        out[c] = F.when(~bad, x)
    return df.withColumns(out)


def iqr_fences(df: DataFrame, cols: Sequence[str], k: float = 1.5, exact: bool = True
               ) -> dict[str, tuple[float, float]]:
    """Q1 - k*IQR, Q3 + k*IQR per column (exact quartiles; ``exact=False`` takes a sketch alone)."""
    probs = [0.25, 0.75]
    if exact:
        quartiles = exact_quantiles(df, {c: probs for c in cols})
    else:
        quartiles = df.agg(*[F.percentile_approx(F.col(c), probs, 100000).alias(c) for c in cols]).first().asDict()
    fences = {}
    for c in cols:
        q1, q3 = quartiles[c] if quartiles[c] is not None else (None, None)
        if q1 is None:
            continue
        iqr = q3 - q1
        fences[c] = (q1 - k * iqr, q3 + k * iqr)
    return fences


def iqr_clip(df: DataFrame, cols: Sequence[str], k: float = 1.5, exact: bool = True) -> DataFrame:
    fences = iqr_fences(df, cols, k, exact)
    # greatest/least skip NULLs, so a missing value is kept missing explicitly
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)))
                           for c, (lo, hi) in fences.items()})


def to_numeric(c: str | Column) -> Column:
    """Text -> double; unparseable text -> NULL."""
    return col_of(c).cast("string").try_cast("double")


def zero_at_night(df: DataFrame, col: str = "si", hour: str | Column = "hour",
                  hours: Sequence[int] = NIGHT_HOURS) -> DataFrame:
    return df.withColumn(col, F.when(col_of(hour).isin(list(hours)), F.lit(0.0)).otherwise(F.col(col)))
