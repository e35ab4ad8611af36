"""Row filters and column projections.

Filters are plain predicates so Catalyst pushes them to the parquet scan;
projections inspect the schema on the driver (never the data) except
``drop_sparse`` which measures missing shares in one aggregate per frame.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._util import col_of, numeric_columns

# ---------------------------------------------------------------------------
# Complete-set column lists and name-cleaning replacements.
SET_COMPLETE = ["ta", "ws", "rn_hr1", "hm", "si", "ta_chi"]
SET_BASIC = ["ta", "ws", "rn_hr1", "hm"]
SET_INTERPOLATED = ["ta_interpolated", "ws_interpolated", "rn_hr1_filled", "hm_interpolated", "si"]
CLOSED_HOURS = [1, 2, 3, 4]
NAME_REPLACEMENTS = [
    ("%", "pct"), ("(", "_"), (")", "_"), ("[", "_"), ("]", "_"), (":", "_"), (" ", "_"), ("-", "_"),
    ("/", "_"), (".", "_"), (",", "_"), ("&", "and"), ("+", "plus"), ("*", "mult"), ("=", "eq"),
    ("<", "lt"), (">", "gt"), ("!", "not"), ("?", "q"), ("@", "at"), ("#", "hash"), ("$", "dollar"),
]
# ---------------------------------------------------------------------------


def drop_service_hours(df: DataFrame, hour: str = "hour", hours: Sequence[int] = CLOSED_HOURS) -> DataFrame:
    return df.filter(~F.col(hour).isin(list(hours)))


def filter_months_station(df: DataFrame, months: Sequence[int], station: str | None = None,
                          tm: str = "tm", station_col: str = "station_name") -> DataFrame:
    """Month set (by integer arithmetic on ``tm``, so it prunes like a column
    predicate) and optionally one station."""
    cond = (F.floor(F.col(tm) / 10000) % 100).isin(list(months))
    if station is not None:
        cond = cond & (F.col(station_col) == station)
    return df.filter(cond)


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def complete_set_shares(df: DataFrame, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Size and share of each complete-row set, one pass over the frame."""
    aggs = [F.count(F.lit(1)).cast("long").alias("rows")]
    for name, cols in sets.items():
        cond = F.lit(True)
        for c in cols:
            cond = cond & F.col(c).isNotNull()
        aggs.append(F.count_if(cond).cast("long").alias(name))
    out = df.agg(*aggs)
    return out.withColumns({f"{n}_share": F.col(n) / F.col("rows") for n in sets})


def select_dataset(df: DataFrame, mode: str = "basic") -> DataFrame:
    sets = {"complete": SET_COMPLETE, "basic": SET_BASIC,
            "interpolated": ["ta_interpolated", "ws_interpolated", "rn_hr1_filled", "hm_interpolated"]}
    missing = [c for c in sets[mode] if c not in df.columns]
    if missing:
        raise ValueError(f"data set {mode!r} needs the columns {missing}")
    return complete_rows(df, sets[mode])


def slice_stats(df: DataFrame, y: str, **equals) -> DataFrame:
    """Conjunctive equality slice (e.g. station, hour, weekday, rain) -> mean, max, rows."""
    cond = F.lit(True)
    for c, v in equals.items():
        if v is not None:
            cond = cond & (F.col(c) == F.lit(v))
    return df.filter(cond).agg(F.avg(y).alias("mean"), F.max(y).alias("max"),
                               F.count(F.lit(1)).cast("long").alias("rows"))


def log1p_columns(df: DataFrame, cols: Sequence[str], suffix: str = "_log") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": F.log1p(col_of(c)) for c in cols})


def clean_name(name: str) -> str:
    out = name
    for a, b in NAME_REPLACEMENTS:
        out = out.replace(a, b)
    out = re.sub("_{2,}", "_", out)
    return out.strip("_")


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


def numeric_features(train: DataFrame, test: DataFrame | None = None, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns present in both frames, minus excluded names (schema only)."""
    cols = numeric_columns(train, exclude)
    if test is not None:
        tcols = set(test.columns)
        cols = [c for c in cols if c in tcols]
    return cols


def sparse_columns(frames: Sequence[DataFrame], cols: Sequence[str], threshold: float = 0.5) -> list[str]:
    """Columns whose missing share exceeds ``threshold`` in any frame (one aggregate per frame)."""
    drop = set()
    for f in frames:
        row = f.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]).first()
        drop |= {c for c in cols if row[c] is not None and row[c] > threshold}
    return [c for c in cols if c in drop]


def drop_sparse(train: DataFrame, test: DataFrame, cols: Sequence[str], threshold: float = 0.5):
    bad = sparse_columns([train, test], cols, threshold)
    return train.drop(*bad), test.drop(*bad), [c for c in cols if c not in bad]
