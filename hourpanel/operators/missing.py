"""Missing-value profiling: one aggregate per question, long-format results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: null count and %; plus a 'complete_rows' row (all listed columns present)."""
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    aggs = [F.count(F.lit(1)).alias("__rows"), F.count_if(complete).alias("__complete")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"__n_{c}") for c in cols]
    wide = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("variable"), F.col(f"__n_{c}").cast("long").alias("count"),
                      (F.col(f"__n_{c}") / F.col("__rows") * 100).alias("pct")) for c in cols]
    parts.append(F.struct(F.lit("complete_rows").alias("variable"), F.col("__complete").cast("long").alias("count"),
                          (F.col("__complete") / F.col("__rows") * 100).alias("pct")))
    return wide.select(F.inline(F.array(*parts)))


def null_pct_by(df: DataFrame, group: str | Column, cols: Sequence[str], group_name: str = "group") -> DataFrame:
    """Null % per group and variable (long format), one grouped aggregate."""
    g = df.groupBy(F.col(group).alias(group_name) if isinstance(group, str) else group.alias(group_name))
    wide = g.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in cols])
    parts = [F.struct(F.lit(c).alias("variable"), F.col(c).alias("null_pct")) for c in cols]
    return wide.select(group_name, F.inline(F.array(*parts)))


def null_alerts(df: DataFrame, group: str, cols: Sequence[str], threshold_pct: float = 30.0) -> DataFrame:
    return null_pct_by(df, group, cols, group).filter(F.col("null_pct") >= threshold_pct)


def null_overlap(df: DataFrame, cols: Sequence[str], alert_pct: float = 50.0) -> DataFrame:
    """For each ordered pair (var1 before var2): joint-missing count, % of all
    rows, % of var1's missing rows, and an alert when that share exceeds ``alert_pct``."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"__m_{c}") for c in cols]
    aggs += [F.count_if(F.col(a).isNull() & F.col(b).isNull()).alias(f"__j_{a}__{b}") for a, b in pairs]
    wide = df.agg(*aggs)
    parts = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"__j_{a}__{b}").cast("long").alias("joint"),
                      (F.col(f"__j_{a}__{b}") / F.col("__rows") * 100).alias("joint_pct_rows"),
                      (F.col(f"__j_{a}__{b}") / F.col(f"__m_{a}") * 100).alias("joint_pct_var1"))
             for a, b in pairs]
    out = wide.select(F.inline(F.array(*parts)))
    return out.withColumn("alert", (F.coalesce(F.col("joint_pct_var1"), F.lit(0.0)) > alert_pct).cast("int"))


def null_indicator_corr(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlation of missing indicators per pair (NULL when a column is never/always missing)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.corr(F.col(a).isNull().cast("double"), F.col(b).isNull().cast("double")).alias(f"{a}__{b}")
                    for a, b in pairs])
    parts = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs]
    return wide.select(F.inline(F.array(*parts)))


def row_null_count(cols: Sequence[str]) -> Column:
    expr = F.lit(0)
    for c in cols:
        expr = expr + F.col(c).isNull().cast("int")
    return expr


def with_row_nulls(df: DataFrame, cols: Sequence[str], min_multi: int = 2) -> DataFrame:
    n = row_null_count(cols)
    return df.withColumns({"missing_count": n, "multiple_missing": (n >= min_multi)})


def dataset_compare(frames: dict[str, DataFrame], y: str, hour: str = "hour") -> DataFrame:
    """rows, mean of y, distinct hours per tagged data set: one union, one grouped aggregate."""
    out = None
    for name, f in frames.items():
        g = f.select(F.lit(name).alias("dataset"), F.col(y).alias("__y"), F.col(hour).alias("__h"))
        out = g if out is None else out.unionByName(g)
    return out.groupBy("dataset").agg(F.count(F.lit(1)).cast("long").alias("rows"), F.avg("__y").alias("mean_y"),
                                      F.count_distinct("__h").cast("long").alias("hours"))
