"""Small shared helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_TYPES = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [n for n, t in df.dtypes if t.startswith(NUMERIC_TYPES) and n not in set(exclude)]


def nan_to_null(c: str | Column) -> Column:
    """Spark orders NaN above every number and it poisons ``avg``: map to NULL."""
    x = col_of(c)
    return F.when(~F.isnan(x), x)
