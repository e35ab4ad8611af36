"""Shared building blocks for registered queries (Spark side and SQL side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import clean as cl
from ..sources import fixtures as fx

INTEGRAL = ("int", "smallint", "tinyint")


def final(df: DataFrame) -> DataFrame:
    """Widen integral columns to bigint and floats to double (stable schema)."""
    casts = {}
    for n, t in df.dtypes:
        if t in INTEGRAL:
            casts[n] = F.col(n).cast("bigint")
        elif t == "float":
            casts[n] = F.col(n).cast("double")
    return df.withColumns(casts) if casts else df


def r(c: str | Column, d: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, d)


def wide(spark: SparkSession, sf: str) -> DataFrame:
    return fx.panel_wide(spark, sf)


def clean(spark: SparkSession, sf: str) -> DataFrame:
    """Panel with coded missing values and out-of-range weather set to NULL, plus calendar parts."""
    return cal.with_calendar(cl.clean_weather(fx.panel_wide(spark, sf)))


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return fx.panel_hourly(spark, sf)


# ---------------------------------------------------------------------------
# SQL side: the same frames as CTEs.
_SENT = "(-99, -9999, 999, -999, 9999, -88, -77)"
SQL_CLEAN = f"""
panel as ({fx.PANEL_WIDE_SQL}),
clean0 as (
  select station_name, direction, tm,
         case when ta in {_SENT} or ta < -50 or ta > 60 then null else ta end as ta,
         wd,
         case when ws in {_SENT} or ws < 0 then null else ws end as ws,
         rn_day,
         case when rn_hr1 in {_SENT} or rn_hr1 < 0 then null else rn_hr1 end as rn_hr1,
         case when hm in {_SENT} or hm < 0 or hm > 100 then null else hm end as hm,
         case when si in {_SENT} then null else si end as si,
         ta_chi, congestion, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice
  from panel),
clean as (
  select c.*, strptime(cast(tm as varchar), '%Y%m%d%H') as datetime,
         cast(strptime(cast(tm as varchar), '%Y%m%d%H') as date) as date,
         year(strptime(cast(tm as varchar), '%Y%m%d%H')) as year,
         month(strptime(cast(tm as varchar), '%Y%m%d%H')) as month,
         day(strptime(cast(tm as varchar), '%Y%m%d%H')) as day,
         hour(strptime(cast(tm as varchar), '%Y%m%d%H')) as hour,
         isodow(strptime(cast(tm as varchar), '%Y%m%d%H')) - 1 as dayofweek
  from clean0 c)
"""

SQL_PANEL = f"panel as ({fx.PANEL_WIDE_SQL})"
SQL_HOURLY = f"hourly as ({fx.PANEL_HOURLY_SQL})"


def _prefix(ctes: str, body: str) -> str:
    b = body.lstrip()
    if b[:5].lower() == "with ":
        return f"with {ctes},\n{b[5:]}"
    return f"with {ctes}\n{b}"


def with_clean(body: str) -> str:
    return _prefix(SQL_CLEAN, body)


def with_panel(body: str) -> str:
    return _prefix(SQL_PANEL, body)


def with_hourly(body: str) -> str:
    return _prefix(SQL_HOURLY, body)


def sql_case_in(col: str, groups, default: str | None = None) -> str:
    """SQL CASE for membership chains (mirrors calendar._in_chain)."""
    parts = []
    for values, label in groups:
        lab = f"'{label}'" if isinstance(label, str) else str(label)
        parts.append(f"when {col} in ({', '.join(str(v) for v in values)}) then {lab}")
    if default is not None:
        parts.append(f"when {col} is not null then '{default}'")
    return "case " + " ".join(parts) + " end"
