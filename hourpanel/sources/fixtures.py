"""Hourly panels derived from the driver's tables.

Two panels stand in for the station x hour x direction sensor panel:

* ``panel_wide`` (from ``lineitem``): weather columns with coded missing
  values, a target ``congestion`` and a unique row key.  Used by cleaning,
  feature, grouping, statistics and model operators.
* ``panel_hourly`` (from ``events``): a dense station x hour grid with gaps,
  used by lags, fills, interpolation and decomposition.

Both are plain projections / aggregations, so the scan keeps column pruning
and predicate pushdown.  The SQL text in ``PANEL_WIDE_SQL`` and
``PANEL_HOURLY_SQL`` builds the same frames in an ANSI engine (used by the
oracle checks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Window tie-break / row key of panel_wide (unique at every scale).
ROW_KEY = ["tm", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
WEATHER = ["ta", "wd", "ws", "rn_day", "rn_hr1", "hm", "si", "ta_chi"]
PANEL_COLUMNS = ["station_name", "direction", "tm"] + WEATHER + ["congestion"] + ROW_KEY[1:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a driver table.

    The scan's tasks are its input splits.  A table of one row group is one
    split, however many cores there are: ``spark.hourpanel.spread`` (unset:
    no shuffle) deals the rows to that many tasks.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    spread = spark.conf.get("spark.hourpanel.spread", None)
    return df.repartition(int(spread)) if spread else df


def _rush_hour(h: Column) -> Column:
    return h.isin(7, 8, 9, 17, 18, 19)


def panel_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    hour = F.col("l_orderkey") % 24
    ship = F.col("l_shipdate")
    tm = (F.year(ship).cast("long") * 1000000 + F.month(ship) * 10000
          + F.dayofmonth(ship) * 100 + hour).cast("long")
    q, ln, pk = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_partkey")
    rn_hr1 = (F.when(ln <= 4, 0.0).when(ln == 5, 1.5).when(ln == 6, 12.0).otherwise(35.0))
    congestion = (F.col("l_extendedprice") / 1000.0 + 0.5 * q
                  + F.when(_rush_hour(hour), 10.0).otherwise(0.0)
                  + F.when(ln == 7, -4.0).otherwise(0.0))
    return li.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("station_name"),
        F.col("l_linestatus").alias("direction"),
        tm.alias("tm"),
        F.when(pk % 50 == 0, F.lit(-99.0)).otherwise(q - 12.0).alias("ta"),
        (pk % 360).cast("double").alias("wd"),
        F.when(pk % 53 == 1, F.lit(-9999.0)).otherwise(F.col("l_tax") * 100.0).alias("ws"),
        ((ln - 1) * 4).cast("double").alias("rn_day"),
        rn_hr1.cast("double").alias("rn_hr1"),
        F.when(pk % 47 == 2, F.lit(None).cast("double")).otherwise(F.col("l_discount") * 1000.0).alias("hm"),
        F.when(pk % 31 == 3, F.lit(None).cast("double")).otherwise(F.col("l_discount") * 300.0).alias("si"),
        (q - 15.0).alias("ta_chi"),
        congestion.alias("congestion"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
    )


def panel_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense (station, hour) grid over the events' full hour range.

    The hour range is two scalar subqueries (min/max), each station's grid is
    generated next to it with ``sequence``; observed hourly means are joined
    on the (station, hour) key, which is unique on both sides (no skew).
    """
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("station_name"),
        F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("ts_hour"),
        "value",
    )
    lo = ev.select(F.min("ts_hour")).scalar()
    hi = ev.select(F.max("ts_hour")).scalar()
    # the station list is tiny; spread it before generating the grid so the
    # station x hour rows are produced by many tasks, not the one holding the list
    grid = (ev.select("station_name").distinct()
            .repartition(spark.sparkContext.defaultParallelism, "station_name")
            .select("station_name",
                    F.explode(F.sequence(lo, hi, F.expr("INTERVAL 1 HOUR"))).alias("ts_hour")))
    obs = ev.groupBy("station_name", "ts_hour").agg(
        F.avg("value").alias("congestion"), F.count(F.lit(1)).alias("n"))
    return grid.join(obs, ["station_name", "ts_hour"], "left").select("station_name", "ts_hour", "congestion", "n")


# ---------------------------------------------------------------------------
# The same panels in ANSI SQL (DuckDB oracle side).
PANEL_WIDE_SQL = """
select concat('S', cast(l_suppkey as varchar))                               as station_name,
       l_linestatus                                                          as direction,
       cast(year(l_shipdate)*1000000 + month(l_shipdate)*10000
            + day(l_shipdate)*100 + (l_orderkey % 24) as bigint)             as tm,
       case when l_partkey % 50 = 0 then -99.0 else l_quantity - 12.0 end    as ta,
       cast(l_partkey % 360 as double)                                       as wd,
       case when l_partkey % 53 = 1 then -9999.0 else l_tax * 100.0 end      as ws,
       cast((l_linenumber - 1) * 4 as double)                                as rn_day,
       cast(case when l_linenumber <= 4 then 0.0 when l_linenumber = 5 then 1.5
                 when l_linenumber = 6 then 12.0 else 35.0 end as double)    as rn_hr1,
       case when l_partkey % 47 = 2 then null else l_discount * 1000.0 end   as hm,
       case when l_partkey % 31 = 3 then null else l_discount * 300.0 end    as si,
       l_quantity - 15.0                                                     as ta_chi,
       l_extendedprice / 1000.0 + 0.5 * l_quantity
         + case when l_orderkey % 24 in (7, 8, 9, 17, 18, 19) then 10.0 else 0.0 end
         + case when l_linenumber = 7 then -4.0 else 0.0 end                 as congestion,
       l_orderkey, l_partkey, l_suppkey, cast(l_linenumber as bigint) as l_linenumber, l_extendedprice
from lineitem
"""

PANEL_HOURLY_SQL = """
select g.station_name, g.ts_hour, e.congestion, e.n
from (select a.station_name, b.ts_hour
      from (select distinct event_type as station_name from events) a
      cross join (select unnest(generate_series(
                     (select min(date_trunc('hour', ts)) from events),
                     (select max(date_trunc('hour', ts)) from events),
                     interval 1 hour)) as ts_hour) b) g
left join (select event_type as station_name, date_trunc('hour', ts) as ts_hour,
                  avg(value) as congestion, count(*) as n
           from events group by 1, 2) e
  on e.station_name = g.station_name and e.ts_hour = g.ts_hour
"""
