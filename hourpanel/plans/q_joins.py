"""Registered join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import aggregate as ag
from ..operators import joins as jn
from ..sources import fixtures as fx
from .common import clean, final, r, with_clean
from .registry import register

KEY = fx.ROW_KEY
KEY_SQL = ", ".join(KEY)
SPLIT_TM = 2000000000


def _parts(spark, sf):
    df = clean(spark, sf)
    return df.filter(F.col("tm") < SPLIT_TM), df.filter(F.col("tm") >= SPLIT_TM)


@register("join_group_avg", with_clean(f"""
with m as (select hour, dayofweek, avg(congestion) as congestion_hour_day_avg from clean group by all)
select {KEY_SQL}, round(congestion_hour_day_avg, 6) as congestion_hour_day_avg
from clean join m using (hour, dayofweek)"""))
def join_group_avg(spark, sf):
    """Hour x weekday mean merged back onto every row (168-row side, broadcast)."""
    df = jn.join_group_mean(clean(spark, sf), ["hour", "dayofweek"], "congestion", domain=24 * 7)
    return final(df.select(*KEY, r("congestion_hour_day_avg").alias("congestion_hour_day_avg")))


@register("join_outer_align", with_clean("""
with a as (select station_name, avg(congestion) as rainy from clean where rn_hr1 > 5 group by 1),
b as (select station_name, avg(congestion) as dry from clean where rn_hr1 <= 5 group by 1)
select coalesce(a.station_name, b.station_name) as station_name, round(rainy, 6) as rainy, round(dry, 6) as dry,
       round(rainy - dry, 6) as diff
from a full outer join b on a.station_name = b.station_name"""))
def join_outer_align(spark, sf):
    df = clean(spark, sf)
    a = df.filter(F.col("rn_hr1") > 5).groupBy("station_name").agg(F.avg("congestion").alias("rainy"))
    b = df.filter(F.col("rn_hr1") <= 5).groupBy("station_name").agg(F.avg("congestion").alias("dry"))
    out = jn.outer_align(a, b, "station_name", "rainy", "dry")
    return final(out.select("station_name", r("rainy").alias("rainy"), r("dry").alias("dry"), r("diff").alias("diff")))


@register("join_common_keys", with_clean(f"""
with tr as (select * from clean where tm < {SPLIT_TM}),
te as (select * from clean where tm >= {SPLIT_TM}),
k as (select station_name from tr intersect select station_name from te)
select 'train' as part, cast(count(*) as bigint) as n, cast(count(distinct station_name) as bigint) as stations
from tr semi join k using (station_name)
union all
select 'test', cast(count(*) as bigint), cast(count(distinct station_name) as bigint) from te semi join k using (station_name)"""))
def join_common_keys(spark, sf):
    """Keep only stations present in both parts."""
    tr, te = _parts(spark, sf)
    a, b = jn.keep_common(tr, te, "station_name")
    agg = lambda f, name: f.agg(F.lit(name).alias("part"), F.count(F.lit(1)).cast("long").alias("n"),
                                F.count_distinct("station_name").cast("long").alias("stations"))
    return final(agg(a, "train").unionByName(agg(b, "test")))


@register("join_isin_top", with_clean(f"""
with top as (select station_name from clean group by station_name order by avg(congestion) desc, station_name limit 5)
select {KEY_SQL}, station_name from clean semi join top using (station_name)"""))
def join_isin_top(spark, sf):
    df = clean(spark, sf)
    top = ag.top_k(df.groupBy("station_name").agg(F.avg("congestion").alias("m")),
                   [F.desc("m"), F.asc("station_name")], 5)
    return final(jn.keep_in(df, top, "station_name").select(*KEY, "station_name"))


@register("join_map_back", with_clean(f"""
with h as (select hour, avg(congestion) as hour_mean from clean where tm >= {SPLIT_TM} group by hour),
res as (select {KEY_SQL}, congestion - hour_mean as residual from clean join h using (hour) where tm >= {SPLIT_TM})
select {KEY_SQL}, round(coalesce(res.residual, c.congestion), 6) as residual
from clean c left join res using ({KEY_SQL})"""))
def join_map_back(spark, sf):
    """Residuals computed for the test part, mapped back by row key; other rows keep y."""
    df = clean(spark, sf)
    te = df.filter(F.col("tm") >= SPLIT_TM)
    hm = F.broadcast(te.groupBy("hour").agg(F.avg("congestion").alias("hour_mean")))  # 24 rows
    res = te.join(hm, "hour").select(*KEY, (F.col("congestion") - F.col("hour_mean")).alias("residual"))
    out = jn.map_back(df, res, KEY, "residual", "congestion")
    return final(out.select(*KEY, r("residual").alias("residual")))


@register("set_union", with_clean(f"""
select {KEY_SQL}, 'train' as source from clean where tm < {SPLIT_TM}
union all select {KEY_SQL}, 'test' from clean where tm >= {SPLIT_TM}"""))
def set_union(spark, sf):
    tr, te = _parts(spark, sf)
    return final(jn.stack([tr.select(*KEY), te.select(*KEY)], ["train", "test"]))


@register("set_distinct_union", with_clean(f"""
select distinct station_name from clean where tm < {SPLIT_TM}
union select distinct station_name from clean where tm >= {SPLIT_TM}"""))
def set_distinct_union(spark, sf):
    tr, te = _parts(spark, sf)
    return jn.distinct_union([tr, te], "station_name")


_TC = cal.TIME_CATEGORY_LABELS


@register("set_concat_columns", with_clean(f"""
with t as (select {KEY_SQL}, case when hour > -1 and hour <= 6 then '{_TC[0]}' when hour > 6 and hour <= 9 then '{_TC[1]}'
             when hour > 9 and hour <= 16 then '{_TC[2]}' when hour > 16 and hour <= 19 then '{_TC[3]}'
             when hour > 19 and hour <= 23 then '{_TC[4]}' end as time_category from clean)
select {KEY_SQL}, time_category, {', '.join(f'cast(time_category = {chr(39)}{v}{chr(39)} as bigint) as "time_category_{v}"' for v in _TC)}
from t"""))
def set_concat_columns(spark, sf):
    df = clean(spark, sf).withColumn("time_category", cal.time_category("hour"))
    out = jn.one_hot_columns(df, "time_category", _TC)
    return final(out.select(*KEY, "time_category", *[f"time_category_{v}" for v in _TC]))
