"""Registered cleaning / imputation / filter / projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bins as bn
from ..functions import clean as cl
from ..operators import impute as im
from ..operators import select as sel
from ..sources import fixtures as fx
from .common import clean, final, r, wide, with_clean, with_panel
from .registry import register

KEY = fx.ROW_KEY
KEY_SQL = ", ".join(KEY)
_S7 = "(-99, -9999, 999, -999, 9999, -88, -77)"


@register("clean_sentinel", with_panel(f"""
select {KEY_SQL}, case when ta in (-99) then null else ta end as ta,
       case when ws in (-99) then null else ws end as ws from panel"""))
def clean_sentinel(spark, sf):
    df = cl.null_sentinels(wide(spark, sf), ["ta", "ws"], cl.SENTINEL)
    return final(df.select(*KEY, "ta", "ws"))


@register("clean_sentinel_multi", with_panel(f"""
select {', '.join(f"cast(count_if({c} in {_S7}) as bigint) as {c}_sentinels" for c in cl.WEATHER_COLUMNS)}
from panel"""))
def clean_sentinel_multi(spark, sf):
    return final(cl.sentinel_counts(wide(spark, sf), cl.WEATHER_COLUMNS, cl.SENTINELS_ALL))


@register("clean_negative", with_panel(f"""
select {KEY_SQL}, case when congestion >= 0 then congestion end as congestion,
       case when ta_chi >= 0 then ta_chi end as ta_chi from panel"""))
def clean_negative(spark, sf):
    df = cl.null_negative(wide(spark, sf), ["congestion", "ta_chi"])
    return final(df.select(*KEY, "congestion", "ta_chi"))


@register("clean_range", with_panel(f"""
select {KEY_SQL}, case when ta between -50 and 60 then ta end as ta, case when hm between 0 and 100 then hm end as hm,
       case when ws >= 0 then ws end as ws, case when rn_hr1 >= 0 then rn_hr1 end as rn_hr1 from panel"""))
def clean_range(spark, sf):
    df = cl.null_out_of_range(wide(spark, sf))
    return final(df.select(*KEY, "ta", "hm", "ws", "rn_hr1"))


_IQR = ["ta", "ws", "rn_hr1", "hm"]


@register("clean_iqr_clip", with_clean(f"""
with q as (select {', '.join(f"quantile_cont({c}, 0.25) as {c}_q1, quantile_cont({c}, 0.75) as {c}_q3" for c in _IQR)}
           from clean)
select {KEY_SQL}, {', '.join(
    f"round(case when {c} is not null then least(greatest({c}, {c}_q1 - 1.5 * ({c}_q3 - {c}_q1)), "
    f"{c}_q3 + 1.5 * ({c}_q3 - {c}_q1)) end, 6) as {c}" for c in _IQR)}
from clean, q"""))
def clean_iqr_clip(spark, sf):
    """Sentinels removed first, then clipped to the 1.5 IQR fences."""
    df = cl.iqr_clip(clean(spark, sf), _IQR)
    return final(df.select(*KEY, *[r(c).alias(c) for c in _IQR]))


@register("clean_to_numeric", """
select o_orderkey, try_cast(substr(o_orderpriority, 1, 1) as double) as prio_num,
       try_cast(o_orderpriority as double) as prio_bad from orders""")
def clean_to_numeric(spark, sf):
    o = fx.table(spark, sf, "orders")
    return final(o.select("o_orderkey", cl.to_numeric(F.substring("o_orderpriority", 1, 1)).alias("prio_num"),
                          cl.to_numeric("o_orderpriority").alias("prio_bad")))


@register("clean_night_solar", with_clean(f"""
select {KEY_SQL}, case when hour in (0,1,2,3,4,5,6,19,20,21,22,23) then 0.0 else si end as si from clean"""))
def clean_night_solar(spark, sf):
    df = cl.zero_at_night(clean(spark, sf), "si", "hour")
    return final(df.select(*KEY, "si"))


_FILL = ["ta", "hm", "si", "ws"]


@register("impute_mean", with_clean(f"""
select {KEY_SQL}, {', '.join(f"round(coalesce({c}, (select avg({c}) from clean)), 6) as {c}" for c in _FILL)}
from clean"""))
def impute_mean(spark, sf):
    df = im.impute(clean(spark, sf), _FILL, "mean")
    return final(df.select(*KEY, *[r(c).alias(c) for c in _FILL]))


@register("impute_group_mean", with_clean(f"""
with m as (select hour, avg(hm) as m_hm, avg(si) as m_si from clean group by hour)
select {KEY_SQL}, round(coalesce(hm, m_hm), 6) as hm, round(coalesce(si, m_si), 6) as si
from clean join m using (hour)"""))
def impute_group_mean(spark, sf):
    df = im.impute_group_mean(clean(spark, sf), ["hm", "si"], ["hour"], domain=24)
    return final(df.select(*KEY, r("hm").alias("hm"), r("si").alias("si")))


@register("impute_median", with_clean(f"""
select {KEY_SQL}, {', '.join(f"round(coalesce({c}, (select median({c}) from clean)), 6) as {c}" for c in _FILL)}
from clean"""))
def impute_median(spark, sf):
    df = im.impute(clean(spark, sf), _FILL, "median")
    return final(df.select(*KEY, *[r(c).alias(c) for c in _FILL]))


_TEMP_LABEL_SQL = "case when ta <= 10 then '저온' when ta <= 25 then '중온' when ta is not null then '고온' end"


@register("impute_mode", with_clean(f"""
with l as (select {KEY_SQL}, {_TEMP_LABEL_SQL} as temp_category from clean),
m as (select arg_min(temp_category, (-n, temp_category)) as mode_v
      from (select temp_category, count(*) as n from l where temp_category is not null group by 1))
select {KEY_SQL}, coalesce(temp_category, mode_v) as temp_category from l, m"""))
def impute_mode(spark, sf):
    df = clean(spark, sf).withColumn("temp_category", bn.labeler("ta", bn.LABEL_TEMP))
    df = im.impute_mode(df, ["temp_category"])
    return final(df.select(*KEY, "temp_category"))


@register("impute_zero_flags", with_clean(f"""
select {KEY_SQL}, coalesce(cast(ta > 25 as bigint), 0) as is_hot, coalesce(cast(hm > 80 as bigint), 0) as heavy_humid,
       coalesce(cast(ws < 1 as bigint), 0) as calm_air from clean"""))
def impute_zero_flags(spark, sf):
    df = clean(spark, sf).select(*KEY, (F.col("ta") > 25).cast("int").alias("is_hot"),
                                 (F.col("hm") > 80).cast("int").alias("heavy_humid"),
                                 (F.col("ws") < 1).cast("int").alias("calm_air"))
    return final(im.impute_zero_flags(df))


@register("impute_interactions", with_clean(f"""
with x as (select {KEY_SQL}, ta * hm as temp_humidity_interaction, ta * (1 + hm / 100) as apparent_temp,
                  ta - ws * 2 as wind_chill from clean)
select {KEY_SQL}, {', '.join(f"round(coalesce({c}, (select median({c}) from x)), 6) as {c}"
                              for c in ("temp_humidity_interaction", "apparent_temp", "wind_chill"))}
from x"""))
def impute_interactions(spark, sf):
    df = clean(spark, sf).select(*KEY, (F.col("ta") * F.col("hm")).alias("temp_humidity_interaction"),
                                 (F.col("ta") * (1 + F.col("hm") / 100)).alias("apparent_temp"),
                                 (F.col("ta") - F.col("ws") * 2).alias("wind_chill"))
    df = im.impute_interactions(df)
    cols = ["temp_humidity_interaction", "apparent_temp", "wind_chill"]
    return final(df.select(*KEY, *[r(c).alias(c) for c in cols]))


@register("impute_rain_zero", with_clean(f"""
select {KEY_SQL}, coalesce(case when hm > 50 then rn_hr1 end, 0.0) as rn_hr1_filled from clean"""))
def impute_rain_zero(spark, sf):
    """Missing hourly rain -> 0 (rain is masked where humidity <= 50 to create gaps)."""
    df = clean(spark, sf).withColumn("rn_hr1", F.when(F.col("hm") > 50, F.col("rn_hr1")))
    return final(im.impute_rain_zero(df).select(*KEY, "rn_hr1_filled"))


@register("filter_service_hours", with_clean(f"""
select {KEY_SQL}, cast(hour as bigint) as hour, congestion from clean where hour not in (1, 2, 3, 4)"""))
def filter_service_hours(spark, sf):
    df = sel.drop_service_hours(clean(spark, sf))
    return final(df.select(*KEY, "hour", "congestion"))


@register("filter_months_station", with_panel(f"""
select {KEY_SQL}, station_name, congestion from panel
where (tm // 10000) % 100 in (6, 7, 8) and station_name = 'S1'"""))
def filter_months_station(spark, sf):
    df = sel.filter_months_station(wide(spark, sf), [6, 7, 8], "S1")
    return final(df.select(*KEY, "station_name", "congestion"))


@register("filter_complete_sets", with_clean("""
select cast(count(*) as bigint) as rows,
       cast(count_if(ta is not null and ws is not null and rn_hr1 is not null and hm is not null and si is not null
                     and ta_chi is not null) as bigint) as complete,
       cast(count_if(ta is not null and ws is not null and rn_hr1 is not null and hm is not null) as bigint) as basic,
       round(count_if(ta is not null and ws is not null and rn_hr1 is not null and hm is not null and si is not null
                      and ta_chi is not null) / count(*), 6) as complete_share,
       round(count_if(ta is not null and ws is not null and rn_hr1 is not null and hm is not null) / count(*), 6)
         as basic_share
from clean"""))
def filter_complete_sets(spark, sf):
    out = sel.complete_set_shares(clean(spark, sf), {"complete": sel.SET_COMPLETE, "basic": sel.SET_BASIC})
    return final(out.withColumns({"complete_share": r("complete_share"), "basic_share": r("basic_share")}))


@register("filter_any_null_rows", with_clean(f"""
select {KEY_SQL}, ta, ws, hm, congestion from clean
where ta is not null and ws is not null and hm is not null and congestion is not null"""))
def filter_any_null_rows(spark, sf):
    df = sel.complete_rows(clean(spark, sf), ["ta", "ws", "hm", "congestion"])
    return final(df.select(*KEY, "ta", "ws", "hm", "congestion"))


@register("filter_slice", with_clean("""
select round(avg(congestion), 6) as mean, round(max(congestion), 6) as max, cast(count(*) as bigint) as rows
from clean where station_name = 'S1' and hour = 8"""))
def filter_slice(spark, sf):
    out = sel.slice_stats(clean(spark, sf), "congestion", station_name="S1", hour=8)
    return final(out.select(r("mean").alias("mean"), r("max").alias("max"), "rows"))


@register("proj_log1p", with_clean(f"""
select {KEY_SQL}, round(ln(1 + rn_hr1), 9) as rn_hr1_log, round(ln(1 + rn_day), 9) as rn_day_log,
       round(ln(1 + si), 9) as si_log from clean"""))
def proj_log1p(spark, sf):
    df = sel.log1p_columns(clean(spark, sf), ["rn_hr1", "rn_day", "si"])
    return final(df.select(*KEY, *[r(f"{c}_log", 9).alias(f"{c}_log") for c in ("rn_hr1", "rn_day", "si")]))


@register("proj_clean_names", with_clean(f"""
select {KEY_SQL}, ta as ta_pct, hm as humidity_lt50, ws as wind_speed_m_s from clean"""))
def proj_clean_names(spark, sf):
    df = clean(spark, sf).select(*KEY, F.col("ta").alias("ta (%)"), F.col("hm").alias("humidity <50"),
                                 F.col("ws").alias("wind-speed [m/s]"))
    return final(sel.clean_names(df))


_EXCLUDE = ["congestion", "tm", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
            "year", "day"]


@register("proj_numeric_features", with_clean("""
select ta, wd, ws, rn_day, rn_hr1, hm, si, ta_chi, cast(month as bigint) as month, cast(hour as bigint) as hour,
       cast(dayofweek as bigint) as dayofweek from clean where tm >= 2000000000"""))
def proj_numeric_features(spark, sf):
    """Numeric columns common to train and test minus identifiers/target, applied to test."""
    df = clean(spark, sf)
    train = df.filter(F.col("tm") < 2000000000).withColumn("train_only", F.lit(1.0))
    test = df.filter(F.col("tm") >= 2000000000).withColumn("test_only", F.lit(1.0))
    cols = sel.numeric_features(train, test, _EXCLUDE)
    return final(test.select(*cols))


@register("proj_drop_sparse", with_clean("""
with x as (select tm, ta, hm, case when rn_hr1 > 20 then ta end as rainy_ta, case when hour < 12 then hm end as am_hm
           from clean)
select c as column_name from (values ('ta'), ('hm'), ('rainy_ta'), ('am_hm')) v(c)
where c not in (
  select 'rainy_ta' from x where tm < 2000000000 having avg(cast(rainy_ta is null as double)) > 0.5
  union select 'rainy_ta' from x where tm >= 2000000000 having avg(cast(rainy_ta is null as double)) > 0.5
  union select 'am_hm' from x where tm < 2000000000 having avg(cast(am_hm is null as double)) > 0.5
  union select 'am_hm' from x where tm >= 2000000000 having avg(cast(am_hm is null as double)) > 0.5
  union select 'ta' from x where tm < 2000000000 having avg(cast(ta is null as double)) > 0.5
  union select 'hm' from x where tm < 2000000000 having avg(cast(hm is null as double)) > 0.5)"""))
def proj_drop_sparse(spark, sf):
    """Features kept after dropping those >50 % missing in train or test."""
    df = clean(spark, sf).select("tm", "ta", "hm", F.when(F.col("rn_hr1") > 20, F.col("ta")).alias("rainy_ta"),
                                 F.when(F.col("hour") < 12, F.col("hm")).alias("am_hm"))
    train, test = df.filter(F.col("tm") < 2000000000), df.filter(F.col("tm") >= 2000000000)
    _, _, kept = sel.drop_sparse(train, test, ["ta", "hm", "rainy_ta", "am_hm"])
    return spark.createDataFrame([(c,) for c in kept], "column_name string")
