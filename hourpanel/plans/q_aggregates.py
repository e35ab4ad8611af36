"""Registered aggregation / pivot / top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bins as bn
from ..functions import calendar as cal
from ..functions import features as ft
from ..operators import aggregate as ag
from ..operators.quantiles import exact_quantiles
from .common import clean, final, r, with_clean
from .registry import register


@register("agg_group_mean", with_clean("""
select cast(hour as bigint) as hour, round(avg(congestion), 6) as mean_congestion,
       cast(count(*) as bigint) as n
from clean group by hour"""))
def agg_group_mean(spark, sf):
    """Mean congestion per hour of day (the flagship question)."""
    df = clean(spark, sf)
    out = df.groupBy("hour").agg(r(F.avg("congestion")).alias("mean_congestion"),
                                 F.count(F.lit(1)).cast("long").alias("n"))
    return final(out)


@register("agg_group_multi", with_clean("""
select cast(dayofweek as bigint) as dayofweek, cast(count(congestion) as bigint) as count,
       round(avg(congestion), 6) as mean, round(stddev_samp(congestion), 6) as std,
       round(min(congestion), 6) as min, round(max(congestion), 6) as max
from clean group by dayofweek"""))
def agg_group_multi(spark, sf):
    df = clean(spark, sf)
    out = ag.group_stats(df, ["dayofweek"], "congestion")
    return final(out.select("dayofweek", "count", *[r(c).alias(c) for c in ("mean", "std", "min", "max")]))


_TEMP_GROUP_SQL = ("case when ta > -40 and ta <= 0 then '추움' when ta > 0 and ta <= 15 then '적정' "
                   "when ta > 15 and ta <= 40 then '더움' end")


@register("agg_label_ranges", with_clean(f"""
select temp_group, round(min(ta), 6) as min, round(max(ta), 6) as max, round(avg(ta), 6) as mean,
       cast(count(ta) as bigint) as count
from (select ta, {_TEMP_GROUP_SQL} as temp_group from clean) t
where temp_group is not null group by temp_group"""))
def agg_label_ranges(spark, sf):
    df = clean(spark, sf).withColumn("temp_group", bn.cut("ta", bn.TEMP_3_EDGES, bn.TEMP_3_LABELS))
    out = ag.label_ranges(df, "temp_group", "ta")
    return final(out.select("temp_group", *[r(c).alias(c) for c in ("min", "max", "mean")], "count"))


@register("agg_two_key_mean", with_clean("""
select cast(month as bigint) as month,
       case when month in (3,4,5) then '봄' when month in (6,7,8) then '여름'
            when month in (9,10,11) then '가을' when month in (12,1,2) then '겨울' else '기타' end as season,
       round(avg(congestion), 6) as mean_congestion
from clean group by all"""))
def agg_two_key_mean(spark, sf):
    df = clean(spark, sf).withColumn("season", cal.season("month", "label"))
    return final(ag.group_mean(df, ["month", "season"], "congestion", "mean_congestion")
                 .withColumn("mean_congestion", r("mean_congestion")))


@register("agg_two_key_mean_hour", with_clean("""
select cast(hour as bigint) as hour,
       case when month in (3,4,5) then '봄' when month in (6,7,8) then '여름'
            when month in (9,10,11) then '가을' when month in (12,1,2) then '겨울' else '기타' end as season,
       round(avg(congestion), 6) as mean_congestion
from clean group by all"""))
def agg_two_key_mean_hour(spark, sf):
    """Mean by hour and season."""
    df = clean(spark, sf).withColumn("season", cal.season("month", "label"))
    return final(ag.group_mean(df, ["hour", "season"], "congestion", "mean_congestion").withColumn("mean_congestion", r("mean_congestion")))


@register("agg_bool_key", with_clean("""
select cast(hour in (7,8,9,17,18,19) as bigint) as is_rush,
       round(avg(congestion), 6) as mean_congestion, cast(count(*) as bigint) as n
from clean group by 1"""))
def agg_bool_key(spark, sf):
    df = clean(spark, sf)
    key = F.col("hour").isin(cal.RUSH_HOURS["eda"]).cast("long").alias("is_rush")
    out = df.groupBy(key).agg(r(F.avg("congestion")).alias("mean_congestion"),
                              F.count(F.lit(1)).cast("long").alias("n"))
    return final(out)


def _dow_pivot_sql(agg: str, fill0: bool = False) -> str:
    cols = []
    for d, name in enumerate(cal.WEEKDAY_NAMES_KO):
        expr = f"{agg}(case when dayofweek = {d} then congestion end)" if agg == "avg" else \
            f"count(case when dayofweek = {d} then 1 end)"
        if agg == "avg":
            expr = f"round({expr}, 6)"
        cols.append(f"{expr} as \"{name}\"")
    return with_clean(f"select cast(hour as bigint) as hour, {', '.join(cols)} from clean group by hour")


@register("agg_pivot_mean", _dow_pivot_sql("avg"))
def agg_pivot_mean(spark, sf):
    """hour x weekday mean congestion, weekday columns in Monday-first order."""
    df = clean(spark, sf).withColumn("weekday_ko", cal.dow_name("dayofweek"))
    out = ag.pivot_mean(df, ["hour"], "weekday_ko", "congestion", cal.WEEKDAY_NAMES_KO)
    return final(out.select("hour", *[r(n).alias(n) for n in cal.WEEKDAY_NAMES_KO]))


@register("agg_count_pivot", _dow_pivot_sql("count"))
def agg_count_pivot(spark, sf):
    df = clean(spark, sf).withColumn("weekday_ko", cal.dow_name("dayofweek"))
    out = ag.pivot_mean(df, ["hour"], "weekday_ko", "congestion", cal.WEEKDAY_NAMES_KO, agg="count", fill=0)
    return final(out)


_RAIN_INT_SQL = ("case when rn_day = 0 then '무강수' when rn_day <= 5 then '약한비' "
                 "when rn_day <= 20 then '보통비' when rn_day is not null then '강한비' end")


@register("agg_unstack", with_clean(f"""
select cast(dayofweek as bigint) as dayofweek,
       {', '.join(f"coalesce(round(avg(case when ri = '{lab}' then congestion end), 6), 0) as \"{lab}\""
                  for lab in bn.RAIN_INTENSITY)}
from (select *, {_RAIN_INT_SQL} as ri from clean) t group by dayofweek"""))
def agg_unstack(spark, sf):
    """weekday x rain intensity means, wide, absent cells filled with 0."""
    df = clean(spark, sf).withColumn("ri", bn.rain_intensity("rn_day"))
    out = ag.pivot_mean(df, ["dayofweek"], "ri", "congestion", bn.RAIN_INTENSITY)
    out = out.select("dayofweek", *[F.coalesce(r(n), F.lit(0.0)).alias(n) for n in bn.RAIN_INTENSITY])
    return final(out)


@register("agg_value_counts", with_clean(f"""
select ri as value, cast(count(*) as bigint) as count,
       round(count(*) / sum(count(*)) over (), 6) as share
from (select {_RAIN_INT_SQL} as ri from clean) t group by ri"""))
def agg_value_counts(spark, sf):
    df = clean(spark, sf)
    out = ag.value_counts(df, bn.rain_intensity("rn_day"))
    return final(out.withColumn("share", r("share")))


@register("agg_rate", with_clean("""
select cast(count(*) as bigint) as rows,
       cast(count_if(rn_hr1 > 0) as bigint) as rain_count, round(avg(coalesce(cast(rn_hr1 > 0 as int), 0)), 6) as rain_share,
       cast(count_if(hour in (1,2,3,4)) as bigint) as closed_count,
       round(avg(cast(hour in (1,2,3,4) as int)), 6) as closed_share
from clean"""))
def agg_rate(spark, sf):
    df = clean(spark, sf)
    out = ag.rate(df, {"rain": F.col("rn_hr1") > 0, "closed": F.col("hour").isin(1, 2, 3, 4)})
    return final(out.select("rows", "rain_count", r("rain_share").alias("rain_share"), "closed_count",
                            r("closed_share").alias("closed_share")))


@register("agg_distinct", with_clean("""
select cast(count(distinct hour) as bigint) as n_hours,
       array_to_string(list_sort(list_distinct(list(cast(hour as varchar)))), ',') as hours,
       cast(count_if(hour in (1,2,3,4) and congestion = 0) as bigint) as closed_zero,
       cast(count_if(hour in (1,2,3,4) and congestion <> 0) as bigint) as closed_nonzero,
       cast(count(distinct station_name) as bigint) as n_stations
from clean"""))
def agg_distinct(spark, sf):
    df = clean(spark, sf)
    closed = F.col("hour").isin(1, 2, 3, 4)
    out = df.agg(
        F.count_distinct("hour").cast("long").alias("n_hours"),
        F.array_join(F.sort_array(F.collect_set(F.col("hour").cast("string"))), ",").alias("hours"),
        F.count_if(closed & (F.col("congestion") == 0)).cast("long").alias("closed_zero"),
        F.count_if(closed & (F.col("congestion") != 0)).cast("long").alias("closed_nonzero"),
        F.count_distinct("station_name").cast("long").alias("n_stations"))
    return final(out)


@register("agg_peak", with_clean("""
with m as (select hour, avg(ta) as ta, avg(hm) as hm, avg(congestion) as congestion from clean group by hour),
l as (select hour, 'ta' as variable, ta as v from m union all select hour, 'hm', hm from m
      union all select hour, 'congestion', congestion from m)
select variable, cast(arg_max(hour, (v, -hour)) as bigint) as max_hour, round(max(v), 6) as max_value,
       cast(arg_min(hour, (v, hour)) as bigint) as min_hour, round(min(v), 6) as min_value
from l group by variable"""))
def agg_peak(spark, sf):
    df = clean(spark, sf)
    out = ag.peak_values(df, "hour", ["ta", "hm", "congestion"])
    return final(out.select("variable", "max_hour", r("max_value").alias("max_value"), "min_hour",
                            r("min_value").alias("min_value")))


@register("agg_reindex", with_clean("""
select y.year, coalesce(c.n, 0) as n
from (select cast(unnest(range(1990, 2001)) as bigint) as year) y
left join (select cast(year as bigint) as year, cast(count(*) as bigint) as n from clean group by 1) c on c.year = y.year"""))
def agg_reindex(spark, sf):
    """Rows per year on a fixed domain that reaches beyond the data's years (absent -> 0)."""
    counts = clean(spark, sf).groupBy(F.col("year").cast("long").alias("year")).agg(F.count(F.lit(1)).cast("long").alias("n"))
    return final(ag.reindex(counts, "year", list(range(1990, 2001)), {"n": 0}).withColumn("year", F.col("year").cast("long")))


def _effect_labels():
    return {
        "hour": F.col("hour"),
        "dayofweek": F.col("dayofweek"),
        "rain": F.when(F.col("rn_hr1") > 0, "rain").when(F.col("rn_hr1").isNotNull(), "dry"),
        "temp": bn.cut("ta", bn.TEMP_3_EDGES, bn.TEMP_3_LABELS),
    }


@register("agg_effect_table", with_clean(f"""
with l as (
  select congestion, 'hour' as kind, cast(hour as varchar) as value from clean
  union all select congestion, 'dayofweek', cast(dayofweek as varchar) from clean
  union all select congestion, 'rain', case when rn_hr1 > 0 then 'rain' when rn_hr1 is not null then 'dry' end from clean
  union all select congestion, 'temp', {_TEMP_GROUP_SQL} from clean),
o as (select avg(congestion) as overall from clean)
select kind, value, round(avg(congestion), 6) as mean, cast(count(congestion) as bigint) as n,
       round(any_value(o.overall), 6) as overall,
       round((avg(congestion) - any_value(o.overall)) / any_value(o.overall) * 100, 6) as pct_change
from l, o where value is not null group by kind, value"""))
def agg_effect_table(spark, sf):
    df = clean(spark, sf)
    out = ag.effect_table(df, "congestion", _effect_labels())
    return final(out.select("kind", "value", r("mean").alias("mean"), "n", r("overall").alias("overall"),
                            r("pct_change").alias("pct_change")))


@register("agg_impact_summary", with_clean("""
select round(avg(case when rn_hr1 > 0 then congestion end) - avg(case when rn_hr1 = 0 then congestion end), 6) as rain_diff,
       round((avg(case when rn_hr1 > 0 then congestion end) - avg(case when rn_hr1 = 0 then congestion end))
             / avg(case when rn_hr1 = 0 then congestion end) * 100, 6) as rain_pct,
       round(regr_slope(congestion, ta) * 10, 6) as temp_slope_10,
       round(regr_slope(congestion, ta) * 10 / avg(congestion) * 100, 6) as temp_pct_10,
       round(avg(case when month in (6,7,8) then congestion end) - avg(case when month in (12,1,2) then congestion end), 6) as summer_winter_diff,
       round((avg(case when month in (6,7,8) then congestion end) - avg(case when month in (12,1,2) then congestion end))
             / avg(case when month in (12,1,2) then congestion end) * 100, 6) as summer_winter_pct
from clean"""))
def agg_impact_summary(spark, sf):
    df = clean(spark, sf)
    y, rn, m = F.col("congestion"), F.col("rn_hr1"), F.col("month")
    rain, dry = F.avg(F.when(rn > 0, y)), F.avg(F.when(rn == 0, y))
    summer, winter = F.avg(F.when(m.isin(6, 7, 8), y)), F.avg(F.when(m.isin(12, 1, 2), y))
    slope = F.regr_slope(y, F.col("ta"))
    out = df.agg(r(rain - dry).alias("rain_diff"), r((rain - dry) / dry * 100).alias("rain_pct"),
                 r(slope * 10).alias("temp_slope_10"), r(slope * 10 / F.avg(y) * 100).alias("temp_pct_10"),
                 r(summer - winter).alias("summer_winter_diff"),
                 r((summer - winter) / winter * 100).alias("summer_winter_pct"))
    return final(out)


@register("agg_time_patterns", with_clean("""
select round(avg(congestion), 6) as overall,
       round(avg(case when hour between 7 and 9 then congestion end), 6) as morning,
       round((avg(case when hour between 7 and 9 then congestion end) / avg(congestion) - 1) * 100, 6) as morning_pct,
       round(avg(case when hour between 17 and 19 then congestion end), 6) as evening,
       round((avg(case when hour between 17 and 19 then congestion end) / avg(congestion) - 1) * 100, 6) as evening_pct,
       round(avg(case when hour between 0 and 5 then congestion end), 6) as night,
       round((avg(case when hour between 0 and 5 then congestion end) / avg(congestion) - 1) * 100, 6) as night_pct
from clean"""))
def agg_time_patterns(spark, sf):
    df = clean(spark, sf)
    h = F.col("hour")
    conds = {"morning": h.between(7, 9), "evening": h.between(17, 19), "night": h.between(0, 5)}
    out = ag.conditional_means(df, "congestion", conds)
    cols = [r("overall").alias("overall")]
    for k in conds:
        cols += [r(k).alias(k), r((F.col(k) / F.col("overall") - 1) * 100).alias(f"{k}_pct")]
    return final(out.select(*cols))


@register("agg_day_patterns", with_clean("""
with o as (select avg(congestion) as overall from clean)
select cast(dayofweek as bigint) as dayofweek, round(avg(congestion), 6) as mean,
       round((avg(congestion) / any_value(o.overall) - 1) * 100, 6) as pct_vs_overall
from clean, o group by dayofweek"""))
def agg_day_patterns(spark, sf):
    df = clean(spark, sf)
    overall = df.select(F.avg("congestion")).scalar()
    out = df.groupBy("dayofweek").agg(F.avg("congestion").alias("mean"))
    return final(out.select("dayofweek", r("mean").alias("mean"),
                            r((F.col("mean") / F.lit(overall) - 1) * 100).alias("pct_vs_overall")))


@register("agg_sensitivity", with_clean("""
select station_name, round(avg(case when rn_hr1 > 0 then congestion end), 6) as rainy_mean,
       round(avg(case when not (rn_hr1 > 0) then congestion end), 6) as dry_mean,
       round(avg(case when rn_hr1 > 0 then congestion end) - avg(case when not (rn_hr1 > 0) then congestion end), 6) as diff,
       round((avg(case when rn_hr1 > 0 then congestion end) - avg(case when not (rn_hr1 > 0) then congestion end))
             / avg(case when not (rn_hr1 > 0) then congestion end) * 100, 6) as pct
from clean group by station_name"""))
def agg_sensitivity(spark, sf):
    df = clean(spark, sf)
    out = ag.split_mean_diff(df, "station_name", "congestion", F.col("rn_hr1") > 0)
    return final(out.select("station_name", *[r(c).alias(c) for c in ("rainy_mean", "dry_mean", "diff", "pct")]))


@register("agg_threshold_diff", with_clean("""
select station_name, round(avg(case when rn_hr1 > 5 then congestion end), 6) as heavy_mean,
       round(avg(case when rn_hr1 <= 5 then congestion end), 6) as light_mean,
       round(avg(case when rn_hr1 > 5 then congestion end) - avg(case when rn_hr1 <= 5 then congestion end), 6) as diff
from clean group by station_name"""))
def agg_threshold_diff(spark, sf):
    df = clean(spark, sf)
    out = df.groupBy("station_name").agg(
        F.avg(F.when(F.col("rn_hr1") > 5, F.col("congestion"))).alias("heavy_mean"),
        F.avg(F.when(F.col("rn_hr1") <= 5, F.col("congestion"))).alias("light_mean"))
    out = out.withColumn("diff", F.col("heavy_mean") - F.col("light_mean"))
    return final(out.select("station_name", *[r(c).alias(c) for c in ("heavy_mean", "light_mean", "diff")]))


@register("agg_condition_rank", with_clean(f"""
select station_name, cast(hour as bigint) as hour, cast(dayofweek as bigint) as dayofweek,
       cast(coalesce(cast(rn_hr1 > 0 as int), 0) as bigint) as is_rainy, {_TEMP_GROUP_SQL} as temp_group,
       round(avg(congestion), 6) as mean_congestion, cast(count(*) as bigint) as n
from clean group by all
order by avg(congestion) desc, station_name, hour, dayofweek, is_rainy, temp_group limit 10"""))
def agg_condition_rank(spark, sf):
    """Top-10 (station, hour, weekday, rain, temperature group) by mean congestion."""
    df = clean(spark, sf).withColumns({"is_rainy": ft.is_rainy("rn_hr1").cast("long"),
                                       "temp_group": bn.cut("ta", bn.TEMP_3_EDGES, bn.TEMP_3_LABELS)})
    keys = ["station_name", "hour", "dayofweek", "is_rainy", "temp_group"]
    g = df.groupBy(*keys).agg(F.avg("congestion").alias("m"), F.count(F.lit(1)).cast("long").alias("n"))
    top = ag.top_k(g, [F.desc("m")] + [F.asc_nulls_first(k) for k in keys], 10)
    return final(top.select(*keys, r("m").alias("mean_congestion"), "n"))


_COMBO_SQL = (f"concat_ws('_', {_TEMP_GROUP_SQL}, cast(coalesce(cast(rn_hr1 > 0 as int), 0) as varchar), "
              "case when hour > -1 and hour <= 6 then '심야' when hour > 6 and hour <= 9 then '출근' "
              "when hour > 9 and hour <= 16 then '낮' when hour > 16 and hour <= 19 then '퇴근' "
              "when hour > 19 and hour <= 23 then '밤' end)")


@register("agg_min_support", with_clean(f"""
select combo as key, cast(count(*) as bigint) as n, round(avg(congestion), 6) as mean
from (select congestion, {_COMBO_SQL} as combo from clean) t
group by combo having count(*) > 1000"""))
def agg_min_support(spark, sf):
    df = clean(spark, sf)
    key = ft.combo_key(bn.cut("ta", bn.TEMP_3_EDGES, bn.TEMP_3_LABELS), ft.is_rainy("rn_hr1"),
                       cal.time_category("hour"))
    out = ag.support_filter(df, key, "congestion", 1000)
    return final(out.withColumn("mean", r("mean")))


@register("agg_rain_delta", with_clean(f"""
with m as (select cast(dayofweek as bigint) as dayofweek, {_RAIN_INT_SQL} as ri, avg(congestion) as mean
           from clean group by all),
d as (select dayofweek, mean as dry from m where ri = '무강수')
select m.dayofweek, m.ri as rain_level, round(m.mean, 6) as mean, round(m.mean - d.dry, 6) as delta,
       round((m.mean - d.dry) / d.dry * 100, 6) as delta_pct
from m join d on m.dayofweek = d.dayofweek where m.ri is not null and m.ri <> '무강수'"""))
def agg_rain_delta(spark, sf):
    """Per weekday, each rain level's mean minus the dry level's mean (window, no self-join)."""
    from pyspark.sql import Window
    df = clean(spark, sf).withColumn("ri", bn.rain_intensity("rn_day"))
    m = df.groupBy("dayofweek", "ri").agg(F.avg("congestion").alias("mean"))
    dry = F.max(F.when(F.col("ri") == bn.RAIN_INTENSITY[0], F.col("mean"))).over(Window.partitionBy("dayofweek"))
    out = (m.withColumn("dry", dry)
           .filter(F.col("ri").isNotNull() & (F.col("ri") != bn.RAIN_INTENSITY[0]) & F.col("dry").isNotNull()))
    return final(out.select("dayofweek", F.col("ri").alias("rain_level"), r("mean").alias("mean"),
                            r(F.col("mean") - F.col("dry")).alias("delta"),
                            r((F.col("mean") - F.col("dry")) / F.col("dry") * 100).alias("delta_pct")))


@register("agg_top_station_season", with_clean("""
with top as (select station_name from clean group by station_name
             order by avg(congestion) desc, station_name limit 5)
select c.station_name, cast(case when month in (3,4,5) then 1 when month in (6,7,8) then 2
                                 when month in (9,10,11) then 3 else 4 end as bigint) as season,
       round(avg(congestion), 6) as mean_congestion
from clean c semi join top t on c.station_name = t.station_name group by all"""))
def agg_top_station_season(spark, sf):
    df = clean(spark, sf)
    top = ag.top_k(df.groupBy("station_name").agg(F.avg("congestion").alias("m")),
                   [F.desc("m"), F.asc("station_name")], 5).select("station_name")
    # top is 5 rows by construction -> broadcast semi join
    sub = df.join(F.broadcast(top), "station_name", "left_semi").withColumn("season", cal.season("month"))
    out = sub.groupBy("station_name", "season").agg(r(F.avg("congestion")).alias("mean_congestion"))
    return final(out)


_Q_SQL = "quantile_cont(ta, 0.1)"


@register("agg_season_extremes", with_clean("""
with s as (select *, case when month in (3,4,5) then '봄' when month in (6,7,8) then '여름'
                          when month in (9,10,11) then '가을' when month in (12,1,2) then '겨울' else '기타' end as season
           from clean),
q as (select season, quantile_cont(ta, 0.1) as q10, quantile_cont(ta, 0.9) as q90 from s group by season)
select s.season, round(avg(case when ta >= q90 then congestion end), 6) as hot_mean,
       round(avg(case when ta <= q10 then congestion end), 6) as cold_mean,
       round(avg(case when rn_hr1 > 0 then congestion end), 6) as rainy_mean,
       round(avg(case when rn_hr1 = 0 then congestion end), 6) as dry_mean
from s join q on s.season = q.season group by s.season"""))
def agg_season_extremes(spark, sf):
    """Per season: mean congestion in the top/bottom temperature decile (season-wise
    quantiles: one column of temperatures per season label), rainy vs dry."""
    df = clean(spark, sf).withColumn("season", cal.season("month", "label"))
    labels = ["봄", "여름", "가을", "겨울"]  # every month 1-12 has one of the four
    by_season = df.select(*[F.when(F.col("season") == s, F.col("ta")).alias(s) for s in labels])
    q = exact_quantiles(by_season, {s: [0.1, 0.9] for s in labels})
    q10, q90 = [F.coalesce(*[F.when(F.col("season") == s, F.lit(q[s][i])) for s in labels]).cast("double") for i in (0, 1)]
    y = F.col("congestion")
    out = df.groupBy("season").agg(
        r(F.avg(F.when(F.col("ta") >= q90, y))).alias("hot_mean"),
        r(F.avg(F.when(F.col("ta") <= q10, y))).alias("cold_mean"),
        r(F.avg(F.when(F.col("rn_hr1") > 0, y))).alias("rainy_mean"),
        r(F.avg(F.when(F.col("rn_hr1") == 0, y))).alias("dry_mean"))
    return final(out)


TRANSITIONS = [(5, 6), (8, 9), (11, 12), (2, 3)]


@register("agg_transition", with_clean(f"""
with m as (select month, avg(congestion) as mean from clean group by month),
t as (select * from (values {', '.join(f'({a}, {b})' for a, b in TRANSITIONS)}) v(m_from, m_to))
select cast(t.m_from as bigint) as month_from, cast(t.m_to as bigint) as month_to,
       round(a.mean, 6) as mean_from, round(b.mean, 6) as mean_to, round(b.mean - a.mean, 6) as change
from t join m a on a.month = t.m_from join m b on b.month = t.m_to"""))
def agg_transition(spark, sf):
    df = clean(spark, sf)
    m = df.groupBy("month").agg(F.avg("congestion").alias("mean"))  # <= 12 rows
    t = spark.createDataFrame(TRANSITIONS, "month_from int, month_to int")
    a = F.broadcast(m.select(F.col("month").alias("month_from"), F.col("mean").alias("mean_from")))
    b = F.broadcast(m.select(F.col("month").alias("month_to"), F.col("mean").alias("mean_to")))
    out = t.join(a, "month_from").join(b, "month_to")
    return final(out.select("month_from", "month_to", r("mean_from").alias("mean_from"),
                            r("mean_to").alias("mean_to"),
                            r(F.col("mean_to") - F.col("mean_from")).alias("change")))


@register("agg_year_compare", with_clean("""
select case when tm < 2000000000 then 'train' else 'test' end as part,
       round(avg(congestion), 6) as mean_y, round(stddev_samp(congestion), 6) as std_y,
       round(avg(ta), 6) as mean_ta, round(avg(hm), 6) as mean_hm, cast(count(*) as bigint) as n
from clean group by 1"""))
def agg_year_compare(spark, sf):
    df = clean(spark, sf).withColumn("part", F.when(F.col("tm") < 2000000000, "train").otherwise("test"))
    out = df.groupBy("part").agg(r(F.avg("congestion")).alias("mean_y"), r(F.stddev_samp("congestion")).alias("std_y"),
                                 r(F.avg("ta")).alias("mean_ta"), r(F.avg("hm")).alias("mean_hm"),
                                 F.count(F.lit(1)).cast("long").alias("n"))
    return final(out)


@register("agg_describe", with_clean("""
select 'congestion' as variable, cast(count(congestion) as bigint) as count, round(avg(congestion), 6) as mean,
       round(stddev_samp(congestion), 6) as std, round(min(congestion), 6) as min,
       round(quantile_cont(congestion, 0.25), 6) as q25, round(quantile_cont(congestion, 0.5), 6) as q50,
       round(quantile_cont(congestion, 0.75), 6) as q75, round(max(congestion), 6) as max from clean
union all
select 'ta', cast(count(ta) as bigint), round(avg(ta), 6), round(stddev_samp(ta), 6), round(min(ta), 6),
       round(quantile_cont(ta, 0.25), 6), round(quantile_cont(ta, 0.5), 6), round(quantile_cont(ta, 0.75), 6),
       round(max(ta), 6) from clean
union all
select 'hm', cast(count(hm) as bigint), round(avg(hm), 6), round(stddev_samp(hm), 6), round(min(hm), 6),
       round(quantile_cont(hm, 0.25), 6), round(quantile_cont(hm, 0.5), 6), round(quantile_cont(hm, 0.75), 6),
       round(max(hm), 6) from clean"""))
def agg_describe(spark, sf):
    df = clean(spark, sf)
    out = ag.describe(df, ["congestion", "ta", "hm"])
    return final(out.select("variable", "count", *[r(c).alias(c) for c in
                                                   ("mean", "std", "min", "q25", "q50", "q75", "max")]))


# ------------------------------------------------------------------ top-k and sort
@register("top_hours", with_clean("""
with m as (select cast(hour as bigint) as hour, avg(congestion) as mean from clean group by hour)
select * from (select 'high' as side, hour, round(mean, 6) as mean_congestion from m order by mean desc, hour limit 10)
union all
select * from (select 'low', hour, round(mean, 6) from m order by mean asc, hour limit 10)"""))
def top_hours(spark, sf):
    m = clean(spark, sf).groupBy("hour").agg(F.avg("congestion").alias("mean"))
    hi = ag.top_k(m, [F.desc("mean"), F.asc("hour")], 10).select(F.lit("high").alias("side"), "hour", "mean")
    lo = ag.top_k(m, [F.asc("mean"), F.asc("hour")], 10).select(F.lit("low").alias("side"), "hour", "mean")
    return final(hi.unionByName(lo).select("side", "hour", r("mean").alias("mean_congestion")))


@register("top_stations", with_clean("""
with s as (select station_name, avg(case when rn_hr1 > 0 then congestion end) as rainy_mean,
                  avg(case when not (rn_hr1 > 0) then congestion end) as dry_mean from clean group by station_name)
select station_name, round(rainy_mean - dry_mean, 6) as diff, round((rainy_mean - dry_mean) / dry_mean * 100, 6) as pct
from s order by rainy_mean - dry_mean desc, station_name limit 15"""))
def top_stations(spark, sf):
    """Fifteen stations with the largest rainy-minus-dry difference."""
    s = ag.split_mean_diff(clean(spark, sf), "station_name", "congestion", F.col("rn_hr1") > 0)
    top = ag.top_k(s, [F.desc("diff"), F.asc("station_name")], 15)
    return final(top.select("station_name", r("diff").alias("diff"), r("pct").alias("pct")))


_INTER_COLS = {
    "temp_hour_interaction": "ta * hour", "rain_weekend_effect": "rn_day * cast(dayofweek >= 5 as int)",
    "weather_composite": "ta * 0.4 + hm * 0.3 + ws * 0.2 + rn_day * 0.1",
    "temp_humidity_product": "ta * hm", "rain_wind_product": "rn_day * ws", "discomfort_index":
    "0.81 * ta + 0.01 * hm * (0.99 * ta - 14.3) + 46.3", "feels_like": "ta - ws * 0.5"}


@register("top_abs_corr", with_clean(f"""
with c as ({' union all '.join(f"select '{k}' as feature, corr({v}, congestion) as r from clean" for k, v in _INTER_COLS.items())})
select feature, round(r, 6) as r, case when abs(r) > 0.5 then '강함' when abs(r) > 0.3 then '중간' else '약함' end as strength
from c order by abs(r) desc, feature limit 5"""))
def top_abs_corr(spark, sf):
    """Five derived features most correlated (|r|) with the target, with a strength label."""
    from ..operators import stats as st
    df = clean(spark, sf).withColumn("is_weekend", cal.weekend_flag())
    cols = {**ft.eda_cross_columns(), "discomfort_index": ft.discomfort_index(), "feels_like": ft.feels_like()}
    keep = ["temp_hour_interaction", "rain_weekend_effect", "weather_composite", "temp_humidity_product",
            "rain_wind_product", "discomfort_index", "feels_like"]
    df = df.withColumns({k: cols[k] for k in keep})
    long = st.unpivot(df, ["congestion"], keep, "feature")
    rr = long.groupBy("feature").agg(F.corr("value", "congestion").alias("r"))
    top = ag.top_k(rr, [F.desc(F.abs("r")), F.asc("feature")], 5)
    a = F.abs("r")
    return final(top.select("feature", r("r").alias("r"),
                            F.when(a > 0.5, "강함").when(a > 0.3, "중간").otherwise("약함").alias("strength")))


@register("top_per_group", with_clean(f"""
with a as (select *, {'case ' + ' '.join(f"when hour in ({', '.join(map(str, hs))}) then '{lab}'" for hs, lab in cal.TIME_GROUPS) + ' end'} as time_group
           from clean where hour not in (1,2,3,4)),
c as ({' union all '.join(f"select time_group, '{v}' as variable, corr({v}, congestion) as r from a group by time_group" for v in ('ta', 'ws', 'rn_hr1', 'hm', 'si', 'ta_chi'))})
select time_group, arg_max(variable, (abs(r), variable)) as strongest, round(max(abs(r)), 6) as abs_r
from c where r is not null group by time_group"""))
def top_per_group(spark, sf):
    """Strongest weather variable (|r| with the target) per service time group."""
    from ..operators import stats as st
    df = clean(spark, sf).filter(~F.col("hour").isin(1, 2, 3, 4)).withColumn("time_group", cal.time_group("hour"))
    g = st.corr_grouped(df, ["time_group"], "congestion", ["ta", "ws", "rn_hr1", "hm", "si", "ta_chi"])
    g = g.filter(F.col("r").isNotNull())
    out = g.groupBy("time_group").agg(F.max_by("variable", F.struct(F.abs("r"), F.col("variable"))).alias("strongest"),
                                      r(F.max(F.abs("r"))).alias("abs_r"))
    return final(out)


@register("sort_multi", with_clean("""
select station_name, tm, l_orderkey, l_linenumber, congestion from clean
order by station_name, tm, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice"""))
def sort_multi(spark, sf):
    """Rows ordered by station then time (range-partitioned sort; total order via the row key)."""
    df = clean(spark, sf).orderBy("station_name", "tm", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                  "l_extendedprice")
    return final(df.select("station_name", "tm", "l_orderkey", "l_linenumber", "congestion"))


HIST_BINS = 30


@register("agg_plot_data", with_clean(f"""
with b as (select min(congestion) as lo, max(congestion) as hi from clean),
h as (select least(cast(floor((congestion - lo) / (hi - lo) * {HIST_BINS}) as bigint), {HIST_BINS - 1}) as bin,
             count(*) as n from clean, b group by 1),
box as (select quantile_cont(congestion, 0.25) as q1, quantile_cont(congestion, 0.5) as q2,
               quantile_cont(congestion, 0.75) as q3 from clean)
select 'hist' as kind, cast(bin as double) as bin, cast(n as double) as n, round(lo + (hi - lo) * bin / {HIST_BINS}, 6) as x
from h, b
union all select 'box_q1', cast(null as double), cast(null as double), round(q1, 6) from box
union all select 'box_median', cast(null as double), cast(null as double), round(q2, 6) from box
union all select 'box_q3', cast(null as double), cast(null as double), round(q3, 6) from box"""))
def agg_plot_data(spark, sf):
    """Data behind the charts: 30-bin histogram of the target and its box statistics."""
    from ..operators import plotdata as pdat
    df = clean(spark, sf)
    hist = pdat.histogram(df, "congestion", HIST_BINS).select(
        F.lit("hist").alias("kind"), F.col("bin").cast("double").alias("bin"), F.col("n").cast("double").alias("n"),
        r("x_left").alias("x"))
    box = pdat.box_stats(df, "congestion")
    # bin / n are doubles so the box rows can carry NULL without a nullable-integer column
    return final(hist.unionByName(box.select("kind", F.lit(None).cast("double").alias("bin"),
                                             F.lit(None).cast("double").alias("n"), r("x").alias("x"))))


KDE_BINS, KDE_GRID = 512, 100


@register("agg_plot_kde", with_clean(f"""
with s as (select min(congestion) as lo, max(congestion) as hi, count(congestion) as n,
                  stddev_samp(congestion) * pow(count(congestion), -0.2) as h from clean),
hb as (select least(cast(floor((congestion - lo) / (hi - lo) * {KDE_BINS}) as bigint), {KDE_BINS - 1}) as bin,
              count(*) as n from clean, s where congestion is not null group by 1),
c as (select lo + (bin + 0.5) * (hi - lo) / {KDE_BINS} as c, hb.n from hb, s),
g as (select (lo - 3 * h) + ((hi + 3 * h) - (lo - 3 * h)) * i / {KDE_GRID - 1} as x
      from s, range(0, {KDE_GRID}) t(i))
select round(x, 6) as x, round(sum(c.n * exp(-0.5 * ((x - c) / h) * ((x - c) / h))) / (any_value(s.n) * any_value(h) * sqrt(2 * pi())), 9)
       as density from g, c, s group by x"""))
def agg_plot_kde(spark, sf):
    """Kernel density of the target on a 100-point grid (binned, Scott bandwidth)."""
    from ..operators import plotdata as pdat
    out = pdat.kde_binned(clean(spark, sf), "congestion", KDE_BINS, KDE_GRID)
    return final(out.select(r("x").alias("x"), r("density", 9).alias("density")))
