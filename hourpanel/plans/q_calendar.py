"""Registered calendar, binning and weather-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bins as bn
from ..functions import calendar as cal
from ..functions import features as ft
from ..operators.quantiles import exact_quantiles
from ..sources import fixtures as fx
from .common import clean, final, r, sql_case_in, with_clean
from .registry import register

KEY = fx.ROW_KEY
KEY_SQL = ", ".join(KEY)


def _sql_cut(col: str, edges, labels, include_lowest=False) -> str:
    parts = []
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        lo_s = "'-infinity'::double" if lo == float("-inf") else repr(float(lo))
        hi_s = "'infinity'::double" if hi == float("inf") else repr(float(hi))
        op = ">=" if (i == 0 and include_lowest) else ">"
        lab_s = f"'{lab}'" if isinstance(lab, str) else str(lab)
        parts.append(f"when {col} {op} {lo_s} and {col} <= {hi_s} then {lab_s}")
    return "case " + " ".join(parts) + " end"


def _sql_labeler(col: str, bands, zero_label=None) -> str:
    parts = [f"when {col} = 0 then '{zero_label}'"] if zero_label else []
    for bound, lab in bands:
        parts.append(f"when {col} is not null then '{lab}'" if bound is None else f"when {col} <= {bound} then '{lab}'")
    return "case " + " ".join(parts) + " end"


def _key(df, *cols):
    return final(df.select(*KEY, *cols))


@register("cal_parse", with_clean(f"select {KEY_SQL}, datetime from clean"))
def cal_parse(spark, sf):
    return _key(clean(spark, sf), "datetime")


@register("cal_parts", with_clean(f"""
select {KEY_SQL}, strftime(date, '%Y-%m-%d') as date, year, month, day, hour, dayofweek from clean"""))
def cal_parts(spark, sf):
    """Calendar parts (the date is rendered ISO yyyy-MM-dd for a type-stable comparison)."""
    return _key(clean(spark, sf), F.date_format("date", "yyyy-MM-dd").alias("date"), "year", "month", "day", "hour",
                "dayofweek")


@register("cal_tm_arith", with_clean(f"""
select {KEY_SQL}, tm % 100 as hour_arith, (tm // 10000) % 100 as month_arith, (tm // 100) % 100 as day_arith
from clean"""))
def cal_tm_arith(spark, sf):
    df = clean(spark, sf)
    return _key(df, cal.tm_hour("tm").alias("hour_arith"), cal.tm_month("tm").alias("month_arith"),
                (F.floor(F.col("tm") / 100) % 100).alias("day_arith"))


@register("cal_iso_week", with_clean(f"select {KEY_SQL}, weekofyear(datetime) as week_of_year from clean"))
def cal_iso_week(spark, sf):
    return _key(clean(spark, sf), cal.iso_week("datetime").alias("week_of_year"))


@register("cal_weekend", with_clean(f"""
select {KEY_SQL}, cast(dayofweek >= 5 as bigint) as is_weekend,
       case when dayofweek >= 5 then 'weekend' else 'weekday' end as day_type from clean"""))
def cal_weekend(spark, sf):
    return _key(clean(spark, sf), cal.weekend_flag().alias("is_weekend"), cal.day_type().alias("day_type"))


@register("cal_dow_flags", with_clean(f"""
select {KEY_SQL}, cast(dayofweek = 0 as bigint) as is_monday, cast(dayofweek = 4 as bigint) as is_friday,
       cast(dayofweek = 5 as bigint) as is_saturday, cast(dayofweek = 6 as bigint) as is_sunday from clean"""))
def cal_dow_flags(spark, sf):
    return _key(clean(spark, sf), *[c.alias(n) for n, c in cal.dow_flags().items()])


@register("cal_dow_name", with_clean(f"""
select {KEY_SQL}, dayofweek as weekday_order,
       {sql_case_in('dayofweek', [([i], n) for i, n in enumerate(cal.WEEKDAY_NAMES_KO)])} as weekday_ko from clean"""))
def cal_dow_name(spark, sf):
    return _key(clean(spark, sf), F.col("dayofweek").alias("weekday_order"), cal.dow_name().alias("weekday_ko"))


@register("cal_season", with_clean(f"""
select {KEY_SQL},
  cast({sql_case_in('month', [(v, k) for k, v in cal.SEASON_CODE_1_4.items()])} as bigint) as season_1_4,
  cast({sql_case_in('month', [(v, k) for k, v in cal.SEASON_CODE_0_3.items()])} as bigint) as season_0_3,
  {sql_case_in('month', cal.SEASON_LABELS_KO, cal.SEASON_LABEL_OTHER)} as season_label,
  {sql_case_in('month', cal.SEASON_DETAILED)} as detailed_season
from clean"""))
def cal_season(spark, sf):
    return _key(clean(spark, sf), cal.season("month", "code_1_4").alias("season_1_4"),
                cal.season("month", "code_0_3").alias("season_0_3"),
                cal.season("month", "label").alias("season_label"),
                cal.season("month", "detailed").alias("detailed_season"))


@register("cal_time_category", with_clean(f"""
select {KEY_SQL}, {_sql_cut('hour', cal.TIME_CATEGORY_EDGES, cal.TIME_CATEGORY_LABELS)} as time_category from clean"""))
def cal_time_category(spark, sf):
    return _key(clean(spark, sf), cal.time_category("hour").alias("time_category"))


@register("cal_time_group", with_clean(f"""
select {KEY_SQL}, {sql_case_in('hour', cal.TIME_GROUPS)} as time_group from clean"""))
def cal_time_group(spark, sf):
    return _key(clean(spark, sf), cal.time_group("hour").alias("time_group"))


@register("cal_time_period", with_clean(f"""
select {KEY_SQL}, {sql_case_in('hour', cal.TIME_PERIODS, cal.TIME_PERIOD_DEFAULT)} as time_period from clean"""))
def cal_time_period(spark, sf):
    return _key(clean(spark, sf), cal.time_period("hour").alias("time_period"))


@register("cal_rush_flag", with_clean(f"""
select {KEY_SQL}, {', '.join(f"cast(hour in ({', '.join(map(str, hs))}) as bigint) as rush_{k}"
                              for k, hs in cal.RUSH_HOURS.items())} from clean"""))
def cal_rush_flag(spark, sf):
    return _key(clean(spark, sf), *[cal.rush_flag("hour", k).alias(f"rush_{k}") for k in cal.RUSH_HOURS])


@register("cal_commute_peak", with_clean(f"""
select {KEY_SQL}, cast(hour between 7 and 9 as bigint) as is_morning_commute,
       cast(hour between 17 and 19 as bigint) as is_evening_commute,
       cast(hour between 7 and 9 or hour between 17 and 19 as bigint) as is_commute_time,
       cast(hour between 8 and 9 as bigint) as is_morning_peak, cast(hour between 18 and 19 as bigint) as is_evening_peak,
       cast(hour between 8 and 9 or hour between 18 and 19 as bigint) as is_peak_time from clean"""))
def cal_commute_peak(spark, sf):
    return _key(clean(spark, sf), *[c.alias(n) for n, c in cal.commute_flags().items()])


@register("cal_weekend_windows", with_clean(f"""
select {KEY_SQL}, cast(dayofweek >= 5 and hour >= 8 as bigint) as is_weekend_peak,
       cast(dayofweek >= 5 and hour between 8 and 12 as bigint) as weekend_hour_8_12,
       cast(dayofweek >= 5 and hour between 13 and 17 as bigint) as weekend_hour_13_17,
       cast(dayofweek >= 5 and hour between 18 and 22 as bigint) as weekend_hour_18_22 from clean"""))
def cal_weekend_windows(spark, sf):
    return _key(clean(spark, sf), *[c.alias(n) for n, c in cal.weekend_windows().items()])


@register("cal_day_hour_combo", with_clean(f"""
select {KEY_SQL}, concat_ws('_', cast(dayofweek as varchar), cast(hour as varchar)) as day_hour_combo from clean"""))
def cal_day_hour_combo(spark, sf):
    return _key(clean(spark, sf), cal.day_hour_combo().alias("day_hour_combo"))


@register("cal_cyclic", with_clean(f"""
select {KEY_SQL}, round(sin(2 * pi() * hour / 24), 9) as hour_sin, round(cos(2 * pi() * hour / 24), 9) as hour_cos,
       round(sin(2 * pi() * dayofweek / 7), 9) as day_sin, round(cos(2 * pi() * dayofweek / 7), 9) as day_cos,
       round(sin(2 * pi() * month / 12), 9) as month_sin, round(cos(2 * pi() * month / 12), 9) as month_cos,
       round(sin(2 * pi() * weekofyear(datetime) / 52), 9) as week_sin,
       round(cos(2 * pi() * weekofyear(datetime) / 52), 9) as week_cos from clean"""))
def cal_cyclic(spark, sf):
    df = cal.cyclic_features(clean(spark, sf).withColumn("week", cal.iso_week()), week="week")
    names = [f"{p}_{t}" for p in ("hour", "day", "month", "week") for t in ("sin", "cos")]
    return _key(df, *[r(n, 9).alias(n) for n in names])


_FIXED_MD = cal.recurring_month_days()


@register("cal_holiday", with_clean(f"""
select {KEY_SQL}, cast(date in ({', '.join(f"date '{d}'" for d in sorted(set(cal.HOLIDAYS)))})
                       or strftime(date, '%m-%d') in ({', '.join(f"'{m}'" for m in _FIXED_MD)}) as bigint) as is_holiday
from clean"""))
def cal_holiday(spark, sf):
    """Holiday flag: listed dates plus the fixed-date holidays of any year."""
    return _key(clean(spark, sf), cal.holiday_flag("date", recurring=True).alias("is_holiday"))


@register("cal_holiday_cross", with_clean(f"""
with h as (select *, cast(strftime(date, '%m-%d') in ({', '.join(f"'{m}'" for m in _FIXED_MD)}) as int) as is_holiday
           from clean)
select {KEY_SQL}, cast(is_holiday = 1 and hour between 7 and 9 as bigint) as is_holiday_and_morning,
       cast(is_holiday = 1 and hour between 17 and 19 as bigint) as is_holiday_and_evening from h"""))
def cal_holiday_cross(spark, sf):
    df = clean(spark, sf).withColumn("is_holiday", cal.holiday_flag("date", recurring=True))
    return _key(df, *[c.alias(n) for n, c in cal.holiday_cross().items()])


@register("cal_direction_cross", with_clean(f"""
select {KEY_SQL}, cast(hour between 7 and 9 and direction = 'O' as bigint) as is_morning_outer,
       cast(hour between 17 and 19 and direction = 'F' as bigint) as is_evening_inner from clean"""))
def cal_direction_cross(spark, sf):
    """Morning & up-line, evening & down-line (here the up/down codes are O/F)."""
    return _key(clean(spark, sf), *[c.alias(n) for n, c in cal.direction_cross(up="O", down="F").items()])


@register("cal_format", with_clean(f"""
select {KEY_SQL}, strftime(datetime, '%Y%m%d%H%M') as stamp,
       cast(substr(strftime(datetime, '%Y%m%d%H%M'), 9, 2) as bigint) as stamp_hour,
       strftime(datetime, '%Y-%m-%d') as date_str from clean"""))
def cal_format(spark, sf):
    df = clean(spark, sf).withColumn("stamp", cal.format_stamp("datetime"))
    return _key(df, "stamp", cal.stamp_hour("stamp").alias("stamp_hour"), cal.date_string().alias("date_str"))


# ------------------------------------------------------------------ binning
@register("bin_cut", with_clean(f"""
select {KEY_SQL},
  {_sql_cut('ta', bn.TEMP_6_EDGES, bn.TEMP_6_LABELS)} as temp_bin,
  {_sql_cut('ta', bn.TEMP_LEVEL_EDGES, bn.TEMP_LEVEL_LABELS)} as temp_level,
  {_sql_cut('hm', bn.HUMIDITY_LEVEL_EDGES, bn.HUMIDITY_LEVEL_LABELS)} as humidity_level,
  {_sql_cut('0.81 * ta + 0.01 * hm * (0.99 * ta - 14.3) + 46.3', bn.COMFORT_EDGES, bn.COMFORT_LABELS)} as comfort_level,
  {_sql_cut('ws', bn.WIND_LEVEL_EDGES, bn.WIND_LEVEL_LABELS)} as wind_level
from clean"""))
def bin_cut(spark, sf):
    df = clean(spark, sf)
    return _key(df, bn.cut("ta", bn.TEMP_6_EDGES, bn.TEMP_6_LABELS).alias("temp_bin"),
                bn.cut("ta", bn.TEMP_LEVEL_EDGES, bn.TEMP_LEVEL_LABELS).alias("temp_level"),
                bn.cut("hm", bn.HUMIDITY_LEVEL_EDGES, bn.HUMIDITY_LEVEL_LABELS).alias("humidity_level"),
                bn.cut(ft.discomfort_index(), bn.COMFORT_EDGES, bn.COMFORT_LABELS).alias("comfort_level"),
                bn.cut("ws", bn.WIND_LEVEL_EDGES, bn.WIND_LEVEL_LABELS).alias("wind_level"))


def _qcut_sql(col: str, q: int, labels) -> str:
    qs = ", ".join(f"quantile_cont({col}, {i / q})" for i in range(q + 1))
    e = [f"e[{i + 1}]" for i in range(q + 1)]
    parts = []
    for i, lab in enumerate(labels):
        op = ">=" if i == 0 else ">"
        parts.append(f"when {col} {op} {e[i]} and {col} <= {e[i + 1]} then '{lab}'")
    return qs, "case " + " ".join(parts) + " end"


_QA, _QB = _qcut_sql("ta", 3, bn.TEMP_QCUT_LABELS)
_FA, _FB = _qcut_sql("feels_like", 4, bn.FEELS_QCUT_LABELS)


@register("bin_qcut", with_clean(f"""
with x as (select *, ta - ws * 0.5 as feels_like from clean),
e1 as (select [{_QA}] as e from x), e2 as (select [{_FA}] as e from x)
select {KEY_SQL}, (select {_QB} from e1) as temp_level,
       (select {_FB} from e2) as feels_like_level from x"""))
def bin_qcut(spark, sf):
    df = clean(spark, sf).withColumn("feels_like", ft.feels_like())
    df = bn.qcut(df, "ta", 3, bn.TEMP_QCUT_LABELS, out="temp_level")
    df = bn.qcut(df, "feels_like", 4, bn.FEELS_QCUT_LABELS, out="feels_like_level")
    return _key(df, "temp_level", "feels_like_level")


@register("bin_rain_intensity", with_clean(f"""
select {KEY_SQL}, case when rn_day = 0 then '무강수' when rn_day <= 5 then '약한비' when rn_day <= 20 then '보통비'
                       when rn_day is not null then '강한비' end as rain_intensity from clean"""))
def bin_rain_intensity(spark, sf):
    return _key(clean(spark, sf), bn.rain_intensity("rn_day").alias("rain_intensity"))


@register("bin_weather_labels", with_clean(f"""
select {KEY_SQL}, {_sql_labeler('ta', bn.LABEL_TEMP)} as temp_category,
       {_sql_labeler('hm', bn.LABEL_HUMIDITY)} as humidity_category,
       {_sql_labeler('rn_hr1', bn.LABEL_RAIN, bn.LABEL_RAIN_ZERO)} as rainfall_category,
       {_sql_labeler('ws', bn.LABEL_WIND)} as wind_category, {_sql_labeler('si', bn.LABEL_SOLAR)} as solar_category,
       {_sql_labeler('ta_chi', bn.LABEL_APPARENT)} as apparent_temp_category from clean"""))
def bin_weather_labels(spark, sf):
    df = bn.weather_labels(clean(spark, sf))
    return _key(df, "temp_category", "humidity_category", "rainfall_category", "wind_category",
                "solar_category", "apparent_temp_category")


@register("bin_quantile_bands", with_clean("""
with q as (select quantile_cont(ta, 0.05) as q05, quantile_cont(ta, 0.25) as q25, quantile_cont(ta, 0.75) as q75,
                  quantile_cont(ta, 0.95) as q95 from clean),
b as (select 0 as band, ta, congestion from clean, q where ta <= q05
      union all select 1, ta, congestion from clean, q where ta > q05 and ta <= q25
      union all select 2, ta, congestion from clean, q where ta > q25 and ta <= q75
      union all select 3, ta, congestion from clean, q where ta > q75 and ta <= q95
      union all select 4, ta, congestion from clean, q where ta >= q95)
select cast(band as bigint) as band, cast(count(*) as bigint) as n, round(avg(congestion), 6) as mean_congestion
from b group by band"""))
def bin_quantile_bands(spark, sf):
    """Rows per temperature quantile band (bands overlap at q95) and mean target per band."""
    df = clean(spark, sf)
    q05, q25, q75, q95 = [F.lit(v) for v in exact_quantiles(df, {"ta": [0.05, 0.25, 0.75, 0.95]})["ta"]]
    ex = df.select(F.explode(bn.quantile_band_masks("ta", q05, q25, q75, q95)).alias("band"), "congestion")
    out = ex.groupBy("band").agg(F.count(F.lit(1)).cast("long").alias("n"), r(F.avg("congestion")).alias("mean_congestion"))
    return final(out)


@register("bin_rain_bands", with_clean(f"""
select {KEY_SQL}, case when rn_hr1 = 0 then '{bn.RAIN_BANDS[0]}' when rn_hr1 <= 2 then '{bn.RAIN_BANDS[1]}'
       when rn_hr1 <= 5 then '{bn.RAIN_BANDS[2]}' when rn_hr1 > 5 then '{bn.RAIN_BANDS[3]}' end as rain_band from clean"""))
def bin_rain_bands(spark, sf):
    return _key(clean(spark, sf), bn.rain_band("rn_hr1").alias("rain_band"))


@register("bin_rare_collapse", with_clean(f"""
with c as (select station_name, count(*) as n from clean group by station_name)
select {KEY_SQL}, case when c.n > 600 then x.station_name else 'Other' end as station_group
from clean x left join c using (station_name)"""))
def bin_rare_collapse(spark, sf):
    """Stations with more than 600 rows keep their name, the rest become 'Other'."""
    out = bn.rare_collapse(clean(spark, sf), "station_name", 600, out="station_group")
    return _key(out, "station_group")


# ------------------------------------------------------------------ features
_TH_SQL = """th as (select quantile_cont(ta, 0.05) as ta_q05, quantile_cont(ta, 0.95) as ta_q95,
                    quantile_cont(ws, 0.90) as ws_q90, quantile_cont(ws, 0.95) as ws_q95,
                    quantile_cont(hm, 0.05) as hm_q05, quantile_cont(hm, 0.95) as hm_q95 from clean)"""
_FLAGS_SQL = """coalesce(cast(ta <= ta_q05 as int), 0) as extreme_cold, coalesce(cast(ta >= ta_q95 as int), 0) as extreme_heat,
  coalesce(cast(ta > ta_q05 and ta < ta_q95 as int), 0) as moderate_temp, coalesce(cast(rn_hr1 = 0 as int), 0) as no_rain,
  coalesce(cast(rn_hr1 > 0 and rn_hr1 <= 2 as int), 0) as light_rain, coalesce(cast(rn_hr1 > 10 as int), 0) as heavy_rain,
  coalesce(cast(rn_hr1 > 30 as int), 0) as extreme_rain, coalesce(cast(ws <= 1 as int), 0) as calm_wind,
  coalesce(cast(ws >= ws_q90 as int), 0) as strong_wind, coalesce(cast(ws >= ws_q95 as int), 0) as extreme_wind,
  coalesce(cast(hm <= hm_q05 as int), 0) as extreme_dry, coalesce(cast(hm >= hm_q95 as int), 0) as extreme_humid"""
_FLAG_NAMES = ["extreme_cold", "extreme_heat", "moderate_temp", "no_rain", "light_rain", "heavy_rain", "extreme_rain",
               "calm_wind", "strong_wind", "extreme_wind", "extreme_dry", "extreme_humid"]


@register("feat_extreme_flags", with_clean(f"""
with {_TH_SQL}, f as (select {KEY_SQL}, {_FLAGS_SQL} from clean, th)
select {KEY_SQL}, {', '.join(f'cast({n} as bigint) as {n}' for n in _FLAG_NAMES)} from f"""))
def feat_extreme_flags(spark, sf):
    df = ft.with_extreme_flags(clean(spark, sf))
    return _key(df, *_FLAG_NAMES)


@register("feat_extreme_any", with_clean(f"""
with {_TH_SQL}, f as (select {KEY_SQL}, {_FLAGS_SQL} from clean, th)
select cast(sum(greatest(extreme_cold, extreme_heat, heavy_rain, extreme_wind, extreme_dry, extreme_humid)) as bigint)
         as extreme_rows,
       round(avg(greatest(extreme_cold, extreme_heat, heavy_rain, extreme_wind, extreme_dry, extreme_humid)), 6)
         as extreme_share from f"""))
def feat_extreme_any(spark, sf):
    df = ft.with_extreme_flags(clean(spark, sf))
    out = df.agg(F.sum("extreme_weather_any").cast("long").alias("extreme_rows"),
                 r(F.avg("extreme_weather_any")).alias("extreme_share"))
    return final(out)


@register("feat_interactions", with_clean(f"""
select {KEY_SQL}, ta * (1 + hm / 100) as apparent_temp, ta * hm as temp_humidity_interaction, ta - ws * 2 as wind_chill,
       ta * ws as temp_wind_interaction, rn_hr1 * ws as rain_wind_interaction, rn_hr1 * hm as rain_humidity_interaction,
       ta * hour as temp_hour_interaction, ta * month as temp_season_interaction from clean"""))
def feat_interactions(spark, sf):
    cols = ft.interaction_columns()
    return _key(clean(spark, sf).withColumns(cols), *cols.keys())


@register("feat_extreme_rush", with_clean(f"""
with {_TH_SQL}, f as (select {KEY_SQL}, hour, {_FLAGS_SQL} from clean, th)
select {KEY_SQL}, cast(greatest(extreme_cold, extreme_heat, heavy_rain, extreme_wind, extreme_dry, extreme_humid)
                       * cast(hour in (8, 9, 19, 20) as int) as bigint) as extreme_weather_rush from f"""))
def feat_extreme_rush(spark, sf):
    df = ft.with_extreme_flags(clean(spark, sf)).withColumn("time_period", cal.time_period("hour"))
    return _key(df, ft.extreme_rush().alias("extreme_weather_rush"))


@register("feat_discomfort", with_clean(f"""
select {KEY_SQL}, round(0.81 * ta + 0.01 * hm * (0.99 * ta - 14.3) + 46.3, 9) as discomfort_index,
       round(ta - ws * 0.5, 9) as feels_like, round(ta * 0.4 + hm * 0.3 + ws * 0.2 + rn_day * 0.1, 9) as weather_composite
from clean"""))
def feat_discomfort(spark, sf):
    """Discomfort index, feels-like temperature and the composite weather index."""
    df = clean(spark, sf)
    return _key(df, r(ft.discomfort_index(), 9).alias("discomfort_index"), r(ft.feels_like(), 9).alias("feels_like"),
                r(ft.weather_composite(), 9).alias("weather_composite"))


@register("feat_feels_like", with_clean(f"""
select {_sql_cut('ta - ws * 0.5', [-1e9, 0, 10, 20, 1e9], ['cold', 'cool', 'mild', 'warm'])} as feels_band,
       round(avg(congestion), 6) as mean_congestion, cast(count(*) as bigint) as n
from clean where ta is not null and ws is not null group by 1"""))
def feat_feels_like(spark, sf):
    """Mean congestion per feels-like band."""
    df = clean(spark, sf).withColumn("fl", ft.feels_like()).filter(F.col("fl").isNotNull())
    band = bn.cut("fl", [-1e9, 0, 10, 20, 1e9], ["cold", "cool", "mild", "warm"]).alias("feels_band")
    out = df.groupBy(band).agg(r(F.avg("congestion")).alias("mean_congestion"), F.count(F.lit(1)).cast("long").alias("n"))
    return final(out)


@register("feat_composite", with_clean("""
select cast(hour in (7, 8, 9, 17, 18, 19) as bigint) as rush_hour,
       round(avg(ta * 0.4 + hm * 0.3 + ws * 0.2 + rn_day * 0.1), 6) as mean_composite,
       round(corr(ta * 0.4 + hm * 0.3 + ws * 0.2 + rn_day * 0.1, congestion), 6) as r_composite
from clean group by 1"""))
def feat_composite(spark, sf):
    df = clean(spark, sf).withColumn("wc", ft.weather_composite())
    out = df.groupBy(F.col("hour").isin(ft.EDA_RUSH_HOURS).cast("long").alias("rush_hour")).agg(
        r(F.avg("wc")).alias("mean_composite"), r(F.corr("wc", "congestion")).alias("r_composite"))
    return final(out)


@register("feat_cross_eda", with_clean(f"""
with x as (select *, cast(dayofweek >= 5 as int) as is_weekend, ta * 0.4 + hm * 0.3 + ws * 0.2 + rn_day * 0.1 as wc
           from clean)
select {KEY_SQL}, ta * hour as temp_hour_interaction, rn_day * is_weekend as rain_weekend_effect,
       round(wc, 9) as weather_composite, round(cast(hour in (7,8,9,17,18,19) as int) * wc, 9) as rush_weather_interaction,
       round(is_weekend * wc, 9) as weekend_weather_interaction, ta * hm as temp_humidity_product,
       rn_day * ws as rain_wind_product from x"""))
def feat_cross_eda(spark, sf):
    df = clean(spark, sf).withColumn("is_weekend", cal.weekend_flag())
    cols = ft.eda_cross_columns()
    df = df.withColumns(cols)
    rounded = {"weather_composite", "rush_weather_interaction", "weekend_weather_interaction"}
    return _key(df, *[r(c, 9).alias(c) if c in rounded else F.col(c) for c in cols])


@register("feat_is_rainy", with_clean(f"select {KEY_SQL}, coalesce(cast(rn_hr1 > 0 as bigint), 0) as is_rainy from clean"))
def feat_is_rainy(spark, sf):
    return _key(clean(spark, sf), ft.is_rainy().alias("is_rainy"))


@register("feat_combo_key", with_clean(f"""
select {KEY_SQL}, concat_ws('_', {_sql_cut('ta', bn.TEMP_3_EDGES, bn.TEMP_3_LABELS)},
                 cast(coalesce(cast(rn_hr1 > 0 as int), 0) as varchar),
                 {_sql_cut('hour', cal.TIME_CATEGORY_EDGES, cal.TIME_CATEGORY_LABELS)}) as weather_time_combo from clean"""))
def feat_combo_key(spark, sf):
    key = ft.combo_key(bn.cut("ta", bn.TEMP_3_EDGES, bn.TEMP_3_LABELS), ft.is_rainy(), cal.time_category("hour"))
    return _key(clean(spark, sf), key.alias("weather_time_combo"))
