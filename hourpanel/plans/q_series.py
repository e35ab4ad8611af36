"""Registered window / time-series queries.

Series queries run the skew-safe block path with the library's block size;
the tests run the same operators with small blocks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as se
from ..sources import fixtures as fx
from .common import clean, final, hourly, r, with_clean, with_hourly
from .registry import register

KEY = fx.ROW_KEY
KEY_SQL = ", ".join(KEY)
W_ST = f"partition by station_name order by {KEY_SQL}"
W_H = "partition by station_name order by ts_hour"


def hourly_pos(spark, sf):
    """Hourly panel with its position inside each station's series."""
    df = hourly(spark, sf).select("station_name", "ts_hour", "congestion")
    return se.sequence_index(df, ["station_name"], ["ts_hour"], length="n_rows")


def wide_pos(spark, sf, cols):
    """Key and ``cols`` of the cleaned wide panel, series = station, ordered by stamp + row-key tie-break."""
    return se.sequence_index(clean(spark, sf).select("station_name", *KEY, *cols), ["station_name"], KEY)


@register("win_lag_target", with_hourly(f"""
select station_name, ts_hour, {', '.join(f'lag(congestion, {k}) over ({W_H}) as congestion_lag_{k}' for k in (1, 2, 3, 24, 48))}
from hourly"""))
def win_lag_target(spark, sf):
    df = se.add_lags(hourly_pos(spark, sf), ["station_name"], "pos", ["congestion"], [1, 2, 3, 24, 48],
                     name="{col}_lag_{k}")
    return final(df.select("station_name", "ts_hour", *[f"congestion_lag_{k}" for k in (1, 2, 3, 24, 48)]))


_WV = ["ta", "ws", "rn_hr1", "hm"]


@register("win_lag_weather", with_clean(f"""
select {KEY_SQL}, {', '.join(f'lag({c}, 24) over ({W_ST}) as {c}_lag_24' for c in _WV)} from clean"""))
def win_lag_weather(spark, sf):
    df = se.add_lags(wide_pos(spark, sf, _WV), ["station_name"], "pos", _WV, [24])
    return final(df.select(*KEY, *[f"{c}_lag_24" for c in _WV]))


@register("win_ma_weather", with_clean(f"""
select {KEY_SQL}, {', '.join(f'round(avg({c}) over ({W_ST} rows between {k - 1} preceding and current row), 6) as {c}_ma_{k}'
                              for c in _WV for k in (3, 6, 12))} from clean"""))
def win_ma_weather(spark, sf):
    df = se.add_rolling_means(wide_pos(spark, sf, _WV), ["station_name"], "pos", _WV, [3, 6, 12])
    return final(df.select(*KEY, *[r(f"{c}_ma_{k}").alias(f"{c}_ma_{k}") for c in _WV for k in (3, 6, 12)]))


@register("win_ma_target", with_hourly(f"""
select station_name, ts_hour, {', '.join(
    f'round(avg(congestion) over ({W_H} rows between {k - 1} preceding and current row), 6) as congestion_ma_{k}'
    for k in (3, 6, 12, 24))} from hourly"""))
def win_ma_target(spark, sf):
    df = se.add_rolling_means(hourly_pos(spark, sf), ["station_name"], "pos", ["congestion"], [3, 6, 12, 24])
    return final(df.select("station_name", "ts_hour", *[r(f"congestion_ma_{k}").alias(f"congestion_ma_{k}")
                                                         for k in (3, 6, 12, 24)]))


_FFBF_SQL = f"""coalesce(congestion,
    last_value(congestion ignore nulls) over ({W_H} rows between unbounded preceding and current row),
    first_value(congestion ignore nulls) over ({W_H} rows between current row and unbounded following))"""


@register("win_fill_ff_bf", with_hourly(f"""
select station_name, ts_hour, round(coalesce({_FFBF_SQL}, (select median(congestion) from hourly)), 6) as congestion
from hourly"""))
def win_fill_ff_bf(spark, sf):
    df = se.fill_ff_bf(hourly_pos(spark, sf), ["station_name"], "pos", ["congestion"])
    return final(df.select("station_name", "ts_hour", r("congestion").alias("congestion")))


@register("win_fill_lag", with_clean(f"""
with l as (select {KEY_SQL}, station_name, ta, lag(ta, 24) over ({W_ST}) as ta_lag_24,
                  lag(congestion, 1) over ({W_ST}) as congestion_lag_1 from clean)
select {KEY_SQL}, coalesce(ta_lag_24, ta, 0.0) as ta_lag_24,
       round(coalesce(congestion_lag_1, avg(congestion_lag_1) over (partition by station_name), 50.0), 6) as congestion_lag_1
from l"""))
def win_fill_lag(spark, sf):
    df = se.add_lags(wide_pos(spark, sf, ["ta", "congestion"]), ["station_name"], "pos", ["ta"], [24])
    df = se.add_lags(df, ["station_name"], "pos", ["congestion"], [1])
    df = se.fill_lag_features(df, ["station_name"], {"ta_lag_24": "ta"}, ["congestion_lag_1"])
    return final(df.select(*KEY, "ta_lag_24", r("congestion_lag_1").alias("congestion_lag_1")))


@register("win_interpolate", with_hourly(f"""
with p as (select *, row_number() over ({W_H}) - 1 as pos from hourly),
q as (select *, last_value(case when congestion is not null then pos end ignore nulls)
                  over ({W_H} rows between unbounded preceding and current row) as pi,
                last_value(congestion ignore nulls) over ({W_H} rows between unbounded preceding and current row) as pv,
                first_value(case when congestion is not null then pos end ignore nulls)
                  over ({W_H} rows between current row and unbounded following) as ni,
                first_value(congestion ignore nulls) over ({W_H} rows between current row and unbounded following) as nv
      from p)
select station_name, ts_hour,
       round(case when congestion is not null then congestion
                  when pi is not null and ni is not null then pv + (nv - pv) * (pos - pi) / (ni - pi)
                  when pi is not null then pv end, 6) as congestion_interpolated
from q"""))
def win_interpolate(spark, sf):
    df = se.interpolate_linear(hourly_pos(spark, sf), ["station_name"], "pos", ["congestion"])
    return final(df.select("station_name", "ts_hour", r("congestion_interpolated").alias("congestion_interpolated")))


@register("win_drop_warmup", with_hourly(f"""
select * from (select station_name, ts_hour, {', '.join(f'lag(congestion, {k}) over ({W_H}) as lag_{k}' for k in (1, 2, 3))}
               from hourly) where lag_1 is not null and lag_2 is not null and lag_3 is not null"""))
def win_drop_warmup(spark, sf):
    df = se.add_lags(hourly_pos(spark, sf), ["station_name"], "pos", ["congestion"], [1, 2, 3], name="lag_{k}")
    df = se.drop_warmup(df, ["lag_1", "lag_2", "lag_3"])
    return final(df.select("station_name", "ts_hour", "lag_1", "lag_2", "lag_3"))


@register("win_chrono_split", with_clean("""
with s as (select tm, percent_rank() over (order by tm) as pr from (select distinct tm from clean)),
t as (select c.tm, c.congestion, case when s.pr < 0.8 then 'train' else 'test' end as part from clean c join s using (tm))
select part, cast(count(*) as bigint) as n, min(tm) as min_tm, max(tm) as max_tm, round(avg(congestion), 6) as mean_y
from t group by part"""))
def win_chrono_split(spark, sf):
    df = se.chrono_split(clean(spark, sf), "tm", 0.8)
    out = df.groupBy("part").agg(F.count(F.lit(1)).cast("long").alias("n"), F.min("tm").alias("min_tm"),
                                 F.max("tm").alias("max_tm"), r(F.avg("congestion")).alias("mean_y"))
    return final(out)


_DECOMP_SQL = with_hourly(f"""
with f as (select station_name, ts_hour, {_FFBF_SQL} as y from hourly),
p as (select *, row_number() over ({W_H}) - 1 as pos, count(*) over (partition by station_name) as n from f),
t0 as (select *, case when pos >= 12 and pos <= n - 13 then
         (sum(y) over (partition by station_name order by pos rows between 12 preceding and 12 following)
          - 0.5 * (lag(y, 12) over (partition by station_name order by pos)
                   + lead(y, 12) over (partition by station_name order by pos))) / 24 end as trend0,
         pos >= 12 and pos < least(36, n - 13) as in_f,
         pos >= greatest(12, n - 13 - 24) and pos < n - 13 as in_b
       from p),
fit as (select station_name,
          regr_slope(case when in_f then trend0 end, case when in_f then pos end) as kf,
          regr_intercept(case when in_f then trend0 end, case when in_f then pos end) as nf,
          regr_slope(case when in_b then trend0 end, case when in_b then pos end) as kb,
          regr_intercept(case when in_b then trend0 end, case when in_b then pos end) as nb,
          count_if(y is null) as ymiss
        from t0 group by station_name),
t as (select t0.*, fit.ymiss, case when pos < 12 then kf * pos + nf when pos > n - 13 then kb * pos + nb
                                  else trend0 end as trend
      from t0 join fit using (station_name)),
ph as (select station_name, pos % 24 as phase, avg(y - trend) as pm from t group by all),
phc as (select station_name, phase, pm - avg(pm) over (partition by station_name) as seasonal from ph)
select t.station_name, t.ts_hour,
       round(case when n >= 48 and ymiss = 0 then trend end, 6) as trend,
       round(case when n >= 48 and ymiss = 0 then seasonal end, 6) as seasonal,
       round(case when n >= 48 and ymiss = 0 then y - trend - seasonal else y end, 6) as residual
from t join phc on t.station_name = phc.station_name and t.pos % 24 = phc.phase""")


@register("win_decompose", _DECOMP_SQL)
def win_decompose(spark, sf):
    """Daily-period additive decomposition of the gap-filled hourly series."""
    df = hourly_pos(spark, sf)
    df = se.fill_ff_bf(df, ["station_name"], "pos", ["congestion"], median_fallback=False)
    out = se.decompose_additive(df, ["station_name"], "pos", "n_rows", "congestion", 24)
    return final(out.select("station_name", "ts_hour", r("trend").alias("trend"), r("seasonal").alias("seasonal"),
                            r("residual").alias("residual")))


def _chained(spark, sf):
    """The whole feature chain fitted on the train period, applied to the test period."""
    from .feature_chain import FeatureChain
    df = fx.panel_wide(spark, sf)  # the chain adds the calendar's columns where no row moves any more
    tr, te = df.filter(F.col("tm") < 2000000000), df.filter(F.col("tm") >= 2000000000)
    chain = FeatureChain(series_keys=["station_name"], order=KEY,
                         exclude=["tm", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"], target="congestion")
    return chain.fit(tr).transform(te)


@register("impute_chain")
def impute_chain(spark, sf):
    """Whole feature chain fitted on the train period, applied to the test period;
    returns the per-column missing counts of the result (all zero)."""
    from ..sources import panel_io as pio
    return pio.profile(_chained(spark, sf))


_CHAIN_WEATHER = ("ta", "ws", "rn_hr1", "hm")
_CHAIN_W = f"(partition by station_name order by {', '.join(KEY)}"
_CHAIN_OUT = ["ta", "ws", "rn_hr1", "hm", "si", "ta_lag_24", "hm_lag_24", "ta_ma_3", "rn_hr1_ma_12", "congestion_lag_1", "congestion_lag_24", "congestion_ma_6"]


@register("impute_chain_rows", with_clean(f"""
with med as (select {', '.join(f'median({c}) as m_{c}' for c in (*_CHAIN_WEATHER, 'si'))} from clean where tm < 2000000000),
te as (select * from clean where tm >= 2000000000),
s as (
  select te.*, {', '.join(f"""coalesce(last_value({c} ignore nulls) over {_CHAIN_W} rows between unbounded preceding and current row),
    first_value({c} ignore nulls) over {_CHAIN_W} rows between current row and unbounded following), m_{c}) as f_{c}""" for c in _CHAIN_WEATHER)},
    m_si, lag(ta, 24) over {_CHAIN_W}) as l_ta, lag(hm, 24) over {_CHAIN_W}) as l_hm,
    avg(ta) over {_CHAIN_W} rows between 2 preceding and current row) as a_ta, avg(rn_hr1) over {_CHAIN_W} rows between 11 preceding and current row) as a_rn,
    lag(congestion, 1) over {_CHAIN_W}) as c1, lag(congestion, 24) over {_CHAIN_W}) as c24,
    avg(congestion) over {_CHAIN_W} rows between 5 preceding and current row) as a_c
  from te, med)
select {', '.join(KEY)}, round(f_ta, 6) as ta, round(f_ws, 6) as ws, round(f_rn_hr1, 6) as rn_hr1, round(f_hm, 6) as hm, round(coalesce(si, m_si), 6) as si,
       round(coalesce(l_ta, f_ta, 0), 6) as ta_lag_24, round(coalesce(l_hm, f_hm, 0), 6) as hm_lag_24, round(coalesce(a_ta, f_ta, 0), 6) as ta_ma_3,
       round(coalesce(a_rn, f_rn_hr1, 0), 6) as rn_hr1_ma_12, round(coalesce(c1, avg(c1) over (partition by station_name), 50), 6) as congestion_lag_1,
       round(coalesce(c24, avg(c24) over (partition by station_name), 50), 6) as congestion_lag_24, round(coalesce(a_c, avg(a_c) over (partition by station_name), 50), 6) as congestion_ma_6
from s"""))
def impute_chain_rows(spark, sf):
    """The filled rows of the chain: weather, lags and rolling means of each test row."""
    return final(_chained(spark, sf).select(*KEY, *[r(c).alias(c) for c in _CHAIN_OUT]))


def cal_panel(spark, sf):
    from ..functions import calendar as cal
    return cal.with_calendar(fx.panel_wide(spark, sf))
