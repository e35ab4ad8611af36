"""Registered missing-value profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import impute as im
from ..operators import missing as ms
from ..operators import select as sel
from ..operators import series as se
from ..sources import fixtures as fx
from .common import clean, final, r, with_clean
from .registry import register

KEY = fx.ROW_KEY
KEY_SQL = ", ".join(KEY)
WCOLS = ["ta", "ws", "hm", "si", "rn_hr1"]
BASIC = ["ta", "ws", "rn_hr1", "hm"]
W_ST = f"partition by station_name order by {KEY_SQL}"


@register("agg_null_profile", with_clean(" union all ".join(
    [f"select '{c}' as variable, cast(count_if({c} is null) as bigint) as count, "
     f"round(count_if({c} is null) / count(*) * 100, 6) as pct from clean" for c in WCOLS]
    + ["select 'complete_rows', cast(count_if(" + " and ".join(f"{c} is not null" for c in WCOLS)
       + ") as bigint), round(count_if(" + " and ".join(f"{c} is not null" for c in WCOLS)
       + ") / count(*) * 100, 6) from clean"])))
def agg_null_profile(spark, sf):
    out = ms.null_profile(clean(spark, sf), WCOLS)
    return final(out.withColumn("pct", r("pct")))


def _by(kind):
    return " union all ".join(
        f"select '{kind}' as kind, cast({kind} as bigint) as grp, '{c}' as variable, "
        f"round(avg(cast({c} is null as double)) * 100, 6) as null_pct from clean group by {kind}" for c in WCOLS)


@register("agg_null_by_group", with_clean(f"{_by('hour')} union all {_by('month')}"))
def agg_null_by_group(spark, sf):
    """Null % per variable by hour and by (true) month, long format."""
    df = clean(spark, sf)
    h = ms.null_pct_by(df, "hour", WCOLS, "grp").select(F.lit("hour").alias("kind"), "*")
    m = ms.null_pct_by(df, "month", WCOLS, "grp").select(F.lit("month").alias("kind"), "*")
    return final(h.unionByName(m).withColumn("null_pct", r("null_pct")))


ALERT_PCT = 3.0


@register("agg_null_alerts", with_clean(f"""
select hour, variable, round(pct, 6) as null_pct from (select cast(hour as bigint) as hour, variable, pct from
  ({' union all '.join(f"select hour, '{c}' as variable, avg(cast({c} is null as double)) * 100 as pct from clean group by hour" for c in WCOLS)}))
where pct >= {ALERT_PCT}"""))
def agg_null_alerts(spark, sf):
    """(hour, variable) cells whose missing share reaches the alert level (3 % here; 30 % is the default)."""
    df = clean(spark, sf)
    return final(ms.null_alerts(df, "hour", WCOLS, ALERT_PCT).withColumn("null_pct", r("null_pct")))


_PAIRS = [(a, b) for i, a in enumerate(WCOLS) for b in WCOLS[i + 1:]]


@register("agg_null_overlap", with_clean(" union all ".join(
    f"select '{a}' as var1, '{b}' as var2, cast(count_if({a} is null and {b} is null) as bigint) as joint, "
    f"round(count_if({a} is null and {b} is null) / count(*) * 100, 6) as joint_pct_rows, "
    f"round(count_if({a} is null and {b} is null) / nullif(count_if({a} is null), 0) * 100, 6) as joint_pct_var1, "
    f"cast(coalesce(count_if({a} is null and {b} is null) / nullif(count_if({a} is null), 0) * 100, 0) > 50 as bigint)"
    f" as alert from clean" for a, b in _PAIRS)))
def agg_null_overlap(spark, sf):
    out = ms.null_overlap(clean(spark, sf), WCOLS)
    return final(out.withColumns({"joint_pct_rows": r("joint_pct_rows"), "joint_pct_var1": r("joint_pct_var1")}))


@register("agg_null_corr", with_clean(" union all ".join(
    f"select '{a}' as var1, '{b}' as var2, round(corr(cast({a} is null as double), cast({b} is null as double)), 6) as r "
    f"from clean" for a, b in _PAIRS)))
def agg_null_corr(spark, sf):
    out = ms.null_indicator_corr(clean(spark, sf), WCOLS)
    return final(out.withColumn("r", r("r")))


@register("agg_row_null_count", with_clean(f"""
select {KEY_SQL}, {' + '.join(f'cast({c} is null as bigint)' for c in BASIC)} as missing_count,
       cast(({' + '.join(f'cast({c} is null as int)' for c in BASIC)}) >= 2 as bigint) as multiple_missing from clean"""))
def agg_row_null_count(spark, sf):
    df = ms.with_row_nulls(clean(spark, sf), BASIC)
    return final(df.select(*KEY, "missing_count", F.col("multiple_missing").cast("long").alias("multiple_missing")))


def dataset_c(spark, sf):
    """Set C: ta/ws/hm interpolated by position inside each station series
    among rows with fewer than two missing basic variables; rain gaps -> 0."""
    df = ms.with_row_nulls(clean(spark, sf).select("station_name", *KEY, *BASIC, "si", "hour", "congestion"), BASIC).drop("missing_count")
    ok = df.filter(~F.col("multiple_missing"))
    ok = se.sequence_index(ok, ["station_name"], KEY)
    ok = se.interpolate_linear(ok, ["station_name"], "pos", ["ta", "ws", "hm"]).drop("pos")
    rest = df.filter(F.col("multiple_missing")).withColumns(
        {f"{c}_interpolated": F.col(c) for c in ("ta", "ws", "hm")})
    allrows = ok.unionByName(rest)
    allrows = im.impute_rain_zero(allrows)
    return sel.complete_rows(allrows, sel.SET_INTERPOLATED)


_MM = " + ".join(f"cast({c} is null as int)" for c in BASIC)
_W_OK = f"partition by station_name order by {KEY_SQL}"
_INTERP = ", ".join(f"""
  case when {c} is not null then {c}
       when last_value(case when {c} is not null then pos end ignore nulls) over ({_W_OK} rows between unbounded preceding and current row) is not null
        and first_value(case when {c} is not null then pos end ignore nulls) over ({_W_OK} rows between current row and unbounded following) is not null
       then last_value({c} ignore nulls) over ({_W_OK} rows between unbounded preceding and current row)
          + (first_value({c} ignore nulls) over ({_W_OK} rows between current row and unbounded following)
             - last_value({c} ignore nulls) over ({_W_OK} rows between unbounded preceding and current row))
          * (pos - last_value(case when {c} is not null then pos end ignore nulls) over ({_W_OK} rows between unbounded preceding and current row))
          / (first_value(case when {c} is not null then pos end ignore nulls) over ({_W_OK} rows between current row and unbounded following)
             - last_value(case when {c} is not null then pos end ignore nulls) over ({_W_OK} rows between unbounded preceding and current row))
       else last_value({c} ignore nulls) over ({_W_OK} rows between unbounded preceding and current row) end as {c}_interpolated"""
                    for c in ("ta", "ws", "hm"))
SQL_C = f"""mm as (select *, ({_MM}) >= 2 as multiple_missing from clean),
okp as (select *, row_number() over ({_W_OK}) - 1 as pos from mm where not multiple_missing),
oki as (select * exclude (pos), {_INTERP} from okp),
c_all as (select * from oki union all by name
          select *, ta as ta_interpolated, ws as ws_interpolated, hm as hm_interpolated from mm where multiple_missing),
c_set as (select *, coalesce(rn_hr1, 0.0) as rn_hr1_filled from c_all
          where ta_interpolated is not null and ws_interpolated is not null and hm_interpolated is not null and si is not null)"""


@register("agg_dataset_compare", with_clean(f"""
with {SQL_C}
select 'A' as dataset, cast(count(*) as bigint) as rows, round(avg(congestion), 6) as mean_y,
       cast(count(distinct hour) as bigint) as hours from clean
where ta is not null and ws is not null and rn_hr1 is not null and hm is not null and si is not null and ta_chi is not null
union all
select 'B', cast(count(*) as bigint), round(avg(congestion), 6), cast(count(distinct hour) as bigint) from clean
where ta is not null and ws is not null and rn_hr1 is not null and hm is not null
union all
select 'C', cast(count(*) as bigint), round(avg(congestion), 6), cast(count(distinct hour) as bigint) from c_set"""))
def agg_dataset_compare(spark, sf):
    df = clean(spark, sf)
    frames = {"A": sel.complete_rows(df, sel.SET_COMPLETE), "B": sel.complete_rows(df, sel.SET_BASIC),
              "C": dataset_c(spark, sf)}
    out = ms.dataset_compare(frames, "congestion")
    return final(out.withColumn("mean_y", r("mean_y")))


@register("filter_complete_sets_interpolated", with_clean(f"""
with {SQL_C}
select {KEY_SQL}, round(ta_interpolated, 6) as ta_interpolated, round(ws_interpolated, 6) as ws_interpolated,
       round(hm_interpolated, 6) as hm_interpolated, rn_hr1_filled from c_set"""))
def filter_complete_sets_interpolated(spark, sf):
    """Data set C rows (interpolated weather, rain gaps as 0)."""
    c = dataset_c(spark, sf)
    return final(c.select(*KEY, *[r(f"{v}_interpolated").alias(f"{v}_interpolated") for v in ("ta", "ws", "hm")],
                          "rn_hr1_filled"))
