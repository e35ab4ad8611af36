"""Registered statistics and hour-effect queries.

The analysis frame follows the study: service hours only (1-4 h dropped)
and rows complete in the basic weather set (ta, ws, rn_hr1, hm).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bins as bn
from ..functions import calendar as cal
from ..operators import effects as fx_eff
from ..operators import select as sel
from ..operators import stats as st
from ..operators.quantiles import exact_quantiles, grouped_quantiles
from ..sources import fixtures as fx
from .common import clean, final, r, sql_case_in, with_clean
from ..session import materialize
from .registry import register

KEY = fx.ROW_KEY
KEY_SQL = ", ".join(KEY)
XS = ["ta", "ws", "rn_hr1", "hm"]
CORR_VARS = ["ta", "ws", "rn_hr1", "hm", "si", "ta_chi"]
LABEL_SETS = ["temp_category", "humidity_category", "rainfall_category", "wind_category", "solar_category",
              "apparent_temp_category"]


def analysis(spark, sf):
    df = sel.complete_rows(sel.drop_service_hours(clean(spark, sf)), sel.SET_BASIC)
    return bn.weather_labels(df.withColumn("time_group", cal.time_group("hour")))


def _lab(col, bands, zero=None):
    parts = [f"when {col} = 0 then '{zero}'"] if zero else []
    parts += [f"when {col} is not null then '{lab}'" if b is None else f"when {col} <= {b} then '{lab}'"
              for b, lab in bands]
    return "case " + " ".join(parts) + " end"


SQL_ANALYSIS = f"""a as (select *, {sql_case_in('hour', cal.TIME_GROUPS)} as time_group,
  {_lab('ta', bn.LABEL_TEMP)} as temp_category, {_lab('hm', bn.LABEL_HUMIDITY)} as humidity_category,
  {_lab('rn_hr1', bn.LABEL_RAIN, bn.LABEL_RAIN_ZERO)} as rainfall_category, {_lab('ws', bn.LABEL_WIND)} as wind_category,
  {_lab('si', bn.LABEL_SOLAR)} as solar_category, {_lab('ta_chi', bn.LABEL_APPARENT)} as apparent_temp_category
  from clean where hour not in (1, 2, 3, 4) and ta is not null and ws is not null and rn_hr1 is not null
  and hm is not null)"""


def with_a(body: str) -> str:
    b = body.strip()
    if b.lower().startswith("with "):
        return with_clean(f"with {SQL_ANALYSIS}, {b[5:]}")
    return with_clean(f"with {SQL_ANALYSIS} {b}")


def _strength_sql(rcol: str, preset: str) -> str:
    parts = [f"when abs({rcol}) is not null then '{lab}'" if b is None else f"when abs({rcol}) < {b} then '{lab}'"
             for b, lab in st.STRENGTH_PRESETS[preset]]
    return "case " + " ".join(parts) + " end"


def _pair_rows(vars_, src: str) -> str:
    rows = []
    for a in vars_:
        for b in vars_:
            if a == b:
                rows.append(f"select '{a}' as var1, '{b}' as var2, 1.0 as r, count_if({a} is not null) as n from {src}")
            else:
                rows.append(f"select '{a}', '{b}', corr({a}, {b}), count_if({a} is not null and {b} is not null) from {src}")
    return " union all ".join(rows)


MATRIX_VARS = ["congestion", "ta", "ws", "hm", "rn_hr1", "si"]


def _simpson(density: str, low: str, high: str, steps: int) -> str:
    """Integral of ``density`` (an expression of ``s``) in SQL."""
    step = f"(({high}) - ({low})) / {steps}.0"
    at = density.replace("<s>", f"(({low}) + {step} * i)")
    return (f"{step} / 3 * list_sum([case when i = 0 or i = {steps} then 1.0 when i % 2 = 1 then 4.0 else 2.0 end"
            f" * ({at}) for i in range({steps + 1})])")


def _t_p_sql(t: str, v: str) -> str:
    """Two-sided p-value: one minus twice the integral of the t density from 0 to |t| (flat beyond 60)."""
    dens = (f"exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt({v} * pi())"
            f" * pow(1 + <s> * <s> / {v}, -({v} + 1) / 2.0)")
    return f"greatest(0.0, 1 - 2 * ({_simpson(dens, '0.0', f'least(abs({t}), 60.0)', 2000)}))"


def _f_p_sql(f: str, d1: str, d2: str) -> str:
    """Upper tail of the F distribution: the beta density in sin^2 form, integrated up to x = d2 / (d2 + d1 F)."""
    dens = (f"2 * exp(lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0))"
            f" * pow(sin(<s>), {d2} - 1) * pow(cos(<s>), {d1} - 1)")
    return _simpson(dens, "0.0", f"asin(sqrt({d2} / ({d2} + {d1} * {f})))", 40000)


_STARS_SQL = "case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' when p is not null then '' end"
_SIZE_SQL = """case when abs(effect) >= 2 then '큰 효과' when abs(effect) >= 1 then '중간 효과'
            when abs(effect) >= 0.5 then '작은 효과' else '' end"""


def _regression_sql(name: str, means: str, using: str) -> str:
    """Least squares of congestion on ta, ws, rn_hr1 and hm about the given means, in SQL.

    Each regressor is replaced by what the earlier ones leave of it, the
    target likewise; the slopes follow backwards.  Defines <name>_means,
    <name>_coef (b1..b4, syy and sse) and what lies between.
    """
    n = name
    return f"""
{n}_means as ({means}),
{n}_0 as (select congestion - my as y, ta - m1 as x1, ws - m2 as x2, rn_hr1 - m3 as x3, hm - m4 as x4
          from a join {n}_means {using}),
{n}_g1 as (select sum(x2 * x1) / sum(x1 * x1) as a21, sum(x3 * x1) / sum(x1 * x1) as a31,
                  sum(x4 * x1) / sum(x1 * x1) as a41, sum(y * x1) / sum(x1 * x1) as c1, sum(y * y) as syy from {n}_0),
{n}_1 as (select y - c1 * x1 as y, x2 - a21 * x1 as x2, x3 - a31 * x1 as x3, x4 - a41 * x1 as x4 from {n}_0, {n}_g1),
{n}_g2 as (select sum(x3 * x2) / sum(x2 * x2) as a32, sum(x4 * x2) / sum(x2 * x2) as a42,
                  sum(y * x2) / sum(x2 * x2) as c2 from {n}_1),
{n}_2 as (select y - c2 * x2 as y, x3 - a32 * x2 as x3, x4 - a42 * x2 as x4 from {n}_1, {n}_g2),
{n}_g3 as (select sum(x4 * x3) / sum(x3 * x3) as a43, sum(y * x3) / sum(x3 * x3) as c3 from {n}_2),
{n}_3 as (select y - c3 * x3 as y, x4 - a43 * x3 as x4 from {n}_2, {n}_g3),
{n}_g4 as (select sum(y * x4) / sum(x4 * x4) as c4 from {n}_3),
{n}_sse as (select sum((y - c4 * x4) * (y - c4 * x4)) as sse from {n}_3, {n}_g4),
{n}_b3 as (select *, c4 as b4, c3 - a43 * c4 as b3 from {n}_g1, {n}_g2, {n}_g3, {n}_g4, {n}_sse),
{n}_b2 as (select *, c2 - a32 * b3 - a42 * b4 as b2 from {n}_b3),
{n}_coef as (select *, c1 - a21 * b2 - a31 * b3 - a41 * b4 as b1 from {n}_b2)"""


_MEANS = "avg(congestion) as my, avg(ta) as m1, avg(ws) as m2, avg(rn_hr1) as m3, avg(hm) as m4"
_OLS_CTES = _regression_sql("o", f"select {_MEANS} from a", "on true")
_FE_CTES = _regression_sql("e", f"select hour, count(*) as nh, {_MEANS} from a group by hour", "using (hour)") + """,
alpha as (select hour, nh, my, my - b1 * m1 - b2 * m2 - b3 * m3 - b4 * m4 as alpha from e_means, e_coef),
base as (select alpha as base_alpha from alpha order by hour limit 1),
fe_hours as (select hour, nh, my, alpha - base_alpha as time_effect from alpha, base),
adj as (select a.*, time_effect, congestion - time_effect as y_adj,
               b1 * ta + b2 * ws + b3 * rn_hr1 + b4 * hm + base_alpha as climate_prediction
        from a join fe_hours using (hour), e_coef, base)"""
_SPLIT_CTES = _OLS_CTES + "," + _FE_CTES + """,
ssb as (select sum(nh * (my - g) * (my - g)) as ssb from fe_hours, (select avg(congestion) as g from a)),
r2 as (select 1 - o_coef.sse / o_coef.syy as w, ssb / (e_coef.syy + ssb) as t, 1 - e_coef.sse / (e_coef.syy + ssb) as f
       from o_coef, e_coef, ssb)"""


@register("stat_corr", with_a("""
select round(corr(ta, congestion), 6) as r, cast(count_if(ta is not null and congestion is not null) as bigint) as n,
       round(corr(rn_hr1, congestion), 6) as r_rain from a"""))
def stat_corr(spark, sf):
    df = analysis(spark, sf)
    both = F.col("ta").isNotNull() & F.col("congestion").isNotNull()
    out = df.agg(r(F.corr("ta", "congestion")).alias("r"), F.count_if(both).cast("long").alias("n"),
                 r(F.corr("rn_hr1", "congestion")).alias("r_rain"))
    return final(out)


@register("stat_corr_matrix", with_clean(f"""
select var1, var2, round(r, 6) as r, cast(n as bigint) as n from ({_pair_rows(MATRIX_VARS, 'clean')})"""))
def stat_corr_matrix(spark, sf):
    out = st.corr_pairs(clean(spark, sf), MATRIX_VARS)
    return final(out.withColumn("r", r("r")))


_GROUPED_SQL = " union all ".join(
    f"select time_group, '{v}' as variable, corr({v}, congestion) as r, "
    f"count_if({v} is not null and congestion is not null) as n from a group by time_group" for v in CORR_VARS)


@register("stat_corr_grouped", with_a(f"""
select time_group, variable, round(r, 6) as r, cast(n as bigint) as n from ({_GROUPED_SQL}) where n > 2"""))
def stat_corr_grouped(spark, sf):
    out = st.corr_grouped(analysis(spark, sf), ["time_group"], "congestion", CORR_VARS, min_n=2)
    return final(out.withColumn("r", r("r")))


_SEASON_SQL = ("case when month in (3,4,5) then '봄' when month in (6,7,8) then '여름' when month in (9,10,11) then '가을' "
               "when month in (12,1,2) then '겨울' else '기타' end")


@register("stat_corr_grouped_season", with_a("with s as (select *, " + _SEASON_SQL + " as season from a)" + f"""
select season, variable, round(r, 6) as r, cast(n as bigint) as n from ({_GROUPED_SQL.replace('time_group', 'season').replace('from a ', 'from s ')}) where n > 10"""))
def stat_corr_grouped_season(spark, sf):
    """Correlations per season and variable with more than 10 pairs."""
    df = analysis(spark, sf).withColumn("season", cal.season("month", "label"))
    out = st.corr_grouped(df, ["season"], "congestion", CORR_VARS, min_n=10)
    return final(out.withColumn("r", r("r")))


_QUANTILE_VARS = ["congestion", "ta", "hm"]


@register("stat_group_quantiles", with_clean(" union all ".join(
    f"select station_name, '{v}' as variable, cast(count({v}) as bigint) as n, round(quantile_cont({v}, 0.1), 6) as q10, "
    f"round(quantile_cont({v}, 0.5), 6) as q50, round(quantile_cont({v}, 0.9), 6) as q90 from clean group by station_name having count({v}) > 0"
    for v in _QUANTILE_VARS)))
def stat_group_quantiles(spark, sf):
    """Exact quantiles of three variables for every station."""
    out = grouped_quantiles(clean(spark, sf), ["station_name"], _QUANTILE_VARS, [0.1, 0.5, 0.9])
    return final(out.select("station_name", "variable", "n", *[r(F.col("quantiles")[i]).alias(c) for i, c in enumerate(("q10", "q50", "q90"))]))


@register("stat_corr_test", with_a(f"""
select time_group, variable, round(r, 6) as r, cast(n as bigint) as n,
       round(r * sqrt((n - 2) / (1 - r * r)), 6) as t, cast(n - 2 as bigint) as df,
       {_strength_sql('r', 'five')} as strength, cast(abs(r) >= 0.4 as bigint) as notable
from ({_GROUPED_SQL}) where n > 2"""))
def stat_corr_test(spark, sf):
    g = st.corr_grouped(analysis(spark, sf), ["time_group"], "congestion", CORR_VARS, min_n=2)
    out = st.corr_test_columns(g)
    return final(out.select("time_group", "variable", r("r").alias("r"), "n", r("t").alias("t"), "df", "strength",
                            "notable"))


@register("stat_corr_test_pvalue", with_a(f"""
with g as (select *, r * sqrt((n - 2) / (1 - r * r)) as t from ({_GROUPED_SQL}) where n > 2),
w as (select *, {_t_p_sql('t', '(n - 2)')} as p from g)
select time_group, variable, round(r, 6) as r, cast(n as bigint) as n, round(t, 6) as t, cast(n - 2 as bigint) as df,
       round(p, 9) as p_value, {_STARS_SQL} as stars, {_strength_sql('r', 'five')} as strength,
       cast(abs(r) >= 0.4 as bigint) as notable from w"""))
def stat_corr_test_pvalue(spark, sf):
    """Same as stat_corr_test plus two-sided p-values and significance stars."""
    g = st.corr_grouped(analysis(spark, sf), ["time_group"], "congestion", CORR_VARS, min_n=2)
    out = st.corr_test_columns(g, with_p=True)
    return final(out.select("time_group", "variable", r("r").alias("r"), "n", r("t").alias("t"), "df",
                            r("p_value", 9).alias("p_value"), "stars", "strength", "notable"))


@register("stat_strength_label", with_clean(f"""
with m as (select var1 as variable, r from ({_pair_rows(MATRIX_VARS, 'clean')}) where var2 = 'congestion'
           and var1 <> 'congestion')
select variable, round(r, 6) as r, {_strength_sql('r', 'five')} as strength_five,
       {_strength_sql('r', 'three')} as strength_three, {_strength_sql('r', 'effect')} as strength_effect from m"""))
def stat_strength_label(spark, sf):
    m = st.corr_pairs(clean(spark, sf), MATRIX_VARS).filter((F.col("var2") == "congestion")
                                                            & (F.col("var1") != "congestion"))
    out = m.select(F.col("var1").alias("variable"), r("r").alias("r"),
                   *[st.strength_label("r", p).alias(f"strength_{p}") for p in ("five", "three", "effect")])
    return final(out)


def _anova_frame(spark, sf):
    df = analysis(spark, sf)
    long = df.select("time_group", "congestion", F.inline(F.array(
        *[F.struct(F.lit(c).alias("label_set"), F.col(c).alias("label")) for c in LABEL_SETS])))
    return long


_ANOVA_LONG_SQL = " union all ".join(f"select time_group, congestion, '{c}' as label_set, {c} as label from a"
                                     for c in LABEL_SETS)


@register("stat_anova", with_a(f"""
with l as ({_ANOVA_LONG_SQL}),
cells as (select time_group, label_set, label, count(congestion) as n, avg(congestion) as m,
                 coalesce(var_samp(congestion), 0) as v
          from l where label is not null and congestion is not null group by all),
g as (select *, sum(n * m) over (partition by time_group, label_set) / sum(n) over (partition by time_group, label_set)
               as grand from cells),
s as (select time_group, label_set, count(*) as k, sum(n) as n, sum(n * (m - grand) * (m - grand)) as ssb,
             sum((n - 1) * v) as ssw from g group by all)
select time_group, label_set, cast(k as bigint) as k, cast(n as bigint) as n, cast(k - 1 as bigint) as df1,
       cast(n - k as bigint) as df2, round((ssb / (k - 1)) / (ssw / (n - k)), 6) as f_stat
from s where k >= 2"""))
def stat_anova(spark, sf):
    out = st.anova_oneway(_anova_frame(spark, sf), ["time_group", "label_set"], "label", "congestion")
    return final(out.select("time_group", "label_set", "k", "n", "df1", "df2", r("f_stat").alias("f_stat")))


@register("stat_anova_pvalue", with_a(f"""
with l as ({_ANOVA_LONG_SQL}),
cells as (select time_group, label_set, label, count(congestion) as n, avg(congestion) as m,
                 coalesce(var_samp(congestion), 0) as v
          from l where label is not null and congestion is not null group by all),
g as (select *, sum(n * m) over (partition by time_group, label_set) / sum(n) over (partition by time_group, label_set)
               as grand from cells),
s as (select time_group, label_set, count(*) as k, sum(n) as n, sum(n * (m - grand) * (m - grand)) as ssb,
             sum((n - 1) * v) as ssw from g group by all),
t as (select *, (ssb / (k - 1)) / (ssw / (n - k)) as f from s where k >= 2)
select time_group, label_set, cast(k as bigint) as k, cast(n as bigint) as n, cast(k - 1 as bigint) as df1,
       cast(n - k as bigint) as df2, round(f, 6) as f_stat, round({_f_p_sql('f', '(k - 1)', '(n - k)')}, 9) as p_value
from t"""))
def stat_anova_pvalue(spark, sf):
    out = st.anova_oneway(_anova_frame(spark, sf), ["time_group", "label_set"], "label", "congestion", with_p=True)
    return final(out.select("time_group", "label_set", "k", "n", "df1", "df2", r("f_stat").alias("f_stat"),
                            r("p_value", 9).alias("p_value")))


_BANDS_SQL = """q as (select quantile_cont(ta, 0.05) as q05, quantile_cont(ta, 0.25) as q25, quantile_cont(ta, 0.75) as q75,
                  quantile_cont(ta, 0.95) as q95, avg(congestion) as mu from a),
b as (select 0 as band, congestion from a, q where ta <= q05
      union all select 1, congestion from a, q where ta > q05 and ta <= q25
      union all select 2, congestion from a, q where ta > q25 and ta <= q75
      union all select 3, congestion from a, q where ta > q75 and ta <= q95
      union all select 4, congestion from a, q where ta >= q95)"""


@register("stat_ttest_1samp", with_a(f"""
with {_BANDS_SQL}
select cast(band as bigint) as band, round(avg(congestion), 6) as mean, round(stddev_samp(congestion), 6) as std,
       cast(count(congestion) as bigint) as n, round(avg(congestion) - any_value(mu), 6) as effect,
       round((avg(congestion) - any_value(mu)) / (stddev_samp(congestion) / sqrt(count(congestion))), 6) as t,
       case when abs(avg(congestion) - any_value(mu)) >= 2 then '큰 효과' when abs(avg(congestion) - any_value(mu)) >= 1
            then '중간 효과' when abs(avg(congestion) - any_value(mu)) >= 0.5 then '작은 효과' else '' end as size_label
from b, q group by band having count(congestion) >= 30"""))
def stat_ttest_1samp(spark, sf):
    """Temperature quantile bands: band mean vs the overall mean (n >= 30)."""
    out = _band_ttest(analysis(spark, sf), "congestion", with_p=False)
    return final(out.select("band", r("mean").alias("mean"), r("std").alias("std"), "n", r("effect").alias("effect"),
                            r("t").alias("t"), "size_label"))


def _band_ttest(df, y, with_p):
    q05, q25, q75, q95 = [F.lit(v) for v in exact_quantiles(df, {"ta": [0.05, 0.25, 0.75, 0.95]})["ta"]]
    ex = df.select(F.explode(bn.quantile_band_masks("ta", q05, q25, q75, q95)).alias("band"), y)
    return st.ttest_1samp(ex, "band", y, F.lit(df.agg(F.avg(y)).first()[0]), with_p=with_p)


@register("stat_ttest_1samp_pvalue", with_a(f"""
with {_BANDS_SQL},
g as (select band, avg(congestion) as mean, count(congestion) as n, avg(congestion) - any_value(mu) as effect,
             (avg(congestion) - any_value(mu)) / (stddev_samp(congestion) / sqrt(count(congestion))) as t
      from b, q group by band having count(congestion) >= 30),
w as (select *, {_t_p_sql('t', '(n - 1)')} as p from g)
select cast(band as bigint) as band, round(mean, 6) as mean, cast(n as bigint) as n, round(t, 6) as t,
       round(p, 9) as p_value, {_STARS_SQL} as stars, {_SIZE_SQL} as size_label from w"""))
def stat_ttest_1samp_pvalue(spark, sf):
    out = _band_ttest(analysis(spark, sf), "congestion", with_p=True)
    return final(out.select("band", r("mean").alias("mean"), "n", r("t").alias("t"),
                            r("p_value", 9).alias("p_value"), "stars", "size_label"))


@register("stat_normality", with_a(f"""
with {_FE_CTES},
e as (select congestion - climate_prediction - time_effect as e from adj),
m as (select avg(e) as mu from e),
c as (select count(*) as n, avg((e - mu) * (e - mu)) as m2, avg((e - mu) * (e - mu) * (e - mu)) as m3,
             avg((e - mu) * (e - mu) * (e - mu) * (e - mu)) as m4 from e, m)
select cast(n as bigint) as n, round(m3 / pow(m2, 1.5), 6) as skewness, round(m4 / (m2 * m2) - 3, 6) as excess_kurtosis,
       round(n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4), 4) as jb,
       round(exp(-(n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4)) / 2), 9) as p_value from c"""))
def stat_normality(spark, sf):
    """Jarque-Bera on all residuals of the fitted model: target less weather prediction less hour effect."""
    df, fe = _effects(spark, sf)
    e = fe.transform(df).select((F.col("congestion") - F.col("climate_prediction") - F.col("time_effect")).alias("e"))
    out = st.normality_jb(e, "e")
    return final(out.select("n", r("skewness").alias("skewness"), r("excess_kurtosis").alias("excess_kurtosis"),
                            r("jb", 4).alias("jb"), r("p_value", 9).alias("p_value")))


def _horner_sql(x: str, cs) -> str:
    out = repr(cs[-1])
    for c in cs[-2::-1]:
        out = f"({out} * ({x}) + {c!r})"
    return out


def _normal_quantile_sql(p: str) -> str:
    def ratio(x, top, bottom):
        return f"{_horner_sql(x, top)} / {_horner_sql(x, bottom)}"
    tail = f"sqrt(-ln(least({p}, 1 - {p})))"
    return (f"case when abs({p} - 0.5) <= 0.425 then ({p} - 0.5) * {ratio(f'0.180625 - ({p} - 0.5) * ({p} - 0.5)', *st.PPND_CENTRE)} "
            f"else sign({p} - 0.5) * case when {tail} <= 5.0 then {ratio(f'{tail} - 1.6', *st.PPND_NEAR)} else {ratio(f'{tail} - 5.0', *st.PPND_FAR)} end end")


@register("stat_normality_sf", with_a(f"""
with {_FE_CTES},
e as (select congestion - climate_prediction - time_effect as e from adj),
k as (select e, (row_number() over (order by e) - 0.375::double) / (count(*) over () + 0.25::double) as p from e),
s as (select e, {_normal_quantile_sql('p')} as m from k),
w as (select count(*)::double as n, pow(corr(e, m), 2) as w from s)
select cast(n as bigint) as n, round(w, 6) as w,
       round((ln(1 - w) - (-1.2725 + 1.0521 * (ln(ln(n)) - ln(n)))) / (1.0308 - 0.26758 * (ln(ln(n)) + 2 / ln(n))), 4) as z from w"""))
def stat_normality_sf(spark, sf):
    """Shapiro-Francia on all residuals of the fitted model."""
    df, fe = _effects(spark, sf)
    e = fe.transform(df).select((F.col("congestion") - F.col("climate_prediction") - F.col("time_effect")).alias("e"))
    return final(st.normality_sf(e, "e").select("n", r("w").alias("w"), r("z", 4).alias("z")))


@register("stat_ols", with_a(f"""
with {_OLS_CTES}
select 'intercept' as term, round(my - b1 * m1 - b2 * m2 - b3 * m3 - b4 * m4, 6) as value from o_means, o_coef
union all select 'ta', round(b1, 6) from o_coef union all select 'ws', round(b2, 6) from o_coef
union all select 'rn_hr1', round(b3, 6) from o_coef union all select 'hm', round(b4, 6) from o_coef
union all select 'r2', round(1 - sse / syy, 6) from o_coef"""))
def stat_ols(spark, sf):
    """Least squares of congestion on the weather set from one Gram aggregate."""
    fit = st.ols(analysis(spark, sf), "congestion", XS)
    rows = [(n, float(c)) for n, c in zip(fit["names"], fit["coef"])] + [("r2", fit["r2"])]
    return spark.createDataFrame(rows, "term string, value double").withColumn("value", r("value"))


@register("stat_slope", with_a("""
select station_name, round(regr_slope(congestion, ta), 6) as slope, round(regr_intercept(congestion, ta), 6) as intercept,
       cast(regr_count(congestion, ta) as bigint) as n from a group by station_name"""))
def stat_slope(spark, sf):
    out = analysis(spark, sf).groupBy("station_name").agg(
        r(F.regr_slope("congestion", "ta")).alias("slope"), r(F.regr_intercept("congestion", "ta")).alias("intercept"),
        F.regr_count("congestion", "ta").cast("long").alias("n"))
    return final(out)


def _effects(spark, sf):
    # several passes follow (fit, adjusted frame, checks): read one checkpoint, not the whole plan each time
    df = materialize(analysis(spark, sf).select("station_name", "tm", "hour", "congestion", "rn_hr1", *[
        c for c in XS if c != "rn_hr1"]))
    return df, fx_eff.fit_hour_effects(df, "congestion", XS, "hour")


@register("stat_fixed_effects", with_a(f"""
with {_FE_CTES}
select 'beta_ta' as term, cast(null as bigint) as hour, round(b1, 6) as value from e_coef
union all select 'beta_ws', null, round(b2, 6) from e_coef
union all select 'beta_rn_hr1', null, round(b3, 6) from e_coef
union all select 'beta_hm', null, round(b4, 6) from e_coef
union all select 'time_effect', cast(hour as bigint), round(time_effect, 6) from fe_hours"""))
def stat_fixed_effects(spark, sf):
    """Weather slopes net of hour fixed effects, and each hour's effect vs the first hour."""
    _, fe = _effects(spark, sf)
    coefs = spark.createDataFrame([(f"beta_{k}", None, v) for k, v in fe.beta.items()],
                                  "term string, hour int, value double")
    hours = fe.hour_table.select(F.lit("time_effect").alias("term"), "hour", F.col("time_effect").alias("value"))
    return final(coefs.unionByName(hours).withColumn("value", r("value")))


@register("stat_effect_split", with_a(f"""
with {_SPLIT_CTES}
select 'r2_weather' as metric, round(w, 6) as value from r2 union all select 'r2_time', round(t, 6) from r2
union all select 'r2_full', round(f, 6) from r2 union all select 'time_share_pct', round(t / f * 100, 6) from r2
union all select 'climate_share_pct', round(100 - t / f * 100, 6) from r2"""))
def stat_effect_split(spark, sf):
    _, fe = _effects(spark, sf)
    rows = [("r2_weather", fe.r2_weather), ("r2_time", fe.r2_time), ("r2_full", fe.r2_full),
            ("time_share_pct", fe.time_share), ("climate_share_pct", 100 - fe.time_share if fe.r2_full else 0.0)]
    rows = [(k, float(v)) for k, v in rows]
    return spark.createDataFrame(rows, "metric string, value double").withColumn("value", r("value"))


@register("stat_effect_ranking", with_a(f"""
with {_FE_CTES},
c as (select 'ta' as term, b1 as v from e_coef union all select 'ws', b2 from e_coef
      union all select 'rn_hr1', b3 from e_coef union all select 'hm', b4 from e_coef),
top as (select * from fe_hours where time_effect <> 0 order by abs(time_effect) desc, hour limit 5)
select term, round(v, 6) as value, case when abs(v) > 1 then '큰' when abs(v) > 0.5 then '중간' else '작은' end as size,
       cast(null as bigint) as hour from c
union all select concat('hour_', hour), round(time_effect, 6), null, cast(hour as bigint) from top"""))
def stat_effect_ranking(spark, sf):
    """Weather coefficients with a size label, and the five hours with the largest |effect|."""
    _, fe = _effects(spark, sf)
    coefs = spark.createDataFrame([(k, v) for k, v in fe.beta.items()], "term string, value double")
    coefs = coefs.withColumns({"size": st.coef_size_label("value"), "hour": F.lit(None).cast("long")})
    hours = fe.hour_table.filter(F.col("time_effect") != 0).orderBy(F.desc(F.abs("time_effect")), "hour").limit(5)
    hours = hours.select(F.concat(F.lit("hour_"), F.col("hour").cast("string")).alias("term"),
                         F.col("time_effect").alias("value"), F.lit(None).cast("string").alias("size"),
                         F.col("hour").cast("long").alias("hour"))
    return final(coefs.unionByName(hours).withColumn("value", r("value")))


@register("stat_adjust_hours", with_a(f"""
with {_FE_CTES}
select cast(hour as bigint) as hour, round(avg(congestion), 6) as before, round(avg(y_adj), 6) as after,
       round(abs(avg(congestion) - avg(y_adj)), 6) as diff, round(var_samp(y_adj), 4) as var_after
from adj group by hour"""))
def stat_adjust_hours(spark, sf):
    """Mean target per hour before and after the hour effect is removed, and the variance left."""
    df, fe = _effects(spark, sf)
    before, after = F.avg("congestion"), F.avg("congestion_time_adjusted")
    out = fe.transform(df).groupBy("hour").agg(
        r(before).alias("before"), r(after).alias("after"), r(F.abs(before - after)).alias("diff"),
        r(F.var_samp("congestion_time_adjusted"), 4).alias("var_after"))
    return final(out)


@register("stat_adjust_check", with_a(f"""
with {_FE_CTES},
v as (select hour, count(*) as n, avg(y_adj) as m, var_samp(y_adj) as v from adj group by hour),
s as (select count(*) as k, sum(n) as n, sum(n * (m - (select avg(y_adj) from adj)) * (m - (select avg(y_adj) from adj))) as ssb,
             sum((n - 1) * v) as ssw, avg(v) as var_mean, min(v) as var_min, max(v) as var_max,
             stddev_samp(v) / avg(v) as var_cv from v),
f as (select *, (ssb / (k - 1)) / (ssw / (n - k)) as f from s),
c as (select avg(y_adj - climate_prediction) as rm, stddev_samp(y_adj - climate_prediction) as rs,
             corr(hour, congestion) as r0, corr(hour, y_adj) as r1, var_samp(y_adj) as v1, var_samp(congestion) as v0 from adj)
select round(var_mean, 4) as var_mean, round(var_min, 4) as var_min, round(var_max, 4) as var_max, round(var_cv, 6) as var_cv,
       round(rm, 6) + 0.0 as resid_mean, round(rs, 6) as resid_std, round(r0, 6) as r_hour_before, round(r1, 6) as r_hour_after,
       round((1 - abs(r1) / abs(r0)) * 100, 4) as corr_reduction_pct, round((1 - v1 / v0) * 100, 6) as var_reduction_pct,
       round(f, 6) as anova_f_after, round({_f_p_sql('f', '(k - 1)', '(n - k)')}, 9) as anova_p_after from f, c"""))
def stat_adjust_check(spark, sf):
    """What the adjustment leaves: spread of the hourly variances, residual moments, correlation with the
    hour before and after and its reduction, and ANOVA of the adjusted target over the hours."""
    df, fe = _effects(spark, sf)
    adj = fe.transform(df)
    by_hour = adj.groupBy("hour").agg(F.var_samp("congestion_time_adjusted").alias("v"))
    spread = by_hour.agg(r(F.avg("v"), 4).alias("var_mean"), r(F.min("v"), 4).alias("var_min"), r(F.max("v"), 4).alias("var_max"),
                         r(F.stddev_samp("v") / F.avg("v")).alias("var_cv"))
    r0, r1 = F.corr("hour", "congestion"), F.corr("hour", "congestion_time_adjusted")
    resid = adj.withColumn("res", F.col("congestion_time_adjusted") - F.col("climate_prediction")).agg(
        r(F.avg("res")).alias("resid_mean"), r(F.stddev_samp("res")).alias("resid_std"),
        r(r0).alias("r_hour_before"), r(r1).alias("r_hour_after"),
        r((1 - F.abs(r1) / F.abs(r0)) * 100, 4).alias("corr_reduction_pct"),
        r((1 - F.var_samp("congestion_time_adjusted") / F.var_samp("congestion")) * 100).alias("var_reduction_pct"))
    an = st.anova_oneway(adj.withColumn("g", F.lit(1)), ["g"], "hour", "congestion_time_adjusted", with_p=True).select(
        r("f_stat").alias("anova_f_after"), r("p_value", 9).alias("anova_p_after"))
    # three one-row aggregates: assemble their scalars into one row (no join needed)
    vals = {**spread.first().asDict(), **resid.first().asDict(), **an.first().asDict()}
    names = list(vals)
    out = spark.createDataFrame([tuple(float(vals[k]) if vals[k] is not None else None for k in names)],
                                ", ".join(f"{k} double" for k in names))
    return final(out)


@register("stat_corr_shift", with_a(f"""
with {_FE_CTES},
l as ({' union all '.join(f"select '{v}' as variable, {v} as x, congestion, y_adj from adj" for v in XS)}),
g as (select variable, corr(x, congestion) as r_before, corr(x, y_adj) as r, count(x) as n from l group by variable),
w as (select *, {_t_p_sql('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)')} as p from g)
select variable, round(r_before, 6) as r_before, round(r, 6) as r_after, cast(n as bigint) as n, round(p, 9) as p_after,
       {_strength_sql('r', 'effect')} as effect_class from w"""))
def stat_corr_shift(spark, sf):
    """r(x, y) before and after removing the hour effect, per weather variable, with p and class."""
    df, fe = _effects(spark, sf)
    adj = fe.transform(df)
    long = st.unpivot(adj, ["congestion", "congestion_time_adjusted"], XS)
    out = long.groupBy("variable").agg(F.corr("value", "congestion").alias("r_before"),
                                       F.corr("value", "congestion_time_adjusted").alias("r_after"),
                                       F.count("value").cast("long").alias("n"))
    out = out.withColumn("t_after", st.corr_t("r_after", "n"))
    out = out.withColumn("p_after", st.t_pvalue(F.col("t_after"), (F.col("n") - 2).cast("double")))
    out = out.withColumn("effect_class", st.strength_label("r_after", "effect"))
    return final(out.select("variable", r("r_before").alias("r_before"), r("r_after").alias("r_after"), "n",
                            r("p_after", 9).alias("p_after"), "effect_class"))


COLLINEAR_VARS = ["ta", "ta_chi", "ws", "hm", "si", "rn_hr1", "rn_day"]


@register("stat_collinear", with_clean(f"""
select var1, var2, round(r, 6) as r from ({_pair_rows(COLLINEAR_VARS, 'clean')})
where var1 < var2 and abs(r) > 0.7"""))
def stat_collinear(spark, sf):
    m = st.corr_pairs(clean(spark, sf), COLLINEAR_VARS)
    out = m.filter((F.col("var1") < F.col("var2")) & (F.abs("r") > 0.7)).select("var1", "var2", r("r").alias("r"))
    return final(out)


_BAND_ROWS = " union all ".join(
    [f"""select '{v}' as variable, '{lab}' as band, y_adj from adj, (select quantile_cont({v}, 0.05) as q05,
    quantile_cont({v}, 0.25) as q25, quantile_cont({v}, 0.75) as q75, quantile_cont({v}, 0.95) as q95 from a) where {cond}"""
     for v in ("ta", "ws", "hm") for lab, cond in (
         ("band_0", f"{v} <= q05"), ("band_1", f"{v} > q05 and {v} <= q25"), ("band_2", f"{v} > q25 and {v} <= q75"),
         ("band_3", f"{v} > q75 and {v} <= q95"), ("band_4", f"{v} >= q95"))]
    + [f"select 'rn_hr1' as variable, {lab} as band, y_adj from adj where {cond}" for lab, cond in (
        ("'비없음'", "rn_hr1 = 0"), ("'약한비(0-2mm)'", "rn_hr1 > 0 and rn_hr1 <= 2"),
        ("'보통비(2-5mm)'", "rn_hr1 > 2 and rn_hr1 <= 5"), ("'강한비(5mm초과)'", "rn_hr1 > 5"))])


@register("stat_extreme_bands", with_a(f"""
with {_FE_CTES},
l as ({_BAND_ROWS}),
g as (select variable, band, avg(y_adj) as mean, count(*) as n, avg(y_adj) - (select avg(y_adj) from adj) as effect,
             (avg(y_adj) - (select avg(y_adj) from adj)) / (stddev_samp(y_adj) / sqrt(count(*))) as t
      from l group by variable, band having count(*) >= 30),
w as (select *, {_t_p_sql('t', '(n - 1)')} as p from g)
select variable, band, round(mean, 6) as mean, cast(n as bigint) as n, round(effect, 6) as effect, round(t, 6) as t,
       round(p, 9) as p_value, {_STARS_SQL} as stars, {_SIZE_SQL} as size_label from w"""))
def stat_extreme_bands(spark, sf):
    """Hour-adjusted target against its mean in the bands of every weather variable: quantile bands, and
    fixed bands for rain.  All bands of all variables are one grouped aggregate."""
    df, fe = _effects(spark, sf)
    adj, y = fe.transform(df), "congestion_time_adjusted"
    cuts = [v for v in XS if v != "rn_hr1"]
    q = exact_quantiles(df, {v: [0.05, 0.25, 0.75, 0.95] for v in cuts})
    names = {v: F.transform(bn.quantile_band_masks(v, *[F.lit(x) for x in q[v]]),
                            lambda b: F.concat(F.lit("band_"), b.cast("string"))) for v in cuts}
    names["rn_hr1"] = F.array(bn.rain_band("rn_hr1"))

    def tagged(v, bands):
        return F.transform(bands, lambda b: F.struct(F.lit(v).alias("variable"), b.alias("band")))
    rows = F.flatten(F.array(*[tagged(v, bands) for v, bands in names.items()]))
    long = adj.select(y, F.inline(rows)).filter(F.col("band").isNotNull())
    key = F.struct("variable", "band").alias("at")
    out = st.ttest_1samp(long, key, y, F.lit(adj.agg(F.avg(y)).first()[0]), with_p=True)
    return final(out.select("at.variable", "at.band", r("mean").alias("mean"), "n", r("effect").alias("effect"),
                            r("t").alias("t"), r("p_value", 9).alias("p_value"), "stars", "size_label"))


@register("stat_hour_variance", with_a("""
select cast(hour as bigint) as hour, round(var_samp(congestion), 4) as var_before, round(var_samp(congestion), 4) as var_after
from a group by hour"""))
def stat_hour_variance(spark, sf):
    """Within-hour variance before and after the hour adjustment (a per-hour shift keeps it)."""
    df, fe = _effects(spark, sf)
    adj = fe.transform(df)
    out = adj.groupBy("hour").agg(r(F.var_samp("congestion"), 4).alias("var_before"),
                                  r(F.var_samp("congestion_time_adjusted"), 4).alias("var_after"))
    return final(out)


_FE1_SQL = with_a("""
with h as (select hour, count(*) as nh, avg(congestion) as my, avg(ta) as mx from a group by hour),
d as (select a.hour, congestion - my as yd, ta - mx as xd, congestion from a join h using (hour)),
s as (select sum(xd * yd) / sum(xd * xd) as beta, sum(yd * yd) as syy, sum(xd * yd) as sxy from d),
o as (select avg(congestion) as ybar, sum((congestion - (select avg(congestion) from a)) * (congestion - (select avg(congestion) from a))) as sst from a),
b as (select (select my - (select beta from s) * mx from h order by hour limit 1) as a0)
select 'beta_ta' as term, cast(-1 as bigint) as hour, round(beta, 9) as value from s
union all select 'time_effect', cast(h.hour as bigint), round((my - s.beta * mx) - b.a0, 9) from h, s, b
union all select 'r2_time', cast(-1 as bigint), round(sum(nh * (my - ybar) * (my - ybar)) / any_value(sst), 9) from h, o
union all select 'r2_full', cast(-1 as bigint), round(1 - (any_value(syy) - any_value(beta) * any_value(sxy)) / any_value(sst), 9)
          from s, o
union all select 'r2_weather', cast(-1 as bigint), round(corr(ta, congestion) * corr(ta, congestion), 9) from a""")


@register("stat_fixed_effects_ta", _FE1_SQL)
def stat_fixed_effects_ta(spark, sf):
    """Single-regressor companion of stat_fixed_effects / stat_effect_split (SQL-checkable):
    the within-hour slope of temperature, each hour's effect vs the first hour, and the three R^2."""
    _df = analysis(spark, sf)
    fe = fx_eff.fit_hour_effects(_df, "congestion", ["ta"], "hour")
    rows = [("beta_ta", -1, fe.beta["ta"]), ("r2_time", -1, fe.r2_time), ("r2_full", -1, fe.r2_full),
            ("r2_weather", -1, fe.r2_weather)]  # hour -1: not an hour row
    head = spark.createDataFrame([(k, h, float(v)) for k, h, v in rows], "term string, hour long, value double")
    hours = fe.hour_table.select(F.lit("time_effect").alias("term"), F.col("hour").cast("long").alias("hour"),
                                 F.col("time_effect").alias("value"))
    return head.unionByName(hours).withColumn("value", r("value", 9))
