"""Registered prediction and evaluation queries.

Model fits are Spark ML estimators (rows-only checks).  Evaluation operators
are model-agnostic; their oracle-checked queries score a deterministic
baseline predictor (train-period hour x weekday mean) so SQL can recompute
them exactly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import evaluate as ev
from ..operators import joins as jn
from ..operators import plotdata as pdat
from ..operators import select as sel
from ..operators import series as se
from ..session import store
from ..sources import fixtures as fx
from ..sources import panel_io as pio
from . import boosting as bo
from . import ml, tuning
from .common import clean, final, r, with_clean
from .registry import register

KEY = fx.ROW_KEY
KEY_SQL = ", ".join(KEY)
SPLIT_TM = 2000000000
BASE_FEATURES = ["hour", "dayofweek", "month", "is_weekend", "season", "is_rush_hour", "hour_sin", "hour_cos",
                 "day_sin", "day_cos", "month_sin", "month_cos", "ta", "ws", "rn_hr1", "hm", "direction_encoded",
                 "is_holiday"]


def model_frame(spark, sf):
    """Cleaned panel, rows complete in the basic weather set, with model features."""
    df = sel.complete_rows(clean(spark, sf), sel.SET_BASIC)
    df = df.withColumns({"is_weekend": cal.weekend_flag(), "season": cal.season("month", "code_0_3"),
                         "is_rush_hour": cal.rush_flag("hour", "model"),
                         "direction_encoded": (F.col("direction") == "O").cast("int"),
                         "is_holiday": cal.holiday_flag("date", recurring=True),
                         "time_period": cal.time_period("hour")})
    df = df.withColumns(cal.commute_flags())
    return cal.cyclic_features(df)


def parts(spark, sf):
    df = model_frame(spark, sf)
    return df.filter(F.col("tm") < SPLIT_TM), df.filter(F.col("tm") >= SPLIT_TM)


#: What the fits use beside: the day of the month and the code of the station.
FIT_FEATURES = [*BASE_FEATURES, "day", "station_encoded"]
FIT_COLUMNS = [*KEY, "station_name", "direction", "time_period", "congestion", "day", *BASE_FEATURES, "is_morning_peak", "is_evening_peak"]


def narrow_parts(spark, sf):
    """Train and test rows with the columns that fits read, stored once."""
    narrow = store(model_frame(spark, sf).select(*FIT_COLUMNS), "fit-rows")
    return narrow.filter(F.col("tm") < SPLIT_TM), narrow.filter(F.col("tm") >= SPLIT_TM)


def fit_parts(spark, sf):
    """Train and test rows of the stations that both have, with the code of the station.

    The columns that fits read are stored once; the stations' set, their codes, the fit and its scoring read that.
    """
    tr, te = jn.keep_common(*narrow_parts(spark, sf), "station_name")
    tr, te, _ = ml.label_encode(tr.withColumn("station", F.col("station_name")), ["station"], te.withColumn("station", F.col("station_name")))
    return tr, te


def baseline_predictions(spark, sf):
    """Test rows with the train-period hour x weekday mean as the prediction."""
    tr, te = parts(spark, sf)
    overall = tr.select(F.avg("congestion")).scalar()
    means = F.broadcast(tr.groupBy("hour", "dayofweek").agg(F.avg("congestion").alias("pred0")))  # <= 168 rows
    out = te.join(means, ["hour", "dayofweek"], "left")
    return out.withColumn("prediction", F.coalesce(F.col("pred0"), F.lit(overall))).drop("pred0")


SQL_MODEL = f"""m as (select * from clean where ta is not null and ws is not null and rn_hr1 is not null and hm is not null),
tr as (select * from m where tm < {SPLIT_TM}), te as (select * from m where tm >= {SPLIT_TM}),
bm as (select hour, dayofweek, avg(congestion) as pred0 from tr group by all),
p as (select te.*, coalesce(bm.pred0, (select avg(congestion) from tr)) as prediction
      from te left join bm using (hour, dayofweek))"""


def with_p(body: str) -> str:
    b = body.strip()
    if b.lower().startswith("with "):
        return with_clean(f"with {SQL_MODEL}, {b[5:]}")
    return with_clean(f"with {SQL_MODEL} {b}")


# --------------------------------------------------------------------------- splits, encoding, scaling
@register("ml_random_split", with_p("""
with s as (select congestion, case when (cast('0x' || substr(md5(concat_ws('|', '42', tm, l_orderkey, l_partkey, l_suppkey,
             l_linenumber)), 1, 8) as bigint) % 1000000) / 1000000.0 < 0.8 then 'train' else 'test' end as part from m)
select part, count(*) as n, round(avg(congestion), 6) as mean_y from s group by part"""))
def ml_random_split(spark, sf):
    """80/20 split by a seeded hash of the row key (reproducible under any partitioning)."""
    df = ml.hash_split(model_frame(spark, sf), KEY[:-1], 0.8, 42)  # the integer keys
    return final(df.groupBy("part").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                        r(F.avg("congestion")).alias("mean_y")))


@register("ml_year_split", with_clean("""
select cast(year as bigint) as year, case when year <= 1996 then 'train' else 'test' end as part,
       cast(count(*) as bigint) as n from clean group by all"""))
def ml_year_split(spark, sf):
    """Train on the years up to 1996, test on the later ones."""
    df = clean(spark, sf)
    years = [r["year"] for r in df.select("year").distinct().collect()]  # calendar years
    tr, te = ml.year_split(df, "year", [y for y in years if y <= 1996], [y for y in years if y > 1996])
    out = tr.withColumn("part", F.lit("train")).unionByName(te.withColumn("part", F.lit("test")))
    return final(out.groupBy("year", "part").agg(F.count(F.lit(1)).cast("long").alias("n")))


@register("ml_scale", with_p(f"""
with s as (select avg(ta) as m_ta, stddev_pop(ta) as s_ta, avg(hm) as m_hm, stddev_pop(hm) as s_hm from tr)
select {KEY_SQL}, round((ta - m_ta) / s_ta, 6) as ta_scaled, round((hm - m_hm) / s_hm, 6) as hm_scaled,
       round(((ta - m_ta) / s_ta) * s_ta + m_ta, 6) as ta_original from te, s"""))
def ml_scale(spark, sf):
    """Standardize with train statistics, apply to test, and invert."""
    tr, te = parts(spark, sf)
    _, te_s, stats = ml.standardize(tr, ["ta", "hm"], te)
    te_s = ml.unstandardize(te_s, {"ta": stats["ta"]})
    return final(te_s.select(*KEY, r("ta_scaled").alias("ta_scaled"), r("hm_scaled").alias("hm_scaled"),
                             r("ta_original").alias("ta_original")))


_TP_SQL = "case " + " ".join(f"when hour in ({', '.join(map(str, hs))}) then '{lab}'" for hs, lab in cal.TIME_PERIODS) \
    + f" else '{cal.TIME_PERIOD_DEFAULT}' end"


@register("ml_label_encode", with_p(f"""
with trl as (select distinct station_name from tr), tpl as (select distinct {_TP_SQL} as tp from tr),
sc as (select station_name, cast(row_number() over (order by station_name) - 1 as double) as station_code from trl),
tc as (select tp, cast(row_number() over (order by tp) - 1 as double) as period_code from tpl)
select {KEY_SQL}, coalesce(sc.station_code, (select count(*) from trl)) as station_name_encoded,
       coalesce(tc.period_code, (select count(*) from tpl)) as time_period_encoded
from te left join sc using (station_name) left join tc on tc.tp = {_TP_SQL}"""))
def ml_label_encode(spark, sf):
    """Alphabetical codes fitted on train, applied to test (unseen -> extra code)."""
    tr, te = parts(spark, sf)
    _, te_e, _ = ml.label_encode(tr, ["station_name", "time_period"], te)
    return final(te_e.select(*KEY, "station_name_encoded", "time_period_encoded"))


_TC = cal.TIME_CATEGORY_LABELS


@register("ml_one_hot", with_clean(f"""
with t as (select {KEY_SQL}, case when hour > -1 and hour <= 6 then '{_TC[0]}' when hour > 6 and hour <= 9 then '{_TC[1]}'
             when hour > 9 and hour <= 16 then '{_TC[2]}' when hour > 16 and hour <= 19 then '{_TC[3]}'
             when hour > 19 and hour <= 23 then '{_TC[4]}' end as tc from clean),
codes as (select tc, row_number() over (order by tc) - 1 as code from (select distinct tc from t))
select {KEY_SQL}, {', '.join(f'cast(code = {i} as double) as ohe_{i}' for i in range(5))} from t join codes using (tc)"""))
def ml_one_hot(spark, sf):
    """Time category indexed alphabetically, then one-hot (all levels kept)."""
    from pyspark.ml.functions import vector_to_array
    df = clean(spark, sf).withColumn("tc", cal.time_category("hour"))
    idx = ml.StringIndexer(inputCol="tc", outputCol="tc_idx", stringOrderType="alphabetAsc").fit(df).transform(df)
    oh = ml.one_hot(idx, "tc_idx").withColumn("__a", vector_to_array("tc_idx_ohe"))
    return final(oh.select(*KEY, *[F.col("__a")[i].alias(f"ohe_{i}") for i in range(5)]))


@register("ml_one_hot_station", with_p(f"""
with k as (select station_name from tr group by 1 having count(*) > 100),
codes as (select station_name, cast(row_number() over (order by station_name) - 1 as bigint) as code from k)
select {KEY_SQL}, coalesce(code, (select count(*) from k)) as code, cast((select count(*) + 1 from k) as bigint) as width
from te left join codes using (station_name)"""))
def ml_one_hot_station(spark, sf):
    """Station dummies after the rare collapse (over 100 train rows), as sparse vectors: each test row's place and the width."""
    tr, te = parts(spark, sf)
    _, te, _ = ml.sparse_dummies(tr.select("station_name"), "station_name", te.select(*KEY, "station_name"))

    # a vector's type is no Arrow type: its one entry and its size are read row by row
    entry = F.udf(lambda v: (int(v.indices[0]), int(v.size)), "struct<code:long,width:long>")
    got = te.withColumn("e", entry("station_name_dummies"))
    return final(got.select(*KEY, F.col("e.code").alias("code"), F.col("e.width").alias("width")))


# --------------------------------------------------------------------------- weights
@register("ml_weights", with_p(f"""
with q as (select quantile_cont(congestion, 0.8) as q80 from tr),
w as (select {KEY_SQL}, cast(dayofweek >= 5 as int) as we, (hour between 8 and 9) or (hour between 18 and 19) as peak,
             congestion > q80 as high from tr, q)
select {KEY_SQL}, round(case when peak then 2.0 when we = 1 then 3.0 else 1.0 end
                        * case when high then 1.8 else 1.0 end * case when we = 1 and high then 2.0 else 1.0 end, 6)
                  as weight from w"""))
def ml_weights(spark, sf):
    tr, _ = parts(spark, sf)
    w = ml.sample_weights(tr, "congestion", ml.high_threshold(tr, "congestion"))
    return final(w.select(*KEY, r("weight").alias("weight")))


@register("ml_weights_by_day", with_p("""
with q as (select quantile_cont(congestion, 0.8) as q80 from tr),
w as (select cast(dayofweek >= 5 as int) as we, (hour between 8 and 9) or (hour between 18 and 19) as peak, congestion > q80 as high from tr, q)
select case when we = 1 then 'weekend' else 'weekday' end as day_type, cast(count(*) as bigint) as n,
       round(avg(case when peak then 2.0 when we = 1 then 3.0 else 1.0 end * case when high then 1.8 else 1.0 end
                 * case when we = 1 and high then 2.0 else 1.0 end), 6) as mean_weight from w group by 1"""))
def ml_weights_by_day(spark, sf):
    """Rows and mean weight by day type."""
    tr, _ = parts(spark, sf)
    w = ml.sample_weights(tr, "congestion", ml.high_threshold(tr, "congestion"))
    return final(w.groupBy(F.when(F.col("is_weekend") == 1, "weekend").otherwise("weekday").alias("day_type")).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("weight")).alias("mean_weight")))


# --------------------------------------------------------------------------- models
def _fit_eval(spark, sf, kind, params=None, weight=False, features=FIT_FEATURES):
    tr, te = fit_parts(spark, sf)
    if weight:
        tr = ml.sample_weights(tr, "congestion", ml.high_threshold(tr, "congestion"))
    model = ml.fit_model(tr, features, "congestion", kind, params, "weight" if weight else None, key=KEY)
    return model, ml.evaluate(model, te, "congestion")


def _metrics_frame(spark, rows):
    return spark.createDataFrame([(k, float(m["mae"]), float(m["rmse"]), float(m["r2"]), int(m["n"])) for k, m in rows],
                                 "model string, mae double, rmse double, r2 double, n long")


# Features as SQL, in the order of FIT_FEATURES.
_HOLIDAY_SQL = f"""(date in ({', '.join(f"date '{d}'" for d in sorted(set(cal.HOLIDAYS)))})
    or strftime(date, '%m-%d') in ({', '.join(f"'{m}'" for m in cal.recurring_month_days())}))"""
_FEATURE_SQL = {
    "is_weekend": "dayofweek >= 5", "is_rush_hour": "hour in (7, 8, 9, 18, 19, 20)", "direction_encoded": "direction = 'O'",
    "is_holiday": _HOLIDAY_SQL, "season": "case when month in (12, 1, 2) then 0 when month <= 5 then 1 when month <= 8 then 2 else 3 end",
    "hour_sin": "sin(2 * pi() * hour / 24)", "hour_cos": "cos(2 * pi() * hour / 24)", "day_sin": "sin(2 * pi() * dayofweek / 7)",
    "day_cos": "cos(2 * pi() * dayofweek / 7)", "month_sin": "sin(2 * pi() * month / 12)", "month_cos": "cos(2 * pi() * month / 12)"}
SQL_FIT_ROWS = f"""both_have as (select station_name from tr intersect select station_name from te),
codes as (select station_name, row_number() over (order by station_name) - 1 as station_encoded from both_have),
fit_rows as (select tm, congestion as y, {', '.join(f'cast({_FEATURE_SQL.get(c, c)} as double) as x{i}' for i, c in enumerate(FIT_FEATURES))}
             from m join codes using (station_name))"""


def _linear_sql(rows: str, p: int = len(FIT_FEATURES)) -> str:
    """Errors on held-out rows of least squares by successive residuals: CTEs that end in ``errors`` (k, actual, e).

    ``rows`` selects k (which fit), fit (whether the row is fitted on), y and x0..  Each regressor in turn is taken out of the
    later ones and the target, with the slopes of the fitted rows, in all rows; what is left of a held-out row's target is its error.
    """
    names = ["y", *[f"x{i}" for i in range(p)]]
    out = [f"lin_rows as materialized ({rows})",
           f"lin_means as materialized (select k, {', '.join(f'avg({c}) as m_{c}' for c in names)} from lin_rows where fit group by k)",
           f"lin_0 as materialized (select k, fit, y as actual, {', '.join(f'{c} - m_{c} as {c}' for c in names)} from lin_rows join lin_means using (k))"]
    for j in range(p):
        x, rest = f"x{j}", ["y", *[f"x{i}" for i in range(j + 1, p)]]
        slopes = ", ".join(f"coalesce(sum({c} * {x}) / nullif(sum({x} * {x}), 0), 0) as s_{c}" for c in rest)
        out += [f"lin_s{j} as materialized (select k, {slopes} from lin_{j} where fit group by k)",
                f"lin_{j + 1} as materialized (select k, fit, actual, {', '.join(f'{c} - s_{c} * {x} as {c}' for c in rest)} from lin_{j} join lin_s{j} using (k))"]
    return ",\n".join([*out, f"errors as (select k, actual, y as e from lin_{p} where not fit)"])


_LINEAR_MET_SQL = """round(avg(abs(e)), 6) as mae, round(sqrt(avg(e * e)), 6) as rmse,
       round(1 - sum(e * e) / (var_pop(actual) * count(*)), 6) as r2, cast(count(*) as bigint) as n from errors"""


@register("ml_linear", with_p(f"""
with {SQL_FIT_ROWS},
{_linear_sql(f"select 1 as k, tm < {SPLIT_TM} as fit, * exclude (tm) from fit_rows")}
select 'linear' as model, {_LINEAR_MET_SQL}"""))
def ml_linear(spark, sf):
    """Least squares on the train period, its errors on the test period."""
    _, m = _fit_eval(spark, sf, "linear")
    return _metrics_frame(spark, [("linear", m)]).withColumns({c: r(c) for c in ("mae", "rmse", "r2")})


@register("ml_forest")
def ml_forest(spark, sf):
    _, m = _fit_eval(spark, sf, "forest")
    return _metrics_frame(spark, [("forest", m)])


@register("ml_boost")
def ml_boost(spark, sf):
    """Gradient boosting with the study's settings, weighted rows."""
    _, m = _fit_eval(spark, sf, "boost", weight=True)
    return _metrics_frame(spark, [("boost_weighted", m)])


def boost_table(df, fold, weight=None):
    return bo.table(df, FIT_FEATURES, "congestion", KEY, fold, weight)


@register("ml_boost_large")
def ml_boost_large(spark, sf):
    """The study's large weighted model: 2,000 trees of depth 15 for one station's three summer months, fitted in stages.

    The station is the one with the most rows in the train summers (ties: the first by name).
    """
    tr, te = fit_parts(spark, sf)
    summer = F.col("month").isin(6, 7, 8)
    station = tr.where(summer).groupBy("station_name").count().orderBy(F.desc("count"), "station_name").limit(1).select("station_name")
    tr, te = (jn.keep_in(d.where(summer), station, "station_name") for d in (tr, te))
    tr = ml.sample_weights(tr, "congestion", ml.high_threshold(tr, "congestion")).withColumn("fold", F.lit(0))
    both = tr.unionByName(te.withColumns({"weight": F.lit(1.0), "fold": F.lit(1)}))
    t = boost_table(both, "fold", "weight")
    run = bo.Run("large", tuning.LARGE, (0,), (1,), (500, 1000, 2000))
    fitted = bo.fit_staged(t, run, pio.io_dir(spark, "boost-large"))
    rows = [(s["stage"], sum(len(x.feature) for x in fitted.trees[:s["stage"]]), s["mae"], s["mse"] ** 0.5 if s["n"] else None, s["r2"], s["n"]) for s in fitted.scores]
    return spark.createDataFrame(rows, "trees int, nodes long, mae double, rmse double, r2 double, n long")


@register("ml_grid")
def ml_grid(spark, sf):
    """The study's whole grid, 108 settings x 5 folds: 180 runs in step, scored after 50, 100 and 200 trees."""
    tr, _ = fit_parts(spark, sf)
    res = tuning.grid_search(boost_table(tuning.hash_folds(tr, KEY, tuning.GRID_FOLDS), "fold"))
    return spark.createDataFrame([(*[x[k] for k in tuning.GRID], x["folds"], x["cv_mse"], x["cv_mse"] ** 0.5) for x in res],
                                 "trees int, depth int, rate double, rows double, columns double, folds int, cv_mse double, cv_rmse double")


@register("ml_search")
def ml_search(spark, sf):
    """Seeded random search over the study's ranges, 10 trials x 3 expanding windows, each fit entered in a ledger."""
    tr, _ = fit_parts(spark, sf)
    t = boost_table(ml.time_folds(tr, "tm", tuning.SEARCH_FOLDS), "fold")
    res = tuning.search(t, tuning.TrialLedger(spark, pio.io_dir(spark, "trials")))
    return spark.createDataFrame([tuple(x.values()) for x in res], "trial int, trees int, depth int, rate double, rows double, columns double, "
                                 "l1 double, l2 double, folds int, cv_mae double")


@register("ml_ts_cv", with_p(f"""
with {SQL_FIT_ROWS},
blocks as (select tm, ntile(4) over (order by tm) - 1 as block from (select distinct tm from fit_rows where tm < {SPLIT_TM})),
{_linear_sql("select k, block < k as fit, f.* exclude (tm) from fit_rows f join blocks using (tm) join (values (1), (2), (3)) v(k) on block <= k")}
select cast(k as int) as fold, {_LINEAR_MET_SQL} group by k"""))
def ml_ts_cv(spark, sf):
    """Three expanding-window folds cut on the distinct stamps (linear model), solved from the blocks' moments."""
    tr, _ = fit_parts(spark, sf)
    res = ml.ts_cv_linear(tr, FIT_FEATURES, "congestion", "tm")
    out = spark.createDataFrame([(x["fold"], float(x["mae"]), float(x["rmse"]), float(x["r2"]), int(x["n"])) for x in res],
                                "fold int, mae double, rmse double, r2 double, n long")
    return out.withColumns({c: r(c) for c in ("mae", "rmse", "r2")})


VAR_FEATURES = ["hour", "dayofweek", "is_weekend", "hour_sin", "ta", "ws", "rn_hr1", "hm", "is_rush_hour"]
_VAR_SQL = {"is_weekend": "cast(dayofweek >= 5 as int)", "hour_sin": "sin(2 * pi() * hour / 24)",
            "is_rush_hour": "cast(hour in (7, 8, 9, 18, 19, 20) as int)"}


@register("ml_variance_select", with_p(" union all ".join(
    f"select '{c}' as feature from tr having var_samp({_VAR_SQL.get(c, c)}) > 0.01" for c in VAR_FEATURES)))
def ml_variance_select(spark, sf):
    tr, _ = parts(spark, sf)
    kept = ml.variance_select(tr, VAR_FEATURES)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@register("ml_importance_select")
def ml_importance_select(spark, sf):
    tr, _ = fit_parts(spark, sf)
    kept = ml.importance_select(tr, FIT_FEATURES, "congestion", key=KEY)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@register("ml_importance")
def ml_importance(spark, sf):
    """Top-15 forest importances with their feature family."""
    tr, _ = fit_parts(spark, sf)
    model = ml.fit_model(tr, FIT_FEATURES, "congestion", "forest", key=KEY)
    imp = ml.importances(model, FIT_FEATURES)[:15]
    return spark.createDataFrame([(f, v, ml.importance_family(f)) for f, v in imp], "feature string, importance double, family string")


@register("ml_importance_family")
def ml_importance_family(spark, sf):
    tr, _ = fit_parts(spark, sf)
    model = ml.fit_model(tr, FIT_FEATURES, "congestion", "forest", key=KEY)
    imp = spark.createDataFrame(ml.importances(model, FIT_FEATURES), "feature string, importance double")
    return imp.groupBy(ml.family_expr(F.col("feature")).alias("family")).agg(F.sum("importance").alias("importance"))


@register("ml_time_residual")
def ml_time_residual(spark, sf):
    """Forest on nine time features; variance of the target removed by it."""
    tr, te = narrow_parts(spark, sf)
    tr2, te2, _ = ml.time_residual(tr, te, "congestion", key=KEY)
    out = tr2.select(F.lit("train").alias("part"), "congestion", "residual").unionByName(
        te2.select(F.lit("test").alias("part"), "congestion", "residual"))
    return out.groupBy("part").agg(
        ((1 - F.var_samp("residual") / F.var_samp("congestion")) * 100).alias("variance_removed_pct"),
        F.count(F.lit(1)).cast("long").alias("n"))


@register("ml_target_swap")
def ml_target_swap(spark, sf):
    """Weather-only model trained on the time residual instead of the raw target."""
    tr, te = narrow_parts(spark, sf)
    tr2, te2, _ = ml.time_residual(tr, te, "congestion", key=KEY)
    feats = ["ta", "ws", "rn_hr1", "hm", "is_holiday", "is_weekend"]
    model = ml.fit_model(tr2, feats, "residual", "forest", key=KEY)
    return _metrics_frame(spark, [("forest_on_residual", ml.evaluate(model, te2, "residual"))])


BASE_BOOST = {"maxIter": 100, "maxDepth": 6}


@register("ml_lag_model")
def ml_lag_model(spark, sf):
    """Boosting as it comes, with its iterations chosen on the last fifth of the train stamps, and with lags 1-3 and the
    hour x weekday mean on top; compare RMSE / R^2."""
    df = model_frame(spark, sf).select("station_name", *KEY, *BASE_FEATURES, "congestion")
    df = se.sequence_index(df, ["station_name"], KEY)
    df = store(se.add_lags(df, ["station_name"], "pos", ["congestion"], [1, 2, 3]), "lagged")  # the means, three fits and their scoring read it
    df = se.drop_warmup(df, ["congestion_lag_1", "congestion_lag_2", "congestion_lag_3"])
    train = df.filter(F.col("tm") < SPLIT_TM)  # the means are the train period's, for both parts
    means = train.groupBy("hour", "dayofweek").agg(F.avg("congestion").alias("congestion_hour_day_avg"))
    df = df.join(jn.bounded(means, 24 * 7), ["hour", "dayofweek"])
    tr, te = df.filter(F.col("tm") < SPLIT_TM), df.filter(F.col("tm") >= SPLIT_TM)
    tr = se.chrono_split(tr, "tm", 0.8).withColumn("held_back", F.col("part") != "train")
    lag_feats = BASE_FEATURES + ["congestion_lag_1", "congestion_lag_2", "congestion_lag_3", "congestion_hour_day_avg"]
    rows = []
    for name, feats, valid in [("boost_base", BASE_FEATURES, None), ("boost_tuned", BASE_FEATURES, "held_back"),
                               ("boost_lags", lag_feats, "held_back")]:
        model = ml.fit_model(tr, feats, "congestion", "boost", BASE_BOOST if valid is None else None, valid=valid, key=KEY)
        rows.append((name, ml.evaluate(model, te, "congestion")))
    return _metrics_frame(spark, rows)


# --------------------------------------------------------------------------- metrics and evaluation (oracle-checked)
_MET_SQL = """round(avg(abs(prediction - congestion)), 6) as mae, round(sqrt(avg((prediction - congestion) * (prediction - congestion))), 6) as rmse,
       round(1 - sum((prediction - congestion) * (prediction - congestion))
             / (sum(congestion * congestion) - sum(congestion) * sum(congestion) / count(congestion)), 6) as r2,
       cast(count(congestion) as bigint) as n"""


@register("ml_metrics", with_p(f"select {_MET_SQL} from p"))
def ml_metrics(spark, sf):
    out = ev.metrics(baseline_predictions(spark, sf), "congestion", "prediction")
    return final(out.select(r("mae").alias("mae"), r("rmse").alias("rmse"), r("r2").alias("r2"), "n"))


@register("ml_best", with_p(f"""
with allp as (select 'hour_weekday_mean' as model, congestion, prediction from p
              union all select 'overall_mean', congestion, (select avg(congestion) from tr) from p),
mm as (select model, avg(abs(prediction - congestion)) as mae, sqrt(avg((prediction - congestion) * (prediction - congestion))) as rmse,
              1 - sum((prediction - congestion) * (prediction - congestion))
                  / (sum(congestion * congestion) - sum(congestion) * sum(congestion) / count(congestion)) as r2
       from allp group by model),
b as (select * from mm order by mae, model limit 1)
select model, round(mae, 6) as mae, round(rmse, 6) as rmse, round(r2, 6) as r2,
       case when r2 > 0.8 then 'good' when r2 > 0.6 then 'fair' else 'poor' end as grade,
       cast(r2 < 0.7 as bigint) as needs_work from b"""))
def ml_best(spark, sf):
    """Pick the candidate with the lowest MAE and grade it by R^2."""
    p = baseline_predictions(spark, sf)
    tr, _ = parts(spark, sf)
    overall = tr.select(F.avg("congestion")).scalar()
    cands = p.select(F.lit("hour_weekday_mean").alias("model"), "congestion", "prediction").unionByName(
        p.select(F.lit("overall_mean").alias("model"), "congestion", F.lit(overall).alias("prediction")))
    m = ev.metrics(cands, "congestion", "prediction", by=["model"]).drop("n")
    best = ev.best_model(m)
    return final(best.select("model", r("mae").alias("mae"), r("rmse").alias("rmse"), r("r2").alias("r2"), "grade",
                             "needs_work"))


@register("eval_hourly_error", with_p("""
select cast(hour as bigint) as hour, round(avg(abs(prediction - congestion)), 6) as mae, cast(count(*) as bigint) as n
from p group by hour"""))
def eval_hourly_error(spark, sf):
    out = ev.hourly_error(baseline_predictions(spark, sf), "congestion", "prediction")
    return final(out.withColumn("mae", r("mae")))


@register("eval_actual_vs_pred", with_p("""
select cast(hour as bigint) as hour, cast(dayofweek >= 5 as bigint) as is_weekend,
       round(avg(congestion), 6) as actual_mean, round(avg(prediction), 6) as pred_mean,
       round(stddev_samp(congestion), 6) as actual_std, round(stddev_samp(prediction), 6) as pred_std,
       cast(count(*) as bigint) as n from p group by all"""))
def eval_actual_vs_pred(spark, sf):
    d = baseline_predictions(spark, sf)
    out = ev.actual_vs_pred(d, "congestion", "prediction", ["hour", "is_weekend"])
    return final(out.select("hour", "is_weekend", *[r(c).alias(c) for c in
                                                    ("actual_mean", "pred_mean", "actual_std", "pred_std")], "n"))


@register("eval_bias", with_p("""
select 'all' as subset, cast(hour as bigint) as hour, round(avg(prediction - congestion), 6) as bias,
       cast(count(*) as bigint) as n from p group by hour
union all
select 'weekend_8plus', cast(hour as bigint), round(avg(prediction - congestion), 6), cast(count(*) as bigint)
from p where dayofweek >= 5 and hour >= 8 group by hour"""))
def eval_bias(spark, sf):
    d = baseline_predictions(spark, sf)
    a = ev.bias_by(d, "congestion", "prediction", ["hour"]).select(F.lit("all").alias("subset"), "*")
    w = ev.bias_by(d, "congestion", "prediction", ["hour"], (F.col("dayofweek") >= 5) & (F.col("hour") >= 8))
    w = w.select(F.lit("weekend_8plus").alias("subset"), "*")
    return final(a.unionByName(w).withColumn("bias", r("bias")))


@register("eval_daily_direction", with_p("""
select 'date_hour' as level, strftime(date, '%Y-%m-%d') as period, direction, cast(hour as bigint) as hour,
       round(avg(congestion), 6) as actual_mean, round(avg(prediction), 6) as pred_mean from p group by all
union all
select 'month', strftime(date, '%Y-%m'), direction, cast(-1 as bigint), round(avg(congestion), 6), round(avg(prediction), 6)
from p group by all"""))
def eval_daily_direction(spark, sf):
    """Hourly means per date x direction and daily-level means per month x direction."""
    d = baseline_predictions(spark, sf)
    a = d.groupBy(F.date_format("date", "yyyy-MM-dd").alias("period"), "direction", "hour").agg(
        F.avg("congestion").alias("actual_mean"), F.avg("prediction").alias("pred_mean"))
    a = a.select(F.lit("date_hour").alias("level"), "*")
    m = d.groupBy(F.date_format("date", "yyyy-MM").alias("period"), "direction").agg(
        F.avg("congestion").alias("actual_mean"), F.avg("prediction").alias("pred_mean"))
    m = m.select(F.lit("month").alias("level"), "period", "direction", F.lit(-1).alias("hour"), "actual_mean", "pred_mean")
    out = a.unionByName(m)
    return final(out.withColumns({"actual_mean": r("actual_mean"), "pred_mean": r("pred_mean")}))


@register("eval_peak_error", with_p("""
select round(avg(case when (hour between 8 and 9) or (hour between 18 and 19) then abs(prediction - congestion) end), 6) as peak_mae,
       round(avg(case when not ((hour between 8 and 9) or (hour between 18 and 19)) then abs(prediction - congestion) end), 6) as non_peak_mae,
       round(avg(case when dayofweek >= 5 then abs(prediction - congestion) end), 6) as weekend_mae,
       round(avg(case when not (dayofweek >= 5) then abs(prediction - congestion) end), 6) as non_weekend_mae from p"""))
def eval_peak_error(spark, sf):
    d = baseline_predictions(spark, sf)
    out = ev.conditional_error(d, "congestion", "prediction",
                               {"peak": F.col("is_peak_time") == 1, "weekend": F.col("is_weekend") == 1})
    return final(out.select(*[r(c).alias(c) for c in out.columns]))


@register("eval_residuals", with_p("""
with e as (select congestion - prediction as residual from p),
b as (select min(residual) as lo, max(residual) as hi from e),
h as (select least(cast(floor((residual - lo) / (hi - lo) * 30) as bigint), 29) as bin, count(*) as n from e, b group by 1)
select 'hist' as kind, cast(bin as double) as bin, cast(n as double) as value from h
union all select 'mean', cast(null as double), round(avg(residual), 6) from e
union all select 'std', cast(null as double), round(stddev_samp(residual), 6) from e"""))
def eval_residuals(spark, sf):
    d = baseline_predictions(spark, sf)
    stats, hist = ev.residual_summary(d, "congestion", "prediction")
    h = hist.select(F.lit("hist").alias("kind"), F.col("bin").cast("double").alias("bin"), F.col("n").cast("double").alias("value"))
    s = stats.select(F.inline(F.array(F.struct(F.lit("mean").alias("kind"), F.lit(None).cast("double").alias("bin"),
                                               r("mean").alias("value")),
                                      F.struct(F.lit("std").alias("kind"), F.lit(None).cast("double").alias("bin"),
                                               r("std").alias("value")))))
    return final(h.unionByName(s))


@register("eval_scatter_density", with_p("""
with b as (select min(congestion) as xl, max(congestion) as xh, min(prediction) as yl, max(prediction) as yh
           from p where congestion is not null and prediction is not null)
select least(cast(floor((congestion - xl) / (xh - xl) * 50) as bigint), 49) as congestion_bin,
       least(cast(floor((prediction - yl) / (yh - yl) * 50) as bigint), 49) as prediction_bin,
       count(*) as n
from p, b where congestion is not null and prediction is not null group by all"""))
def eval_scatter_density(spark, sf):
    """Actual against predicted on a 50 x 50 grid, all rows."""
    return final(pdat.histogram_2d(baseline_predictions(spark, sf), "congestion", "prediction", 50))
