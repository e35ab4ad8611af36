"""Registered source and sink queries.

Inputs are the driver tables; file round trips write a panel derived from
them into a fresh folder under ``spark.checkpoint.dir`` and read it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..sources import panel_io as pio
from ..sources.fixtures import ROW_KEY
from . import ml
from .common import final, r, wide, with_clean, with_panel
from .feature_chain import LAGGED, FeatureChain
from .q_ml import SPLIT_TM, SQL_MODEL, baseline_predictions, parts
from .registry import register

COLS = [f.name for f in pio.PANEL_SCHEMA.fields]
COLS_SQL = ", ".join(COLS)


@register("src_csv", with_panel(f"select {COLS_SQL} from panel"))
def src_csv(spark, sf):
    """Panel written as header CSV and read back under the fixed schema."""
    path = pio.write_panel_csv(wide(spark, sf), pio.io_dir(spark, "src_csv"))
    return final(pio.read_panel(spark, path))


@register("src_csv_cp949", with_panel(f"""
select {COLS_SQL.replace('direction', "case direction when 'O' then '상선' else '하선' end as direction")} from panel"""))
def src_csv_cp949(spark, sf):
    """Panel with Korean direction names written as CSV lines in cp949 and read back from the bytes; no line is bad."""
    df = wide(spark, sf).withColumn("direction", F.when(F.col("direction") == "O", "상선").otherwise("하선"))
    lines = df.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COLS]).alias("line"))
    header = spark.createDataFrame([(",".join(COLS),)], "line string").coalesce(1)
    path = pio.write_lines(header.unionByName(lines), pio.io_dir(spark, "cp949"), "cp949")
    rows, bad = pio.read_panel_checked(spark, path, "cp949")
    if not bad.isEmpty():
        raise ValueError("lines that were written don't parse")
    return final(rows)


def _write_years(spark, sf, prefix: bool):
    """One file for each year of the panel; returns the folder and the years."""
    base = pio.io_dir(spark, "years")
    df = wide(spark, sf)
    year = F.floor(F.col("tm") / 1000000).cast("int").alias("year")
    years = sorted(r["year"] for r in df.select(year).distinct().collect())  # calendar years
    for y in years:
        part = df.filter(F.floor(F.col("tm") / 1000000) == y)
        pio.write_panel_csv(part, f"{base}/{pio.FILE_PATTERN.format(yy=y % 100)}",
                            pio.PREFIX_PATTERN.format(yy=y % 100) if prefix else None)
    return base, years


@register("src_multi_year", with_panel(f"""
select {COLS_SQL}, cast(tm // 1000000 as integer) as year from panel"""))
def src_multi_year(spark, sf):
    """Per-year files stacked in one read; each file has its year."""
    return pio.read_years(spark, *_write_years(spark, sf, prefix=False))


@register("src_strip_prefix", with_panel(f"""
select {COLS_SQL}, cast(tm // 1000000 as integer) as year from panel"""))
def src_strip_prefix(spark, sf):
    """Year files whose headers carry a ``train_subwayYY.`` prefix; names stripped on read."""
    return pio.read_years(spark, *_write_years(spark, sf, prefix=True), with_prefix=True)


@register("src_year_partitions", with_panel("""
select cast(tm // 1000000 as bigint) as year, case when tm // 1000000 <= 1996 then 'train' else 'test' end as part,
       count(*) as n, round(avg(congestion), 6) as mean_y from panel group by all"""))
def src_year_partitions(spark, sf):
    """Panel in a folder for each year; train and test years read apart, each from its own folders."""
    path = pio.write_panel(wide(spark, sf), pio.io_dir(spark, "by_year"))
    years = [r["year"] for r in pio.open_panel(spark, path).select("year").distinct().collect()]  # calendar years
    parts_ = [pio.open_panel(spark, path, ys).withColumn("part", F.lit(name)) for name, ys in (
        ("train", [y for y in years if y <= 1996]), ("test", [y for y in years if y > 1996]))]
    out = parts_[0].unionByName(parts_[1]).groupBy("year", "part").agg(F.count("*").alias("n"), r(F.avg("congestion")).alias("mean_y"))
    return final(out)


_PROFILE_TYPES = [("station_name", "string"), ("direction", "string"), ("tm", "bigint"), ("ta", "double"),
                  ("wd", "double"), ("ws", "double"), ("rn_day", "double"), ("rn_hr1", "double"), ("hm", "double"),
                  ("si", "double"), ("ta_chi", "double"), ("congestion", "double"), ("l_orderkey", "bigint"),
                  ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                  ("l_extendedprice", "double")]


@register("src_profile", with_panel(" union all ".join(
    f"select '{c}' as column, '{t}' as type, cast(count_if({c} is null) as bigint) as nulls, "
    f"cast(count(*) as bigint) as rows from panel" for c, t in _PROFILE_TYPES)))
def src_profile(spark, sf):
    return pio.profile(wide(spark, sf))


SINK_SQL = with_clean(f"""with {SQL_MODEL}
select strftime(datetime, '%Y%m%d%H%M') as tm, congestion as congestion1, round(prediction, 6) as congestion2,
       direction, cast(direction = 'O' as integer) as direction_encoded,
       cast(strftime(date, '%m-%d') in ({', '.join(f"'{m}'" for m in cal.recurring_month_days())}) as integer) as is_holiday,
       cast(hour between 7 and 9 and direction = 'O' as integer) as is_morning_outer,
       cast(hour between 17 and 19 and direction = 'F' as integer) as is_evening_inner
from p""")


@register("sink_predictions", SINK_SQL)
def sink_predictions(spark, sf):
    """Prediction file (stamp, actual, predicted, direction, flags) written as CSV and read back."""
    p = baseline_predictions(spark, sf)
    out = p.select(cal.format_stamp("datetime").alias("tm"), F.col("congestion").alias("congestion1"),
                   r("prediction").alias("congestion2"), "direction", "direction_encoded", "is_holiday",
                   *[c.alias(n) for n, c in cal.direction_cross(up="O", down="F").items()])
    path = pio.write_predictions(out, pio.io_dir(spark, "predictions"))
    schema = ("tm string, congestion1 double, congestion2 double, direction string, direction_encoded int, "
              "is_holiday int, is_morning_outer int, is_evening_inner int")
    return spark.read.schema(schema).option("header", True).csv(path)


@register("sink_model")
def sink_model(spark, sf):
    """Fit, save the bundle (feature chain, model, features, metrics, importances), reload through a fallback path list, re-score."""
    tr, te = parts(spark, sf)
    feats = ["hour", "dayofweek", "ta", "ws", "rn_hr1", "hm", "is_weekend"]
    model = ml.fit_model(tr, feats, "congestion", "forest", {"numTrees": ml.IMPORTANCE_TREES}, key=ROW_KEY)
    m = ml.evaluate(model, te, "congestion")
    base = pio.io_dir(spark, "bundle")
    metrics = spark.createDataFrame([(float(m["mae"]), float(m["rmse"]), float(m["r2"]))], "mae double, rmse double, r2 double")
    importance = spark.createDataFrame(ml.importances(model, feats), "feature string, importance double")
    raw = wide(spark, sf).filter(F.col("tm") < SPLIT_TM).select("station_name", *ROW_KEY, *LAGGED)
    chain = FeatureChain(order=ROW_KEY, exclude=ROW_KEY).fit(raw)
    ml.save_bundle(ml.Bundle(model, feats, metrics, importance, chain), base)
    got = ml.load_bundle(spark, [f"{base}-missing", base])
    again = ml.evaluate(got.model, te, "congestion")
    same = got.features == feats and got.chain.medians == chain.medians and got.chain.thresholds == chain.thresholds
    return got.metrics.withColumns({"reloaded_mae": F.lit(float(again["mae"])), "same_chain": F.lit(same),
                                    "n_importances": F.lit(got.importance.count())})
