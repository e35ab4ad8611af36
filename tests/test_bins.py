from pyspark.sql import functions as F

from hourpanel.functions import bins as bn


def test_cut_right_closed_and_out_of_range(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 40.0, 40.1, 60.0, 100.0, 100.1, None]], "hm double")
    out = df.select("hm", bn.cut("hm", bn.HUMIDITY_LEVEL_EDGES, ["low", "mid", "high"]).alias("b")).collect()
    got = {r.hm: r.b for r in out}
    assert got[0.0] is None            # lowest edge is open
    assert got[40.0] == "low" and got[40.1] == "mid"
    assert got[60.0] == "mid" and got[100.0] == "high"
    assert got[100.1] is None and got[None] is None


def test_cut_covers_each_in_range_value_once(spark):
    edges = [-40, -10, 0, 10, 20, 30, 40]
    df = spark.range(-39, 41).select(F.col("id").cast("double").alias("x"))
    out = df.select(bn.cut("x", edges).alias("b")).groupBy().agg(F.count("b").alias("n")).first()["n"]
    assert out == 80


def test_qcut_includes_lowest(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 10)], "x double")
    out = bn.qcut(df, "x", 3, ["a", "b", "c"], out="q").orderBy("x").collect()
    assert out[0].q == "a" and out[-1].q == "c"
    assert [r.q for r in out].count("a") == 3


def test_labeler_null_handling(spark):
    df = spark.createDataFrame([(None,), (5.0,), (30.0,)], "si double")
    plain = df.select(bn.labeler("si", bn.LABEL_SOLAR).alias("l")).collect()
    parity = df.select(bn.labeler("si", bn.LABEL_SOLAR, null_to_last=True).alias("l")).collect()
    assert plain[0].l is None and parity[0].l == bn.LABEL_SOLAR[-1][1]
    assert plain[1].l == bn.LABEL_SOLAR[0][1] and plain[2].l == bn.LABEL_SOLAR[-1][1]


def test_rain_labeler_zero_first(spark):
    df = spark.createDataFrame([(0.0,), (4.0,), (4.5,), (30.0,)], "rn_hr1 double")
    out = [r.l for r in df.select(bn.labeler("rn_hr1", bn.LABEL_RAIN, zero_label=bn.LABEL_RAIN_ZERO).alias("l")).collect()]
    assert out == [bn.LABEL_RAIN_ZERO, "약한비", "보통비", "매우강한비"]


def test_quantile_bands_overlap_at_q95(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    q = [F.lit(v) for v in (0.0, 0.5, 0.8, 1.0)]
    bands = df.select(bn.quantile_band_masks("x", *q).alias("b")).first().b
    assert bands == [3, 4]
