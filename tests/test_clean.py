from pyspark.sql import functions as F

from hourpanel.functions import clean as cl


def test_sentinels_and_nan_to_null(spark):
    vals = [float(v) for v in cl.SENTINELS_ALL] + [None, float("nan"), 12.5]
    df = spark.createDataFrame([(v,) for v in vals], "ta double")
    out = [r.ta for r in cl.null_sentinels(df, ["ta"], cl.SENTINELS_ALL).collect()]
    assert out[:-1] == [None] * (len(vals) - 1) and out[-1] == 12.5


def test_range_gates_inclusive(spark):
    df = spark.createDataFrame([(-51.0, -1.0, -0.1, -1.0), (-50.0, 0.0, 0.0, 0.0), (60.0, 100.0, 3.0, 1.0),
                                (61.0, 101.0, 1.0, 2.0)], "ta double, hm double, ws double, rn_hr1 double")
    rows = cl.null_out_of_range(df).collect()
    assert rows[0].ta is None and rows[0].hm is None and rows[0].ws is None and rows[0].rn_hr1 is None
    assert rows[1].ta == -50.0 and rows[1].hm == 0.0 and rows[1].ws == 0.0
    assert rows[2].ta == 60.0 and rows[2].hm == 100.0
    assert rows[3].ta is None and rows[3].hm is None


def test_clean_weather_equals_two_steps(spark):
    vals = [(-99.0, 50.0), (-9999.0, 120.0), (20.0, -3.0), (70.0, 40.0), (None, None), (10.0, 999.0)]
    df = spark.createDataFrame(vals, "ta double, hm double")
    one = cl.clean_weather(df, ["ta", "hm"]).collect()
    two = cl.null_out_of_range(cl.null_sentinels(df, ["ta", "hm"], cl.SENTINELS_ALL)).collect()
    assert one == two


def test_iqr_clip_keeps_missing(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)] + [(None,), (100.0,)], "x double")
    out = [r.x for r in cl.iqr_clip(df, ["x"]).collect()]
    assert None in out and max(v for v in out if v is not None) < 100.0


def test_to_numeric(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "s string")
    assert [r.v for r in df.select(cl.to_numeric("s").alias("v")).collect()] == [1.5, None, None]
