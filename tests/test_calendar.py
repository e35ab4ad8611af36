from pyspark.sql import functions as F

from hourpanel.functions import calendar as cal


def test_hour_bands_cover_all_hours(spark):
    df = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    out = df.select("hour", cal.time_group().alias("g"), cal.time_period().alias("p"),
                    cal.time_category().alias("c")).collect()
    assert all(r.g is not None and r.p is not None and r.c is not None for r in out)
    by = {r.hour: r for r in out}
    assert by[0].c == "심야" and by[6].c == "심야" and by[7].c == "출근" and by[23].c == "밤"
    assert by[3].g == "운행중단" and by[0].p == "late_night" and by[8].p == "morning_rush_peak"


def test_rush_presets(spark):
    df = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    for k, hours in cal.RUSH_HOURS.items():
        got = [r.hour for r in df.filter(cal.rush_flag("hour", k) == 1).collect()]
        assert got == sorted(hours)


def test_season_presets(spark):
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    rows = df.select("month", cal.season("month", "code_1_4").alias("a"), cal.season("month", "code_0_3").alias("b"),
                     cal.season("month", "label").alias("c"), cal.season("month", "detailed").alias("d")).collect()
    by = {r.month: r for r in rows}
    assert by[1].a == 4 and by[3].a == 1 and by[7].a == 2 and by[10].a == 3
    assert by[12].b == 0 and by[4].b == 1
    assert by[8].c == "여름" and by[8].d == "summer_peak" and by[11].d == "autumn_late"


def test_parse_and_weekday(spark):
    df = spark.createDataFrame([(2021010108,)], "tm long")
    r = cal.with_calendar(df).first()
    assert (r.year, r.month, r.day, r.hour) == (2021, 1, 1, 8)
    assert r.dayofweek == 4  # 2021-01-01 was a Friday, Monday = 0


def test_holiday_flag_day_before_on_after(spark):
    df = spark.createDataFrame([("2021-12-24",), ("2021-12-25",), ("2021-12-26",)], "d string").select(
        F.to_date("d").alias("date"))
    got = [r.h for r in df.select(cal.holiday_flag("date").alias("h")).collect()]
    assert got == [0, 1, 0]
    later = spark.createDataFrame([("2030-12-24",), ("2030-12-25",), ("2030-12-26",)], "d string").select(
        F.to_date("d").alias("date"))
    rec = later.select(cal.holiday_flag("date", recurring=True).alias("h"))
    assert [r.h for r in rec.collect()] == [0, 1, 0]
