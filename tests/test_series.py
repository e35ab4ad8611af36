from collections import Counter

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from hourpanel.operators import series as se


def _lag_frame(spark):
    rows = []
    t0 = datetime(2024, 1, 1)
    rng = np.random.default_rng(7)
    for st in ("A", "B"):
        for d in ("up", "down"):
            for h in range(60):
                v = float(rng.normal(50, 10)) if rng.random() > 0.1 else None
                rows.append((st, d, t0 + timedelta(hours=h), v))
    return spark.createDataFrame(rows, "station string, direction string, ts timestamp_ntz, y double")


def test_sequence_index_equals_row_number(spark):
    df = _lag_frame(spark)
    a = se.sequence_index(df, ["station", "direction"], ["ts"], ranges=5)
    w = Window.partitionBy("station", "direction").orderBy("ts")
    b = df.withColumn("pos", F.row_number().over(w).cast("long") - 1)
    assert sorted(a.select("station", "direction", "ts", "pos").collect()) == \
        sorted(b.select("station", "direction", "ts", "pos").collect())


def test_lags_and_rolling_match_pandas_with_small_blocks(spark):
    df = se.sequence_index(_lag_frame(spark), ["station", "direction"], ["ts"], ranges=5)
    out = se.add_lags(df, ["station", "direction"], "pos", ["y"], [1, 2, 3, 24, 48], block_rows=50)
    out = se.add_rolling_means(out, ["station", "direction"], "pos", ["y"], [3, 6, 12, 24], block_rows=50)
    got = out.toPandas().sort_values(["station", "direction", "ts"]).reset_index(drop=True)
    ref = got[["station", "direction", "ts", "y"]].copy()
    g = ref.groupby(["station", "direction"])["y"]
    for k in (1, 2, 3, 24, 48):
        exp = g.shift(k)
        assert np.allclose(got[f"y_lag_{k}"].astype(float), exp.astype(float), equal_nan=True)
    for k in (3, 6, 12, 24):
        exp = g.transform(lambda s: s.rolling(k, min_periods=1).mean())
        assert np.allclose(got[f"y_ma_{k}"].astype(float), exp.astype(float), equal_nan=True)


def _short(spark):
    rows = [("A", 0, None), ("A", 1, 1.0), ("A", 2, None), ("A", 3, 3.0), ("A", 4, None),
            ("B", 0, 10.0), ("B", 1, None), ("B", 2, None), ("B", 3, 16.0), ("B", 4, None)]
    return spark.createDataFrame(rows, "st string, pos long, x double")


def test_fills_do_not_cross_series(spark):
    for block in (2, None):
        out = se.fill_ff_bf(_short(spark), ["st"], "pos", ["x"], median_fallback=False, block_rows=block)
        got = {(r.st, r.pos): r.x for r in out.collect()}
        assert got[("A", 0)] == 1.0 and got[("A", 2)] == 1.0 and got[("A", 4)] == 3.0
        assert got[("B", 1)] == 10.0 and got[("B", 4)] == 16.0


def test_interpolation_end_rules(spark):
    for block in (2, None):
        out = se.interpolate_linear(_short(spark), ["st"], "pos", ["x"], block_rows=block)
        got = {(r.st, r.pos): r.x_interpolated for r in out.collect()}
        assert got[("A", 0)] is None          # leading gap stays missing
        assert got[("A", 2)] == 2.0           # interior: straight line
        assert got[("A", 4)] == 3.0           # trailing gap repeats the last value
        assert got[("B", 1)] == 12.0 and got[("B", 2)] == 14.0


def _numpy_decompose(y, period=24):
    n = len(y)
    half = period // 2
    w = np.r_[0.5, np.ones(period - 1), 0.5] / period
    trend = np.full(n, np.nan)
    for i in range(half, n - half):
        trend[i] = np.dot(w, y[i - half:i + half + 1])
    front, back = half, n - 1 - half
    fl, bf = min(front + period, back), max(front, back - period)
    k, c = np.polyfit(np.arange(front, fl), trend[front:fl], 1)
    trend[:front] = k * np.arange(0, front) + c
    k, c = np.polyfit(np.arange(bf, back), trend[bf:back], 1)
    trend[back + 1:] = k * np.arange(back + 1, n) + c
    det = y - trend
    pm = np.array([det[i::period].mean() for i in range(period)])
    pm -= pm.mean()
    seas = np.tile(pm, n // period + 1)[:n]
    return trend, seas, y - trend - seas


def test_decomposition_matches_definition_and_threshold(spark):
    rows = []
    for st, n in (("short", 47), ("edge", 48), ("long", 240)):
        for i in range(n):
            rows.append((st, i, n, 0.05 * i + 5 * math.sin(2 * math.pi * i / 24) + (i % 7) * 0.3))
    df = spark.createDataFrame(rows, "st string, pos long, n long, y double")
    out = se.decompose_additive(df, ["st"], "pos", "n", "y", 24, block_rows=30).toPandas()
    short = out[out.st == "short"]
    assert short.trend.isna().all() and np.allclose(short.residual, short.y)
    for st in ("edge", "long"):
        d = out[out.st == st].sort_values("pos")
        t, s, r = _numpy_decompose(d.y.to_numpy())
        assert np.allclose(d.trend, t, atol=1e-9) and np.allclose(d.seasonal, s, atol=1e-9)
        assert np.allclose(d.trend + d.seasonal + d.residual, d.y, atol=1e-9)


def test_chrono_split_is_chronological(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "tm long, y double")
    out = se.chrono_split(df, "tm", 0.8)
    tr = out.filter(F.col("part") == "train").agg(F.max("tm")).first()[0]
    te = out.filter(F.col("part") == "test").agg(F.min("tm")).first()[0]
    assert tr < te and out.filter(F.col("part") == "train").count() == 80


def test_hot_series_block_path_equals_plain_window(spark):
    """One station holds ~90 % of the rows: the bounded-block path must give the
    same lags, rolling means and fills as one window over the whole series."""
    rng = np.random.default_rng(9)
    rows = []
    for st, n in (("HOT", 3000), ("a", 120), ("b", 150)):
        for i in range(n):
            rows.append((st, i, float(rng.normal()) if rng.random() > 0.2 else None))
    df = spark.createDataFrame(rows, "st string, t long, x double")
    idx = se.sequence_index(df, ["st"], ["t"], ranges=9)

    def run(block):
        out = se.add_lags(idx, ["st"], "pos", ["x"], [1, 24], block_rows=block)
        out = se.add_rolling_means(out, ["st"], "pos", ["x"], [3, 12], block_rows=block)
        out = se.fill_ff_bf(out, ["st"], "pos", ["x"], median_fallback=False, block_rows=block)
        return sorted(out.select("st", "t", "x", "x_lag_1", "x_lag_24", "x_ma_3", "x_ma_12").collect())

    a, b = run(64), run(None)
    assert len(a) == len(b) == 3270
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            assert (x is None and y is None) or (isinstance(x, str) and x == y) or abs(x - y) < 1e-9


def test_fused_lags_and_means_equal_separate_passes(spark):
    df = se.sequence_index(_lag_frame(spark), ["station", "direction"], ["ts"], ranges=5)
    fused = se.add_lags_and_means(df, ["station", "direction"], "pos", {"y": ([1, 24], [3, 12])}, block_rows=40)
    sep = se.add_rolling_means(se.add_lags(df, ["station", "direction"], "pos", ["y"], [1, 24], block_rows=40),
                               ["station", "direction"], "pos", ["y"], [3, 12], block_rows=40)
    cols = ["station", "direction", "ts", "y_lag_1", "y_lag_24", "y_ma_3", "y_ma_12"]
    assert sorted(fused.select(*cols).collect()) == sorted(sep.select(*cols).collect())


def test_positions_of_a_hot_series_are_spread(spark):
    """One station holds a third of the rows: no range (task) holds more than a small multiple of its share."""
    hot = spark.range(30000).selectExpr("'hot' as st", "cast((id * 7919) % 30000 as long) as t")
    rest = spark.range(60000).selectExpr("concat('s', id % 300) as st", "cast(id as long) as t")
    df = hot.unionByName(rest)
    by = [F.col("st"), F.col("t")]
    per_task = df.repartitionByRange(16, *by).groupBy(F.spark_partition_id().alias("p")).count()
    assert per_task.agg(F.max("count")).first()[0] < 3 * 90000 / 16
    out = se.sequence_index(df, ["st"], ["t"], length="n", ranges=16)
    got = out.where("st = 'hot'")
    assert got.where("pos <> t or n <> 30000").count() == 0 and got.count() == 30000
    assert out.where("st <> 'hot'").groupBy("st").agg(F.countDistinct("pos").alias("d"), F.max("pos").alias("m"), F.max("n").alias("n")).where(
        "d <> 200 or m <> 199 or n <> 200").count() == 0


def test_rows_without_a_key_are_a_series_of_their_own(spark):
    rows = [(k, t, None if t % 3 == 0 else float(t)) for k in ("a", None, "b") for t in range(10)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(3)
    d = se.sequence_index(df, ["k"], ["t"], length="n", ranges=4)
    assert d.columns == ["k", "t", "v", "n", "pos"]
    assert sorted((str(r.k), r.t, r.pos, r.n) for r in d.collect()) == sorted((str(k), t, t, 10) for k, t, _ in rows)
    filled = se.carry(d, ["k"], "pos", {"f": F.col("v")}, block_rows=4).collect()
    assert Counter(r.k for r in filled) == {"a": 10, None: 10, "b": 10}
    assert all(r.f == (None if r.t == 0 else float(r.t - (r.t % 3 == 0))) for r in filled)
    lagged = se.add_lags(d, ["k"], "pos", ["t"], [1], block_rows=4).collect()
    assert all(r.t_lag_1 == (r.t - 1 if r.t else None) for r in lagged) and len(lagged) == 30
    means = se.fill_lag_features(d.withColumn("y_lag_1", F.when(F.col("t") > 4, F.col("t").cast("double"))), ["k"], {}, ["y_lag_1"]).collect()
    assert len(means) == 30 and all(r.y_lag_1 == (r.t if r.t > 4 else 7.0) for r in means)
