"""Codes, feature chain, bundles, validated boosting, calendar parts and year folders."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourpanel.functions import calendar as cal
from hourpanel.plans import ml
from hourpanel.plans.feature_chain import FeatureChain, FeatureChainModel
from hourpanel.sources import panel_io as pio


def test_codes_unseen_and_missing(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "st string")
    test = spark.createDataFrame([("c",), ("z",), (None,)], "st string")
    tr, te, codes = ml.label_encode(train, ["st"], test)
    assert {(r.st, r.st_encoded) for r in tr.collect()} == {("a", 0.0), ("b", 1.0), ("c", 2.0), (None, 3.0)}
    assert tr.count() == 5 and {(r.st, r.st_encoded) for r in te.collect()} == {("c", 2.0), ("z", 3.0), (None, 3.0)}
    assert codes["st"].count() == 3
    none, _, _ = ml.label_encode(train.limit(0), ["st"])
    assert none.count() == 0


def panel(spark, n=60, stations=("A", "B")):
    rnd = random.Random(5)
    rows = [(st, 2021010000 + 100 * (i // 24) + i % 24, *[None if rnd.random() < 0.1 else rnd.uniform(0, 30) for _ in range(5)],
             rnd.uniform(0, 100)) for st in stations for i in range(n)]
    rows = [(st, tm + 100, *rest) for st, tm, *rest in rows]  # days start at 1
    return spark.createDataFrame(rows, "station_name string, tm long, ta double, ws double, rn_hr1 double, hm double, si double, congestion double")


def test_chain_has_target_lags_and_is_the_same_when_loaded(spark, tmp_path):
    df = panel(spark)
    model = FeatureChain(exclude=["tm"], target="congestion").fit(df)
    model.save(spark, f"{tmp_path}/chain")
    again = FeatureChainModel.load(spark, f"{tmp_path}/chain")
    a = model.transform(df).orderBy("station_name", "tm").collect()
    assert a == again.transform(df).orderBy("station_name", "tm").collect()
    y = [r.congestion for r in a if r.station_name == "A"]
    for k in (1, 2, 3, 24, 48):
        got = [r[f"congestion_lag_{k}"] for r in a if r.station_name == "A"]
        assert got[k:] == y[:-k]
        assert got[:k] == pytest.approx([sum(y[:-k]) / len(y[:-k])] * k)  # the series' mean of the lag
    assert [r.congestion_ma_24 for r in a if r.station_name == "A"] == pytest.approx(
        [sum(y[max(0, i - 23):i + 1]) / len(y[max(0, i - 23):i + 1]) for i in range(len(y))])
    assert all(r.si_lag_24 is not None and r.ta is not None for r in a) and "congestion_lag_1" not in FeatureChain(
        exclude=["tm"]).fit(df).transform(df).columns


def test_bundle_round_trip(spark, tmp_path):
    df = panel(spark).fillna(0.0)
    feats = ["ta", "hm"]
    model = ml.fit_model(df, feats, "congestion", "forest", {"numTrees": 3})
    importance = spark.createDataFrame(ml.importances(model, feats), "feature string, importance double")
    chain = FeatureChain(exclude=["tm"]).fit(df)
    ml.save_bundle(ml.Bundle(model, feats, spark.range(1), importance, chain), f"{tmp_path}/b")
    got = ml.load_bundle(spark, [f"{tmp_path}/none", f"{tmp_path}/b"])
    assert got.features == feats and got.importance.count() == 2 and got.chain.medians == chain.medians
    want = {(r.station_name, r.tm): r.prediction for r in model.transform(df).collect()}
    assert {(r.station_name, r.tm): r.prediction for r in got.model.transform(df).collect()} == want
    ml.save_bundle(ml.Bundle(model, feats, spark.range(1)), f"{tmp_path}/plain")
    plain = ml.load_bundle(spark, [f"{tmp_path}/plain"])
    assert plain.importance is None and plain.chain is None


def test_missing_feature_is_an_error(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 2.0), (3.0, 3.0)], "x double, y double")
    with pytest.raises(Exception):
        ml.fit_model(df, ["x"], "y", "linear")


def test_validated_boosting_stops_early(spark):
    df = spark.range(400).select((F.col("id") % 7).cast("double").alias("x"), F.xxhash64("id").cast("double").alias("y"),
                                 (F.col("id") % 5 == 0).alias("held"))
    model = ml.fit_model(df, ["x"], "y", "boost", {"maxIter": 30, "maxDepth": 2}, valid="held")
    assert model.stages[-1].getNumTrees < 30


def test_time_folds_cover_all_rows(spark):
    df = spark.range(240).select((F.col("id") % 48).alias("tm"), (F.col("id") % 5).cast("double").alias("x"),
                                 (F.col("id") % 5 * 2).cast("double").alias("y"))
    folds = ml.ts_cv(df, ["x"], "y", "tm", "linear")
    assert [f["fold"] for f in folds] == [1, 2, 3] and sum(f["n"] for f in folds) == 180
    assert all(f["r2"] == pytest.approx(1.0, abs=1e-6) for f in folds)


def test_calendar_parts(spark):
    df = cal.with_calendar(spark.createDataFrame([(2021010323,), (2021130100,), (2021010124,), (20210101,), (None,), (1992022900,)], "tm long"))
    got = {r.tm: (r.year, r.month, r.day, r.hour, r.dayofweek) for r in df.collect()}
    assert got[2021010323] == (2021, 1, 3, 23, 6) and got[1992022900] == (1992, 2, 29, 0, 5)
    assert all(got[k] == (None,) * 5 for k in (2021130100, 2021010124, 20210101, None))


def test_year_folders_prune(spark, tmp_path):
    df = panel(spark).withColumn("tm", F.col("tm") + F.when(F.col("station_name") == "A", 1000000).otherwise(0))
    path = pio.write_panel(df, f"{tmp_path}/p")
    one = pio.open_panel(spark, path, [2022])
    assert one.count() == 60 and pio.open_panel(spark, path).count() == 120
    assert {f.rsplit("/", 2)[1] for f in one.inputFiles()} >= {"year=2022"}
    assert "PartitionFilters: [year" in one._jdf.queryExecution().toString().replace("isnotnull(year#", "year#")


def test_linear_folds_from_moments_equal_fits(spark):
    rnd = random.Random(8)
    rows = [(i % 90, rnd.gauss(1e6, 1), rnd.random(), float(i % 5)) for i in range(900)]
    df = spark.createDataFrame([(t, a, b, c, 3 * (a - 1e6) - b + c * 2 + rnd.gauss(0, 1)) for t, a, b, c in rows], "tm long, a double, b double, c double, y double").repartition(5)
    near = df.withColumn("a", F.col("a") - 1e6)  # Spark ML's own fit loses digits beside an offset
    got, same = ml.ts_cv_linear(df, ["a", "b", "c"], "y", "tm"), ml.ts_cv(near, ["a", "b", "c"], "y", "tm", "linear")
    assert [g["fold"] for g in got] == [1, 2, 3]
    data = np.array([(r.fold, 1, r.a, r.b, r.c, r.y) for r in ml.time_folds(near, "tm").collect()])
    for g, w in zip(got, same):
        tr, te = data[data[:, 0] < g["fold"]], data[data[:, 0] == g["fold"]]
        e = te[:, 5] - te[:, 1:5] @ np.linalg.lstsq(tr[:, 1:5], tr[:, 5], rcond=None)[0]
        want = [len(e), np.abs(e).mean(), np.sqrt((e * e).mean()), 1 - (e * e).sum() / ((te[:, 5] - te[:, 5].mean()) ** 2).sum()]
        assert [g[k] for k in ("n", "mae", "rmse", "r2")] == pytest.approx(want, rel=1e-8)
        assert [w[k] for k in ("n", "mae", "rmse", "r2")] == pytest.approx(want, rel=1e-8)
    assert ml.ts_cv_linear(df.limit(0), ["a"], "y", "tm") == []
    with pytest.raises(ValueError, match="missing"):
        ml.ts_cv_linear(df.withColumn("b", F.when(F.col("tm") > 3, F.col("b"))), ["a", "b"], "y", "tm")


def test_sparse_dummies_share_codes(spark):
    train = spark.createDataFrame([("b",)] * 5 + [("a",)] * 4 + [("rare",)] * 2 + [(None,)] * 6, "st string")
    test = spark.createDataFrame([("a",), ("b",), ("rare",), ("new",), (None,)], "st string")
    tr, te, codes = ml.sparse_dummies(train, "st", test, min_count=3)
    assert {(r.label, r.code) for r in codes.collect()} == {("a", 0.0), ("b", 1.0)} and tr.count() == 17
    got = {r.st: r.st_dummies for r in te.collect()}
    assert {k: (v.size, v.indices.tolist(), v.values.tolist()) for k, v in got.items()} == {
        "a": (3, [0], [1.0]), "b": (3, [1], [1.0]), "rare": (3, [2], [1.0]), "new": (3, [2], [1.0]), None: (3, [2], [1.0])}
    y = tr.withColumn("y", F.when(F.col("st") == "a", 5.0).otherwise(1.0))
    model = ml.fit_model(y, ["st_dummies"], "y", "linear")
    assert {r.st: round(r.prediction, 4) for r in model.transform(te).collect()}["a"] == 5.0


def test_half_written_bundles_are_never_seen(spark, tmp_path, monkeypatch):
    df = panel(spark).fillna(0.0)
    model = ml.fit_model(df, ["ta"], "congestion", "forest", {"numTrees": 2})
    path = f"{tmp_path}/b"

    def bundle(k):
        return ml.Bundle(model, ["ta"], spark.range(k, k + 1))
    assert ml.published(spark, path) is None
    first = ml.save_bundle(bundle(1), path)

    class Broken:
        def save(self, *_):
            raise OSError("lost")
    with pytest.raises(OSError):  # between the model and the metrics
        ml.save_bundle(ml.Bundle(model, ["ta"], spark.range(2, 3), chain=Broken()), path)
    assert ml.published(spark, path) == first and ml.load_bundle(spark, [path]).metrics.first().id == 1
    second = ml.save_bundle(bundle(3), path)
    assert ml.published(spark, path) == second > first and ml.load_bundle(spark, [path]).metrics.first().id == 3
    (tmp_path / "b/manifests" / second / "_SUCCESS").unlink()  # its manifest was cut off
    assert ml.load_bundle(spark, [path]).metrics.first().id == 1
    row = spark.read.json(f"{path}/manifests/{first}").first()
    assert row.version == first and sorted(row.parts) == ["features", "metrics", "model"]
