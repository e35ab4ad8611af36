from hourpanel.operators import joins as jn
from hourpanel.plans import ml


def test_weight_precedence(spark):
    rows = []
    for we in (0, 1):
        for mp in (0, 1):
            for ep in (0, 1):
                for y in (1.0, 10.0):
                    rows.append((we, mp, ep, y))
    df = spark.createDataFrame(rows, "is_weekend int, is_morning_peak int, is_evening_peak int, y double")
    out = {(r.is_weekend, r.is_morning_peak, r.is_evening_peak, r.y): r.weight
           for r in ml.sample_weights(df, "y", 5.0).collect()}
    assert out[(1, 0, 0, 1.0)] == 3.0              # weekend
    assert out[(1, 1, 0, 1.0)] == 2.0              # peak overrides weekend
    assert abs(out[(0, 0, 0, 10.0)] - 1.8) < 1e-12  # high
    assert abs(out[(1, 0, 0, 10.0)] - 3.0 * 1.8 * 2.0) < 1e-12
    assert abs(out[(1, 0, 1, 10.0)] - 2.0 * 1.8 * 2.0) < 1e-12


def test_common_station_sets(spark):
    a = spark.createDataFrame([("A",), ("B",), ("C",), ("B",)], "st string")
    b = spark.createDataFrame([("B",), ("C",), ("D",)], "st string")
    x, y = jn.keep_common(a, b, "st")
    assert sorted(r.st for r in x.collect()) == ["B", "B", "C"]
    assert sorted(r.st for r in y.collect()) == ["B", "C"]
