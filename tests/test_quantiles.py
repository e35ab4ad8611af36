import numpy as np
import pytest

from hourpanel.functions import bins as bn
from hourpanel.functions import clean as cl
from hourpanel.operators import aggregate as ag
from hourpanel.operators import plotdata as pdat
from hourpanel.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.05, 0.25, 0.5, 0.9, 0.95, 1.0]


def test_quantiles_equal_linear_percentiles(spark):
    """Several rounds (accuracy far below the rows), ties, one hot value, offsets, NaN, an empty column."""
    rng = np.random.default_rng(11)
    a = np.round(rng.normal(50, 15, 20000), 2)  # rounding creates ties
    b = np.where(rng.random(20000) < 0.4, 7.0, rng.normal(1e8, 1.0, 20000))  # one value holds two fifths
    df = spark.createDataFrame([(float(x), float(y), float("nan"), None) for x, y in zip(a, b)],
                               "a double, b double, c double, d double")
    got = exact_quantiles(df, {"a": PROBS, "b": PROBS, "c": [0.5], "d": [0.5]}, accuracy=100)
    assert np.allclose(got["a"], np.quantile(a, PROBS), atol=1e-9)
    assert np.allclose(got["b"], np.quantile(b, PROBS), rtol=1e-15)
    assert got["c"] == [None] and got["d"] == [None]


def test_quantiles_of_few_values(spark):
    df = spark.createDataFrame([(3,), (1,), (None,)], "x long")
    assert exact_quantiles(df, {"x": [0.0, 0.5, 1.0]})["x"] == [1.0, 2.0, 3.0]
    assert exact_quantiles(df.limit(0), {"x": [0.5]})["x"] == [None]


def test_operators_use_exact_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 102)], "x double")
    assert bn.quantile_edges(df, "x", 4) == [1.0, 26.0, 51.0, 76.0, 101.0]
    assert cl.iqr_fences(df, ["x"]) == {"x": (26.0 - 75.0, 76.0 + 75.0)}
    d = ag.describe(df, ["x"]).first()
    assert (d.q25, d.q50, d.q75, d["count"]) == (26.0, 51.0, 76.0, 101)
    assert {r.kind: r.x for r in pdat.box_stats(df, "x").collect()} == {"box_q1": 26.0, "box_median": 51.0, "box_q3": 76.0}


def test_grouped_quantiles_equal_plain_ones(spark):
    """A thousand groups and one that holds a third of the rows, with nulls, NaNs, ties and a null group."""
    import numpy as np
    from pyspark.sql import functions as F

    from hourpanel.operators.quantiles import grouped_quantiles

    r = np.random.default_rng(1)
    rows = [(None if g == 7 else int(g), None if x is None else float(x), float(k)) for g, x, k in zip(
        [*r.integers(0, 1000, 6000), *[5000] * 3000], [*r.normal(size=8900), *[None] * 50, *[float("nan")] * 50], r.integers(0, 4, 9000))]
    df = spark.createDataFrame(rows, "g long, x double, k double").repartition(7)
    got = {(q.g, q.variable): (q.n, q.quantiles) for q in grouped_quantiles(df, ["g"], ["x", "k"], [0.0, 0.1, 0.5, 1.0]).collect()}
    want = {}
    for g, x, k in rows:
        want.setdefault((g, "k"), []).append(k)
        if x is not None and x == x:
            want.setdefault((g, "x"), []).append(x)
    assert set(got) == set(want)
    for key, values in want.items():
        assert got[key][0] == len(values) and got[key][1] == pytest.approx(list(np.quantile(values, [0.0, 0.1, 0.5, 1.0])))
    one = grouped_quantiles(df, [], ["k"], [0.5]).collect()
    assert [(q.variable, q.n) for q in one] == [("k", 9000)]
    assert grouped_quantiles(df.where(F.lit(False)), ["g"], ["x"], [0.5]).count() == 0
