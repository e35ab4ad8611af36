import numpy as np
import pytest
from pyspark.sql import functions as F

from hourpanel.operators import effects as eff
from hourpanel.operators import stats as st


def test_anova_equal_and_shifted_groups(spark):
    eq = [(g, float(v)) for g in "abc" for v in (1, 2, 3)]
    out = st.anova_oneway(spark.createDataFrame(eq, "g string, y double").withColumn("grp", F.lit(1)), ["grp"], "g", "y")
    assert abs(out.first().f_stat) < 1e-12
    sh = [(g, float(v + i * 3)) for i, g in enumerate("abc") for v in (1, 2, 3)]
    r = st.anova_oneway(spark.createDataFrame(sh, "g string, y double").withColumn("grp", F.lit(1)), ["grp"], "g", "y",
                        with_p=True).first()
    # SSB = 3*(9+0+9)=54 over 2 df, SSW = 3*2 = 6 over 6 df -> F = 27
    assert abs(r.f_stat - 27.0) < 1e-9 and r.df1 == 2 and r.df2 == 6 and abs(r.p_value - 0.001) < 1e-9  # F(2,6)=27 -> p = 10^-3 exactly


def test_perfect_and_undefined_correlation(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1, 5.0) for x in range(10)], "x double, y double, c double")
    m = {(r.var1, r.var2): r.r for r in st.corr_pairs(df, ["x", "y", "c"]).collect()}
    assert abs(m[("x", "y")] - 1.0) < 1e-12 and m[("x", "c")] is None


def test_p_values_known():
    assert abs(st.t_two_sided_p(2.0, 10) - 0.0733880) < 1e-6
    assert abs(st.t_two_sided_p(2.228138852, 10) - 0.05) < 1e-6
    assert abs(st.f_upper_p(4.964602744, 1, 10) - 0.05) < 1e-6
    assert abs(st.f_upper_p(3.0, 2, 20) - 1.3 ** -10) < 1e-12  # d1 = 2: p = (1 + d1 F / d2) ** (-d2 / 2)


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(500, 3))
    y = 1.5 + X @ np.array([0.5, -2.0, 3.0]) + rng.normal(scale=0.1, size=500)
    df = spark.createDataFrame([tuple(map(float, r)) + (float(v),) for r, v in zip(X, y)], "a double, b double, c double, y double")
    fit = st.ols(df, "y", ["a", "b", "c"])
    ref = np.linalg.lstsq(np.c_[np.ones(500), X], y, rcond=None)[0]
    assert np.allclose(fit["coef"], ref, atol=1e-8)


def test_hour_fixed_effects_equal_dummy_regression(spark):
    rng = np.random.default_rng(3)
    n = 600
    hour = rng.integers(0, 6, n)
    x1, x2 = rng.normal(size=n), rng.normal(size=n) + 0.3 * hour
    y = 2 + 0.7 * x1 - 1.2 * x2 + np.array([0, 3, -1, 2, 5, 1])[hour] + rng.normal(scale=0.2, size=n)
    df = spark.createDataFrame([(int(h), float(a), float(b), float(c)) for h, a, b, c in zip(hour, x1, x2, y)],
                               "hour int, x1 double, x2 double, y double")
    fe = eff.fit_hour_effects(df, "y", ["x1", "x2"], "hour")
    D = np.c_[np.ones(n), x1, x2] + 0
    D = np.c_[D, *[(hour == h).astype(float) for h in range(1, 6)]]
    b = np.linalg.lstsq(D, y, rcond=None)[0]
    assert abs(fe.beta["x1"] - b[1]) < 1e-9 and abs(fe.beta["x2"] - b[2]) < 1e-9
    te = {r.hour: r.time_effect for r in fe.hour_table.collect()}
    assert all(abs(te[h] - b[2 + h]) < 1e-9 for h in range(1, 6)) and abs(te[0]) < 1e-12
    pred = D @ b
    r2 = 1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert abs(fe.r2_full - r2) < 1e-9
    adj = fe.transform(df).toPandas()
    assert np.allclose(adj.y_time_adjusted, adj.y - adj.time_effect)


def test_normality_jb_on_normal_sample(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(size=5000)], "e double")
    r = st.normality_jb(df, "e").first()
    assert r.n == 5000 and r.p_value > 0.001


def test_normal_quantile_and_shapiro_francia(spark):
    from statistics import NormalDist

    ps = [1e-300, 1e-12, 1e-4, 0.02, 0.07, 0.075, 0.3, 0.5, 0.7, 0.93, 0.999, 1 - 1e-9]
    got = [r.q for r in spark.createDataFrame([(p,) for p in ps], "p double").select(st.normal_quantile("p").alias("q")).collect()]
    assert got[1:] == pytest.approx([NormalDist().inv_cdf(p) for p in ps[1:]], rel=1e-9, abs=1e-12) and got[0] == pytest.approx(-37.0471, abs=1e-3)
    rng = np.random.default_rng(2)
    for x in (rng.normal(3, 2, 400), rng.exponential(size=300), np.round(rng.normal(size=500), 1)):
        n = len(x)
        m = [NormalDist().inv_cdf((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
        w = np.corrcoef(np.sort(x), m)[0, 1] ** 2
        u = np.log(np.log(n))
        z = (np.log(1 - w) - (-1.2725 + 1.0521 * (u - np.log(n)))) / (1.0308 - 0.26758 * (u + 2 / np.log(n)))
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(5)
        row = st.normality_sf(df, "x").first()
        assert (row.n, row.w, row.z) == pytest.approx((n, w, z), rel=1e-9)
    few = st.normality_sf(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x").first()
    assert few.n == 2 and few.z is None
    assert st.normality_sf(spark.createDataFrame([], "x double"), "x").first().n == 0
