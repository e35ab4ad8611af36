"""Statistics as aggregates: correlations, one-way ANOVA, one-sample t,
normality, least squares on a Gram matrix.

The data-sized work is always one (grouped) aggregate; what reaches the
driver is a handful of sums per group.  p-values are computed on the small
result frame with an Arrow-batched pandas UDF (regularized incomplete beta),
since neither Spark SQL nor the test engine has a t or F distribution.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .._util import col_of, nan_to_null
from .series import sequence_index

# ---------------------------------------------------------------------------
# Correlation strength cut-points and labels (three presets).
STRENGTH_PRESETS = {
    "five": [(0.2, "매우 약함 (무시 가능)"), (0.4, "약한 상관"), (0.6, "중간 정도의 상관"), (0.8, "강한 상관"),
             (None, "매우 강한 상관")],
    "three": [(0.3, "약함"), (0.5, "중간"), (None, "강함")],
    "effect": [(0.1, "weak"), (0.3, "moderate"), (None, "strong")],
}
NOTABLE_R = 0.4
MIN_N_TTEST = 30
# Effect-size labels of a mean difference (|d| thresholds).
EFFECT_SIZE_LABELS = [(2.0, "큰 효과"), (1.0, "중간 효과"), (0.5, "작은 효과")]
# Coefficient size labels (|b| thresholds).
COEF_SIZE_LABELS = [(1.0, "큰"), (0.5, "중간")]
COEF_SIZE_DEFAULT = "작은"
# ---------------------------------------------------------------------------


# --------------------------------------------------------------------------- distributions
def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta (modified Lentz)."""
    tiny, eps = 1e-300, 1e-15
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, df: float) -> float:
    if t is None or df is None or df <= 0 or (isinstance(t, float) and math.isnan(t)):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc_reg(df / 2.0, 0.5, df / (df + t * t))


def f_upper_p(f: float, d1: float, d2: float) -> float:
    if f is None or d1 is None or d2 is None or d1 <= 0 or d2 <= 0 or math.isnan(f):
        return float("nan")
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return betainc_reg(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(float(a), float(b)) if pd.notna(a) and pd.notna(b) else np.nan
                      for a, b in zip(t, df)])


@F.pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_upper_p(float(a), float(b), float(c)) if pd.notna(a) and pd.notna(b) and pd.notna(c)
                      else np.nan for a, b, c in zip(f, d1, d2)])


def stars(p: str | Column) -> Column:
    pc = col_of(p)
    return F.when(pc < 0.001, "***").when(pc < 0.01, "**").when(pc < 0.05, "*").when(pc.isNotNull(), "")


# --------------------------------------------------------------------------- correlation
def strength_label(r: str | Column, preset: str = "five") -> Column:
    a = F.abs(col_of(r))
    expr = None
    for bound, lab in STRENGTH_PRESETS[preset]:
        if bound is None:
            return expr.when(a.isNotNull(), F.lit(lab))
        cond = a < F.lit(bound)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def unpivot(df: DataFrame, ids: Sequence[str | Column], cols: Sequence[str], var: str = "variable",
            val: str = "value") -> DataFrame:
    parts = [F.struct(F.lit(c).alias(var), F.col(c).cast("double").alias(val)) for c in cols]
    return df.select(*ids, F.inline(F.array(*parts)))


def corr_pairs(df: DataFrame, cols: Sequence[str], upper_only: bool = False) -> DataFrame:
    """Pairwise Pearson r on pairwise-complete rows, long format (var1, var2, r, n).

    All pairs are one aggregate; a constant column gives NULL, not an error.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for j, b in enumerate(cols) if (i < j if upper_only else True)]
    aggs = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias(f"r__{a}__{b}"),
                 F.count_if(both).cast("long").alias(f"n__{a}__{b}")]
    wide = df.agg(*aggs)
    parts = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                      (F.lit(1.0) if a == b else F.col(f"r__{a}__{b}")).alias("r"),
                      F.col(f"n__{a}__{b}").alias("n")) for a, b in pairs]
    return wide.select(F.inline(F.array(*parts)))


def corr_grouped(df: DataFrame, group: Sequence[str], y: str, xs: Sequence[str], min_n: int = 0) -> DataFrame:
    """r(x, y) per group x variable: unpivot the variables, one grouped aggregate."""
    long = unpivot(df, [*group, F.col(y).alias("__y")], xs)
    both = F.col("value").isNotNull() & F.col("__y").isNotNull()
    out = long.groupBy(*group, "variable").agg(
        F.corr(F.when(both, F.col("value")), F.when(both, F.col("__y"))).alias("r"),
        F.count_if(both).cast("long").alias("n"))
    return out.filter(F.col("n") > min_n) if min_n else out


def corr_t(r: str | Column = "r", n: str | Column = "n") -> Column:
    rc, nc = col_of(r), col_of(n)
    return rc * F.sqrt((nc - 2) / (1 - rc * rc))


def corr_test_columns(df: DataFrame, with_p: bool = False) -> DataFrame:
    """Add t, df, strength label, notable flag (and p-value / stars)."""
    out = df.withColumns({"t": corr_t(), "df": (F.col("n") - 2).cast("long"),
                          "strength": strength_label("r"), "notable": (F.abs("r") >= NOTABLE_R).cast("int")})
    if with_p:
        out = out.withColumn("p_value", t_pvalue(F.col("t"), F.col("df").cast("double")))
        out = out.withColumn("stars", stars("p_value"))
    return out


# --------------------------------------------------------------------------- normal scores
# ---------------------------------------------------------------------------
# Coefficients of the inverse normal (algorithm AS 241, PPND16) and of the Shapiro-Francia test's z.
PPND_CENTRE = ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
                4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
               (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4,
                3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
PPND_NEAR = ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
              1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
             (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1,
              1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
PPND_FAR = ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
             2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
            (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4,
             1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))
SF_MEAN, SF_SD = (-1.2725, 1.0521), (1.0308, -0.26758)
# ---------------------------------------------------------------------------


def normal_quantile(p: str | Column) -> Column:
    """The inverse of the normal distribution function, to some 16 digits, as a column expression."""
    p = col_of(p)

    def ratio(x, top, bottom):
        def horner(cs):
            out = F.lit(cs[-1])
            for c in cs[-2::-1]:
                out = out * x + F.lit(c)
            return out
        return horner(top) / horner(bottom)

    q = p - 0.5
    tail = F.sqrt(-F.ln(F.least(p, 1 - p)))
    outer = F.when(tail <= 5.0, ratio(tail - 1.6, *PPND_NEAR)).otherwise(ratio(tail - 5.0, *PPND_FAR))
    return F.when(F.abs(q) <= 0.425, q * ratio(0.180625 - q * q, *PPND_CENTRE)).otherwise(F.signum(q) * outer)


def normality_sf(df: DataFrame, col: str) -> DataFrame:
    """Shapiro-Francia test on all rows: n, W' (squared correlation of the order statistics with normal scores), z.

    Ranks come from sorted ranges, so no task sorts the column; ties may take their ranks in any order, since equal
    values add the same to W' whichever score each has.  Under normality z is about standard normal; the
    approximation was made for 5 to 5,000 rows and is carried on beyond.  NULL and NaN are left out; below
    five rows or for a constant column W' or z is NULL.
    """
    values = df.select(nan_to_null(F.col(col).cast("double")).alias("x")).where(F.col("x").isNotNull()).withColumn("all", F.lit(0))
    ranked = sequence_index(values, ["all"], ["x"], pos="place", length="n")
    score = normal_quantile((F.col("place") + 1 - 0.375) / (F.col("n") + 0.25))
    w = ranked.select("x", score.alias("m")).agg(F.count("x").alias("n"), F.pow(F.corr("x", "m"), F.lit(2.0)).alias("w"))
    u = F.ln(F.ln("n"))
    mean = SF_MEAN[0] + SF_MEAN[1] * (u - F.ln("n"))
    sd = SF_SD[0] + SF_SD[1] * (u + 2 / F.ln("n"))
    return w.withColumn("z", F.when((F.col("n") >= 5) & (F.col("w") < 1), (F.ln(1 - F.col("w")) - mean) / sd))


# --------------------------------------------------------------------------- ANOVA / t
def anova_oneway(df: DataFrame, by: Sequence[str], label: str, y: str, with_p: bool = False) -> DataFrame:
    """One-way F of ``y`` across ``label`` values, per ``by`` group (>= 2 labels).

    Cell statistics (n, mean, var) are one grouped aggregate; SSB/SSW come
    from the small cell table.
    """
    cells = (df.filter(F.col(label).isNotNull() & F.col(y).isNotNull())
             .groupBy(*by, label).agg(F.count(y).alias("n"), F.avg(y).alias("m"),
                                      F.coalesce(F.var_samp(y), F.lit(0.0)).alias("v")))
    w = Window.partitionBy(*by)
    cells = cells.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    out = cells.groupBy(*by).agg(
        F.count(F.lit(1)).cast("long").alias("k"), F.sum("n").cast("long").alias("n"),
        F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("ssb"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"))
    out = out.filter(F.col("k") >= 2).withColumns({
        "df1": F.col("k") - 1, "df2": F.col("n") - F.col("k")})
    out = out.withColumn("f_stat", (F.col("ssb") / F.col("df1")) / (F.col("ssw") / F.col("df2")))
    if with_p:
        out = out.withColumn("p_value", f_pvalue(F.col("f_stat"), F.col("df1").cast("double"),
                                                 F.col("df2").cast("double")))
    return out


def ttest_1samp(df: DataFrame, group: str | Column, y: str, mu: float | Column, min_n: int = MIN_N_TTEST,
                with_p: bool = False) -> DataFrame:
    """Per group: mean - mu, std, n, t = (mean - mu) / (std / sqrt(n)); groups with n >= min_n."""
    g = df.groupBy(group).agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"),
                             F.count(y).cast("long").alias("n"))
    g = g.filter(F.col("n") >= min_n).withColumn("effect", F.col("mean") - mu)
    g = g.withColumn("t", F.col("effect") / (F.col("std") / F.sqrt("n")))
    a = F.abs(F.col("effect"))
    lab = None
    for bound, name in EFFECT_SIZE_LABELS:
        lab = F.when(a >= bound, name) if lab is None else lab.when(a >= bound, name)
    g = g.withColumn("size_label", lab.otherwise(""))
    if with_p:
        g = g.withColumn("p_value", t_pvalue(F.col("t"), (F.col("n") - 1).cast("double")))
        g = g.withColumn("stars", stars("p_value"))
    return g


def normality_jb(df: DataFrame, col: str) -> DataFrame:
    """Jarque-Bera from population skewness and excess kurtosis (all rows,
    no sample cap); p = exp(-JB/2) is the chi-square(2) tail in closed form."""
    out = df.agg(F.count(col).cast("long").alias("n"), F.skewness(col).alias("skewness"),
                 F.kurtosis(col).alias("excess_kurtosis"))
    out = out.withColumn("jb", F.col("n") / 6.0 * (F.col("skewness") ** 2 + F.col("excess_kurtosis") ** 2 / 4.0))
    return out.withColumn("p_value", F.exp(-F.col("jb") / 2.0))


# --------------------------------------------------------------------------- least squares
def gram(df: DataFrame, y: str, xs: Sequence[str], intercept: bool = True, weight: str | None = None):
    """X'X, X'y, y'y, n from one aggregate over complete rows (p x p sums)."""
    cols = (["__one"] if intercept else []) + list(xs)
    d = df.dropna(subset=[*xs, y])
    if intercept:
        d = d.withColumn("__one", F.lit(1.0))
    w = F.col(weight) if weight else F.lit(1.0)
    aggs = [F.sum(w * F.col(a) * F.col(b)).alias(f"xx_{i}_{j}") for i, a in enumerate(cols)
            for j, b in enumerate(cols) if j >= i]
    aggs += [F.sum(w * F.col(a) * F.col(y)).alias(f"xy_{i}") for i, a in enumerate(cols)]
    aggs += [F.sum(w * F.col(y) * F.col(y)).alias("yy"), F.sum(w * F.col(y)).alias("sy"), F.sum(w).alias("n")]
    row = d.agg(*aggs).first()
    p = len(cols)
    xtx = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            xtx[i, j] = xtx[j, i] = row[f"xx_{i}_{j}"] or 0.0
    xty = np.array([row[f"xy_{i}"] or 0.0 for i in range(p)])
    return cols, xtx, xty, float(row["yy"] or 0.0), float(row["sy"] or 0.0), float(row["n"] or 0.0)


def ols(df: DataFrame, y: str, xs: Sequence[str], intercept: bool = True) -> dict:
    """Normal-equation least squares; pseudo-inverse when X'X is singular.

    Returns coefficients (intercept first when fitted) and R^2 from the
    same sums (SSE = y'y - 2 b'X'y + b'X'Xb).  With an intercept the sums are
    taken about the means, found in a first aggregate, so that large offsets
    don't cancel; the intercept follows from the means.
    """
    d = df.dropna(subset=[*xs, y])
    means = None
    if intercept:
        row = d.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate([*xs, y])]).first()
        means = [row[f"m{i}"] or 0.0 for i in range(len(xs) + 1)]
        d = d.select(*[(F.col(c) - F.lit(m)).alias(c) for c, m in zip([*xs, y], means)])
    cols, xtx, xty, yy, sy, n = gram(d, y, xs, intercept=False)
    try:
        beta = np.linalg.solve(xtx, xty)
    except np.linalg.LinAlgError:
        beta = np.linalg.pinv(xtx) @ xty
    sse = yy - 2 * beta @ xty + beta @ xtx @ beta
    sst = yy if intercept else yy - sy * sy / n if n else float("nan")
    if intercept:
        beta = np.concatenate([[means[-1] - float(np.dot(beta, means[:-1]))], beta])
    names = (["intercept"] if intercept else []) + list(xs)
    return {"names": names, "coef": [float(b) for b in beta], "r2": float(1 - sse / sst) if sst else float("nan"),
            "n": int(n)}


def predict_linear(names: Sequence[str], coef: Sequence[float]) -> Column:
    expr = F.lit(0.0)
    for nme, b in zip(names, coef):
        expr = expr + (F.lit(float(b)) if nme == "intercept" else F.col(nme) * F.lit(float(b)))
    return expr


def coef_size_label(b: str | Column) -> Column:
    a = F.abs(col_of(b))
    expr = None
    for bound, lab in COEF_SIZE_LABELS:
        expr = F.when(a > bound, lab) if expr is None else expr.when(a > bound, lab)
    return expr.otherwise(COEF_SIZE_DEFAULT)


def coef_frame(spark, fit: Mapping) -> DataFrame:
    return spark.createDataFrame([(n, float(c)) for n, c in zip(fit["names"], fit["coef"])], "term string, coef double")
