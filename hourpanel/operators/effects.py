"""Hour-of-day fixed effects: separate the time effect from the weather effect.

The dummy regression ``y = b0 + X b + sum_h g_h D_h`` (first hour = base) is
solved by within-hour demeaning (Frisch-Waugh-Lovell): the slopes ``b`` of
the demeaned regression equal the dummy model's, and the hour intercepts are
``a_h = mean_h(y) - mean_h(X) b``; the time effect of a row is
``a_hour - a_base`` and the adjusted target is ``y - time effect``.

Data-sized work: one grouped aggregate (hour means, bounded by the number of
hours, which is checked), one broadcast join of that table, one Gram aggregate of the
demeaned columns.  No dummy columns are materialised.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats as st


#: Levels of the fixed effect, at most: their table is broadcast and solved on the driver.
MAX_LEVELS = 10_000


class HourEffects:
    """Result of :func:`fit_hour_effects` (small: coefficients and a per-hour table)."""

    def __init__(self, beta, hour_table: DataFrame, r2_weather, r2_time, r2_full, n, xs, fe, y):
        self.beta, self.hour_table = beta, hour_table
        self.r2_weather, self.r2_time, self.r2_full, self.n = r2_weather, r2_time, r2_full, n
        self.xs, self.fe, self.y = list(xs), fe, y

    @property
    def time_share(self) -> float:
        return self.r2_time / self.r2_full * 100 if self.r2_full else 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        """Add time_effect, climate_effect, adjusted target and climate prediction."""
        climate = st.predict_linear(self.xs, [self.beta[x] for x in self.xs])
        ht = F.broadcast(self.hour_table.select(self.fe, "time_effect", "base_intercept"))
        out = df.join(ht, self.fe, "left")
        return out.withColumns({
            "climate_effect": climate,
            f"{self.y}_time_adjusted": F.col(self.y) - F.col("time_effect"),
            "climate_prediction": climate + F.col("base_intercept"),
        }).drop("base_intercept")


def fit_hour_effects(df: DataFrame, y: str, xs: Sequence[str], fe: str = "hour") -> HourEffects:
    d = df.select(y, *xs, fe).dropna()
    means = d.groupBy(fe).agg(F.count(F.lit(1)).alias("__n"), F.avg(y).alias("__my"),
                              *[F.avg(x).alias(f"__mx_{x}") for x in xs])
    means = means.cache()
    if means.count() > MAX_LEVELS:
        means.unpersist()
        raise ValueError(f"{fe} has more than {MAX_LEVELS} levels")
    dm = d.join(F.broadcast(means), fe).select(
        (F.col(y) - F.col("__my")).alias(y), *[(F.col(x) - F.col(f"__mx_{x}")).alias(x) for x in xs])
    cols, xtx, xty, yy, _, n = st.gram(dm, y, xs, intercept=False)
    try:
        b = np.linalg.solve(xtx, xty)
    except np.linalg.LinAlgError:
        b = np.linalg.pinv(xtx) @ xty
    sse_full = yy - 2 * b @ xty + b @ xtx @ b
    m = means.toPandas()  # one row per hour level (bounded)
    ybar = float((m["__n"] * m["__my"]).sum() / m["__n"].sum())
    ssb = float((m["__n"] * (m["__my"] - ybar) ** 2).sum())
    sst = yy + ssb
    beta = {x: float(v) for x, v in zip(xs, b)}
    m["alpha"] = m["__my"] - sum(beta[x] * m[f"__mx_{x}"] for x in xs)
    base_alpha = float(m.loc[m[fe] == m[fe].min(), "alpha"].iloc[0])
    m["time_effect"] = m["alpha"] - base_alpha
    m["base_intercept"] = base_alpha
    # the hour table is as small as the hour domain: build it from the collected means
    table = df.sparkSession.createDataFrame(
        [(int(h), float(a), float(t), float(bi), int(c)) for h, a, t, bi, c in
         zip(m[fe], m["alpha"], m["time_effect"], m["base_intercept"], m["__n"])],
        f"{fe} int, alpha double, time_effect double, base_intercept double, n long")
    r2_weather = st.ols(d, y, xs)["r2"]
    means.unpersist()
    return HourEffects(beta, table, float(r2_weather), float(ssb / sst) if sst else 0.0,
                       float(1 - sse_full / sst) if sst else 0.0, int(n), xs, fe, y)
