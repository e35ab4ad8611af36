"""Weather feature expressions: extreme-weather flags, interactions, indices.

Data-dependent thresholds (quantiles) are fitted by one aggregate in
``extreme_thresholds``; applying them is a pure projection.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._util import col_of
from ..operators.quantiles import exact_quantiles
from . import calendar as cal

# ---------------------------------------------------------------------------
# Rain / wind limits of the extreme-weather flags.
LIGHT_RAIN_MAX = 2.0
HEAVY_RAIN = 10.0
EXTREME_RAIN = 30.0
CALM_WIND_MAX = 1.0
EXTREME_FLAGS = ["extreme_cold", "extreme_heat", "heavy_rain", "extreme_wind", "extreme_dry", "extreme_humid"]
# Composite weather index weights (ta, hm, ws, rn_day).
COMPOSITE_WEIGHTS = (0.4, 0.3, 0.2, 0.1)
EDA_RUSH_HOURS = [7, 8, 9, 17, 18, 19]
# ---------------------------------------------------------------------------

THRESHOLD_SPEC = {"ta_q05": ("ta", 0.05), "ta_q95": ("ta", 0.95), "ws_q90": ("ws", 0.90),
                  "ws_q95": ("ws", 0.95), "hm_q05": ("hm", 0.05), "hm_q95": ("hm", 0.95)}


def extreme_thresholds(df: DataFrame, exact: bool = True) -> dict[str, float]:
    """All six quantile thresholds (exact linear; ``exact=False`` takes a sketch alone)."""
    if exact:
        probs: dict[str, list[float]] = {}
        for c, p in THRESHOLD_SPEC.values():
            probs.setdefault(c, []).append(p)
        values = exact_quantiles(df, probs)
        return {k: values[c][probs[c].index(p)] for k, (c, p) in THRESHOLD_SPEC.items()}
    row = df.agg(*[F.percentile_approx(c, p, 100000).cast("double").alias(k)
                   for k, (c, p) in THRESHOLD_SPEC.items()]).first()
    return {k: row[k] for k in THRESHOLD_SPEC}


def _flag(cond: Column) -> Column:
    # missing compares false -> 0, as a cast boolean mask does
    return F.coalesce(cond.cast("int"), F.lit(0))


def extreme_flag_columns(th: Mapping[str, float]) -> dict[str, Column]:
    ta, rn, ws, hm = F.col("ta"), F.col("rn_hr1"), F.col("ws"), F.col("hm")
    lit = lambda k: F.lit(th[k]).cast("double")
    flags = {
        "extreme_cold": _flag(ta <= lit("ta_q05")),
        "extreme_heat": _flag(ta >= lit("ta_q95")),
        "moderate_temp": _flag((ta > lit("ta_q05")) & (ta < lit("ta_q95"))),
        "no_rain": _flag(rn == 0),
        "light_rain": _flag((rn > 0) & (rn <= LIGHT_RAIN_MAX)),
        "heavy_rain": _flag(rn > HEAVY_RAIN),
        "extreme_rain": _flag(rn > EXTREME_RAIN),
        "calm_wind": _flag(ws <= CALM_WIND_MAX),
        "strong_wind": _flag(ws >= lit("ws_q90")),
        "extreme_wind": _flag(ws >= lit("ws_q95")),
        "extreme_dry": _flag(hm <= lit("hm_q05")),
        "extreme_humid": _flag(hm >= lit("hm_q95")),
    }
    return flags


def with_extreme_flags(df: DataFrame, thresholds: Mapping[str, float] | None = None, exact: bool = True) -> DataFrame:
    th = thresholds if thresholds is not None else extreme_thresholds(df, exact)
    out = df.withColumns(extreme_flag_columns(th))
    return out.withColumn("extreme_weather_any", F.greatest(*[F.col(c) for c in EXTREME_FLAGS]))


def interaction_columns(hour: str = "hour", month: str = "month") -> dict[str, Column]:
    ta, hm, ws, rn = F.col("ta"), F.col("hm"), F.col("ws"), F.col("rn_hr1")
    return {
        "apparent_temp": ta * (1 + hm / 100),
        "temp_humidity_interaction": ta * hm,
        "wind_chill": ta - ws * 2,
        "temp_wind_interaction": ta * ws,
        "rain_wind_interaction": rn * ws,
        "rain_humidity_interaction": rn * hm,
        "temp_hour_interaction": ta * F.col(hour),
        "temp_season_interaction": ta * F.col(month),
    }


def extreme_rush(extreme_any: str = "extreme_weather_any", period: str = "time_period") -> Column:
    return col_of(extreme_any) * F.col(period).isin(cal.PEAK_PERIODS).cast("int")


def discomfort_index(ta: str = "ta", hm: str = "hm") -> Column:
    t, h = F.col(ta), F.col(hm)
    return 0.81 * t + 0.01 * h * (0.99 * t - 14.3) + 46.3


def feels_like(ta: str = "ta", ws: str = "ws") -> Column:
    return F.col(ta) - F.col(ws) * 0.5


def weather_composite(ta="ta", hm="hm", ws="ws", rn="rn_day") -> Column:
    a, b, c, d = COMPOSITE_WEIGHTS
    return F.col(ta) * a + F.col(hm) * b + F.col(ws) * c + F.col(rn) * d


def eda_cross_columns(hour: str = "hour", weekend: str = "is_weekend") -> dict[str, Column]:
    """Cross terms of the exploratory analysis.

    The weekend indicator is the calendar weekday (the source compared the
    wind-direction column by mistake; see README departures).
    """
    comp = weather_composite()
    rush = F.col(hour).isin(EDA_RUSH_HOURS).cast("int")
    return {
        "temp_hour_interaction": F.col("ta") * F.col(hour),
        "rain_weekend_effect": F.col("rn_day") * F.col(weekend),
        "weather_composite": comp,
        "rush_weather_interaction": rush * comp,
        "weekend_weather_interaction": F.col(weekend) * comp,
        "temp_humidity_product": F.col("ta") * F.col("hm"),
        "rain_wind_product": F.col("rn_day") * F.col("ws"),
    }


def is_rainy(rn: str = "rn_hr1") -> Column:
    return F.coalesce((F.col(rn) > 0).cast("int"), F.lit(0))


def combo_key(*parts: str | Column) -> Column:
    return F.concat_ws("_", *[col_of(p).cast("string") for p in parts])
