"""Binning: right-closed cuts, quantile cuts and the fixed weather labelers.

``cut`` builds a CASE chain from edges: bin i is ``(e[i], e[i+1]]``; values
outside the edges, at the lowest edge, or missing get NULL.  (Spark ML's
``Bucketizer`` is left-closed, so it is not used.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._util import col_of
from ..operators.quantiles import exact_quantiles

INF = float("inf")

# ---------------------------------------------------------------------------
# Fixed values (edges and labels of the analysed study's binnings).
TEMP_6_EDGES = [-40, -10, 0, 10, 20, 30, 40]
TEMP_6_LABELS = ["매우 추움", "추움", "선선함", "보통", "따뜻함", "더움"]
TEMP_3_EDGES = [-40, 0, 15, 40]
TEMP_3_LABELS = ["추움", "적정", "더움"]
TEMP_LEVEL_EDGES = [-INF, 10, 25, INF]
TEMP_LEVEL_LABELS = ["저온(~10℃)", "중온(10~25℃)", "고온(25℃~)"]
HUMIDITY_LEVEL_EDGES = [0, 40, 60, 100]
HUMIDITY_LEVEL_LABELS = ["저습(0~40%)", "중습(40~60%)", "고습(60%~)"]
COMFORT_EDGES = [0, 68, 75, 80, 100]
COMFORT_LABELS = ["쾌적", "보통", "불쾌", "매우불쾌"]
WIND_LEVEL_EDGES = [0, 2, 4, 10, INF]
WIND_LEVEL_LABELS = ["무풍", "약풍", "중풍", "강풍"]
TEMP_QCUT_LABELS = ["저온", "중온", "고온"]
FEELS_QCUT_LABELS = ["매우추움", "추움", "보통", "더움"]
# Rain intensity of the daily total: 0 / <=5 / <=20 / more.
RAIN_INTENSITY = ["무강수", "약한비", "보통비", "강한비"]
# If/elif labelers: (upper bound inclusive, label); last label catches the rest.
LABEL_TEMP = [(10, "저온"), (25, "중온"), (None, "고온")]
LABEL_HUMIDITY = [(40, "저습"), (60, "중습"), (None, "고습")]
LABEL_WIND = [(3, "약풍"), (7, "보통풍"), (None, "강풍")]
LABEL_SOLAR = [(10, "약함"), (20, "보통"), (25, "강함"), (None, "매우강함")]
LABEL_APPARENT = [(-10, "매우추움"), (0, "추움"), (15, "쌀쌀함"), (25, "쾌적함"), (32, "더움"),
                  (40, "무더움"), (None, "위험")]
# Rainfall labeler: exactly 0 first, then upper bounds.
LABEL_RAIN_ZERO = "비없음"
LABEL_RAIN = [(4, "약한비"), (9, "보통비"), (29, "강한비"), (None, "매우강한비")]
# Rain bands for band analysis.
RAIN_BANDS = ["비없음", "약한비(0-2mm)", "보통비(2-5mm)", "강한비(5mm초과)"]
# Quantile band names (formatted with the thresholds).
QBAND_NAMES = ["매우낮음", "낮음", "보통", "높음", "매우높음"]
# ---------------------------------------------------------------------------


def _lit_edge(e: float) -> Column:
    return F.lit(float(e))


def cut(x: str | Column, edges: Sequence[float], labels: Sequence | None = None,
        include_lowest: bool = False) -> Column:
    """Right-closed bins ``(e[i], e[i+1]]``; outside -> NULL.

    ``labels`` defaults to bin indices 0..n-1.  ``include_lowest`` closes the
    first bin on the left (quantile cuts).
    """
    c = col_of(x)
    labels = list(range(len(edges) - 1)) if labels is None else list(labels)
    if len(labels) != len(edges) - 1:
        raise ValueError("need len(edges)-1 labels")
    expr = None
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        lower = c >= _lit_edge(lo) if (i == 0 and include_lowest) else c > _lit_edge(lo)
        cond = lower & (c <= _lit_edge(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def labeler(x: str | Column, bands: Sequence[tuple[float | None, str]], null_to_last: bool = False,
            zero_label: str | None = None) -> Column:
    """If/elif labeler ``x <= bound -> label``; the last band catches the rest.

    A missing value gets NULL unless ``null_to_last`` (then the last label, as
    an if/elif chain on a missing value does).
    """
    c = col_of(x)
    expr = F.when(c == 0, F.lit(zero_label)) if zero_label is not None else None
    for bound, lab in bands:
        if bound is None:
            last = F.lit(lab)
            expr = expr.when(c.isNotNull(), last) if expr is not None else F.when(c.isNotNull(), last)
            if null_to_last:
                expr = expr.otherwise(last)
            return expr
        cond = c <= F.lit(float(bound))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def weather_labels(df: DataFrame, null_to_last: bool = False) -> DataFrame:
    """Six labelers: temperature, humidity, rainfall, wind, solar, apparent temperature."""
    return df.withColumns({
        "temp_category": labeler("ta", LABEL_TEMP, null_to_last),
        "humidity_category": labeler("hm", LABEL_HUMIDITY, null_to_last),
        "rainfall_category": labeler("rn_hr1", LABEL_RAIN, null_to_last, zero_label=LABEL_RAIN_ZERO),
        "wind_category": labeler("ws", LABEL_WIND, null_to_last),
        "solar_category": labeler("si", LABEL_SOLAR, null_to_last),
        "apparent_temp_category": labeler("ta_chi", LABEL_APPARENT, null_to_last),
    })


def rain_intensity(x: str | Column = "rn_day") -> Column:
    """0 / (0,5] / (5,20] / more; missing stays missing."""
    c = col_of(x)
    return (F.when(c == 0, RAIN_INTENSITY[0]).when(c <= 5, RAIN_INTENSITY[1])
            .when(c <= 20, RAIN_INTENSITY[2]).when(c.isNotNull(), RAIN_INTENSITY[3]))


def rain_band(x: str | Column = "rn_hr1") -> Column:
    c = col_of(x)
    return (F.when(c == 0, RAIN_BANDS[0]).when(c <= 2, RAIN_BANDS[1])
            .when(c <= 5, RAIN_BANDS[2]).when(c > 5, RAIN_BANDS[3]))


def quantile_edges(df: DataFrame, x: str, q: int, exact: bool = True, accuracy: int = 100000) -> list[float]:
    """Equal-frequency edges (linear quantiles); ``exact=False`` takes a sketch alone."""
    probs = [i / q for i in range(q + 1)]
    if exact:
        return exact_quantiles(df, {x: probs})[x]
    agg = F.percentile_approx(F.col(x), F.array(*[F.lit(p) for p in probs]), accuracy)
    return [float(v) for v in df.select(agg.alias("e")).first()["e"]]


def qcut(df: DataFrame, x: str, q: int, labels: Sequence | None = None, out: str | None = None,
         exact: bool = True) -> DataFrame:
    """Equal-frequency cut at the quantile edges, lowest included."""
    edges = quantile_edges(df, x, q, exact)
    return df.withColumn(out or f"{x}_qcut", cut(x, edges, labels, include_lowest=True))


def quantile_band_masks(x: str | Column, q05: Column, q25: Column, q75: Column, q95: Column) -> Column:
    """Non-exclusive band membership as an array of band indexes.

    Bands: <=q05, (q05,q25], (q25,q75], (q75,q95], >=q95 (the last overlaps
    at q95, as in the source).  Explode the array to count a row in each band.
    """
    c = col_of(x)
    conds = [c <= q05, (c > q05) & (c <= q25), (c > q25) & (c <= q75), (c > q75) & (c <= q95), c >= q95]
    return F.filter(F.array(*[F.when(cd, F.lit(i)) for i, cd in enumerate(conds)]), lambda v: v.isNotNull())


def rare_collapse(df: DataFrame, col: str, min_count: int = 100, other: str = "Other",
                  out: str | None = None) -> DataFrame:
    """Keep categories with more than ``min_count`` rows, else ``other``.

    Counting is a partial/final aggregate; the surviving category list is
    joined back (adaptive execution broadcasts it when small).
    """
    keep = (df.groupBy(col).count().filter(F.col("count") > min_count)
            .select(F.col(col).alias("__keep"), F.lit(True).alias("__ok")))
    joined = df.join(keep, df[col].eqNullSafe(keep["__keep"]), "left")
    return joined.withColumn(out or col, F.when(F.col("__ok"), F.col(col)).otherwise(F.lit(other))).drop(
        "__keep", "__ok")
