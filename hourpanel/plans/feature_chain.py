"""The whole feature pipeline as an estimator: fit on train, apply anywhere.

Order of steps (as in the study): coded missing values and range gates ->
extreme-weather flags (quantile thresholds) -> detailed time features ->
interactions -> weather lag 24 and rolling means per series, and with
``target`` its lags and rolling means (a mean counts its own row, as in the
study: leave those out of a model of the same row) -> forward / backward fill
per series then median -> lag/MA gaps from the current value, target ones from
the series' mean -> categorical mode -> flags 0 -> interaction medians -> numeric medians.

``fit`` computes every data-dependent constant (6 quantiles, modes, medians)
with a handful of aggregates over the training frame; ``transform`` is
projections plus the skew-safe series operators.  Fitted constants are
applied to the test frame (``refit=True`` recomputes them on each frame, as
the study did).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._util import numeric_columns
from ..functions import calendar as cal
from ..functions import clean as cl
from ..functions import features as ft
from ..operators import impute as im
from ..operators import series as se
from ..session import store

WEATHER = ["ta", "ws", "rn_hr1", "hm"]
# Weather columns with a lag, lags and rolling means.
LAGGED = ["ta", "ws", "rn_hr1", "hm", "si"]
WEATHER_LAGS, WEATHER_WINDOWS = [24], [3, 6, 12]
TARGET_LAGS, TARGET_WINDOWS = [1, 2, 3, 24, 48], [3, 6, 12, 24]
CATEGORICAL = ["time_period", "detailed_season", "day_type"]


class FeatureChainModel:
    def __init__(self, chain: "FeatureChain", thresholds: dict, modes: dict, medians: dict):
        self.chain, self.thresholds, self.modes, self.medians = chain, thresholds, modes, medians

    def transform(self, df: DataFrame) -> DataFrame:
        c = self.chain
        rows = store(c.windows(df), "chain-rows")
        # the fills move narrow rows; the features, made of the weather as it was, follow them
        out = rows.withColumns({f"__raw_{x}": F.col(x) for x in WEATHER})
        # series fills: forward then backward inside the series, then the fitted median
        out = se.fill_ff_bf(out, c.series_keys, "pos", WEATHER, median_fallback=False, block_rows=c.block_rows)
        out = out.fillna({k: v for k, v in self.medians.items() if k in WEATHER})
        base = {x: x.split("_lag_")[0].split("_ma_")[0] for x in out.columns if "_lag_" in x or "_ma_" in x}
        out = se.fill_lag_features(out, c.series_keys, {x: v for x, v in base.items() if v != c.target},
                                   [x for x, v in base.items() if v == c.target])
        out = out.withColumnsRenamed({x: f"__filled_{x}" for x in WEATHER}).withColumnsRenamed({f"__raw_{x}": x for x in WEATHER})
        out = c.derive(out, self.thresholds)
        out = out.withColumns({x: F.col(f"__filled_{x}") for x in WEATHER}).drop(*[f"__filled_{x}" for x in WEATHER])
        out = out.fillna(self.modes)
        out = im.impute_zero_flags(out)
        inter = im.interaction_columns(out)
        out = out.fillna({k: v for k, v in self.medians.items() if k in inter})
        rest = {k: v for k, v in self.medians.items() if k not in WEATHER and k not in inter}
        return out.fillna(rest).drop("pos")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the settings and fitted constants as one line of JSON."""
        state = {"chain": self.chain.settings(), "thresholds": self.thresholds, "modes": self.modes, "medians": self.medians}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeatureChainModel":
        state = json.loads(spark.read.text(path).first()["value"])
        return cls(FeatureChain(**state["chain"]), state["thresholds"], state["modes"], state["medians"])


class FeatureChain:
    def __init__(self, series_keys: Sequence[str] = ("station_name",), order: Sequence[str] = ("tm",),
                 exact: bool = True, block_rows: int | None = se.DEFAULT_BLOCK_ROWS,
                 refit: bool = False, exclude: Sequence[str] = (), target: str | None = None):
        self.series_keys, self.order = list(series_keys), list(order)
        self.exact, self.block_rows, self.refit = exact, block_rows, refit
        self.exclude, self.target = set(exclude), target

    def settings(self) -> dict:
        return {"series_keys": self.series_keys, "order": self.order, "exact": self.exact, "block_rows": self.block_rows,
                "refit": self.refit, "exclude": sorted(self.exclude), "target": self.target}

    def windows(self, df: DataFrame) -> DataFrame:
        """Cleaned rows with their position, lags and rolling means: all that moves rows."""
        d = se.sequence_index(cl.clean_weather(df), self.series_keys, self.order)
        return se.add_lags_and_means(d, self.series_keys, "pos", self.steps(d.columns), block_rows=self.block_rows)

    def derive(self, d: DataFrame, thresholds: dict) -> DataFrame:
        """The features that follow from a row alone."""
        d = ft.with_extreme_flags(d, thresholds)
        if "hour" not in d.columns:
            d = cal.with_calendar(d)
        d = d.withColumns({"week_of_year": cal.iso_week("datetime"), "time_period": cal.time_period("hour"),
                           "detailed_season": cal.season("month", "detailed"), "day_type": cal.day_type("dayofweek"),
                           **cal.dow_flags("dayofweek")})
        d = cal.cyclic_features(d, week="week_of_year")
        d = d.withColumns(ft.interaction_columns())
        return d.withColumn("extreme_weather_rush", ft.extreme_rush())

    def steps(self, columns: Sequence[str]) -> dict[str, tuple[list[int], list[int]]]:
        """Lags and rolling means of each column."""
        out = {c: (WEATHER_LAGS, WEATHER_WINDOWS if c in WEATHER else []) for c in LAGGED if c in columns}
        return out | ({self.target: (TARGET_LAGS, TARGET_WINDOWS)} if self.target else {})

    def fit(self, train: DataFrame) -> FeatureChainModel:
        thresholds = ft.extreme_thresholds(cl.clean_weather(train), self.exact)
        feats = self.derive(store(self.windows(train), "chain-fit"), thresholds)  # a pass reads the columns it needs and derives the rest
        modes = im.mode_values(feats, CATEGORICAL)
        flags = set(im.flag_columns(feats))  # filled with 0
        num = [c for c in numeric_columns(feats, exclude=self.exclude | {"pos"}) if c not in flags]
        medians = im.column_stats(feats, num, "median", self.exact)
        return FeatureChainModel(self, thresholds, modes, medians)

    def fit_transform_pair(self, train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
        model = self.fit(train)
        test_model = self.fit(test) if self.refit else model
        return model.transform(train), test_model.transform(test)
