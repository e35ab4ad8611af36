"""Row-level panel features on a streaming frame.

The study has no stream processing; what carries over unchanged are the
stateless row expressions (cleaning, calendar parts, labels, interactions).
Operators that need a fitted quantile, a mean or an ordered window are batch
only.  The sink uses a checkpoint location under the shared
``spark.checkpoint.dir`` so a restarted query resumes exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import bins as bn
from ..functions import calendar as cal
from ..functions import clean as cl
from ..functions import features as ft
from ..session import ensure_checkpoint_dir
from ..sources.panel_io import PANEL_SCHEMA


def row_features(df: DataFrame) -> DataFrame:
    """Stateless features usable on batch and streaming frames alike."""
    d = cal.with_calendar(cl.clean_weather(df))
    d = d.withColumns({"is_weekend": cal.weekend_flag(), "time_group": cal.time_group("hour"),
                       "time_period": cal.time_period("hour"), "season": cal.season("month", "label"),
                       "is_holiday": cal.holiday_flag("date", recurring=True)})
    d = bn.weather_labels(d)
    return d.withColumns(ft.interaction_columns())


def read_panel_stream(spark: SparkSession, folder: str, fmt: str = "csv", encoding: str = "utf-8") -> DataFrame:
    reader = spark.readStream.schema(PANEL_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True).option("encoding", encoding)
    return reader.format(fmt).load(folder)


def start_feature_stream(spark: SparkSession, source: str, sink: str, name: str = "panel_features",
                         fmt: str = "csv", available_now: bool = True):
    """Feature stream from files to parquet; returns the StreamingQuery."""
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    q = (row_features(read_panel_stream(spark, source, fmt)).writeStream.format("parquet")
         .option("checkpointLocation", ckpt).option("path", sink).outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    return q.start()
