"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import hourpanel
from hourpanel.session import ensure_checkpoint_dir

#: Fixed value: the six ASCII white-space characters, \x20 and \x09-\x0D.
ASCII_SPACE = " \t\n\x0b\f\r"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    The written table survives lost executors, is computed once for all its
    readers, and its file size lets Spark choose between a broadcast join and
    a shuffled one by measurement.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(df: DataFrame) -> DataFrame:
    """``df``, after its session's Python workers have been given this package, once for each context.

    Functions that run in Python workers import the package there; Spark hands the archive to every executor.
    """
    sc = df.sparkSession.sparkContext
    root = os.path.dirname(hourpanel.__file__)
    if not getattr(sc, "_hourpanel_shipped", False) and os.path.isdir(root):
        path = os.path.join(tempfile.mkdtemp(prefix="hourpanel-"), "hourpanel.zip")  # the driver's copy, for Spark to send
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        file = os.path.join(folder, name)
                        z.write(file, os.path.relpath(file, os.path.dirname(root)))
        sc.addPyFile(path)
        sc._hourpanel_shipped = True
    return df


#: Bytes of rows that a Python worker gets at once where several work in a chain, and Spark's own limit, as it is read.
CHAIN_BATCH, SPARK_BATCH = "8388608b", "67108864b"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session has been told to hand Python workers at most ``CHAIN_BATCH`` bytes of rows at once.

    Where functions of Python workers follow each other in a stage, each task has a worker for each, and the JVM and
    all of them hold a batch.  A limit that the session was given stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, SPARK_BATCH) == SPARK_BATCH:
        conf.set(name, CHAIN_BATCH)
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have yet (compared without case, as Spark does)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def text_or_empty(df: DataFrame, col: str) -> Column:
    return F.coalesce(df[col].cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def splitmix(x):
    """SplitMix64 finaliser of a numpy uint64 array: well-mixed bits from any 64-bit key."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
