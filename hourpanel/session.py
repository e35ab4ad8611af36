"""Spark session defaults for panel analytics.

Only settings a Spark user would set: adaptive execution (runtime
re-planning, partition coalescing, skew-join splitting), UTC session time
zone (the panel's ``tm`` key carries no zone), Arrow for the few pandas
boundaries, and the UI off for batch runs.
"""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "false",
    # The JVM does not JIT-compile methods above 8000 bytes of bytecode; a
    # whole-stage-codegen method between 8000 and Spark's default 65535 runs
    # interpreted and is several times slower than falling back.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Window / sort stages are CPU-bound: do not let adaptive coalescing fold a
    # small-but-expensive shuffle into a single task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # checkpoints cut lineage of intermediate results; delete them once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "hourpanel", master: str | None = None,
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``master`` is only set when given (a cluster submit supplies its own).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.driver.memory", os.environ.get("HOURPANEL_DRIVER_MEMORY", "16g"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Settings that results depend on, and the JIT limit on generated methods.  Partition sizes, adaptive execution and
# the rest of the sizing belong to the cluster and are not touched on a session the library did not create.
# (One exception: ``llm.common.small_batches``.)
RUNTIME_SQL_CONF = {k: DEFAULT_CONF[k] for k in (
    "spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.codegen.hugeMethodLimit")}


def tune_session(spark: SparkSession) -> SparkSession:
    """Apply the settings that the queries' results depend on to a session created elsewhere."""
    for k, v in RUNTIME_SQL_CONF.items():
        spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is; a
    cluster session without it is an error, since a folder of one machine
    cannot be read by the others.  Only a local master gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="hourpanel-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a multi-step intermediate result.

    A reliable checkpoint (written under ``spark.checkpoint.dir``, shared
    storage on a cluster) is computed once and read by every later branch,
    instead of every self-join or two-branch step recomputing the whole
    upstream plan; it also survives executor loss.  Never a local checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result as Parquet below ``spark.checkpoint.dir`` and read it back.

    Like ``materialize``, but the columns can be read alone, the file size is
    known to the planner, and the plan starts anew: a checkpoint still carries
    the constraints of the plan it was made of, which the optimizer spends
    minutes on when dozens of derived columns follow.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
