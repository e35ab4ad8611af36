import contextlib
import io

from pyspark.sql import functions as F

from hourpanel.session import RUNTIME_SQL_CONF, ensure_checkpoint_dir, materialize, tune_session


def test_tune_session_applies_runtime_settings(spark):
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    tune_session(spark)
    for k, v in RUNTIME_SQL_CONF.items():
        assert spark.conf.get(k) == v
    assert ensure_checkpoint_dir(spark)


def test_materialize_cuts_lineage(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    agg = df.groupBy("k").agg(F.sum("v").alias("s"))
    m = materialize(agg)
    assert sorted(m.collect()) == sorted(agg.collect())
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        m.groupBy().agg(F.sum("s")).explain()
    assert "Range" not in buf.getvalue()  # the upstream plan is gone; reads the checkpoint
