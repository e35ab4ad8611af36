"""Fills in both directions share one shuffle; the chain moves and stores narrow rows."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from hourpanel.operators import impute as im
from hourpanel.operators import series as se
from hourpanel.plans import feature_chain as fc
from hourpanel.session import ensure_checkpoint_dir


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(2)
    data = [(k, i, *[None if r.random() < 0.7 else r.uniform(0, 9) for _ in range(2)]) for k in ("a", "b", None) for i in range(1 if k == "b" else 23)]
    return spark.createDataFrame(data, "k string, pos long, u double, v double").repartition(3)


@pytest.mark.parametrize("block_rows", [None, 1, 4, 10, 1000])
def test_both_directions_equal_brute_force(rows, block_rows):
    got = {(r.k, r.pos): r for r in se.carry_both(rows, ["k"], "pos", ["u", "v"], True, block_rows).collect()}
    assert len(got) == rows.count()
    for (k, pos), r in got.items():
        for c in ("u", "v"):
            known = sorted(p for (x, p), y in got.items() if x == k and y[c] is not None)
            for name, place in ((f"__p_{c}", [p for p in known if p <= pos][-1:]), (f"__n_{c}", [p for p in known if p >= pos][:1])):
                assert (r[name] and tuple(r[name])) == ((place[0], got[k, place[0]][c]) if place else None)


def test_interpolation_shuffles_the_rows_once(spark, rows):
    plan = se.interpolate_linear(rows, ["k"], "pos", ["u", "v"], 4)._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[-1]
    assert sum("Window" in x for x in final.splitlines()) <= 4 and final.count("Scan ExistingRDD") <= 2


def test_medians_shuffle_no_values(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 1.5).alias("x"), F.when(F.col("id") % 3 == 0, F.col("id") % 7).cast("double").alias("y"), F.lit(None).cast("double").alias("z"))
    before = set(glob.glob(f"{ensure_checkpoint_dir(spark).replace('file:', '')}/*"))
    assert im.column_stats(df, ["x", "y", "z"]) == {"x": 4999 * 1.5 / 2, "y": 3.0}
    assert set(glob.glob(f"{ensure_checkpoint_dir(spark).replace('file:', '')}/*")) == before  # no ranked values were stored


def test_the_chain_stores_no_derived_columns(spark, monkeypatch):
    from tests.test_models import panel
    df, stored = panel(spark), []
    keep = fc.store
    monkeypatch.setattr(fc, "store", lambda d, label: stored.append(d.columns) or keep(d, label))
    model = fc.FeatureChain(exclude=["tm"], target="congestion").fit(df)
    out = model.transform(df)
    assert len(stored) == 2 and all(not {"extreme_cold", "hour", "wind_chill"} & set(c) for c in stored)
    assert {"extreme_cold", "hour", "wind_chill"} <= set(out.columns) and not [c for c in out.columns if c.startswith("__")]
    raw = {(r.station_name, r.tm): r for r in df.collect()}
    for r in out.collect():
        x = raw[r.station_name, r.tm]  # interactions are those of the weather before the fills
        want = x.ta - x.ws * 2 if None not in (x.ta, x.ws) else model.medians["wind_chill"]
        assert r.wind_chill == pytest.approx(want) and r.ta is not None
