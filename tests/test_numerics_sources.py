"""Sums about the mean at large offsets, CSV columns by name, bundles that can't be read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourpanel.operators.evaluate import metrics
from hourpanel.operators.stats import ols
from hourpanel.plans.ml import load_bundle
from hourpanel.sources.panel_io import PANEL_SCHEMA, read_panel


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e8])
def test_r2_and_slope_survive_offsets(spark, offset):
    rng = np.random.default_rng(2)
    x = rng.normal(size=4000)
    y = 3 * x + rng.normal(size=4000)
    rows = [(float(a + offset), float(b + offset), float(3 * a + offset)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "x double, y double, pred double")
    want = 1 - ((y - 3 * x) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert metrics(df, "y", "pred").first()["r2"] == pytest.approx(want, abs=1e-4)
    fit = ols(df, "y", ["x"])
    slope = np.cov(x, y)[0, 1] / np.var(x, ddof=1)
    assert fit["coef"][1] == pytest.approx(slope, rel=1e-5) and fit["names"] == ["intercept", "x"]
    assert fit["coef"][0] == pytest.approx(y.mean() + offset - slope * (x.mean() + offset), abs=1e-6 * max(1.0, offset))


def test_csv_columns_by_name(spark, tmp_path):
    names = [f.name for f in PANEL_SCHEMA.fields]
    row = {n: str(i) for i, n in enumerate(names)} | {"tm": "2021010101", "ta": "bad", "extra": "E"}
    order = ["extra", *names[::-1]]
    (tmp_path / "a.csv").write_text(",".join(order) + "\n" + ",".join(row[n] for n in order) + "\n")
    got = read_panel(spark, str(tmp_path / "a.csv")).first()
    assert got.tm == 2021010101 and got.station_name == "1" and got.ta is None and got.congestion == float(len(names) - 1)
    (tmp_path / "b.csv").write_text("tm,station_name\n1,2\n")
    with pytest.raises(ValueError, match="direction"):
        read_panel(spark, str(tmp_path / "b.csv"))


def test_broken_bundle_is_an_error(spark, tmp_path):
    spark.range(1).select(F.col("id").alias("mae")).write.parquet(f"{tmp_path}/one/metrics")
    with pytest.raises(Exception, match="model"):
        load_bundle(spark, [f"{tmp_path}/none", f"{tmp_path}/one", f"{tmp_path}/two"])
    with pytest.raises(FileNotFoundError):
        load_bundle(spark, [f"{tmp_path}/none"])


def test_cp949_lines_and_bad_rows(spark, tmp_path):
    from hourpanel.sources.panel_io import read_panel_checked

    names = [f.name for f in PANEL_SCHEMA.fields]

    def line(tm, station, n=len(names), end="\r\n"):
        return (",".join([str(tm), station, *["1.5"] * (n - 2)]) + end).encode("cp949")
    header = (",".join(names) + "\r\n").encode("cp949")
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.csv").write_bytes(header + line(2021010101, "서울역") + line(2021010102, '"강남, 2호선"') + b"2021010103,\xff\xff\xff,1\n"
                                       + line(2021010104, "시청", len(names) - 1) + b"\n" + line("x1", "시청") + line(2021010105, "시청"))
    (tmp_path / "p/b.csv").write_bytes(header + line(2022010101, "부산") * 500 + line(2022010102, "부산", 3, ""))
    for size in ("128m", "1k"):  # whole files, and many splits of each
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows, bad = read_panel_checked(spark, f"{tmp_path}/p")
            got = [(r.tm, r.station_name, r.congestion) for r in rows.collect()]
            told = sorted((r.file, r.line, r.reason) for r in bad.collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(got)[:3] == [(2021010101, "서울역", 1.5), (2021010102, "강남, 2호선", 1.5), (2021010105, "시청", 1.5)] and len(got) == 503
        assert told == [("a.csv", 4, "charset"), ("a.csv", 5, "fields"), ("a.csv", 7, "key"), ("b.csv", 502, "fields")]
    with pytest.raises(ValueError, match="no column"):
        (tmp_path / "c.csv").write_bytes(b"tm,x\n1,2\n")
        read_panel_checked(spark, f"{tmp_path}/c.csv")
