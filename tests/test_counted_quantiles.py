"""Quantiles by counted digits: equal to sorting, for odd numbers, ties, gaps and columns without values."""

import random

import numpy as np
import pytest

from hourpanel.operators import impute as im
from hourpanel.operators import quantiles as qu


def test_counted_quantiles_equal_sorted_rows(spark, monkeypatch):
    r = random.Random(8)
    odd = [0.0, -0.0, 1e-320, -1e300, 1e300, float("inf"), float("-inf"), 0.1, 0.1 + 2**-56, -5.5]
    rows = [(r.choice(odd), float(r.randint(-3, 3)), r.gauss(0, 1) if i % 3 else None, float("nan") if i % 2 else 7.25, None, i) for i in range(501)]
    df = spark.createDataFrame(rows, "odd double, few double, many double, nans double, none double, whole int").repartition(3)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    passes = []
    digits = qu._digits
    monkeypatch.setattr(qu, "_digits", lambda d, targets, depth: passes.append(targets) or digits(d, targets, depth))
    got = qu.counted_quantiles(df, {c: probs for c in df.columns})
    for i, c in enumerate(df.columns):
        x = np.sort([row[i] for row in rows if row[i] is not None and row[i] == row[i]])
        if c == "odd":
            assert got[c] == [x[0], x[125], x[250], x[450], x[500]]
        else:
            assert got[c] == ([pytest.approx(v) for v in np.quantile(x, probs)] if len(x) else [None] * 5)
    assert 1 < len(passes) <= 4 and not {"few", "nans", "none"} & {c for c, _ in passes[1]}  # found in the first pass
    assert got == qu.exact_quantiles(df, {c: probs for c in df.columns})
    assert im.column_stats(df, ["many", "few", "none"]) == {"many": got["many"][2], "few": got["few"][2]}


def test_medians_of_many_columns_build_no_sketch(spark, monkeypatch):
    df = spark.range(50).selectExpr(*[f"cast(id * {k} % 17 as double) c{k}" for k in range(1, 9)])
    monkeypatch.setattr(qu, "_aggregate", None)
    assert im.column_stats(df, df.columns)["c1"] == float(np.median([i % 17 for i in range(50)]))
