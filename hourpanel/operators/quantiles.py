"""Exact linear-interpolation quantiles with bounded memory.

``percentile`` buffers the distinct values of a column in one task.
``exact_quantiles`` returns the same values from sketches and counts alone,
for any number of columns and probabilities at once:

1. a quantile of n values lies between two order statistics; each of them is
   searched by rank.  One aggregate of sketches (``percentile_approx``, rank
   error at most n / accuracy) proposes a value at the rank and one on either
   side of it, and the first one also counts the values;
2. one aggregate counts, per proposed value, the rows below it and up to it.
   If the rank lies in a value's run of ties, that value is the answer; else
   the open interval between two proposals that holds the rank takes the
   place of the whole column, and both steps are repeated inside it (a sketch
   of at most accuracy / 2 values is exact and needs no count).

Every round shrinks the interval by about accuracy / 4 and always excludes at
least the proposed values, and a sketch over fewer than ``accuracy`` rows is
exact, so two rounds settle 10^8 rows and three 10^12.  The same path runs
at every size.  NULL and NaN are ignored; an empty column gives None.

``grouped_quantiles`` finds them for every group and column at once: equal
values are counted (combined before the shuffle), the distinct (group, column,
value) rows are cut into sorted ranges, and running counts give each value the
ranks it holds.  No group lies in one task, and nothing reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._util import nan_to_null
from ..session import store

#: Aggregates in one job: a sketch holds a few thousand values, and generated code should stay small.
SKETCHES_PER_JOB, COUNTS_PER_JOB = 32, 200
ACCURACY = 20_000


def _values(col: str) -> Column:
    return nan_to_null(F.col(col).cast("double"))


def _aggregate(df: DataFrame, exprs: Sequence[Column], per_job: int) -> list:
    out = []
    for i in range(0, len(exprs), per_job):
        part = exprs[i:i + per_job]
        out += list(df.agg(*[e.alias(f"a{j}") for j, e in enumerate(part)]).first())
    return out


def order_statistics(df: DataFrame, ranks: Mapping[str, Iterable[int]], sizes: Mapping[str, int],
                     accuracy: int = ACCURACY, proposed: Mapping[str, Iterable[float]] | None = None) -> dict[tuple[str, int], float]:
    """The value at each 0-based rank of each column; ``sizes`` are the columns' non-null counts.

    ``proposed``: values to count first, instead of those of a sketch.
    """
    found: dict[tuple[str, int], float] = {}
    # open search interval (low, high) per target, rows up to low, rows below high
    spans = {(c, k): (None, None, 0, sizes[c]) for c, ks in ranks.items() for k in ks if 0 <= k < sizes[c]}
    given = {c: set(v) for c, v in (proposed or {}).items()}
    while spans:
        wanted: dict[tuple, set[float]] = {}
        for (c, k), (low, high, below, upto) in spans.items() if not given else ():
            n, at = upto - below, k - below
            step = 2 * (n // accuracy + 1)
            wanted.setdefault((c, low, high), set()).update(
                (r + 0.5) / n for r in (at - step, at, at + step) if 0 <= r < n)
        sketches = []
        for (c, low, high), probs in wanted.items():
            x = _values(c)
            inside = x if low is None else F.when(x > low, x)
            inside = inside if high is None else F.when(x < high, inside)
            sketches.append(F.percentile_approx(inside, F.array(*[F.lit(p) for p in sorted(probs)]), accuracy))
        near = given
        given = {}
        sketched = dict(zip(wanted, _aggregate(df, sketches, SKETCHES_PER_JOB)))
        for (c, k), (low, high, below, upto) in list(spans.items()) if sketched else ():
            if 2 * (upto - below) <= accuracy:  # the rank error is less than one: this is the value
                probs = sorted(wanted[c, low, high])
                found[c, k] = sketched[c, low, high][probs.index((k - below + 0.5) / (upto - below))]
                del spans[c, k]
        still = {(c, low, high) for (c, _), (low, high, _, _) in spans.items()}
        for (c, low, high), got in sketched.items():
            if (c, low, high) in still:
                near.setdefault(c, set()).update(got)
        if not near:
            continue
        points = [(c, v) for c, vs in near.items() for v in sorted(vs)]
        counts = _aggregate(df, [e for c, v in points for e in (F.count_if(_values(c) < v), F.count_if(_values(c) <= v))],
                            COUNTS_PER_JOB)
        ties: dict[str, list[tuple[float, int, int]]] = {}
        for (c, v), less, most in zip(points, counts[::2], counts[1::2]):
            ties.setdefault(c, []).append((v, less, most))
        for (c, k), (low, high, below, upto) in list(spans.items()):
            for v, less, most in ties.get(c, ()):
                if less <= k < most:
                    found[c, k] = v
                    del spans[c, k]
                    break
                if most <= k and most > below:
                    low, below = v, most
                elif less > k and less < upto:
                    high, upto = v, less
            else:
                spans[c, k] = (low, high, below, upto)
    return found


def exact_quantiles(df: DataFrame, probs: Mapping[str, Sequence[float]],
                    accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation, ``{column: [value per probability]}``."""
    return quantiles_with(df, probs, [], accuracy)[0]


def quantiles_with(df: DataFrame, probs: Mapping[str, Sequence[float]], extra: Sequence[Column],
                   accuracy: int = ACCURACY) -> tuple[dict[str, list[float | None]], list]:
    """``exact_quantiles``, and the values of other aggregates that the first pass answers too."""
    cols = list(probs)
    step = 2 / accuracy
    near = {c: sorted({min(1.0, max(0.0, p + d)) for p in probs[c] for d in (-step, 0.0, step)}) for c in cols}
    first = _aggregate(df, [e for c in cols for e in (F.count(_values(c)), F.percentile_approx(_values(c), F.array(*map(F.lit, near[c])), accuracy))]
                       + list(extra), 2 * SKETCHES_PER_JOB)
    first, others = first[:2 * len(cols)], first[2 * len(cols):]
    sizes, proposed = dict(zip(cols, first[::2])), {c: v for c, v in zip(cols, first[1::2]) if v}
    at = {c: [p * (sizes[c] - 1) for p in probs[c]] for c in cols if sizes[c]}
    ranks = {c: {k for r in rs for k in (int(r), min(int(r) + 1, sizes[c] - 1))} for c, rs in at.items()}
    x = order_statistics(df, ranks, sizes, accuracy, proposed)

    def value(c, r):
        a, b = x[c, int(r)], x[c, min(int(r) + 1, sizes[c] - 1)]
        return a + (b - a) * (r - int(r)) if a != b else a
    return {c: [value(c, r) for r in at[c]] if c in at else [None] * len(probs[c]) for c in cols}, others


def ranked_values(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(by..., variable, value, below, upto, total): each distinct value's ranks are below..upto - 1 among its group's total.

    NULL is a group of its own; NULL and NaN values are left out.
    """
    parts = F.array(*[F.struct(F.lit(c).alias("variable"), _values(c).alias("value")) for c in cols])
    keys = [*by, "variable"]
    counts = (df.select(*by, F.inline(parts)).where(F.col("value").isNotNull())
              .groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("__n")))
    order = [*keys, "value"]
    ranged = store(counts.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranked-values")
    # running counts inside each (group, range), then the ranges' offsets from a table of one row for each
    inside = Window.partitionBy(*keys, "__range").orderBy("value")
    runs = ranged.withColumn("__upto", F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    each = ranged.groupBy(*keys, "__range").agg(F.sum("__n").alias("__size"))
    group = Window.partitionBy(*keys)
    offsets = each.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"),
                          F.coalesce(F.sum("__size").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
                          F.sum("__size").over(group).alias("total"))
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return runs.join(offsets, same).select(*keys, "value", (F.col("__before") + F.col("__upto") - F.col("__n")).alias("below"),
                                           (F.col("__before") + F.col("__upto")).alias("upto"), "total")


def counted_quantiles(df: DataFrame, probs: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """``exact_quantiles`` of many columns, which are computed anew in each pass: by counting digits instead of by sketches.

    A value's digits are the four 16-bit parts of its bits, put in the order of the values.  A pass counts, for each column
    and the digits that its rank is known to begin with, the rows by the next digit, with their least and greatest value; tasks
    hold 65,536 counts a column at most.  A rank whose digit has one value is found, so columns of few values take one pass and none
    takes more than four, each over the columns that are still open.
    """
    cols = list(probs)
    sizes: dict[str, int] = {}
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], tuple[int, int]] = {}  # (column, rank) -> (the digits before, the rank among the rows that have them)
    at: dict[str, list[float]] = {}
    for depth in range(4):
        targets = sorted({(c, prefix) for (c, _), (prefix, _) in open_.items()}) if depth else [(c, 0) for c in cols]
        if not targets:
            break
        table = _digits(df, targets, depth)
        if not depth:
            sizes = {c: sum(n for _, n, _, _ in table.get((c, 0), ())) for c in cols}
            at = {c: [p * (sizes[c] - 1) for p in probs[c]] for c in cols if sizes[c]}
            open_ = {(c, k): (0, k) for c, rs in at.items() for r in rs for k in (int(r), min(int(r) + 1, sizes[c] - 1))}
        for (c, k), (prefix, left) in list(open_.items()):
            for digit, n, low, high in table[c, prefix]:
                if left < n:
                    break
                left -= n
            if low == high:
                found[c, k] = low
                del open_[c, k]
            else:
                open_[c, k] = prefix << 16 | digit, left
    return {c: [_between(found[c, int(r)], found[c, min(int(r) + 1, sizes[c] - 1)], r - int(r)) for r in at[c]] if c in at else [None] * len(probs[c])
            for c in cols}


def _between(low: float, high: float, share: float) -> float:
    return low if share == 0 or low == high else low + (high - low) * share


def _ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the numbers ``x``; those of equal numbers are equal."""
    bits = (x + 0.0).view(np.int64)
    return (bits ^ (bits >> 63 & np.int64(2**63 - 1))).view(np.uint64) ^ np.uint64(2**63)


def _digits(df: DataFrame, targets: Sequence[tuple[str, int]], depth: int) -> dict[tuple[str, int], list[tuple[int, int, float, float]]]:
    """For each (column, digits before): (next digit, rows, least value, greatest value) in the digits' order."""
    cols = list(dict.fromkeys(c for c, _ in targets))
    prefixes = [(cols.index(c), prefix) for c, prefix in targets]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for b in batches:
            values = [b.column(i).drop_null().to_numpy(zero_copy_only=False) for i in range(len(cols))]
            keys = [_ordered(x) for x in values]
            for t, (i, prefix) in enumerate(prefixes):
                x, key = values[i], keys[i]
                if depth:
                    inside = key >> np.uint64(64 - 16 * depth) == np.uint64(prefix)
                    x, key = x[inside], key[inside]
                if not len(x):
                    continue
                if t not in held:
                    held[t] = np.zeros(2**16, np.int64), np.full(2**16, np.inf), np.full(2**16, -np.inf)
                digit = (key >> np.uint64(48 - 16 * depth) & np.uint64(2**16 - 1)).astype(np.int64)
                n, low, high = held[t]
                np.add.at(n, digit, 1)
                np.minimum.at(low, digit, x)
                np.maximum.at(high, digit, x)
        for t, (n, low, high) in held.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), t, np.int32)), pa.array(some.astype(np.int32)), pa.array(n[some]),
                                              pa.array(low[some]), pa.array(high[some])], names=["t", "digit", "n", "low", "high"])

    rows = df.select(*[_values(c).alias(f"v{i}") for i, c in enumerate(cols)]).mapInArrow(count, "t int, digit int, n long, low double, high double")
    got = rows.groupBy("t", "digit").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict[tuple[str, int], list] = {}
    for r in sorted(got.collect()):
        out.setdefault(targets[r["t"]], []).append((r["digit"], r["n"], r["low"], r["high"]))
    return out


def grouped_quantiles(df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(by..., variable, n, quantiles): an array with the linear-interpolation quantile of each probability."""
    ranked = ranked_values(df, by, cols)
    aggs = [F.max("total").alias("n")]
    for i, p in enumerate(probs):
        rank = F.lit(float(p)) * (F.col("total") - 1)
        low, high = F.floor(rank), F.least(F.floor(rank) + 1, F.col("total") - 1)
        holds = [(F.col("below") <= k) & (k < F.col("upto")) for k in (low, high)]
        aggs += [F.max(F.when(holds[0], F.col("value"))).alias(f"__a{i}"), F.max(F.when(holds[1], F.col("value"))).alias(f"__b{i}")]
    got = ranked.groupBy(*by, "variable").agg(*aggs)

    def value(i, p):
        rank = F.lit(float(p)) * (F.col("n") - 1)
        return F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * (rank - F.floor(rank))
    return got.select(*by, "variable", "n", F.array(*[value(i, p) for i, p in enumerate(probs)]).alias("quantiles"))
