"""Time-series operators over (series keys, time order): lags, rolling means,
forward/backward fills, linear interpolation and additive decomposition.

Scale design
------------
A plain ``Window.partitionBy(station)`` puts each station in one task; if one
station holds a third of the table, that task holds a third of the table.
Every operator here therefore works on a *dense row position* ``pos`` inside
the series and on fixed-size *position blocks*:

1. ``sequence_index``: one range shuffle on (series, order) cuts a long
   series over many tasks; every sorted partition numbers its rows, the rows
   per (series, partition) are counted, and a running sum over that small
   count table gives each partition's offset inside the series.
2. Bounded windows (lag k, lead k, rolling k) run per (series, block of
   ``block_rows`` positions).  The last ``before`` rows of the previous
   block and the first ``after`` rows of the next one are copied in as halo
   rows, so each block task sees exactly what its rows need; halo rows are
   dropped afterwards.  Task size is bounded by ``block_rows + halo``.
3. Unbounded scans (fills) are two-level: the scan runs inside each block,
   each block's last (first) non-null value is summarised in a table of one
   row per ``block_rows`` rows, carried across blocks by a window over that
   table, and joined back: a series of 10^11 rows is 10^5 summary rows.

With ``block_rows=None`` the operators fall back to a plain per-series
window (one shuffle, fine when no series is large).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._util import col_of
from ..session import materialize, store

DEFAULT_BLOCK_ROWS = 1_000_000
UNB_PRE, UNB_FOL = Window.unboundedPreceding, Window.unboundedFollowing


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the left side's keys first, as a join by names has them."""
    other = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    out = left.join(other, same, how).drop(*[f"__right_{k}" for k in keys])
    return out.select(*keys, *[c for c in out.columns if c not in keys])


# --------------------------------------------------------------------------- positions
def sequence_index(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                   pos: str = "pos", length: str | None = None, ranges: int | None = None) -> DataFrame:
    """Add the 0-based row position of each row inside its series.

    ``order`` must be a total order inside a series (add tie-break columns);
    rows whose key is NULL form a series of their own.  ``length`` optionally adds the series
    length.  ``ranges`` sets the number of range partitions (default: the
    session's shuffle partitions).

    No task holds more than one range, whatever share of the rows a series
    has.  The numbered rows are stored, since the numbers depend on the
    ranges: pass only the columns that later steps read.  The ranges' first
    numbers are stored too, so that the planner knows whether they fit a
    broadcast: the rows are not shuffled again for them.
    """
    keys = list(keys)
    by = [*[F.col(k) for k in keys], *[col_of(o) for o in order]]
    d = df.repartitionByRange(*([ranges] if ranges else []), *by).sortWithinPartitions(*by)
    # the id is (partition number << 33) + row number inside the sorted partition
    d = store(d.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    d = d.withColumn("__range", F.shiftright("__id", 33))
    counts = d.groupBy(*keys, "__range").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    wc = Window.partitionBy(*keys).orderBy("__range")
    offs = counts.withColumn("__off", F.coalesce(F.sum("__n").over(wc.rowsBetween(UNB_PRE, -1)), F.lit(0)))
    if length:
        offs = offs.withColumn(length, F.sum("__n").over(Window.partitionBy(*keys)))
    offs = store(offs.drop("__n"), "offsets")
    out = _null_safe(d, offs, [*keys, "__range"], "inner")
    return out.withColumn(pos, F.col("__off") + F.col("__id") - F.col("__first")).drop("__off", "__first", "__id", "__range")


# --------------------------------------------------------------------------- bounded windows
def block_windows(df: DataFrame, keys: Sequence[str], pos: str,
                  make: Callable[[Window], Mapping[str, Column]],
                  before: int, after: int = 0, block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Evaluate window expressions that look at most ``before`` rows back and
    ``after`` rows ahead, per series, on bounded blocks with halo rows.

    ``make(w)`` returns {name: expression using window spec ``w``}; ``w`` is
    partitioned by the series (and block) and ordered by ``pos``.
    """
    keys = list(keys)
    if block_rows is None:
        w = Window.partitionBy(*keys).orderBy(pos)
        return df.withColumns(dict(make(w)))
    if block_rows < max(before, after, 1):
        raise ValueError("block_rows must cover the halo")
    p = F.col(pos)
    blk = F.floor(p / block_rows)
    off = p - blk * block_rows
    targets = [F.struct(blk.alias("b"), F.lit(False).alias("h"))]
    if before > 0:
        targets.append(F.when(off >= block_rows - before, F.struct((blk + 1).alias("b"), F.lit(True).alias("h"))))
    if after > 0:
        targets.append(F.when((off < after) & (blk > 0), F.struct((blk - 1).alias("b"), F.lit(True).alias("h"))))
    ex = df.withColumn("__t", F.explode(F.filter(F.array(*targets), lambda t: t.isNotNull())))
    ex = ex.withColumns({"__blk": F.col("__t.b"), "__halo": F.col("__t.h")}).drop("__t")
    w = Window.partitionBy(*keys, "__blk").orderBy(pos)
    out = ex.withColumns(dict(make(w)))
    return out.filter(~F.col("__halo")).drop("__blk", "__halo")


def add_lags(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str], lags: Sequence[int],
             block_rows: int | None = DEFAULT_BLOCK_ROWS, name: str = "{col}_lag_{k}") -> DataFrame:
    """``col`` shifted by k rows inside the series (NULL for the first k rows)."""
    def make(w):
        return {name.format(col=c, k=k): F.lag(c, k).over(w) for c in cols for k in lags}
    return block_windows(df, keys, pos, make, before=max(lags), block_rows=block_rows)


def add_rolling_means(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str], windows: Sequence[int],
                      include_current: bool = True, block_rows: int | None = DEFAULT_BLOCK_ROWS,
                      name: str = "{col}_ma_{k}") -> DataFrame:
    """Trailing mean over k rows with at least one observation (pandas
    ``rolling(k, min_periods=1)``); ``include_current=False`` ends the window
    one row earlier so a target's own value does not leak into its feature."""
    end = 0 if include_current else -1

    def make(w):
        return {name.format(col=c, k=k): F.avg(c).over(w.rowsBetween(end - (k - 1), end))
                for c in cols for k in windows}
    return block_windows(df, keys, pos, make, before=max(windows) - end, block_rows=block_rows)


def add_lags_and_means(df: DataFrame, keys: Sequence[str], pos: str,
                       steps: Mapping[str, tuple[Sequence[int], Sequence[int]]],
                       block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Lags and trailing means, ``{column: (lags, mean lengths)}``, in one blocked window pass
    (one halo explode, one shuffle, one sort instead of two)."""
    def make(w):
        out = {f"{c}_lag_{k}": F.lag(c, k).over(w) for c, (lags, _) in steps.items() for k in lags}
        out.update({f"{c}_ma_{k}": F.avg(c).over(w.rowsBetween(-(k - 1), 0)) for c, (_, sizes) in steps.items() for k in sizes})
        return out
    before = max(n for lags, sizes in steps.values() for n in [*lags, *[k - 1 for k in sizes]])
    return block_windows(df, keys, pos, make, before=before, block_rows=block_rows)


def carry(df: DataFrame, keys: Sequence[str], pos: str, exprs: Mapping[str, Column], forward: bool = True,
          block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Last non-null value up to the row (``forward``) or first non-null from
    the row on (backward), per series.  Two-level block scan (see module doc).

    The block summaries are read off the in-block scan itself (its value at
    the block's last row in scan order), so the input is referenced once and
    its exchange is shared.  Backward scans run as forward scans over the
    descending order: Spark evaluates an (unbounded preceding, current) frame
    incrementally, while a (current, unbounded following) frame is
    recomputed for every row.
    """
    keys = list(keys)
    names = list(exprs)
    base = df.withColumns({f"__v_{n}": e for n, e in exprs.items()})
    p = F.col(pos) if forward else F.col(pos).desc()
    if block_rows is None:
        frame = Window.partitionBy(*keys).orderBy(p).rowsBetween(UNB_PRE, 0)
        out = base.withColumns({n: F.last(f"__v_{n}", True).over(frame) for n in names})
        return out.drop(*[f"__v_{n}" for n in names])
    base = base.withColumn("__blk", F.floor(F.col(pos) / block_rows))
    frame = Window.partitionBy(*keys, "__blk").orderBy(p).rowsBetween(UNB_PRE, 0)
    local = base.withColumns({f"__l_{n}": F.last(f"__v_{n}", True).over(frame) for n in names}).drop(
        *[f"__v_{n}" for n in names])
    pick = F.max_by if forward else F.min_by
    summ = local.groupBy(*keys, "__blk").agg(*[pick(F.col(f"__l_{n}"), F.col(pos)).alias(f"__s_{n}") for n in names])
    b = F.col("__blk") if forward else F.col("__blk").desc()
    sframe = Window.partitionBy(*keys).orderBy(b).rowsBetween(UNB_PRE, -1)
    summ = summ.select(*keys, "__blk", *[F.last(f"__s_{n}", True).over(sframe).alias(f"__c_{n}") for n in names])
    out = _null_safe(local, summ, [*keys, "__blk"], "left")
    out = out.withColumns({n: F.coalesce(F.col(f"__l_{n}"), F.col(f"__c_{n}")) for n in names})
    return out.drop("__blk", *[f"__{k}_{n}" for n in names for k in ("l", "c")])


def carry_both(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str], place: bool = False,
               block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``__p_<col>`` and ``__n_<col>``: the last non-null value up to the row and the first from it on, per series.

    Both directions share one shuffle of the rows.  The blocks' last and first values come from an aggregate of their
    own, and only series of more than one block have rows in the table that is joined back.  With ``place`` a value
    is a struct (i, v) of its position and itself.
    """
    keys = list(keys)
    p = F.col(pos)
    block = F.lit(0) if block_rows is None else F.floor(p / block_rows)
    base = df.withColumn("__blk", block.cast("long"))

    def kept(c):
        return F.when(F.col(c).isNotNull(), F.struct(p.alias("i"), F.col(c).alias("v")) if place else F.col(c))

    by = [*keys, "__blk"]
    up, down = (Window.partitionBy(*by).orderBy(o).rowsBetween(UNB_PRE, 0) for o in (p, p.desc()))
    out = base.withColumns({f"__p_{c}": F.last(kept(c), True).over(up) for c in cols})
    out = out.withColumns({f"__n_{c}": F.last(kept(c), True).over(down) for c in cols})
    if block_rows is None:
        return out.drop("__blk")
    at = {c: F.when(F.col(c).isNotNull(), p) for c in cols}
    ends = base.groupBy(*by).agg(*[f(kept(c), at[c]).alias(f"__{n}_{c}") for c in cols for f, n in ((F.max_by, "e"), (F.min_by, "s"))])
    before, after = (Window.partitionBy(*keys).orderBy(o).rowsBetween(UNB_PRE, -1) for o in (F.col("__blk"), F.col("__blk").desc()))
    carried = ends.select(*by, *[F.last(f"__e_{c}", True).over(before).alias(f"__b_{c}") for c in cols],
                          *[F.last(f"__s_{c}", True).over(after).alias(f"__a_{c}") for c in cols])
    some = reduce(or_, [F.col(f"__{n}_{c}").isNotNull() for c in cols for n in ("b", "a")])
    out = _null_safe(out, carried.where(some), by, "left")
    out = out.withColumns({f"__{n}_{c}": F.coalesce(F.col(f"__{n}_{c}"), F.col(f"__{o}_{c}")) for c in cols for n, o in (("p", "b"), ("n", "a"))})
    return out.drop("__blk", *[f"__{o}_{c}" for c in cols for o in ("b", "a")])


def fill_ff_bf(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str], median_fallback: bool = True,
               block_rows: int | None = DEFAULT_BLOCK_ROWS, exact: bool = True) -> DataFrame:
    """Forward fill, then backward fill inside the series, then the global median."""
    both = carry_both(df, keys, pos, cols, block_rows=block_rows)
    out = both.withColumns({c: F.coalesce(F.col(c), F.col(f"__p_{c}"), F.col(f"__n_{c}")) for c in cols})
    out = out.drop(*[f"__{p}_{c}" for c in cols for p in ("p", "n")])
    if median_fallback:
        from .impute import column_stats
        out = out.fillna(column_stats(df, cols, "median", exact))
    return out


def fill_lag_features(df: DataFrame, keys: Sequence[str], weather_lags: Mapping[str, str],
                      target_lags: Sequence[str] = (), target_default: float = 50.0) -> DataFrame:
    """Missing weather lag/MA -> the current value of its base variable, else 0;
    missing target lag -> the series mean of that lag column, else ``target_default``.

    The series means are a grouped aggregate joined back on the series key.
    """
    out = df.withColumns({c: F.coalesce(F.col(c), F.col(base), F.lit(0.0)) for c, base in weather_lags.items()})
    if target_lags:
        keys = list(keys)
        # stored, so that the planner knows its size: a small one is broadcast and the rows stay where they are
        means = store(df.groupBy(*keys).agg(*[F.avg(c).alias(f"__m_{c}") for c in target_lags]), "series-means")
        out = _null_safe(out, means, keys, "left").withColumns(
            {c: F.coalesce(F.col(c), F.col(f"__m_{c}"), F.lit(float(target_default))) for c in target_lags})
        out = out.drop(*[f"__m_{c}" for c in target_lags])
    return out


def interpolate_linear(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str],
                       block_rows: int | None = DEFAULT_BLOCK_ROWS, suffix: str = "_interpolated") -> DataFrame:
    """Linear interpolation by row position inside the series.

    Interior gaps: straight line between the neighbouring observations.
    Leading gaps stay missing; trailing gaps repeat the last observation.
    """
    p = F.col(pos)
    both = carry_both(df, keys, pos, cols, True, block_rows)
    outs = {}
    for c in cols:
        pi, pv = F.col(f"__p_{c}.i"), F.col(f"__p_{c}.v")
        ni, nv = F.col(f"__n_{c}.i"), F.col(f"__n_{c}.v")
        lin = pv + (nv - pv) * (p - pi) / (ni - pi)
        outs[f"{c}{suffix}"] = (F.when(F.col(c).isNotNull(), F.col(c))
                                .when(F.col(f"__p_{c}").isNotNull() & F.col(f"__n_{c}").isNotNull(), lin)
                                .when(F.col(f"__p_{c}").isNotNull(), pv))
    return both.withColumns(outs).drop(*[f"__{k}_{c}" for c in cols for k in ("p", "n")])


def drop_warmup(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def chrono_split(df: DataFrame, time_col: str, train_share: float = 0.8, part: str = "part") -> DataFrame:
    """Tag rows 'train'/'test' by chronological rank of the distinct stamps.

    The distinct stamp table is bounded by the number of hours in the span
    (not by the rows), so its single ordered window is cheap.
    """
    stamps = df.select(time_col).distinct()
    ranked = stamps.withColumn("__pr", F.percent_rank().over(Window.orderBy(time_col)))
    cut = ranked.select(time_col, F.when(F.col("__pr") < train_share, "train").otherwise("test").alias(part))
    return df.join(cut, time_col)


# --------------------------------------------------------------------------- decomposition
def decompose_additive(df: DataFrame, keys: Sequence[str], pos: str, length: str, y: str, period: int = 24,
                       min_rows: int | None = None, block_rows: int | None = DEFAULT_BLOCK_ROWS,
                       out: str = "residual") -> DataFrame:
    """Additive decomposition per series: trend, seasonal and residual.

    * trend: centred moving average (for an even period the 2 x period filter,
      weights 1/2 at both ends), defined from position period/2 to
      n-1-period/2; the ends are extrapolated with the least-squares line
      through the first ``period`` and the last ``period`` defined trend
      points (the last defined point itself excluded, as the common
      statistical-library routine does).
    * seasonal: mean of (y - trend) per phase ``pos % period``, centred.
    * residual: y - trend - seasonal.
    Series shorter than ``min_rows`` (default 2 periods) or with a missing y
    keep ``residual = y``.

    Windows run on bounded blocks; line fits and phase means are grouped
    aggregates over the series (map-side combined), joined back.
    """
    keys = list(keys)
    min_rows = min_rows or 2 * period
    half = period // 2
    p, n = F.col(pos), F.col(length)

    def make(w):
        if period % 2 == 0:
            s = F.sum(y).over(w.rowsBetween(-half, half))
            edge = F.lag(y, half).over(w) + F.lead(y, half).over(w)
            ma = (s - 0.5 * edge) / period
        else:
            ma = F.avg(y).over(w.rowsBetween(-half, half))
        return {"__trend0": F.when((p >= half) & (p <= n - 1 - half), ma)}

    t = materialize(block_windows(df, keys, pos, make, before=half, after=half, block_rows=block_rows))
    front, back = F.lit(half), n - 1 - half
    in_front = (p >= front) & (p < F.least(front + period, back))
    in_back = (p >= F.greatest(front, back - period)) & (p < back)
    fits = t.groupBy(*keys).agg(
        F.regr_slope(F.when(in_front, F.col("__trend0")), F.when(in_front, p.cast("double"))).alias("__kf"),
        F.regr_intercept(F.when(in_front, F.col("__trend0")), F.when(in_front, p.cast("double"))).alias("__nf"),
        F.regr_slope(F.when(in_back, F.col("__trend0")), F.when(in_back, p.cast("double"))).alias("__kb"),
        F.regr_intercept(F.when(in_back, F.col("__trend0")), F.when(in_back, p.cast("double"))).alias("__nb"),
        F.count_if(F.col(y).isNull()).alias("__ymiss"))
    t = _null_safe(t, fits, keys, "left")
    trend = (F.when(p < front, F.col("__kf") * p + F.col("__nf"))
             .when(p > back, F.col("__kb") * p + F.col("__nb"))
             .otherwise(F.col("__trend0")))
    t = materialize(t.withColumns({"trend": trend, "__phase": p % period}))
    phase = (t.groupBy(*keys, "__phase").agg(F.avg(F.col(y) - F.col("trend")).alias("__pm")))
    phase = phase.withColumn("seasonal", F.col("__pm") - F.avg("__pm").over(Window.partitionBy(*keys)))
    t = _null_safe(t, phase.drop("__pm"), [*keys, "__phase"], "left")
    ok = (n >= min_rows) & (F.col("__ymiss") == 0)
    t = t.withColumns({
        "trend": F.when(ok, F.col("trend")),
        "seasonal": F.when(ok, F.col("seasonal")),
    })
    t = t.withColumn(out, F.when(ok, F.col(y) - F.col("trend") - F.col("seasonal")).otherwise(F.col(y)))
    return t.drop("__trend0", "__kf", "__nf", "__kb", "__nb", "__ymiss", "__phase")
