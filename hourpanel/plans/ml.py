"""Prediction plans on Spark ML: encoding, scaling, weights, model fits,
time-ordered cross-validation, feature selection, importances.

Every fit is a Spark ML estimator over a DataFrame (distributed); the driver
only holds parameter maps, metrics rows and importance vectors.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from uuid import uuid4

import numpy as np

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import series as se
from ..operators.quantiles import exact_quantiles
from ..session import store
from . import boosting as bo
from .boosting import path_exists
from .feature_chain import FeatureChainModel

# ---------------------------------------------------------------------------
# Model settings of the study.
FOREST_TREES, SEED = 100, 42
BOOST_DEFAULT = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.1}
FOREST_DEPTH, VALID_TOLERANCE = 5, 0.01
VARIANCE_MIN = 0.01
IMPORTANCE_MIN, IMPORTANCE_TREES = 0.005, 20
# Weights: weekend 3.0, morning/evening peak 2.0 (overrides weekend), x1.8 above the 80th
# percentile of the target, x2 more for weekend & high.
W_WEEKEND, W_PEAK, W_HIGH, W_WEEKEND_HIGH, HIGH_Q = 3.0, 2.0, 1.8, 2.0, 0.8
FAMILIES = [("extreme", ["extreme_", "heavy_", "strong_"]), ("interaction", ["interaction", "_x_", "temp_humidity"]),
            ("lag", ["lag_", "_ma_", "shift"]), ("time", ["hour", "day", "time_period", "season"])]
FAMILY_DEFAULT = "base"
TIME_FEATURES = ["hour", "dayofweek", "month", "hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos"]
# ---------------------------------------------------------------------------


# --------------------------------------------------------------------------- splits
def hash_split(df: DataFrame, key: Sequence[str], train_share: float = 0.8, seed: int = SEED,
               part: str = "part") -> DataFrame:
    """Reproducible random split by the MD5 of an integer or text row key (independent of partitioning)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1_000_000) / 1_000_000.0
    return df.withColumn(part, F.when(u < train_share, "train").otherwise("test"))


def year_split(df: DataFrame, year_col: str, train_years: Sequence[int], test_years: Sequence[int]):
    return df.filter(F.col(year_col).isin(list(train_years))), df.filter(F.col(year_col).isin(list(test_years)))


def time_folds(df: DataFrame, time_col: str, n_splits: int = 3, fold: str = "fold") -> DataFrame:
    """Expanding-window folds: distinct stamps cut into n_splits+1 equal blocks
    by ``ntile`` (a window over the bounded distinct-stamp table)."""
    stamps = df.select(time_col).distinct()
    stamps = stamps.withColumn(fold, F.ntile(n_splits + 1).over(Window.orderBy(time_col)) - 1)
    return df.join(stamps, time_col)


# --------------------------------------------------------------------------- encoding / scaling
def label_codes(df: DataFrame, col: str) -> DataFrame:
    """(label, code): alphabetical 0-based codes of the distinct values of ``col``; NULL has none.

    The distinct values are numbered inside sorted ranges, so neither the
    driver nor one task holds them all, however many there are.
    """
    values = df.where(F.col(col).isNotNull()).select(F.lit(0).alias("__all"), F.col(col).alias("label")).distinct()
    return se.sequence_index(values, ["__all"], ["label"], pos="code").select("label", F.col("code").cast("double").alias("code"))


def label_encode(train: DataFrame, cols: Sequence[str], test: DataFrame | None = None, suffix: str = "_encoded"):
    """Alphabetical codes fitted on ``train``, added to both frames; unseen and missing labels get the code after the last.

    Returns (train, test, codes), where ``codes`` maps a column to its (label, code) table.
    """
    codes = {c: label_codes(train, c) for c in cols}
    sizes = {c: t.count() for c, t in codes.items()}

    def apply(d):
        for c, t in codes.items():
            t = t.select(F.col("label").alias("__label"), F.col("code").alias("__code"))
            d = d.join(t, F.col(c) == F.col("__label"), "left").withColumn(
                f"{c}{suffix}", F.coalesce(F.col("__code"), F.lit(float(sizes[c])))).drop("__label", "__code")
        return d

    return apply(train), (apply(test) if test is not None else None), codes


def one_hot(df: DataFrame, index_col: str, out: str | None = None) -> DataFrame:
    enc = OneHotEncoder(inputCols=[index_col], outputCols=[out or f"{index_col}_ohe"], dropLast=False)
    return enc.fit(df).transform(df)


def sparse_dummies(train: DataFrame, col: str, test: DataFrame | None = None, min_count: int = 100, suffix: str = "_dummies"):
    """Sparse 0/1 vectors of a label after the rare collapse, with the codes of ``train`` in both frames.

    Labels with more than ``min_count`` train rows get alphabetical codes (numbered in sorted ranges); all others, new
    and missing ones get the code after the last.  Returns (train, test, codes) with ``<col>_code`` and the
    vector column; the driver learns the number of codes alone, and a row holds one entry of its vector.
    """
    kept = train.groupBy(col).count().filter((F.col("count") > min_count) & F.col(col).isNotNull()).select(col)
    codes = store(label_codes(kept, col), "codes")
    n = codes.count()
    # the encoder is told the number of codes by a frame that has the last one
    encoder = OneHotEncoder(inputCols=[f"{col}_code"], outputCols=[f"{col}{suffix}"], dropLast=False).fit(
        train.sparkSession.createDataFrame([(float(n),)], f"`{col}_code` double"))

    def apply(d):
        t = codes.select(F.col("label").alias("__label"), F.col("code").alias("__code"))
        coded = d.join(t, F.col(col) == F.col("__label"), "left").withColumn(f"{col}_code", F.coalesce("__code", F.lit(float(n))))
        return encoder.transform(coded.drop("__label", "__code"))

    return apply(train), (apply(test) if test is not None else None), codes


def standardize(train: DataFrame, cols: Sequence[str], test: DataFrame | None = None, suffix: str = "_scaled"):
    """(x - mean) / std with train statistics (one aggregate, population std), as plain columns."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    stats = {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}

    def apply(d):
        return d.withColumns({f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})
    return apply(train), (apply(test) if test is not None else None), stats


def unstandardize(df: DataFrame, stats: Mapping[str, tuple[float, float]], suffix: str = "_scaled",
                  out_suffix: str = "_original") -> DataFrame:
    return df.withColumns({f"{c}{out_suffix}": F.col(f"{c}{suffix}") * F.lit(s) + F.lit(m) for c, (m, s) in stats.items()})


# --------------------------------------------------------------------------- weights
def sample_weights(df: DataFrame, y: str, high_threshold: float, weekend: str = "is_weekend",
                   morning_peak: str = "is_morning_peak", evening_peak: str = "is_evening_peak",
                   out: str = "weight") -> DataFrame:
    """Assigned (not multiplied) base weight: peak 2.0 overrides weekend 3.0; then
    x1.8 above the threshold and x2 for weekend & high, in that order."""
    we = F.col(weekend) == 1
    peak = (F.col(morning_peak) == 1) | (F.col(evening_peak) == 1)
    high = F.col(y) > F.lit(high_threshold)
    base = F.when(peak, F.lit(W_PEAK)).when(we, F.lit(W_WEEKEND)).otherwise(F.lit(1.0))
    w = base * F.when(high, F.lit(W_HIGH)).otherwise(F.lit(1.0)) * F.when(we & high, F.lit(W_WEEKEND_HIGH)).otherwise(F.lit(1.0))
    return df.withColumn(out, w)


def high_threshold(df: DataFrame, y: str, q: float = HIGH_Q) -> float:
    return exact_quantiles(df, {y: [q]})[y][0]


# --------------------------------------------------------------------------- models
def assemble(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def fit_model(train: DataFrame, features: Sequence[str], label: str, kind: str, params: Mapping | None = None,
              weight: str | None = None, valid: str | None = None, key: Sequence[str] | None = None) -> PipelineModel | bo.TreeModel:
    """``linear``: assembler + Spark ML regression on persisted columns.  ``forest`` and ``boost``: trees on stored bin codes (``boosting``).

    A missing feature is an error: drop or fill such rows before.  Boosting with ``valid`` (a boolean column) doesn't
    train on those rows and stops when their error no longer falls.  ``key`` tells rows apart, so that a forest's
    samples don't depend on the rows' places.
    """
    p = dict(params or {})
    cols = list(dict.fromkeys([*features, label, *[c for c in (weight, valid) if c]]))
    if kind == "linear":
        model = LinearRegression(labelCol=label, featuresCol="features", solver="normal", **p)
        data = train.select(*cols).persist()
        try:
            return Pipeline(stages=[assemble(features), model.setWeightCol(weight) if weight else model]).fit(data)
        finally:
            data.unpersist()
    if kind not in ("forest", "boost"):
        raise ValueError(kind)
    fold = F.col(valid).cast("int") if valid else F.lit(0)
    t = bo.table(train, features, label, key, fold, weight, whole=True)
    if kind == "forest":
        fitted = bo.forest(t, bo.Bagging(p.pop("numTrees", FOREST_TREES), p.pop("maxDepth", FOREST_DEPTH), SEED))
    else:
        q = {**BOOST_DEFAULT, **p}
        settings = bo.Settings(trees=q["maxIter"], depth=q["maxDepth"], rate=q["stepSize"], l2=0.0, seed=SEED)
        fitted, = bo.fit(t, [bo.Run("boost", settings, (0,), (1,), stop=VALID_TOLERANCE if valid else None)])
    return bo.TreeModel(t.features, t.cuts, fitted)


def evaluate(model: PipelineModel, test: DataFrame, label: str, pred: str = "prediction") -> dict:
    row = ev.metrics(model.transform(test), label, pred).first()
    return row.asDict()


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    imp = model.importances() if isinstance(model, bo.TreeModel) else model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, [float(v) for v in imp]), key=lambda t: (-t[1], t[0]))


def importance_family(name: str) -> str:
    for fam, marks in FAMILIES:
        if any(m in name for m in marks):
            return fam
    return FAMILY_DEFAULT


def family_expr(name: Column) -> Column:
    expr = None
    for fam, marks in FAMILIES:
        cond = F.lit(False)
        for m in marks:
            cond = cond | name.contains(m)
        expr = F.when(cond, fam) if expr is None else expr.when(cond, fam)
    return expr.otherwise(FAMILY_DEFAULT)


# --------------------------------------------------------------------------- selection
def variance_select(df: DataFrame, features: Sequence[str], threshold: float = VARIANCE_MIN) -> list[str]:
    """Keep features whose sample variance exceeds the threshold (one aggregate)."""
    row = df.agg(*[F.var_samp(c).alias(c) for c in features]).first()
    return [c for c in features if row[c] is not None and row[c] > threshold]


def importance_select(train: DataFrame, features: Sequence[str], label: str,
                      minimum: float = IMPORTANCE_MIN, trees: int = IMPORTANCE_TREES, key: Sequence[str] | None = None) -> list[str]:
    model = fit_model(train, features, label, "forest", {"numTrees": trees}, key=key)
    return [f for f, v in importances(model, features) if v >= minimum]


# --------------------------------------------------------------------------- validation
def fold_moments(df: DataFrame, cols: Sequence[str], fold: str = "fold") -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """(n, means, centred products) of the columns in each fold, from one grouped aggregate."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    whole = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in cols]
    aggs = [F.count(F.lit(1)).alias("n"), sum(whole[1:], whole[0]).alias("gaps"), F.array(*[F.avg(c) for c in cols]).alias("means"),
            F.array(*[F.covar_pop(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")) for i, j in pairs]).alias("products")]
    out = {}
    for row in df.groupBy(fold).agg(*aggs).collect():  # a row for each fold
        if row["gaps"]:
            raise ValueError("a column has missing values")
        c = np.zeros((len(cols), len(cols)))
        for (i, j), v in zip(pairs, row["products"]):
            c[i, j] = c[j, i] = v * row["n"]
        out[row[fold]] = (row["n"], np.array(row["means"], float), c)
    return out


def merge_moments(a, b):
    """Moments of two disjoint sets of rows together."""
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def ts_cv_linear(df: DataFrame, features: Sequence[str], label: str, time_col: str, n_splits: int = 3) -> list[dict]:
    """``ts_cv`` of the linear model: one pass gives each block's moments, windows are their running sums, every fold is
    solved from them; squared errors follow from the moments too, and one more pass has all folds' absolute errors."""
    cols = [*features, label]
    folds = store(time_folds(df.select(time_col, *cols), time_col, n_splits), "folds")
    blocks = fold_moments(folds, cols)
    if 0 not in blocks:
        return []
    seen, out, fitted = blocks[0], [], {}
    for k in range(1, n_splits + 1):
        if k not in blocks:
            continue
        means, c = seen[1], seen[2]
        b = np.linalg.pinv(c[:-1, :-1], rcond=1e-12, hermitian=True) @ c[:-1, -1]
        a = means[-1] - b @ means[:-1]
        n, m, held = blocks[k]
        g = np.append(-b, 1.0)  # error = label - a - b x = g z - a
        sse = g @ held @ g + n * (g @ m - a) ** 2
        fitted[k] = (a, b)
        out.append({"fold": k, "rmse": float(np.sqrt(sse / n)), "r2": float(1 - sse / held[-1, -1]) if held[-1, -1] > 0 else None, "n": n})
        seen = merge_moments(seen, blocks[k])
    error = None
    for k, (a, b) in fitted.items():
        linear = sum((F.col(f) * F.lit(float(v)) for f, v in zip(features, b)), F.lit(float(a)))
        error = (F.when if error is None else error.when)(F.col("fold") == k, F.abs(F.col(label) - linear))
    mae = {r["fold"]: r["mae"] for r in folds.groupBy("fold").agg(F.avg(error).alias("mae")).collect()} if fitted else {}
    return [{"fold": x["fold"], "mae": mae[x["fold"]], **{k: v for k, v in x.items() if k != "fold"}} for x in out]


def ts_cv(df: DataFrame, features: Sequence[str], label: str, time_col: str, kind: str, params: Mapping | None = None,
          n_splits: int = 3) -> list[dict]:
    """Expanding-window CV: fold k validates on block k after training on blocks < k."""
    f = time_folds(df, time_col, n_splits).cache()
    out = []
    for k in range(1, n_splits + 1):
        model = fit_model(f.filter(F.col("fold") < k), features, label, kind, params)
        m = evaluate(model, f.filter(F.col("fold") == k), label)
        out.append({"fold": k, **m})
    f.unpersist()
    return out


def time_residual(train: DataFrame, test: DataFrame, label: str, features: Sequence[str] = TIME_FEATURES,
                  trees: int = FOREST_TREES, out: str = "residual", key: Sequence[str] | None = None):
    """Forest on time features only; residual = y - prediction becomes the new target."""
    model = fit_model(train, features, label, "forest", {"numTrees": trees}, key=key)
    tr = model.transform(train).withColumn(out, F.col(label) - F.col("prediction")).drop("prediction")
    te = model.transform(test).withColumn(out, F.col(label) - F.col("prediction")).drop("prediction")
    return tr, te, model


# --------------------------------------------------------------------------- persistence
@dataclass
class Bundle:
    """What a saved model needs to be used again: the fitted pipeline, its feature names in order, the metrics, and where
    there are any, the importances and the fitted feature chain."""
    model: PipelineModel | bo.TreeModel
    features: list[str]
    metrics: DataFrame
    importance: DataFrame | None = None
    chain: FeatureChainModel | None = None


def save_bundle(bundle: Bundle, path: str) -> str:
    """Write a new version below ``path`` and publish it; returns the version's name.

    A version's folder is written whole before its manifest, a folder of one row that counts once it has its
    ``_SUCCESS`` mark.  A reader takes the newest manifest, so it meets the earlier version or the new one, never half.
    """
    spark = bundle.metrics.sparkSession
    version = f"{time.time_ns():020d}-{uuid4().hex[:8]}"
    place = f"{path}/versions/{version}"
    if isinstance(bundle.model, bo.TreeModel):
        bundle.model.save(spark, f"{place}/model")
    else:
        bundle.model.write().save(f"{place}/model")
    spark.createDataFrame(list(enumerate(bundle.features)), "place int, feature string").write.parquet(f"{place}/features")
    if bundle.importance is not None:
        bundle.importance.write.parquet(f"{place}/importance")
    if bundle.chain is not None:
        bundle.chain.save(spark, f"{place}/chain")
    bundle.metrics.write.parquet(f"{place}/metrics")
    parts = [p for p, x in (("importance", bundle.importance), ("chain", bundle.chain)) if x is not None]
    manifest = spark.createDataFrame([(version, ["model", "features", "metrics", *parts], len(bundle.features))],
                                     "version string, parts array<string>, n_features int")
    manifest.coalesce(1).write.json(f"{path}/manifests/{version}")
    return version


def published(spark, path: str) -> str | None:
    """The newest version whose manifest is whole, or None."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return None
    names = sorted((x.getPath().getName() for x in fs.listStatus(fs_path)), reverse=True)
    return next((n for n in names if path_exists(spark, f"{path}/manifests/{n}/_SUCCESS")), None)


def _if_there(read):
    """``read()``, or None if its path does not exist; any other failure is an error."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_bundle(spark, paths: Sequence[str]) -> Bundle:
    """Load what is published at the first path that has a bundle (fallback list); a bundle that can't be read is an error.

    A path without manifests may hold one bundle itself, as earlier versions wrote them.
    """
    for p in paths:
        version = published(spark, p)
        p = f"{p}/versions/{version}" if version else p
        metrics = _if_there(lambda: spark.read.parquet(f"{p}/metrics"))
        if metrics is None:
            continue
        trees = path_exists(spark, f"{p}/model/trees")
        model = bo.TreeModel.load(spark, f"{p}/model") if trees else PipelineModel.load(f"{p}/model")
        features = [r["feature"] for r in spark.read.parquet(f"{p}/features").orderBy("place").collect()]
        return Bundle(model, features, metrics, _if_there(lambda: spark.read.parquet(f"{p}/importance")),
                      _if_there(lambda: FeatureChainModel.load(spark, f"{p}/chain")))
    raise FileNotFoundError(f"no bundle in {list(paths)}")
