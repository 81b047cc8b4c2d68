"""Model stage (M1-M7): scaling, folds, cross-fitting and metrics.

Fits are MLlib estimators (distributed over the training rows); the fold loop
runs on the driver and joins everything by session key, never by position.
Per-feature statistics are one-row aggregates (bounded by the feature count).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickflow.config import Workspace, session_workspace
from clickflow.functions.stats import exact_quantiles
from clickflow.operators.select import assemble, sample_key
from clickflow.schema import LABEL, N_FOLDS, SEED, SESSION


def standardize(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """M1: z = (x - mean) / std with mean and *population* std of train; a
    zero std scales by 1 (so a constant column becomes 0 on train)."""
    stats = train.agg(
        *[F.avg(F.col(f"`{c}`")).alias(f"m_{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(F.col(f"`{c}`")).alias(f"s_{i}") for i, c in enumerate(cols)],
    )

    def apply(df: DataFrame) -> DataFrame:
        j = df.crossJoin(F.broadcast(stats))
        keep = [c for c in df.columns if c not in cols]
        z = []
        for i, c in enumerate(cols):
            sd = F.col(f"s_{i}")
            scale = F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)
            z.append(((F.col(f"`{c}`") - F.col(f"m_{i}")) / scale).alias(c))
        return j.select(*keep, *z)

    return apply(train), apply(test)


def kfold_assign(train: DataFrame, k: int = N_FOLDS, seed: int = SEED, bucket_chars: int = 4) -> DataFrame:
    """M2: fold 0..k-1 per session with sizes differing by at most one.

    Sessions are ranked by md5(session:seed). The global rank is built without
    a single-task sort: rank inside buckets of the hash prefix (uniform, so
    balanced), plus each bucket's offset from a table of at most
    16**bucket_chars rows (the only broadcast, bounded by a constant)."""
    ids = train.select(SESSION).distinct().withColumn("_h", sample_key(seed))
    ids = ids.withColumn("_b", F.substring("_h", 1, bucket_chars))
    w = Window.partitionBy("_b").orderBy("_h", SESSION)
    ids = ids.withColumn("_rn", F.row_number().over(w))
    counts = ids.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    ow = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(ow), F.lit(0)).alias("_off"))
    ranked = ids.join(F.broadcast(offsets), "_b")
    return ranked.select(SESSION, ((F.col("_off") + F.col("_rn") - 1) % k).cast("int").alias("fold"))


def forest_factory(cols: Sequence[str], seed: int = SEED, num_trees: int = 100, max_depth: int = 10, max_bins: int = 256):
    """Default regressor of the cross-fit: a regression forest (MLlib). Its
    trees grow level by level in one pass over the data per level, so a fold
    costs about ``max_depth`` jobs."""
    rf = RandomForestRegressor(
        featuresCol="features",
        labelCol=LABEL,
        seed=seed,
        numTrees=num_trees,
        maxDepth=max_depth,
        maxBins=max_bins,
        maxMemoryInMB=1024,
        cacheNodeIds=True,
    )

    return lambda df: rf.fit(vectors(df, cols))


def vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df if "features" in df.columns else assemble(df, cols)


HELD_OUT = "held_out"


def gbt_factory(
    cols: Sequence[str], seed: int = SEED, max_iter: int = 50, max_depth: int = 3, tolerance: float = 0.01, step: float = 0.3
):
    """Gradient-boosted trees (MLlib) that stop on the held-out rows: a round whose error there is not
    smaller by ``tolerance`` ends the fit, and the best model so far is kept (at most ``max_iter`` trees)."""
    gbt = GBTRegressor(
        featuresCol="features",
        labelCol=LABEL,
        seed=seed,
        maxIter=max_iter,
        maxDepth=max_depth,
        stepSize=step,
        validationTol=tolerance,
    )

    def fit(df: DataFrame):
        if HELD_OUT in df.columns:
            return gbt.copy({gbt.validationIndicatorCol: HELD_OUT}).fit(vectors(df, cols))
        return gbt.fit(vectors(df, cols))

    fit.validates = True
    return fit


def cross_fit(
    train: DataFrame,
    test: DataFrame,
    folds: DataFrame,
    cols: Sequence[str],
    fit: Callable[[DataFrame], object] | None = None,
    k: int = N_FOLDS,
    parallelism: int | None = None,
    ws: Workspace | None = None,
) -> tuple[DataFrame, DataFrame, list]:
    """M3: for each fold, fit on the other folds, predict the held-out rows
    (out-of-fold) and the test rows; the test prediction is the mean over
    folds. Returns (oof: session, fold, label, prediction;
    test: session, prediction; fitted models).

    A ``fit`` with the attribute ``validates`` gets all rows and the column ``held_out``, to stop on them. The
    fits read a narrow table (session, fold, label, feature vector) written to ``ws`` (or the session's
    workspace); nothing is cached."""
    fit = fit or forest_factory(cols)
    ws = ws or session_workspace(train.sparkSession)
    data = train.join(folds, SESSION).where(F.col(LABEL).isNotNull())
    data = ws.put(assemble(data, cols).select(SESSION, "fold", LABEL, "features"), "fit-rows")
    scored = ws.put(assemble(test, cols).select(SESSION, "features"), "test-rows")
    held = [F.col("fold") == f for f in range(k)]

    def one(f: int):
        if getattr(fit, "validates", False):
            return fit(data.withColumn(HELD_OUT, held[f]))
        return fit(data.where(~held[f]))

    # The k fits are independent Spark jobs: submit them from k driver threads
    # (as CrossValidator's ``parallelism``) so small folds share the cores. The threads
    # take on the caller's job group.
    with ThreadPoolExecutor(max_workers=parallelism or k) as pool:
        models = list(pool.map(inheritable_thread_target(train.sparkSession)(one), range(k)))
    oof_parts = []
    for f, model in enumerate(models):
        oof_parts.append(model.transform(data.where(held[f])).select(SESSION, "fold", LABEL, "prediction"))
        # the k models score the test rows side by side in one pass
        scored = model.transform(scored).withColumnRenamed("prediction", f"_p{f}")
    oof = oof_parts[0]
    for p in oof_parts[1:]:
        oof = oof.unionByName(p)
    total = sum((F.col(f"_p{f}") for f in range(1, k)), F.col("_p0"))
    test_pred = scored.select(SESSION, (total / k).alias("prediction"))
    return oof, test_pred, models


def fold_ols_predictions(
    train: DataFrame, test: DataFrame, folds: DataFrame, x: str = "event_type_count", k: int = N_FOLDS
) -> tuple[DataFrame, DataFrame]:
    """Deterministic stand-in regressor (so the fold and metric steps can be
    checked in SQL): per fold, least squares ``label ~ a + b * x`` fitted on
    the other folds from sums only (n, sx, sy, sxy, sxx: k rows), then the
    same out-of-fold / fold-averaged test prediction as ``cross_fit``."""
    xv = F.col(x).cast("double")
    data = train.join(folds, SESSION).where(F.col(LABEL).isNotNull())
    per = data.groupBy("fold").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(xv).alias("sx"),
        F.sum(LABEL).alias("sy"),
        F.sum(xv * F.col(LABEL)).alias("sxy"),
        F.sum(xv * xv).alias("sxx"),
    )
    tot = per.agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "sx", "sy", "sxy", "sxx")])
    o = {c: F.col(f"t_{c}") - F.col(c) for c in ("n", "sx", "sy", "sxy", "sxx")}
    den = o["n"] * o["sxx"] - o["sx"] * o["sx"]
    b = F.when(den != 0, (o["n"] * o["sxy"] - o["sx"] * o["sy"]) / den).otherwise(F.lit(0.0))
    params = per.crossJoin(tot).select("fold", b.alias("_b"), o["sy"].alias("_sy"), o["sx"].alias("_sx"), o["n"].alias("_n"))
    params = params.select("fold", "_b", ((F.col("_sy") - F.col("_b") * F.col("_sx")) / F.col("_n")).alias("_a"))
    pred = F.col("_a") + F.col("_b") * xv
    oof = data.join(F.broadcast(params), "fold").select(SESSION, "fold", LABEL, pred.alias("prediction"))
    # the mean over folds of a + b * x is mean(a) + mean(b) * x: one row
    mean = params.agg((F.sum("_a") / k).alias("_a"), (F.sum("_b") / k).alias("_b"))
    test_pred = test.select(SESSION, x).crossJoin(F.broadcast(mean)).select(SESSION, pred.alias("prediction"))
    return oof, test_pred


def fold_metrics(oof: DataFrame) -> DataFrame:
    """M4: RMSE per fold, with the mean and population std over folds."""
    per = oof.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg((F.col(LABEL) - F.col("prediction")) ** 2)).alias("rmse"),
    )
    summary = per.agg(F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"))
    return per.crossJoin(F.broadcast(summary))


def oof_metrics(oof: DataFrame) -> DataFrame:
    """M5: RMSE and MSE over all out-of-fold predictions."""
    mse = oof.agg(F.avg((F.col(LABEL) - F.col("prediction")) ** 2).alias("oof_mse"))
    return mse.select(F.sqrt("oof_mse").alias("oof_rmse"), "oof_mse")


def mean_importance(spark, models: list, cols: Sequence[str]) -> DataFrame:
    """M6: model importance averaged over the fold models, per feature."""
    rows = []
    for i, m in enumerate(models):
        for c, v in zip(cols, m.featureImportances.toArray().tolist()):
            rows.append((i, c, float(v)))
    df = spark.createDataFrame(rows, "fold int, feature string, importance double")
    return df.groupBy("feature").agg(F.avg("importance").alias("importance"))


def prediction_stats(pred: DataFrame, col: str = "prediction", ws: Workspace | None = None) -> DataFrame:
    """M7: min, max, mean, exact median and population std of predictions."""
    basic = pred.agg(
        F.min(col).alias("pred_min"),
        F.max(col).alias("pred_max"),
        F.avg(col).alias("pred_mean"),
        F.stddev_pop(col).alias("pred_std"),
    )
    med = exact_quantiles(pred, col, [0.5], names=["pred_median"], ws=ws)
    return basic.crossJoin(med).select("pred_min", "pred_max", "pred_mean", "pred_median", "pred_std")
