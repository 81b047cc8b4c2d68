"""Feature selection (J3, F1-F7): label attachment, numeric matrix, sample,
forest ranking, top-k, projection, keyword categories and category report.

Per-feature tables (scores, importances) have one row per feature, so they
are bounded by the schema width, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickflow.operators.features import LABEL_COLUMNS
from clickflow.operators.joins import by_session
from clickflow.schema import LABEL, SEED, SESSION, TOP_N_FEATURES

KEYS = (SESSION, "split", LABEL)


def attach_label(features: DataFrame, events: DataFrame) -> DataFrame:
    """Train features left-joined with the distinct (session, label)
    pairs of the train events; a session with two labels fans out to two rows.

    Features built ``with_label`` know the lowest and highest label of their session, which is all there is to
    know where these are equal. Only sessions that differ are looked up in the events; whether there are any is
    asked of ``features`` when this is called, so hand in a written table.
    """
    train = features.where(F.col("split") == "train")
    if not set(LABEL_COLUMNS) <= set(features.columns):
        labels = events.where(F.col("split") == "train").select(SESSION, LABEL).distinct()
        return train.join(labels, SESSION, "left")
    low, high = F.col("_label_min"), F.col("_label_max")
    several = F.coalesce(low != high, F.lit(False)) | ((F.col("_labels") > 0) & (F.col("_no_labels") > 0))
    one = train.where(~several).withColumn(LABEL, low).drop(*LABEL_COLUMNS)
    if train.where(several).isEmpty():
        return one
    many = train.where(several).drop(*LABEL_COLUMNS)
    rows = events.where(F.col("split") == "train").select(SESSION, LABEL)
    labels = by_session(rows, many.select(SESSION), "left_semi").distinct()
    return one.unionByName(many.join(labels, SESSION, "left"))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = KEYS) -> list[str]:
    """names of the numeric columns other than key, split and label
    (string columns are dropped; nulls and infinities were filled by D16)."""
    return [
        f.name
        for f in df.schema.fields
        if f.name not in exclude and isinstance(f.dataType, T.NumericType)
    ]


def sample_key(seed: int = SEED) -> Column:
    """A repeatable pseudo-random order of sessions (same text in DuckDB)."""
    return F.md5(F.concat(F.col(SESSION), F.lit(f":{seed}")))


def sample_rows(df: DataFrame, n: int = 5000, seed: int = SEED, bucket_chars: int = 4) -> DataFrame:
    """``n`` rows without replacement (all, if there are fewer), repeatable: those with the smallest sample keys.

    The threshold comes from counts by the key's first characters: a table of at most
    16**bucket_chars rows, the only broadcast. Buckets below it are taken whole and stay where they are; only the one
    that holds the n-th row is ranked. Rows with the same session follow by label."""
    keyed = df.withColumn("_key", sample_key(seed)).withColumn("_b", F.substring("_key", 1, bucket_chars))
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_left", F.lit(n) - F.coalesce(before, F.lit(0))).where("_left > 0")
    near = keyed.join(F.broadcast(counts), "_b")
    ties = [F.col(c) for c in (SESSION, LABEL) if c in df.columns]
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_key", *ties))
    border = near.where("_c > _left").withColumn("_place", place).where("_place <= _left")
    return near.where("_c <= _left").select(*df.columns).unionByName(border.select(*df.columns))


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def fit_forest(
    train: DataFrame,
    cols: Sequence[str],
    num_trees: int = 100,
    max_depth: int = 10,
    seed: int = SEED,
    max_bins: int = 256,
):
    """regression forest on the given columns (all features tried at each
    split, bootstrap rows, as the reference forest)."""
    rf = RandomForestRegressor(
        featuresCol="features",
        labelCol=LABEL,
        numTrees=num_trees,
        maxDepth=max_depth,
        seed=seed,
        featureSubsetStrategy="all",
        maxBins=max_bins,
        # Larger split-statistics budget per task: fewer passes per tree level;
        # node ids are cached (and checkpointed) instead of re-routed each level.
        maxMemoryInMB=1024,
        cacheNodeIds=True,
    )
    return rf.fit(assemble(train.where(F.col(LABEL).isNotNull()), cols).select(LABEL, "features"))


def importance_table(spark, cols: Sequence[str], values: Sequence[float], name: str = "score") -> DataFrame:
    """(feature, score) from a per-feature vector (one row per feature)."""
    rows = [(c, float(v)) for c, v in zip(cols, values)]
    return spark.createDataFrame(rows, f"feature string, {name} double")


def forest_importance(spark, model, cols: Sequence[str]) -> DataFrame:
    """Impurity importance of a fitted tree ensemble (MLlib averages over trees)."""
    return importance_table(spark, cols, model.featureImportances.toArray().tolist())


def correlation_scores(train: DataFrame, cols: Sequence[str], label: str = LABEL) -> DataFrame:
    """Stand-in ranking score, |Pearson correlation| with the label (0 when
    undefined): one aggregate over the train rows, then unpivoted to
    (feature, score). Deterministic, so the ranking steps can be checked in SQL."""
    # Long (feature, x, y) rows aggregated by feature: a narrow codegen
    # aggregate, combined map-side to one row per feature and task (a single
    # aggregate with three moments per column is too wide to compile).
    rows = train.where(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("_y"), *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]
    )
    long = rows.unpivot(["_y"], list(cols), "feature", "_x")
    x, y = F.col("_x"), F.col("_y")
    # Pearson r from population moments; ANSI mode raises on a zero variance
    # inside ``corr``, so divide with try_divide (null -> score 0).
    r = long.groupBy("feature").agg(
        F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("corr")
    )
    score = F.when(F.isnan("corr") | F.col("corr").isNull(), F.lit(0.0)).otherwise(F.abs("corr"))
    return r.select("feature", score.alias("score"))


def _rank_key(score: str) -> Column:
    """Scores equal to 9 places tie (then the name decides), so features equal
    up to scaling rank alike in every engine."""
    return F.floor(F.col(score) * 1e9 + 0.5)


def top_features(scores: DataFrame, n: int = TOP_N_FEATURES, score: str = "score") -> DataFrame:
    """the n best features, descending score, name breaking ties, with rank."""
    w = Window.orderBy(_rank_key(score).desc(), F.col("feature"))
    # One row per feature: a single-partition window over the schema width.
    return scores.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= n)


def feature_reduction(scores: DataFrame, n: int = TOP_N_FEATURES) -> DataFrame:
    """How many features there are, how many are chosen, and by how much (percent) this reduces them."""
    counts = scores.agg(F.count(F.lit(1)).alias("n_features"))
    chosen = F.least("n_features", F.lit(n)).cast("long")
    ratio = (1 - F.try_divide(F.col("n_chosen"), F.col("n_features"))) * 100
    return counts.withColumn("n_chosen", chosen).withColumn("reduction_percent", ratio)


def select_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = (SESSION, "split")) -> DataFrame:
    """Project the chosen feature columns."""
    return df.select(*[c for c in keep if c in df.columns], *[F.col(f"`{c}`") for c in names])


# Fixed keyword rules, in order; the first hit wins (on the lower-cased name).
CATEGORY_RULES = (
    ("Temporal", ("time", "hour", "duration", "minute", "second")),
    ("Product/Category", ("product", "category")),
    ("Event/Behavior", ("view", "buy", "cart", "event")),
    ("Conversion/Ratio", ("ratio", "rate", "conversion")),
    ("Aggregation", ("count", "nunique", "sum")),
    ("Engagement", ("diversity", "exploration", "efficiency")),
)


def feature_category(col: Column) -> Column:
    """keyword category of a feature name, as a native expression."""
    low = F.lower(col)
    expr = None
    for name, words in CATEGORY_RULES:
        cond = None
        for w in words:
            hit = low.contains(w)
            cond = hit if cond is None else cond | hit
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise("Other")


def feature_categories(scores: DataFrame) -> DataFrame:
    return scores.withColumn("category", feature_category(F.col("feature")))


def category_report(scores: DataFrame, top: int = 20, per_category: int = 3, score: str = "score") -> DataFrame:
    """of the ``top`` best features, per category: count, the best
    ``per_category`` names with rank, and how many more there are."""
    best = top_features(scores, top, score).drop("rank")
    cat = feature_categories(best)
    w = Window.partitionBy("category").orderBy(_rank_key(score).desc(), F.col("feature"))
    wc = Window.partitionBy("category")
    out = cat.select(
        "category",
        F.count(F.lit(1)).over(wc).alias("n_features"),
        F.row_number().over(w).alias("rank_in_category"),
        "feature",
        F.col(score).alias("score"),
    )
    return out.where(F.col("rank_in_category") <= per_category).withColumn(
        "n_more", F.greatest(F.col("n_features") - per_category, F.lit(0))
    )
