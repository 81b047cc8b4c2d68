"""Selection and model properties (FIXTURES.md F-3) and keyword categories."""

import hashlib

import pytest
from pyspark.sql import functions as F

from clickflow.config import Workspace
from clickflow.operators import model as M
from clickflow.operators import select as S
from clickflow.operators.features import session_features
from clickflow.schema import LABEL


@pytest.fixture(scope="module")
def toy(spark):
    df = spark.range(400).select(
        F.col("id").cast("string").alias("user_session"),
        F.lit("train").alias("split"),
        (F.col("id") % 17).cast("double").alias("a"),
        (F.col("id") % 5).cast("double").alias("b"),
        F.lit(3.0).alias("c"),
    )
    return df.withColumn(LABEL, 2 * F.col("a") + F.col("b"))


def test_fold_sizes_exact(toy):
    folds = M.kfold_assign(toy)
    sizes = sorted(r["count"] for r in folds.groupBy("fold").count().collect())
    assert sizes == [80] * 5
    assert folds.select("user_session").distinct().count() == 400


def test_constant_column_scales_to_zero(toy):
    tr, _ = M.standardize(toy, toy, ["a", "b", "c"])
    row = tr.agg(F.max(F.abs("c")).alias("c"), F.avg("a").alias("ma"), F.stddev_pop("a").alias("sa")).collect()[0]
    assert row.c == 0.0 and row.ma == pytest.approx(0.0, abs=1e-12) and row.sa == pytest.approx(1.0)


def test_forest_importance_ranks(spark, toy):
    model = S.fit_forest(toy, ["a", "b", "c"], num_trees=20, max_depth=5)
    imp = {r.feature: r.score for r in S.forest_importance(spark, model, ["a", "b", "c"]).collect()}
    assert imp["c"] == 0.0 and imp["a"] > imp["b"] > 0.0


def test_correlation_ranking(toy):
    top = S.top_features(S.correlation_scores(toy, ["a", "b", "c"]), 3).orderBy("rank").collect()
    assert [r.feature for r in top] == ["a", "b", "c"] and top[2].score == 0.0


def test_cross_fit_shapes(spark, toy):
    folds = M.kfold_assign(toy)
    oof, test, models = M.cross_fit(toy, toy.drop(LABEL), folds, ["a", "b", "c"], M.forest_factory(["a", "b", "c"], num_trees=5, max_depth=4))
    assert oof.count() == 400 and test.count() == 400 and len(models) == 5
    metrics = M.fold_metrics(oof).collect()
    assert len(metrics) == 5 and all(m.rmse < 9.0 for m in metrics)  # label std ~9.9


def test_boosted_trees_stop_on_the_held_out_rows(spark, toy):
    folds = M.kfold_assign(toy)
    cols = ["a", "b", "c"]
    oof, test, models = M.cross_fit(toy, toy.drop(LABEL), folds, cols, M.gbt_factory(cols, max_iter=200))
    assert oof.count() == 400 and test.count() == 400
    assert all(m.getNumTrees < 200 for m in models)
    assert M.oof_metrics(oof).collect()[0].oof_rmse < 3.0
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_sample_is_exact_and_distributed(spark, toy):
    for n in (0, 1, 37, 399, 400, 1000):
        got = [r.user_session for r in S.sample_rows(toy, n).collect()]
        order = sorted((r.user_session for r in toy.collect()), key=lambda s: (hashlib.md5(f"{s}:42".encode()).hexdigest(), s))
        assert sorted(got) == sorted(order[:n])
    for chars in (1, 2):  # few buckets: the border bucket is ranked
        assert sorted(r.user_session for r in S.sample_rows(toy, 37, bucket_chars=chars).collect()) == sorted(order[:37])
    twice = toy.unionByName(toy.withColumn(LABEL, F.col(LABEL) + 1))
    got = S.sample_rows(twice, 37).collect()
    assert len(got) == 37 and S.sample_rows(twice.limit(0), 37).count() == 0
    parts = S.sample_rows(toy.repartition(8), 300)
    assert parts.rdd.getNumPartitions() > 1
    assert "Limit" not in parts._jdf.queryExecution().executedPlan().toString()


def test_labels_come_with_the_features(spark, make_events):
    t = "2024-01-01 10:00:0"
    rows = [(1, t + "1", "VIEW", 1, 1, 1, "one", 5.0, "train"), (2, t + "2", "BUY", 1, 1, 1, "one", 5.0, "train"),
            (3, t + "1", "VIEW", 1, 1, 2, "none", None, "train"), (9, t + "1", "VIEW", 1, 1, 4, "test", 7.0, "test")]
    two = [(4, t + "1", "VIEW", 1, 1, 3, "two", 1.0, "train"), (5, t + "2", "VIEW", 1, 1, 3, "two", 2.0, "train"),
           (6, t + "3", "VIEW", 1, 1, 3, "two", 1.5, "train"), (7, t + "1", "VIEW", 1, 1, 5, "half", None, "train"),
           (8, t + "2", "VIEW", 1, 1, 5, "half", 3.0, "train")]
    expected = {("one", 5.0), ("none", None)}
    for some, more in ((rows, set()), (rows + two, {("two", 1.0), ("two", 2.0), ("two", 1.5), ("half", None), ("half", 3.0)})):
        ev = make_events(some)
        with Workspace(spark, "test") as ws:
            f = ws.put(session_features(ev, columns=["event_type_count"], with_label=True), "features")
            got = S.attach_label(f, ev)
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            assert {(r.user_session, r[LABEL]) for r in got.collect()} == expected | more
            assert got.columns == ["user_session", "split", "event_type_count", LABEL]
            assert ("LogicalRDD" in plan) == bool(more)  # the events are read again for sessions that differ only
        plain = S.attach_label(session_features(ev, columns=["event_type_count"]), ev)
        assert {(r.user_session, r[LABEL]) for r in plain.collect()} == expected | more


def test_feature_reduction(spark):
    scores = spark.createDataFrame([(f"f{i}", 1.0) for i in range(40)], "feature string, score double")
    assert tuple(S.feature_reduction(scores).collect()[0]) == (40, 25, 37.5)
    assert tuple(S.feature_reduction(scores.limit(3)).collect()[0]) == (3, 3, 0.0)
    assert tuple(S.feature_reduction(scores.limit(0)).collect()[0]) == (0, 0, None)


def test_fold_ols_recovers_linear_signal(toy):
    folds = M.kfold_assign(toy)
    oof, test = M.fold_ols_predictions(toy.withColumn("event_type_count", F.col("a")),
                                       toy.withColumn("event_type_count", F.col("a")), folds)
    assert M.oof_metrics(oof).collect()[0].oof_rmse < 2.0


@pytest.mark.parametrize(
    "name,cat",
    [
        ("VIEW_per_minute", "Temporal"),
        ("cart_conversion_rate", "Event/Behavior"),
        ("exploration_depth", "Conversion/Ratio"),
        ("exploration_index", "Conversion/Ratio"),
        ("session_efficiency", "Engagement"),
        ("user_id_nunique", "Aggregation"),
        ("day_of_week_min", "Other"),
        ("total_pause_time", "Temporal"),
    ],
)
def test_feature_categories(spark, name, cat):
    df = spark.createDataFrame([(name, 1.0)], "feature string, score double")
    assert S.feature_categories(df).collect()[0].category == cat
