"""Triage rules: per-split anomaly, common sessions, label fan-out."""

from pyspark.sql import functions as F

from clickflow.operators import triage as T


def classes(ev):
    return {r.user_session: r.session_class for r in T.triage_sessions(ev).collect()}


def test_two_users_one_split_is_anomalous(make_events):
    ev = make_events([(1, "2024-01-01 10:00:00", "VIEW", 1, 1, 1, "s", 5.0, "test"),
                      (2, "2024-01-01 10:01:00", "VIEW", 1, 1, 2, "s", 5.0, "test")])
    assert classes(ev) == {"s": "anomalous"}


def test_users_in_different_splits_are_common(make_events):
    ev = make_events([(1, "2024-01-01 10:00:00", "VIEW", 1, 1, 1, "s", 5.0, "train"),
                      (2, "2024-01-01 10:01:00", "VIEW", 1, 1, 2, "s", 5.0, "test")])
    assert classes(ev) == {"s": "common"}


def test_anomalous_in_train_removed_from_both(make_events):
    ev = make_events([(1, "2024-01-01 10:00:00", "VIEW", 1, 1, 1, "s", 5.0, "train"),
                      (2, "2024-01-01 10:01:00", "VIEW", 1, 1, 2, "s", 5.0, "train"),
                      (3, "2024-01-01 10:02:00", "VIEW", 1, 1, 1, "s", 5.0, "test"),
                      (4, "2024-01-01 10:00:00", "VIEW", 1, 1, 9, "m", 1.0, "test")])
    assert T.clean_events(ev).select("user_session").distinct().collect()[0].user_session == "m"
    assert T.model_events(ev).count() == 1
    assert [r.user_session for r in T.placeholder_predictions(ev).collect()] == ["s"]


def test_two_labels_give_two_answers(make_events):
    ev = make_events([(1, "2024-01-01 10:00:00", "VIEW", 1, 1, 1, "s", 5.0, "train"),
                      (2, "2024-01-01 10:01:00", "VIEW", 1, 1, 1, "s", 6.0, "train"),
                      (3, "2024-01-01 10:02:00", "VIEW", 1, 1, 1, "s", None, "test")])
    assert sorted(r.session_value for r in T.common_answers(ev).collect()) == [5.0, 6.0]
    assert T.multi_label_sessions(ev).count() == 1


def test_classes_are_disjoint_and_cover_test_sessions(spark):
    from clickflow.sources.events import clickstream

    ev = clickstream(spark, "/root/testdata/sf0.001")
    tri = T.triage_sessions(ev)
    test_ids = ev.where(F.col("split") == "test").select("user_session").distinct()
    covered = test_ids.join(tri, "user_session", "left").where(F.col("session_class").isNull()).count()
    assert covered == 0
    assert tri.count() == tri.select("user_session").distinct().count()


def test_placeholder_median_weighted_by_rows(make_events):
    # session a: 3 rows of 1.0, session b: 1 row of 100.0 -> event-row median 1.0
    ev = make_events([(1, "2024-01-01 10:00:00", "VIEW", 1, 1, 1, "a", 1.0, "train"),
                      (2, "2024-01-01 10:01:00", "VIEW", 1, 1, 1, "a", 1.0, "train"),
                      (3, "2024-01-01 10:02:00", "VIEW", 1, 1, 1, "a", 1.0, "train"),
                      (4, "2024-01-01 10:00:00", "VIEW", 1, 1, 2, "b", 100.0, "train")])
    assert T.placeholder_median(ev).collect()[0].placeholder_value == 1.0
