"""Hand-made edge cases of the session features (FIXTURES.md F-2)."""

import pytest

from clickflow.operators.features import feature_names, session_features


def feats(make_events, rows):
    out = session_features(make_events(rows)).collect()
    return {r.user_session: r.asDict() for r in out}


def test_schema_has_112_features(make_events):
    df = session_features(make_events([(1, "2024-01-01 10:00:00", "VIEW", 1, 1, 7, "s")]))
    assert df.columns[:2] == ["user_session", "split"]
    assert df.columns[2:] == feature_names()
    assert len(feature_names()) == 112


def test_one_event(make_events):
    f = feats(make_events, [(1, "2024-01-01 10:00:00", "VIEW", 1, 1, 7, "s")])["s"]
    assert f["hour_std"] == 0.0
    assert f["std_time_between_events"] == 0.0 and f["avg_time_between_events"] == 0.0
    assert f["long_pauses_count"] == 0 and f["category_switch_count"] == 0
    assert f["VIEW_per_minute"] == pytest.approx(1e8)
    assert f["event_order_max"] == 1 and f["first_event_is_view"] == 1 and f["last_event_is_view"] == 1


def test_over_midnight_hours(make_events):
    f = feats(make_events, [(1, "2024-01-01 23:50:00", "VIEW", 1, 1, 7, "s"),
                            (2, "2024-01-02 00:10:00", "VIEW", 1, 1, 7, "s")])["s"]
    assert f["session_start_hour"] == 0 and f["session_end_hour"] == 23
    assert f["session_duration_minutes"] == pytest.approx(20.0)


def test_sunday_to_monday(make_events):
    # 2024-01-07 is a Sunday (weekday 6), 2024-01-08 a Monday (0).
    f = feats(make_events, [(1, "2024-01-07 23:00:00", "VIEW", 1, 1, 7, "s"),
                            (2, "2024-01-08 01:00:00", "BUY", 1, 1, 7, "s")])["s"]
    assert (f["day_of_week_min"], f["day_of_week_max"]) == (0, 6)
    assert (f["starts_weekend"], f["ends_weekend"], f["crosses_weekend"]) == (0, 1, 1)


def test_hour_bins(make_events):
    rows = [(i, f"2024-01-01 {h:02d}:00:00", "VIEW", 1, 1, 7, f"s{h}") for i, h in enumerate((0, 6, 12, 23))]
    f = feats(make_events, rows)
    assert [f[f"s{h}"]["hour_bin"] for h in (0, 6, 12, 23)] == [0, 0, 1, 3]


def test_medium_session_bounds(make_events):
    f = feats(make_events, [(1, "2024-01-01 10:00:00", "VIEW", 1, 1, 7, "a"), (2, "2024-01-01 10:05:00", "VIEW", 1, 1, 7, "a"),
                            (3, "2024-01-01 10:00:00", "VIEW", 1, 1, 7, "b"), (4, "2024-01-01 10:30:00", "VIEW", 1, 1, 7, "b")])
    assert f["a"]["is_medium_session"] == 1 and f["b"]["is_medium_session"] == 1
    assert f["a"]["is_short_session"] == 0 and f["b"]["is_long_session"] == 0


def test_null_category(make_events):
    f = feats(make_events, [(1, "2024-01-01 10:00:00", "VIEW", 1, 5, 7, "s"),
                            (2, "2024-01-01 10:01:00", "VIEW", 2, None, 7, "s"),
                            (3, "2024-01-01 10:02:00", "VIEW", 3, 5, 7, "s")])["s"]
    assert f["category_id_nunique"] == 1          # nunique skips null
    assert f["category_unique_ratio"] == pytest.approx(2 / 3)  # unique counts it
    assert f["category_switch_count"] == 2        # 5 -> null -> 5
    assert f["most_viewed_category_count"] == 2


def test_all_categories_null(make_events):
    f = feats(make_events, [(1, "2024-01-01 10:00:00", "VIEW", 1, None, 7, "s"),
                            (2, "2024-01-01 10:01:00", "VIEW", 1, None, 7, "s")])["s"]
    assert f["most_viewed_category_count"] == 0
    assert f["category_switch_count"] == 1  # null != null counts as a switch
    assert f["category_id_nunique"] == 0 and f["most_viewed_category_ratio"] == 0.0


def test_null_first_event_type(make_events):
    f = feats(make_events, [(1, "2024-01-01 10:00:00", None, 1, 1, 7, "s"),
                            (2, "2024-01-01 10:01:00", "ADD_CART", 1, 1, 7, "s"),
                            (3, "2024-01-01 10:02:00", "BUY", 1, 1, 7, "s")])["s"]
    assert f["first_event_is_cart"] == 1 and f["last_event_is_buy"] == 1
    assert f["event_type_count"] == 2 and f["event_type_diversity"] == 3


def test_equal_times_ordered_by_event_id(make_events):
    f = feats(make_events, [(2, "2024-01-01 10:00:00", "BUY", 1, 2, 7, "s"),
                            (1, "2024-01-01 10:00:00", "VIEW", 1, 1, 7, "s")])["s"]
    assert f["first_event_is_view"] == 1 and f["last_event_is_buy"] == 1
    assert f["view_to_buy_direct"] == 1


def test_gap_quantile(make_events):
    secs = [0, 1, 3, 6, 16]  # gaps 1, 2, 3, 10: q75 = 4.75
    rows = [(i, f"2024-01-01 10:00:{s:02d}", "VIEW", 1, 1, 7, "s") for i, s in enumerate(secs)]
    f = feats(make_events, rows)["s"]
    assert f["long_pauses_count"] == 1
    assert f["avg_time_between_events"] == pytest.approx(4.0)
    assert f["total_pause_time"] == pytest.approx(16.0)
    assert f["min_time_between_events"] == 1.0 and f["max_time_between_events"] == 10.0


def test_equal_lengths_bin_in_middle(make_events):
    rows = []
    for s in range(5):
        rows += [(10 * s, "2024-01-01 10:00:00", "VIEW", 1, 1, 7, f"s{s}"),
                 (10 * s + 1, f"2024-01-01 10:0{s + 1}:00", "VIEW", 1, 1, 7, f"s{s}")]
    f = feats(make_events, rows)
    assert {v["event_count_bin"] for v in f.values()} == {2}


def test_no_buy(make_events):
    f = feats(make_events, [(1, "2024-01-01 10:00:00", "VIEW", 1, 1, 7, "s"),
                            (2, "2024-01-01 10:01:00", "ADD_CART", 1, 1, 7, "s"),
                            (3, "2024-01-01 10:02:00", "REMOVE_CART", 1, 1, 7, "s")])["s"]
    assert f["BUY"] == 0 and f["BUY_ratio"] == 0.0 and f["purchase_conversion_rate"] == 0.0
    assert f["cart_abandonment_rate"] == pytest.approx(1.0)
    assert f["has_view_and_buy"] == 0 and f["view_cart_buy_funnel"] == 0
