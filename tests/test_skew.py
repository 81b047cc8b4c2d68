"""Skew-safe operators against brute force: one session holding most rows,
cut into several blocks of time, and the exact order statistics."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickflow.functions.stats import digit_counts, exact_quantiles, order_statistic
from clickflow.operators.sequence import ordered_events, sequence_stats


@pytest.fixture(scope="module")
def hot_events(spark):
    rng = np.random.default_rng(7)
    n_hot, rows = 3000, []
    t = pd.Timestamp("2024-01-01 00:00:00")
    # One hot session (most of the rows) plus small ones; repeated times,
    # null categories, unordered event ids.
    hot_times = t + pd.to_timedelta(np.sort(rng.integers(0, 10_000, n_hot)), unit="s")
    for i, ts in enumerate(hot_times):
        cat = None if i % 97 == 0 else int(rng.integers(0, 3))
        rows.append((int(rng.permutation(1)[0]) * 0 + 10_000 - i, ts.to_pydatetime(), "VIEW", 1, cat, 1, "hot", 1.0, "train"))
    for s in range(40):
        k = int(rng.integers(1, 6))
        for j in range(k):
            ts = t + pd.Timedelta(seconds=int(rng.integers(0, 5000)))
            rows.append((20_000 + s * 10 + j, ts.to_pydatetime(), "BUY", 1, int(rng.integers(0, 2)), 2, f"s{s:02d}", 1.0, "test"))
    from clickflow.schema import EVENT_SCHEMA

    return spark.createDataFrame(rows, EVENT_SCHEMA).repartition(5)


def brute(pdf):
    out = {}
    for sess, g in pdf.sort_values(["user_session", "event_time", "event_id"]).groupby("user_session"):
        d = g["event_time"].diff().dt.total_seconds().dropna()
        cats = g["category_id"].tolist()
        sw = sum(1 for i in range(1, len(cats)) if not (cats[i] == cats[i - 1] and cats[i] is not None and not pd.isna(cats[i])))
        out[sess] = dict(
            avg=d.mean() if len(d) else 0.0,
            mx=d.max() if len(d) else 0.0,
            total=d.sum() if len(d) else 0.0,
            long=int((d > d.quantile(0.75)).sum()) if len(d) else 0,
            sw=sw,
        )
    return out


@pytest.mark.parametrize("block_rows", [50, 250_000])
def test_hot_session_spans_blocks(hot_events, block_rows):
    hot = ordered_events(hot_events, ("category_id",), block_rows).where(F.col("user_session") == "hot")
    rows = hot.orderBy("event_order").select("event_order", "_t", "event_id", "_prev_t").collect()
    assert [r.event_order for r in rows] == list(range(1, 3001))
    assert [(r._t, r.event_id) for r in rows] == sorted((r._t, r.event_id) for r in rows)
    assert [r._prev_t for r in rows] == [None, *[r._t for r in rows[:-1]]]


def test_heavy_hours_are_cut(spark, hot_events, monkeypatch):
    from clickflow.operators import sequence

    rows = hot_events.select("user_session", sequence.micros().alias("_t"))
    rows = rows.withColumn("_hour", F.expr(f"(_t - pmod(_t, {sequence.HOUR}L)) div {sequence.HOUR}L"))
    heavy = sequence.heavy_hours(rows, 50).collect()
    assert {r.user_session for r in heavy} == {"hot"} and len(heavy) == 3 and all(r._parts > 5 for r in heavy)
    monkeypatch.setattr(sequence, "HEAVY_HOURS", 2)  # only hours with more than half of all events
    assert sequence.heavy_hours(rows, 50).collect() == []


@pytest.mark.parametrize("block_rows", [50, 250_000])
def test_sequence_stats_match_brute_force(hot_events, block_rows):
    pdf = hot_events.toPandas()
    pdf["category_id"] = pdf["category_id"].astype(object).where(pdf["category_id"].notna(), None)
    want = brute(pdf)
    got = {r.user_session: r for r in sequence_stats(hot_events, block_rows=block_rows).collect()}
    assert set(got) == set(want)
    for s, w in want.items():
        g = got[s]
        assert g.avg_time_between_events == pytest.approx(w["avg"])
        assert g.max_time_between_events == pytest.approx(w["mx"])
        assert g.total_pause_time == pytest.approx(w["total"])
        assert g.long_pauses_count == w["long"], s
        assert g.category_switch_count == w["sw"], s


def test_gaps_of_years_and_events_without_time(spark, make_events):
    times = ["2001-01-01 00:00:00", "2003-02-01 00:00:00", "2003-02-01 00:00:00", "2010-06-01 12:00:00.000001", "2024-12-31 23:59:59"]
    ev = make_events([(i, t, "VIEW", 1, 1, 1, "s") for i, t in enumerate(times)])
    late = spark.createDataFrame([(9, None, "BUY", 1, 2, 1, "s", 10.0, "train")], ev.schema.simpleString().replace("struct<", "").rstrip(">"))
    row = sequence_stats(ev).collect()[0]
    t = pd.Series(pd.to_datetime(times, format="ISO8601"))
    gaps = t.diff().dt.total_seconds().dropna()
    assert row.max_time_between_events == pytest.approx(gaps.max()) and row.std_time_between_events == pytest.approx(gaps.std())
    assert row.long_pauses_count == int((gaps > gaps.quantile(0.75)).sum()) and row.total_pause_time == pytest.approx(gaps.sum())
    both = {r.event_id: (r.event_order, r._has_prev, r._prev_t is None) for r in ordered_events(ev.unionByName(late)).collect()}
    assert both[9] == (1, False, True) and both[0] == (2, True, True) and both[1][:2] == (3, True)


def test_order_statistic_brute_force(spark):
    rng = np.random.default_rng(3)
    vals = [("a", int(v)) for v in rng.integers(0, 5_000_000, 2000)] + [("b", 7), ("b", 7), ("b", 2), ("b", None), ("c", None)]
    vals += [("d", 2**59), ("d", 2**59 - 1), ("d", 0)]
    df = spark.createDataFrame(vals, "g string, v long")
    ranks = spark.createDataFrame([("a", 1499), ("b", 1), ("d", 2)], "g string, k long")
    for bits in (12, 20):
        counts = digit_counts(df, "g", "v", [F.count(F.lit(1)).alias("rows")], bits)
        got = {r.g: (r.v, r.n_le) for r in order_statistic(counts, ranks, "g", "v", "k", bits).collect()}
        a = np.sort([v for g, v in vals if g == "a"])
        assert got["a"] == (a[1499], int((a <= a[1499]).sum()))
        assert got["b"] == (7, 3) and got["d"] == (2**59, 3) and "c" not in got
        assert {(r.g, r._n, r.rows) for r in counts.where("_level = 3").collect()} == {("a", 2000, 2000), ("b", 3, 4), ("c", 0, 1), ("d", 3, 3)}


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=3001)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(x)], "g int, x double")
    got = {r.g: (r.q25, r.q50, r.q90) for r in exact_quantiles(df, "x", [0.25, 0.5, 0.9], ["g"]).collect()}
    for g in (0, 1):
        xs = x[g::2]
        assert got[g] == pytest.approx(tuple(np.quantile(xs, [0.25, 0.5, 0.9])), rel=1e-12)


def test_weighted_median(spark):
    df = spark.createDataFrame([(1.0, 3), (100.0, 1), (2.0, 2)], "v double, w long")
    assert exact_quantiles(df, "v", [0.5], weight="w", names=["m"]).collect()[0].m == pytest.approx(1.5)


def test_heavy_hours_shuffle_no_row_for_each_hour(spark, make_events):
    """Hours are counted by a small hash first; the exact count comes behind it."""
    from clickflow.operators import sequence as Q

    times = [("busy", f"2024-01-01 10:{i // 60:02d}:{i % 60:02d}") for i in range(300)]
    times += [(f"s{i % 40}", f"2024-01-{1 + i % 28:02d} {i % 24:02d}:00:00") for i in range(400)] + [("busy", "2024-01-02 10:00:00")]
    ev = make_events([(i, t, "VIEW", 1, 1, 1, s) for i, (s, t) in enumerate(times)])
    rows = ev.select("user_session", Q.micros().alias("_t")).withColumn("_hour", F.expr(f"(_t - pmod(_t, {Q.HOUR}L)) div {Q.HOUR}L"))
    heavy = Q.heavy_hours(rows, block_rows=100)
    assert [(r.user_session, r._parts) for r in heavy.collect()] == [("busy", 3)]
    found = heavy._jdf.queryExecution().optimizedPlan().toString()
    assert "_mark" in found
    many = spark.range(300_000).select(F.col("id").cast("string").alias("user_session"), F.col("id").alias("_hour"))
    assert Q.heavy_hours(many, block_rows=100).count() == 0
