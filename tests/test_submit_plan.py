"""Submission rules, the registered queries and plan properties."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clickflow.config import Workspace
from clickflow.operators import submit as U
from clickflow.operators.features import FEATURE_GROUPS, feature_names, session_features, sources_of
from clickflow.operators.sequence import category_switches, event_order, first_last_event, inter_event_gaps
from clickflow.sources.events import clickstream


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([("a", -1.0), ("b", None), ("c", 2.5)], "user_session string, session_value double")
    got = {r.user_session: r.session_value for r in U.clip_negative(df).collect()}
    assert got == {"a": 0.0, "b": None, "c": 2.5}


def test_coverage_lists_missing(make_events, spark):
    ev = make_events([(1, "2024-01-01 10:00:00", "VIEW", 1, 1, 1, "t1", None, "test"),
                      (2, "2024-01-01 10:00:00", "VIEW", 1, 1, 1, "t2", None, "test")])
    sub = spark.createDataFrame([("t1", 1.0)], "user_session string, session_value double")
    row = U.coverage_check(ev, sub).collect()[0]
    assert (row.n_test_sessions, row.n_submission_sessions, row.n_missing, row.counts_match) == (2, 1, 1, False)
    assert [r.user_session for r in U.missing_sessions(ev, sub).collect()] == ["t2"]


def test_every_id_on_one_side_only(spark):
    ids = lambda *x: spark.createDataFrame([(i, 1.0) for i in x], "user_session string, session_value double")
    got = {tuple(r) for r in U.coverage_ids(ids("a", "b", "b", None), ids("b", "c", "c")).collect()}
    assert got == {("a", "missing"), (None, "missing"), ("c", "extra")}
    assert U.coverage_ids(ids("a", None), ids(None, "a")).collect() == []


def test_two_runs_publish_beside_each_other(spark, tmp_path):
    rows = [[("a", 1.5), ("b", None), (None, -0.0), ('q"', 1e-300)], [("a", 2.0)]]
    tables = [spark.createDataFrame(r, "user_session string, session_value double") for r in rows]
    with ThreadPoolExecutor(2) as pool:
        folders = list(pool.map(lambda df: U.write_submission(df, str(tmp_path)), tables))
    assert sorted(files(spark, str(tmp_path))) == sorted(f.rsplit("/", 1)[1] for f in folders)  # and nothing staged
    for r, f in zip(rows, folders):
        assert {tuple(x) for x in U.read_submission(spark, f).collect()} == set(r)


def test_a_run_that_does_not_read_back_is_not_published(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a", 1.5)], "user_session string, session_value double")
    monkeypatch.setattr(U, "read_submission", lambda s, f: df.limit(0))
    with pytest.raises(OSError, match="not published"):
        U.write_submission(df, str(tmp_path))
    assert files(spark, str(tmp_path)) == []


def test_registry_and_oracle_keys():
    from clickflow.plans.oracle import all_oracle
    from clickflow.plans.queries import all_queries

    q, o = all_queries(), all_oracle()
    assert set(q) <= set(entry.queries()) and set(o) <= set(entry.oracle_sql())
    no_oracle = {"fit_forest", "shap_importance", "cross_fit", "boosted_cross_fit", "mean_importance"}
    assert set(o) == set(q) - no_oracle
    assert len(q) >= 60


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and len(df.columns) == 114


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The plan that ran, without the initial one."""
    df.collect()
    return plan_text(df).split("== Initial Plan ==")[0]


def exchanges(text):
    return [x for x in text.split("\n") if "Exchange hashpartitioning" in x and "ReusedExchange" not in x]


def test_a_feature_group_builds_what_it_is_made_of(spark):
    """Durations need the main aggregate only: one scan, one exchange, no sort."""
    ev = clickstream(spark, "/root/testdata/sf0.001")
    text = final_plan(session_features(ev, model_only=True, columns=FEATURE_GROUPS["session_duration"]))
    assert text.count("FileScan") == 1 and len(exchanges(text)) == 1 and "Exchange rangepartitioning" not in text
    assert "SortAggregate" not in text and "Expand" not in text and "percentile" not in text
    products = final_plan(session_features(ev, columns=["product_id_nunique", "products_per_minute"]))
    assert products.count("Expand") == 1 and "category" not in products.split("FileScan")[0].split("Expand")[0]
    with pytest.raises(ValueError, match="unknown features: nothing"):
        session_features(ev, columns=["nothing"])


def test_sources_of_every_feature_are_complete(spark):
    """Features give without the others' sources what they have in the full table, so none is missing."""
    ev = clickstream(spark, "/root/testdata/sf0.001")
    full = {r.user_session: r for r in session_features(ev).collect()}
    alike = {}
    for name in feature_names():
        alike.setdefault(frozenset(sources_of([name])), []).append(name)
    assert len(alike) > 5
    for cols in alike.values():
        for r in session_features(ev, columns=cols).select("user_session", *cols).collect():
            for k in cols:
                assert r[k] == pytest.approx(full[r.user_session][k]), k


def test_event_order_has_one_event_exchange(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "event_id", "ts as event_time", "concat('S', user_id % 50) as user_session", "event_type", "user_id % 7 as category_id"
    )
    for df, extra in ((event_order(ev), 0), (inter_event_gaps(ev), 0), (category_switches(ev), 1)):
        text = final_plan(df)
        blocks = [x for x in exchanges(text) if "_blk" in x]
        assert len(blocks) == 1 and "rangepartitioning" not in text  # the second use of it is a ReusedExchange
        # besides: one row a session and hour (counting), one row a block, one row a session
        assert len(exchanges(text)) <= 3 + extra


def test_first_and_last_event_in_a_hash_aggregate(spark, make_events):
    ev = make_events([(7, "2024-01-01 10:00:00", "BUY", 1, 1, 1, "a"), (-3, "2024-01-01 10:00:00", "VIEW", 1, 1, 1, "a"),
                      (2, "1950-01-01 10:00:00", None, 1, 1, 1, "a"), (9, "1960-01-01 10:00:00", "odd", 1, 1, 1, "b"),
                      (8, "9999-12-31 23:59:59", "ADD_CART", 1, 1, 1, "b"), (1, "2024-01-01 10:00:00", None, 1, 1, 1, "c")])
    got = first_last_event(ev)
    assert {tuple(r) for r in got.collect()} == {("a", "VIEW", "BUY"), ("b", "OTHER", "ADD_CART"), ("c", None, None)}
    assert "HashAggregate" in plan_text(got) and "SortAggregate" not in plan_text(got) and "ObjectHash" not in plan_text(got)


def test_the_session_table_is_aggregated_once(spark):
    """Statistics and features read one written table, which has an owner."""
    ev = clickstream(spark, "/root/testdata/sf0.001")
    with Workspace(spark, "test") as ws:
        df = session_features(ev, columns=["event_count_bin", "is_high_activity"], ws=ws)
        plan = final_plan(df)
        assert plan.count("FileScan") == 2 and "user_session" in plan  # the written table, twice
        assert df.inputFiles() and all(ws.root.rsplit("/", 1)[1] in f for f in df.inputFiles())
        assert files(spark, ws.root)
    assert not files(spark, ws.root)


def files(spark, folder):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def test_features_plan_is_native(spark):
    f = session_features(clickstream(spark, "/root/testdata/sf0.001"))
    text = plan_text(f)
    assert "PythonUDF" not in text and "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert "SortAggregate" not in text
    # The only object aggregate is the per-split percentile of event counts
    # (two groups; its map holds one entry per distinct count value).
    for line in text.split("\n"):
        if "ObjectHashAggregate" in line:
            assert "percentile(event_type_count" in line


def test_scan_prunes_columns(spark):
    """The triage reads neither the label's value nor anything else it does not need."""
    import re

    from clickflow.operators.triage import triage_sessions

    plan = triage_sessions(clickstream(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas
    for read in schemas:
        names = {f.split(":")[0] for f in read.split(",")}
        assert names <= {"event_id", "ts", "user_id"}, names


def test_same_result_for_1_and_16_partitions(spark):
    ev = clickstream(spark, "/root/testdata/sf0.001")
    a = session_features(ev.coalesce(1)).orderBy("user_session").collect()
    b = session_features(ev.repartition(16)).orderBy("user_session").collect()
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for k, v in x.asDict().items():
            w = y[k]
            assert (v == pytest.approx(w)) if isinstance(v, float) else v == w, k
