"""End-to-end run on the smallest test folder (correlation ranking for speed)."""

import pytest

from clickflow.config import shared_dir
from clickflow.plans.flow import run
from clickflow.sources.events import clickstream


def folder(spark, path):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in fs.listStatus(where)} if fs.exists(where) else set()


def test_run_end_to_end(spark):
    ev = clickstream(spark, "/root/testdata/sf0.001")
    out = shared_dir(spark, "flow-test-submission")
    with run(spark, ev, out=out, ranking="correlation", fit=None) as r:
        assert folder(spark, r.workspace.root)
        assert len(r.selected) == 25
        cov = r.coverage.collect()[0]
        assert cov.n_missing == 0 and cov.n_extra == 0 and cov.counts_match
        assert r.fold_metrics.count() == 5
        assert r.submission.where("session_value < 0").count() == 0
        back = spark.read.option("header", True).csv(r.published)
        assert back.columns == ["user_session", "session_value"] and back.count() == r.submission.count()
        assert r.categories.count() > 0
        assert r.prediction_stats.collect()[0].pred_median is not None
        assert tuple(r.reduction.collect()[0])[:2] == (112, 25)
    # the run's tables are gone, the submission stays
    assert not folder(spark, r.workspace.root) and folder(spark, r.published)


def test_a_run_that_fails_leaves_nothing(spark):
    ev = clickstream(spark, "/root/testdata/sf0.001")

    def fails(df):
        raise RuntimeError("no fit")

    base = shared_dir(spark, "")
    before = folder(spark, base)
    with pytest.raises(RuntimeError, match="no fit"):
        run(spark, ev, ranking="correlation", fit=fails)
    assert not {f for f in folder(spark, base) - before if f.startswith("flow")}
