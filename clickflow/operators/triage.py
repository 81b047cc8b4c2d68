"""Session triage (T1-T10): which sessions are anomalous, common, or modelled.

Everything derives from one grouped aggregate (``triage_sessions``): per session
and split, min and max user id (``nunique > 1`` is ``min <> max`` on non-null
ids) and presence flags. The aggregate is map-side combined, so a session
holding a third of the rows adds one partial row per task to the shuffle.
Event-level splits are semi/anti joins of the events with that small
per-session table through ``by_session``: AQE broadcasts it when its measured
size allows, else it can split a hot session of the sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickflow.functions.stats import exact_quantiles
from clickflow.operators.joins import by_session
from clickflow.schema import LABEL, SESSION

ANOMALOUS, COMMON, MODEL = "anomalous", "common", "model"


def _in(split: str, col: str) -> F.Column:
    return F.when(F.col("split") == split, F.col(col))


def triage_aggregates() -> list[F.Column]:
    """Per-session aggregate columns the classification needs: split presence
    and per-split min/max user id (all algebraic, combined map-side)."""
    return [
        F.max((F.col("split") == "train").cast("int")).alias("in_train"),
        F.max((F.col("split") == "test").cast("int")).alias("in_test"),
        F.min(_in("train", "user_id")).alias("_tr_min"),
        F.max(_in("train", "user_id")).alias("_tr_max"),
        F.min(_in("test", "user_id")).alias("_te_min"),
        F.max(_in("test", "user_id")).alias("_te_max"),
    ]


def _anomalous(split: str) -> F.Column:
    lo, hi = ("_tr_min", "_tr_max") if split == "train" else ("_te_min", "_te_max")
    return F.coalesce(F.col(lo) != F.col(hi), F.lit(False))


def session_class() -> F.Column:
    """anomalous: more than one user id within the train rows or within the
    test rows (counted per split, so user A in train and B in test is not
    flagged); common: clean and present in both splits; model: the rest."""
    anom = _anomalous("train") | _anomalous("test")
    common = ~anom & (F.col("in_train") == 1) & (F.col("in_test") == 1)
    return F.when(anom, ANOMALOUS).when(common, COMMON).otherwise(MODEL)


def triage_sessions(events: DataFrame) -> DataFrame:
    """One row per session: split presence, per-split anomaly, class."""
    agg = events.where(F.col(SESSION).isNotNull()).groupBy(SESSION).agg(*triage_aggregates())
    return agg.select(
        SESSION,
        "in_train",
        "in_test",
        _anomalous("train").cast("int").alias("anomalous_train"),
        _anomalous("test").cast("int").alias("anomalous_test"),
        session_class().alias("session_class"),
    )


def anomalous_sessions(events: DataFrame) -> DataFrame:
    """(split, user_session) with more than one distinct user id in that split."""
    return (
        events.where(F.col(SESSION).isNotNull())
        .groupBy("split", SESSION)
        .agg(F.min("user_id").alias("_mn"), F.max("user_id").alias("_mx"))
        .where(F.col("_mn") != F.col("_mx"))
        .select("split", SESSION)
    )


def anomalous_union(events: DataFrame) -> DataFrame:
    """Distinct union of both splits' anomalous session ids."""
    return anomalous_sessions(events).select(SESSION).distinct()


def session_ids(triage: DataFrame, klass: str) -> DataFrame:
    return triage.where(F.col("session_class") == klass).select(SESSION)


def clean_events(events: DataFrame, triage: DataFrame | None = None) -> DataFrame:
    """Events whose session is not anomalous (both splits). Null session
    keys are kept, as ``~isin`` keeps them."""
    triage = triage if triage is not None else triage_sessions(events)
    return by_session(events, session_ids(triage, ANOMALOUS), "left_anti")


def anomalous_test_events(events: DataFrame, triage: DataFrame | None = None) -> DataFrame:
    """T4: test events of anomalous sessions."""
    triage = triage if triage is not None else triage_sessions(events)
    test = events.where(F.col("split") == "test")
    return by_session(test, session_ids(triage, ANOMALOUS), "left_semi")


def placeholder_median(events: DataFrame, triage: DataFrame | None = None) -> DataFrame:
    """T5: median ``session_value`` over clean train *event rows* (each session
    weighted by its row count), common sessions and null sessions included.
    Pre-aggregated to (session, value, rows) before the exact weighted median."""
    triage = triage if triage is not None else triage_sessions(events)
    train = events.where(F.col("split") == "train")
    per_value = train.groupBy(SESSION, LABEL).agg(F.count(F.lit(1)).alias("_rows"))
    clean = by_session(per_value, session_ids(triage, ANOMALOUS), "left_anti")
    return exact_quantiles(clean, LABEL, [0.5], weight="_rows", names=["placeholder_value"])


def placeholder_predictions(events: DataFrame, triage: DataFrame | None = None) -> DataFrame:
    """Every anomalous session that has test rows, valued at the median."""
    triage = triage if triage is not None else triage_sessions(events)
    ids = triage.where((F.col("session_class") == ANOMALOUS) & (F.col("in_test") == 1)).select(SESSION)
    median = placeholder_median(events, triage)
    return ids.crossJoin(F.broadcast(median)).select(SESSION, F.col("placeholder_value").alias(LABEL))


def common_sessions(events: DataFrame, triage: DataFrame | None = None) -> DataFrame:
    """Clean sessions present in both splits."""
    triage = triage if triage is not None else triage_sessions(events)
    return session_ids(triage, COMMON)


def common_answers(events: DataFrame, triage: DataFrame | None = None) -> DataFrame:
    """Distinct (session, label) of the train rows of common sessions; a
    session with two labels gives two rows."""
    triage = triage if triage is not None else triage_sessions(events)
    train = events.where(F.col("split") == "train")
    return by_session(train, session_ids(triage, COMMON), "left_semi").select(SESSION, LABEL).distinct()


def model_events(events: DataFrame, triage: DataFrame | None = None) -> DataFrame:
    """Clean events minus common sessions, both splits (the modelled rows).
    Null session keys are kept, as ``~isin`` keeps them."""
    triage = triage if triage is not None else triage_sessions(events)
    dropped = triage.where(F.col("session_class") != MODEL).select(SESSION)
    return by_session(events, dropped, "left_anti")


def multi_label_sessions(events: DataFrame) -> DataFrame:
    """Data-quality report: train sessions carrying more than one label."""
    return (
        events.where(F.col("split") == "train")
        .groupBy(SESSION)
        .agg(F.count_distinct(LABEL).alias("n_labels"))
        .where(F.col("n_labels") > 1)
    )
