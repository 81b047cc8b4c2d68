"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator name of the inventory. Each reads the test-data tables (through the
derived clickstream) so its work grows with them. Doubles are rounded to 6
places, as in the oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickflow.operators import sequence as E
from clickflow.operators import triage as TR
from clickflow.operators.features import FEATURE_GROUPS, activity_quantiles, session_core, session_features
from clickflow.schema import SESSION
from clickflow.sources.events import clickstream, parse_event_time, quarantine, scan_events, scan_splits

Query = Callable[[SparkSession, str], DataFrame]


def round6(col):
    """floor(x * 1e6 + 0.5) / 1e6: the same IEEE steps in Spark and DuckDB, so
    half-way values round alike (Spark ``round`` rounds the decimal string). Values
    of 1e12 and more have no digits to round there and are passed on; only the
    registered wrappers use it."""
    return F.when(F.abs(col) < 1e12, F.floor(col * 1e6 + 0.5) / 1e6).otherwise(col)


def rounded(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            col = round6(col).alias(f.name)
        cols.append(col)
    return df.select(*cols)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clickstream(spark, sf_dir)


def _model_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.model_events(_events(spark, sf_dir))


def _features(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The features of the modelled sessions, or only ``columns`` and what these are made of."""
    return session_features(_events(spark, sf_dir), model_only=True, columns=columns)


def _group(name: str) -> Query:
    return lambda spark, d: rounded(_features(spark, d, FEATURE_GROUPS[name]))


def _triage_q(fn) -> Query:
    return lambda spark, d: rounded(fn(_events(spark, d)))


def q_parse_event_time(spark: SparkSession, d: str) -> DataFrame:
    ev = _events(spark, d)
    return ev.select("event_id", parse_event_time(F.col("event_time").cast("string")).alias("event_time"))


def q_event_calendar(spark: SparkSession, d: str) -> DataFrame:
    ev = E.event_calendar(_events(spark, d))
    return ev.select("event_id", SESSION, "hour", "day_of_week", "month", "day", "is_weekend")


def q_activity_quantiles(spark: SparkSession, d: str) -> DataFrame:
    ev = _events(spark, d)
    core = session_core(ev, sources=set()).where(F.col("_class") == TR.MODEL)
    return rounded(activity_quantiles(core))


def q_event_presence(spark: SparkSession, d: str) -> DataFrame:
    cols = ["view_cart_buy_funnel", "has_view_and_buy", "has_cart_and_buy", "event_type_diversity"]
    return _features(spark, d, cols)


def q_clean_features(spark: SparkSession, d: str) -> DataFrame:
    cols = ["hour_std", "std_time_between_events", "hour_bin", "category_switch_count"]
    return rounded(_features(spark, d, cols))


def core_queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "scan_events": lambda s, d: _events(s, d),
        "parse_event_time": q_parse_event_time,
        "triage_sessions": _triage_q(TR.triage_sessions),
        "anomalous_sessions": _triage_q(TR.anomalous_sessions),
        "anomalous_union": _triage_q(TR.anomalous_union),
        "clean_events": _triage_q(TR.clean_events),
        "anomalous_test_events": _triage_q(TR.anomalous_test_events),
        "placeholder_median": _triage_q(TR.placeholder_median),
        "placeholder_predictions": _triage_q(TR.placeholder_predictions),
        "common_sessions": _triage_q(TR.common_sessions),
        "common_answers": _triage_q(TR.common_answers),
        "model_events": _triage_q(TR.model_events),
        "event_calendar": q_event_calendar,
        "event_order": lambda s, d: E.event_order(_model_events(s, d)),
        "first_last_event": lambda s, d: E.first_last_event(_model_events(s, d)),
        "inter_event_gaps": lambda s, d: rounded(E.inter_event_gaps(_model_events(s, d))),
        "category_switches": lambda s, d: E.category_switches(_model_events(s, d)),
        "activity_quantiles": q_activity_quantiles,
        "event_presence": q_event_presence,
        "clean_features": q_clean_features,
        "session_features": lambda s, d: rounded(_features(s, d)),
    }
    for name in FEATURE_GROUPS:
        q.setdefault(name, _group(name))
    return q


# ---------------------------------------------------------------- model side
from clickflow.config import session_workspace  # noqa: E402
from clickflow.operators import model as M  # noqa: E402
from clickflow.operators import select as S  # noqa: E402
from clickflow.operators import submit as U  # noqa: E402
from clickflow.operators.features import LABEL_COLUMNS, feature_names  # noqa: E402
from clickflow.schema import LABEL  # noqa: E402

#: What the stand-in regressor reads.
STANDIN = ["event_type_count"]


class Ctx:
    """The pipeline pieces one query needs, each built when it is first asked for, from the feature ``columns``
    that it needs (default: all)."""

    def __init__(self, spark: SparkSession, sf_dir: str, columns: list[str] | None = None):
        self.spark = spark
        self.ws = session_workspace(spark)
        self.derived = _events(spark, sf_dir)
        self.cols = columns or feature_names()
        self.columns = columns

    @cached_property
    def events(self) -> DataFrame:
        """All features read the events several times: derived (fields of the text, labels joined) and written once for them."""
        return self.derived if self.columns else self.ws.put(self.derived, "events")

    @property
    def triage(self) -> DataFrame:
        return TR.triage_sessions(self.__dict__.get("events", self.derived))  # one pass needs no written table

    @cached_property
    def labelled(self) -> DataFrame:
        # Read by several later steps (labels, ranking, scaling, fits): written once, so
        # later plans start from a scan of the columns they need.
        features = session_features(self.events, model_only=True, columns=self.columns, ws=self.ws, with_label=True)
        return self.ws.put(features, "features")

    @property
    def features(self) -> DataFrame:
        return self.labelled.drop(*LABEL_COLUMNS)

    @cached_property
    def train(self) -> DataFrame:
        return S.attach_label(self.labelled, self.events)

    @property
    def test(self) -> DataFrame:
        return self.features.where(F.col("split") == "test")

    @cached_property
    def _scores(self) -> DataFrame:
        return self.ws.put(S.correlation_scores(self.train, self.cols), "scores")

    def scores(self) -> DataFrame:
        return self._scores

    def top_names(self, n: int = 25) -> list[str]:
        rows = S.top_features(self.scores(), n).orderBy("rank").select("feature").collect()
        return [r.feature for r in rows]

    def scaled(self, names: list[str]) -> tuple[DataFrame, DataFrame]:
        return M.standardize(S.select_features(self.train, names + [LABEL]), S.select_features(self.test, names), names)

    def cross_fit(self, names: list[str], fit=None):
        return M.cross_fit(*self.scaled(names), self.folds(), names, fit, ws=self.ws)

    def folds(self) -> DataFrame:
        """Folds of the modelled train sessions; these follow from the triage alone."""
        modelled = (F.col("session_class") == TR.MODEL) & (F.col("in_train") == 1)
        return M.kfold_assign(self.triage.where(modelled).select(SESSION))

    def standin(self):
        return M.fold_ols_predictions(self.train, self.test, self.folds())

    def submission(self) -> DataFrame:
        _, test_pred = self.standin()
        return U.assemble_submission(
            test_pred,
            TR.common_answers(self.events, self.triage),
            TR.placeholder_predictions(self.events, self.triage),
        )


def _standin(spark: SparkSession, d: str) -> Ctx:
    return Ctx(spark, d, STANDIN)


def _long(df: DataFrame, names: list[str]) -> DataFrame:
    return df.unpivot([SESSION, "split"], names, "feature", "value")


def q_attach_label(spark, d):
    return rounded(Ctx(spark, d).train)


def q_numeric_columns(spark, d):
    train = Ctx(spark, d).train
    return rounded(train.select(SESSION, *S.numeric_columns(train)))


#: Small enough to be fewer than all rows on every test folder but the smallest.
SAMPLE = 1000


def q_sample_rows(spark, d):
    return rounded(S.sample_rows(_standin(spark, d).train, SAMPLE).select(SESSION, LABEL))


def q_select_features(spark, d):
    c = Ctx(spark, d)
    names = c.top_names()
    return rounded(_long(S.select_features(c.features, names), names))


def q_standardize(spark, d):
    c = Ctx(spark, d)
    names = c.top_names()
    tr, te = M.standardize(S.select_features(c.train, names), S.select_features(c.test, names), names)
    return rounded(_long(tr.unionByName(te), names))


def q_fit_forest(spark, d):
    c = Ctx(spark, d)
    model = S.fit_forest(S.sample_rows(c.train), c.cols)
    return S.forest_importance(spark, model, c.cols)


def q_shap_importance(spark, d):
    from clickflow.operators.shap import shap_ranking

    c = Ctx(spark, d)
    return shap_ranking(spark, c.train, c.cols)


def _predictions(oof: DataFrame, test_pred: DataFrame) -> DataFrame:
    return oof.select(SESSION, F.lit("oof").alias("kind"), "prediction").unionByName(
        test_pred.select(SESSION, F.lit("test").alias("kind"), "prediction")
    )


def q_cross_fit(spark, d):
    c = Ctx(spark, d)
    oof, test_pred, _ = c.cross_fit(c.top_names())
    return _predictions(oof, test_pred)


def q_boosted_cross_fit(spark, d):
    c = Ctx(spark, d)
    names = c.top_names()
    oof, test_pred, _ = c.cross_fit(names, M.gbt_factory(names))
    return _predictions(oof, test_pred)


def q_mean_importance(spark, d):
    c = Ctx(spark, d)
    names = c.top_names()
    _, _, models = c.cross_fit(names)
    return M.mean_importance(spark, models, names)


def q_model_invariants(spark, d):
    """What must hold for fitted models whatever the trees look like: check, n (rows concerned), holds."""
    from clickflow.operators.shap import shap_importance, shap_sums

    c = Ctx(spark, d)
    names, rows = c.top_names(), []
    forest = S.fit_forest(S.sample_rows(c.train, SAMPLE), names, num_trees=20, max_depth=6)
    sums = shap_sums(spark, c.train, forest, names)
    off = F.abs(F.col("base") + F.col("attributed") - F.col("prediction")) > 1e-6 * F.greatest(F.lit(1.0), F.abs("prediction"))
    importance = S.forest_importance(spark, forest, names)
    scores = shap_importance(spark, c.train, forest, names)
    oof, test_pred, models = c.cross_fit(names, M.forest_factory(names, num_trees=10, max_depth=5))
    mean = M.mean_importance(spark, models, names)
    boost_oof, boost_test, boosted = c.cross_fit(names, M.gbt_factory(names))

    def check(name: str, df: DataFrame, holds) -> None:
        rows.append(df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"), F.coalesce(holds, F.lit(False)).alias("holds")))

    one = lambda col: F.abs(F.sum(col) - 1) < 1e-9
    check("attributions add up to the prediction", sums, ~F.bool_or(off))
    check("forest importances are shares", importance, one("score") & (F.min("score") >= 0))
    check("every feature has a mean attribution", scores, F.min("score") >= 0)
    check("mean importances are shares", mean, one("importance") & (F.min("importance") >= 0))
    for name, out, pred in (("forest", oof, test_pred), ("boosted", boost_oof, boost_test)):
        better = F.sqrt(F.avg((F.col(LABEL) - F.col("prediction")) ** 2)) < F.stddev_pop(LABEL)
        check(f"{name}: one out-of-fold prediction a session", out, F.count_distinct(SESSION) == F.count("prediction"))
        check(f"{name}: better than the mean", out, better)
        check(f"{name}: one test prediction a session", pred, F.count_distinct(SESSION) == F.count("prediction"))
    trees = spark.createDataFrame([(m.getNumTrees,) for m in boosted], "trees int")
    check("boosted: every fold stops before its limit", trees, F.max("trees") < boosted[0].getMaxIter())
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def q_write_submission(spark, d):
    c = _standin(spark, d)
    done = c.ws.put(U.clip_negative(c.submission()), "submission")
    return rounded(U.read_submission(spark, U.write_submission(done, c.ws.folder("published"))))


def q_coverage_ids(spark, d):
    """Test sessions against the sessions of the modelled rows: those of the other classes are missing, those of train are extra."""
    ev = _events(spark, d)
    triage = TR.triage_sessions(ev)
    return U.coverage_ids(U.expected_sessions(ev), TR.session_ids(triage, TR.MODEL))


def q_profile_shapes(spark, d):
    """Rows and columns of each stage, from one aggregate over the events
    joined with the session classes, plus the feature tables."""
    from clickflow.sources.io import profile_shapes

    # the rows of the feature table do not depend on its columns
    return profile_shapes(_events(spark, d), TR.triage_sessions(_events(spark, d)), _features(spark, d, []), 1 + len(feature_names()))


def _export(spark: SparkSession, d: str, broken: bool) -> tuple[str, str]:
    """Write the derived clickstream as the two-file CSV export (text ids, no event_id and no split column)."""
    text = {"product_id": "PROD_", "category_id": "CAT_", "user_id": "USER_"}
    ev = _events(spark, d)
    ids = [F.concat(F.lit(p), F.col(c).cast("string")).alias(c) for c, p in text.items()]
    time = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    session = F.col(SESSION)
    if broken:
        time = F.when(F.col("event_id") % 97 == 0, F.lit("no time")).otherwise(time)
        session = F.when(F.col("event_id") % 89 != 0, session)
    out = ev.select("split", time.alias("event_time"), "event_type", *ids, session.alias(SESSION), F.col(LABEL).cast("string").alias(LABEL))
    base = session_workspace(spark).folder("export")
    for split, cols in (("train", out.columns[1:]), ("test", out.columns[1:-1])):
        out.where(F.col("split") == split).select(*cols).write.option("header", True).csv(f"{base}/{split}")
    return f"{base}/train", f"{base}/test"


def q_scan_splits(spark, d):
    back = scan_splits(spark, *_export(spark, d, broken=False), fmt="csv")
    return rounded(back.drop("event_id"))


def q_input_status(spark, d):
    """The two exported splits, and one that is not there."""
    from clickflow.sources.io import input_status

    train, test = _export(spark, d, broken=False)
    return input_status(spark, {"train": train, "test": test, "validation": f"{train}-validation"})


def q_features_train_statistics(spark, d):
    columns = FEATURE_GROUPS["activity_flags"] + FEATURE_GROUPS["equal_width_bins"]
    return session_features(_events(spark, d), model_only=True, columns=columns, statistics="train")


def q_scan_layouts(spark, d):
    """One folder with two header lines: other order, a further column, line breaks inside of fields."""
    ev = _events(spark, d).withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    folder = session_workspace(spark).folder("layouts")
    writer = lambda df: df.write.option("header", True).option("escape", '"').mode("append").csv(folder)
    writer(ev.where("event_id % 2 = 0"))
    text = F.concat(F.lit('one "'), F.col("product_id").cast("string"), F.lit('"\n two'))
    writer(ev.where("event_id % 2 = 1").withColumn("product_id", text).withColumn("note", F.lit("a,\nb")).select("note", *reversed(ev.columns)))
    return rounded(scan_events(spark, folder, fmt="csv"))


def q_quarantine(spark, d):
    train, test = _export(spark, d, broken=True)
    bad = quarantine(spark, train, split="train").unionByName(quarantine(spark, test, split="test"))
    return bad.select("split", F.explode("reasons").alias("reason")).groupBy("split", "reason").agg(F.count("*").alias("n_rows"))


def model_queries() -> dict[str, Query]:
    return {
        "scan_splits": q_scan_splits,
        "scan_layouts": q_scan_layouts,
        "input_status": q_input_status,
        "features_train_statistics": q_features_train_statistics,
        "quarantine": q_quarantine,
        "multi_label_sessions": lambda s, d: TR.multi_label_sessions(_events(s, d)),
        "attach_label": q_attach_label,
        "numeric_columns": q_numeric_columns,
        "sample_rows": q_sample_rows,
        "fit_forest": q_fit_forest,
        "shap_importance": q_shap_importance,
        "top_features": lambda s, d: rounded(S.top_features(Ctx(s, d).scores())),
        "select_features": q_select_features,
        "feature_reduction": lambda s, d: rounded(S.feature_reduction(Ctx(s, d).scores())),
        "standardize": q_standardize,
        "kfold_assign": lambda s, d: Ctx(s, d).folds(),
        "cross_fit": q_cross_fit,
        "boosted_cross_fit": q_boosted_cross_fit,
        "model_invariants": q_model_invariants,
        "fold_metrics": lambda s, d: rounded(M.fold_metrics(_standin(s, d).standin()[0])),
        "oof_metrics": lambda s, d: rounded(M.oof_metrics(_standin(s, d).standin()[0])),
        "mean_importance": q_mean_importance,
        "prediction_stats": lambda s, d: rounded(M.prediction_stats(_standin(s, d).standin()[1])),
        "feature_categories": lambda s, d: rounded(S.feature_categories(Ctx(s, d).scores())),
        "category_report": lambda s, d: rounded(S.category_report(Ctx(s, d).scores())),
        "assemble_submission": lambda s, d: rounded(_standin(s, d).submission()),
        "clip_negative": lambda s, d: rounded(U.clip_negative(_standin(s, d).submission()).select(SESSION, LABEL)),
        "coverage_check": lambda s, d: (lambda c: U.coverage_check(c.events, c.submission()))(_standin(s, d)),
        "coverage_ids": q_coverage_ids,
        "write_submission": q_write_submission,
        "profile_shapes": q_profile_shapes,
    }


def all_queries() -> dict[str, Query]:
    return {**core_queries(), **model_queries()}
