"""The reference's whole run as one call: events in, submission and reports out.

    from clickflow.plans.flow import run
    with run(spark, events, out="/shared/submission") as result:
        result.fold_metrics.show()

Steps (each a Spark job graph; only per-feature tables and the top-k names
reach the driver): triage -> session features -> labels -> ranking (TreeSHAP
on the forest fitted to the sample, or |correlation|) -> top 25 -> scaling ->
exact-size folds -> cross-fit -> fold / out-of-fold metrics -> prediction
statistics -> submission (model + common answers + placeholders, clipped) ->
coverage check -> CSV.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickflow.config import Workspace
from clickflow.operators import model as M
from clickflow.operators import select as S
from clickflow.operators import submit as U
from clickflow.operators import triage as TR
from clickflow.operators.features import LABEL_COLUMNS, feature_names, session_features
from clickflow.schema import LABEL, N_FOLDS, TOP_N_FEATURES


@dataclass
class FlowResult:
    features: DataFrame
    ranking: DataFrame
    selected: list[str]
    oof: DataFrame
    test_predictions: DataFrame
    fold_metrics: DataFrame
    oof_metrics: DataFrame
    importance: DataFrame
    prediction_stats: DataFrame
    submission: DataFrame
    coverage: DataFrame
    categories: DataFrame
    reduction: DataFrame
    #: Folder of the published submission, if one was asked for.
    published: str | None
    #: Owner of the tables that these results read.
    workspace: Workspace

    def close(self) -> None:
        """Delete the run's tables; the results above cannot be read afterwards. The published submission stays."""
        self.workspace.close()

    def __enter__(self) -> FlowResult:
        return self

    def __exit__(self, *error) -> None:
        self.close()


def run(
    spark: SparkSession,
    events: DataFrame,
    out: str | None = None,
    ranking: str = "shap",
    top_n: int = TOP_N_FEATURES,
    k: int = N_FOLDS,
    fit=None,
    sample: int = 5000,
) -> FlowResult:
    """Run everything; publish the submission CSV below ``out`` when given. ``sample`` bounds the rows the ranking forest is
    fitted on. Use the result in a ``with`` block, or close it, to delete the run's tables."""
    ws = Workspace(spark, "flow")
    try:
        return _run(spark, events, out, ranking, top_n, k, fit, sample, ws)
    except BaseException:
        ws.close()
        raise


def _run(spark, events, out, ranking, top_n, k, fit, sample, ws: Workspace) -> FlowResult:
    triage = TR.triage_sessions(events)
    labelled = ws.put(session_features(events, model_only=True, ws=ws, with_label=True), "features")
    train = S.attach_label(labelled, events)
    features = labelled.drop(*LABEL_COLUMNS)
    test = features.where(F.col("split") == "test")
    cols = feature_names()

    if ranking == "shap":
        from clickflow.operators.shap import shap_ranking

        scores = shap_ranking(spark, train, cols, sample)
    else:
        scores = S.correlation_scores(train, cols)
    scores = ws.put(scores, "scores")
    top = S.top_features(scores, top_n).orderBy("rank").select("feature").collect()
    selected = [r.feature for r in top]

    tr, te = M.standardize(S.select_features(train, selected + [LABEL]), S.select_features(test, selected), selected)
    folds = M.kfold_assign(train, k)
    oof, test_pred, models = M.cross_fit(tr, te, folds, selected, fit or M.forest_factory(selected), k, ws=ws)
    oof, test_pred = ws.put(oof, "oof"), ws.put(test_pred, "test-predictions")

    submission = U.clip_negative(
        U.assemble_submission(
            test_pred,
            TR.common_answers(events, triage),
            TR.placeholder_predictions(events, triage),
        )
    )
    submission = ws.put(submission, "submission")
    published = U.write_submission(submission, out) if out else None
    importance = M.mean_importance(spark, models, selected)
    return FlowResult(
        features=features,
        ranking=scores,
        selected=selected,
        oof=oof,
        test_predictions=test_pred,
        fold_metrics=M.fold_metrics(oof),
        oof_metrics=M.oof_metrics(oof),
        importance=importance,
        prediction_stats=M.prediction_stats(test_pred, ws=ws),
        submission=submission,
        coverage=U.coverage_check(events, submission),
        categories=S.category_report(importance, score="importance"),
        reduction=S.feature_reduction(scores, top_n),
        published=published,
        workspace=ws,
    )
