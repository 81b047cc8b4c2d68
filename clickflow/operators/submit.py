"""Submission assembly (U1-U3) and the sink."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickflow.schema import LABEL, SESSION


def assemble_submission(model: DataFrame, common: DataFrame, placeholders: DataFrame) -> DataFrame:
    """UNION ALL by name of model predictions, known answers of common
    sessions and placeholder rows; duplicates are kept, ``source`` says which."""
    parts = [
        model.select(SESSION, F.col("prediction").alias(LABEL), F.lit("model").alias("source")),
        common.select(SESSION, LABEL, F.lit("common").alias("source")),
        placeholders.select(SESSION, LABEL, F.lit("placeholder").alias("source")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clip_negative(df: DataFrame, col: str = LABEL) -> DataFrame:
    """Negative values to 0; null stays null (``greatest`` would not)."""
    return df.withColumn(col, F.when(F.col(col) < 0, F.lit(0.0)).otherwise(F.col(col)))


def coverage_ids(expected: DataFrame, submission: DataFrame) -> DataFrame:
    """Every session id that stands on one side only: ``missing`` from the submission or ``extra`` in it."""
    return _compared(expected, submission).where("not (_expected and _submitted)").select(
        SESSION, F.when(F.col("_expected"), "missing").otherwise("extra").alias("side")
    )


def _compared(expected: DataFrame, submission: DataFrame) -> DataFrame:
    """Session, ``_expected``, ``_submitted``: one full outer comparison of the distinct ids, as one
    aggregate over both (a null id is an id)."""
    both = expected.select(SESSION, F.lit(True).alias("_e")).unionByName(submission.select(SESSION, F.lit(False).alias("_e")))
    return both.groupBy(SESSION).agg(F.bool_or("_e").alias("_expected"), F.bool_or(~F.col("_e")).alias("_submitted"))


def expected_sessions(events: DataFrame) -> DataFrame:
    return events.where(F.col("split") == "test").select(SESSION).distinct()


def coverage_check(events: DataFrame, submission: DataFrame) -> DataFrame:
    """Distinct test sessions vs distinct submitted sessions, plus how many
    test sessions are missing and how many submitted ones are extra."""
    e, s = F.col("_expected"), F.col("_submitted")
    out = _compared(expected_sessions(events), submission).agg(
        F.count_if(e).alias("n_test_sessions"),
        F.count_if(s).alias("n_submission_sessions"),
        F.count_if(e & ~s).alias("n_missing"),
        F.count_if(s & ~e).alias("n_extra"),
    )
    return out.withColumn("counts_match", F.col("n_test_sessions") == F.col("n_submission_sessions"))


def missing_sessions(events: DataFrame, submission: DataFrame) -> DataFrame:
    """The test session ids absent from the submission (for the warning)."""
    return coverage_ids(expected_sessions(events), submission).where("side = 'missing'").select(SESSION)


def _contents(df: DataFrame) -> tuple:
    """Rows, labels and an order-free sum over all rows."""
    mark = F.xxhash64(SESSION, LABEL).cast("decimal(38,0)")
    return tuple(df.agg(F.count(F.lit(1)), F.count(LABEL), F.sum(mark)).first())


def read_submission(spark, folder: str) -> DataFrame:
    return spark.read.option("header", True).schema(f"{SESSION} string, {LABEL} double").csv(folder)


def write_submission(df: DataFrame, path: str, single_file: bool = False) -> str:
    """``user_session,session_value`` CSV with a header; returns the folder that holds it.

    Every run writes to a folder of its own below ``path``, reads it back, compares rows, labels and contents with
    ``df`` (hand in a written table: it is read twice) and only then renames it to ``path/run-<id>``. Runs at the same
    time do not meet; a run that fails leaves nothing that looks like a result. Executors write
    part files; one file only on request (``coalesce(1)``).
    """
    spark = df.sparkSession
    run = uuid4().hex
    staged, final = f"{path}/_staged-{run}", f"{path}/run-{run}"
    out = df.select(SESSION, LABEL)
    (out.coalesce(1) if single_file else out).write.option("header", True).csv(staged)
    jvm = spark._jvm
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (staged, final))
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    wanted, got = _contents(out), _contents(read_submission(spark, staged))
    if wanted != got or not fs.rename(source, target):
        fs.delete(source, True)
        raise OSError(f"the submission was not published: wrote {got}, expected {wanted}")
    return final
