"""What inputs there are. S5: shapes of the pipeline stages (rows, columns), computed as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickflow.operators.joins import by_session
from clickflow.schema import SESSION


def profile_shapes(events: DataFrame, triage: DataFrame, features: DataFrame, n_features: int | None = None) -> DataFrame:
    """Rows and column counts of: input splits, clean splits, anomalous test
    rows, model splits and the feature tables. One aggregate over events
    joined with the per-session class (null sessions count as clean). ``n_features``: the
    columns of the feature table where ``features`` has only its rows."""
    ev_cols = len(events.columns)
    feat_cols = n_features or len([c for c in features.columns if c != "split"])
    cls = by_session(events, triage.select(SESSION, "session_class"), "left")
    klass = F.coalesce(F.col("session_class"), F.lit("model"))
    agg = cls.groupBy("split").agg(
        F.count(F.lit(1)).alias("all"),
        F.count_if(klass != "anomalous").alias("clean"),
        F.count_if(klass == "anomalous").alias("anomalous"),
        F.count_if(klass == "model").alias("model"),
    )
    rows = agg.select(
        "split",
        F.inline(
            F.array(
                F.struct(F.lit("events").alias("stage"), F.col("all").alias("n_rows")),
                F.struct(F.lit("clean").alias("stage"), F.col("clean").alias("n_rows")),
                F.struct(F.lit("anomalous").alias("stage"), F.col("anomalous").alias("n_rows")),
                F.struct(F.lit("model").alias("stage"), F.col("model").alias("n_rows")),
            )
        ),
    )
    rows = rows.where((F.col("stage") != "anomalous") | (F.col("split") == "test")).select(
        F.concat_ws("_", "stage", "split").alias("stage"), "n_rows", F.lit(ev_cols).alias("n_cols")
    )
    feats = features.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.concat_ws("_", F.lit("features"), "split").alias("stage"), "n_rows", F.lit(feat_cols).alias("n_cols")
    )
    return rows.unionByName(feats)


def input_status(spark: SparkSession, paths: dict[str, str], fmt: str = "csv") -> DataFrame:
    """Name, present, n_rows of each input: a run can be refused, with all that is missing, before it starts.
    The rows of inputs that are there are counted; a missing path has none."""
    conf, out = spark._jsc.hadoopConfiguration(), None
    for name, path in paths.items():
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        present = bool(where.getFileSystem(conf).exists(where))
        rows = spark.read.format(fmt).option("header", True).load(path).agg(F.count(F.lit(1)).alias("n")) if present else spark.range(1).select(F.lit(None).cast("long").alias("n"))
        one = rows.select(F.lit(name).alias("name"), F.lit(present).alias("present"), F.col("n").alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


def require_inputs(status: DataFrame) -> None:
    """Raise with the names of all inputs that are missing or empty."""
    bad = [r.name for r in status.where("not present or n_rows = 0").select("name").collect()]  # a row for each input
    if bad:
        raise FileNotFoundError(f"missing or empty inputs: {', '.join(sorted(bad))}")
