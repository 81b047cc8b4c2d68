"""Session helpers: building a session for tests and local runs, and reading
cluster settings (checkpoint folder, partition count) from the session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "clickflow") -> SparkSession:
    """A local session for tests and benchmarks (on a cluster, use the cluster's own)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``; only when the
    session has none (a local test) pick a scratch folder of our own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        conf_dir = tempfile.mkdtemp(prefix="clickflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder, for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base.rstrip("/"), name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


class Workspace:
    """Owner of the tables that one run writes to the shared folder.

    A written table fixes values that must not be computed twice differently (block ids of a range exchange, whose
    bounds are sampled), cuts the lineage, so that a lost executor re-reads files, and is read by column. ``close``, or
    leaving a ``with`` block, deletes all of them; DataFrames that read them are of no use afterwards.
    """

    def __init__(self, spark: SparkSession, name: str = "run"):
        self.spark, self.root, self.used = spark, shared_dir(spark, f"{name}-{uuid4().hex}"), 0

    def put(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write as Parquet and read back."""
        self.used += 1
        path = f"{self.root}/{self.used:03d}-{name}"
        df.write.partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)

    def folder(self, name: str) -> str:
        """A folder of its own for files that are not tables."""
        self.used += 1
        return f"{self.root}/{self.used:03d}-{name}"

    def close(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        root.getFileSystem(conf).delete(root, True)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *error) -> None:
        self.close()


_shared: dict[str, Workspace] = {}


def session_workspace(spark: SparkSession) -> Workspace:
    """The application's own workspace, for callers that name none: deleted when Python ends."""
    key = spark.sparkContext.applicationId
    if key not in _shared:
        _shared[key] = Workspace(spark, "session")
        atexit.register(_close, key)
    return _shared[key]


def _close(key: str) -> None:
    ws = _shared.pop(key)
    sc = ws.spark.sparkContext
    if sc._jsc is not None and sc.applicationId == key:
        ws.close()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters where it is not installed there and not on their PYTHONPATH."""
    folder = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as tmp:  # the driver copies it to the executors at once
        archive = shutil.make_archive(os.path.join(tmp, "clickflow"), "zip", os.path.dirname(folder), os.path.basename(folder))
        spark.sparkContext.addPyFile(archive)
