"""Sources: CSV round trip of the two-file layout, strict time parsing."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from clickflow.config import shared_dir
from clickflow.sources.io import input_status, require_inputs
from clickflow.sources.events import clickstream, csv_layouts, scan_events, scan_splits


def test_two_file_csv_round_trip(spark):
    ev = clickstream(spark, "/root/testdata/sf0.001")
    base = shared_dir(spark, "src-test")
    cols = ["event_id", "event_time", "event_type", "product_id", "category_id", "user_id", "user_session"]
    ev.where("split = 'train'").select(*cols, "session_value").write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(f"{base}/train")
    ev.where("split = 'test'").select(*cols).write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(f"{base}/test")
    back = scan_splits(spark, f"{base}/train", f"{base}/test", fmt="csv")
    assert back.count() == ev.count()
    assert back.where("split = 'test'").where(F.col("session_value").isNotNull()).count() == 0
    a = {(r.event_id, r.event_time) for r in ev.select("event_id", "event_time").collect()}
    b = {(r.event_id, r.event_time) for r in back.select("event_id", "event_time").collect()}
    assert a == b


def test_missing_path_surfaces(spark):
    with pytest.raises(AnalysisException):
        scan_events(spark, "/nonexistent/events.parquet").count()


def _csv(spark, name, lines):
    path = shared_dir(spark, f"src-{name}")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


HEADER = "user_session,user_id,event_time,category_id,product_id,event_type,session_value"


def test_columns_by_name_and_text_ids(spark):
    path = _csv(spark, "names", [HEADER, "S1,USER_1,2025-01-01 10:00:00,CAT_2,PROD_3,BUY,7.5", "S1,USER_2,2025-01-01 10:01:00,CAT_4,PROD_5,VIEW,7.5"])
    rows = scan_events(spark, path, fmt="csv", split="train").orderBy("event_time").collect()
    assert [(r.product_id, r.category_id, r.user_id, r.event_type, r.session_value, r.split) for r in rows] == [
        ("PROD_3", "CAT_2", "USER_1", "BUY", 7.5, "train"),
        ("PROD_5", "CAT_4", "USER_2", "VIEW", 7.5, "train"),
    ]
    assert rows[0].event_id < rows[1].event_id  # built from the order of the rows
    from clickflow.operators.triage import triage_sessions

    assert [r.session_class for r in triage_sessions(scan_events(spark, path, fmt="csv", split="train")).collect()] == ["anomalous"]


def test_bad_rows_raise_or_go_to_quarantine(spark):
    from clickflow.sources.events import quarantine

    path = _csv(
        spark,
        "bad",
        [HEADER, "S1,U,2025-01-01 10:00:00,C,P,BUY,1.0", "S2,U,yesterday,C,P,BUY,1.0", ",U,2025-01-01 10:00:00,C,P,BUY,1.0", "S3,U,2025-01-01 10:00:00,C,P,BUY,much"],
    )
    with pytest.raises(Exception):
        scan_events(spark, path, fmt="csv", split="train").collect()
    good = scan_events(spark, path, fmt="csv", split="train", strict=False).collect()
    assert [r.user_session for r in good] == ["S1"]
    bad = quarantine(spark, path, fmt="csv", split="train").collect()
    assert sorted(r for b in bad for r in b.reasons) == ["bad event_time", "bad session_value", "null user_session"]


def test_missing_column_and_unknown_format(spark):
    path = _csv(spark, "short", ["user_session,user_id", "S,U"])
    with pytest.raises(ValueError, match="event_time"):
        scan_events(spark, path, fmt="csv", split="train")
    with pytest.raises(ValueError):
        scan_events(spark, path, fmt="json", split="train")


def test_parquet_folder_without_suffix(spark):
    ev = clickstream(spark, "/root/testdata/sf0.001")
    path = shared_dir(spark, "src-plain-folder")
    ev.write.mode("overwrite").parquet(path)
    assert scan_events(spark, path).count() == ev.count()


def test_hot_session_is_dealt_over_tasks(spark, make_events):
    """Half of the events in one session, no broadcast: AQE splits the hot partition of the join."""
    from clickflow.operators.triage import clean_events

    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "8k")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    try:
        n = 40_000
        ev = spark.range(n, numPartitions=8).select(
            F.col("id").alias("event_id"),
            F.expr("timestamp_ntz'2025-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id)").alias("event_time"),
            F.lit("VIEW").alias("event_type"), (F.col("id") % 50).alias("product_id"), (F.col("id") % 5).alias("category_id"),
            F.when((F.col("id") % 997 == 3) & (F.col("id") % 2 == 1), F.col("id")).otherwise(1).alias("user_id"),
            F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 997)).alias("user_session"),
            F.lit(1.0).alias("session_value"), F.lit("train").alias("split"),
        )
        rows = clean_events(ev).withColumn("t", F.spark_partition_id()).groupBy("t").count().collect()
        gone = sum(1 for i in range(n) if i % 997 == 3 and i % 2 == 1)
        assert gone and sum(r["count"] for r in rows) == n - gone
        assert max(r["count"] for r in rows) < n / 3
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_layouts_of_one_folder_are_united(spark, tmp_path):
    base = "event_time,event_type,product_id,category_id,user_id,user_session"
    (tmp_path / "a.csv").write_text(f"{base}\n2024-01-01 10:00:00,VIEW,p1,c1,u1,s1\n")
    (tmp_path / "b.csv").write_text('\ufeffuser_session,"note, long",user_id,category_id,product_id,event_type,event_time\n'
                                    's2,"two\nlines",u2,c2,"p ""2""\nend",BUY,2024-01-01 11:00:00\n')
    import gzip

    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(f"{base}\n2024-01-01 12:00:00,VIEW,p3,,u3,s3\n".encode()))
    (tmp_path / "d.csv").write_text("")
    assert sorted(map(len, csv_layouts(spark, str(tmp_path)).values())) == [1, 2]
    rows = scan_events(spark, str(tmp_path), fmt="csv", split="train").orderBy("event_time").collect()
    assert [(r.user_session, r.event_type, r.product_id, r.category_id, r.user_id) for r in rows] == [
        ("s1", "VIEW", "p1", "c1", "u1"), ("s2", "BUY", 'p "2"\nend', "c2", "u2"), ("s3", "VIEW", "p3", None, "u3")]
    (tmp_path / "e.csv").write_text("event_time,user_id\n2024-01-01 10:00:00,u\n")
    with pytest.raises(ValueError, match="e.csv lacks the columns event_type"):
        scan_events(spark, str(tmp_path), fmt="csv", split="train")


def test_ids_of_two_splits_differ_and_null_times_raise(spark, tmp_path):
    base = "event_time,event_type,product_id,category_id,user_id,user_session"
    for name in ("train", "test"):
        (tmp_path / f"{name}.csv").write_text(f"{base}\n2024-01-01 10:00:00,VIEW,p1,c1,u1,s1\n")
    rows = scan_splits(spark, str(tmp_path / "train.csv"), str(tmp_path / "test.csv"), fmt="csv").collect()
    assert len({r.event_id for r in rows}) == 2 and {r.split for r in rows} == {"train", "test"}
    bad = tmp_path / "bad.csv"
    bad.write_text(f"{base}\n,VIEW,p1,c1,u1,s1\n")
    with pytest.raises(Exception, match="null event_time"):
        scan_events(spark, str(bad), fmt="csv", split="train").collect()
    assert scan_events(spark, str(bad), fmt="csv", split="train", strict=False).collect() == []


def test_missing_inputs_are_named_together(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n2\n")
    (tmp_path / "b.csv").write_text("x\n")
    paths = {n: str(tmp_path / f"{n}.csv") for n in "abc"}
    status = input_status(spark, paths)
    assert {tuple(r) for r in status.collect()} == {("a", True, 2), ("b", True, 0), ("c", False, None)}
    with pytest.raises(FileNotFoundError, match="empty inputs: b, c"):
        require_inputs(status)
    require_inputs(status.where("name = 'a'"))
