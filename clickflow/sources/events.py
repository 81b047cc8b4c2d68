"""Event sources.

``scan_events`` reads a click-event export (CSV with a header, or parquet) by column
name, ids as text. ``quarantine`` returns the rows of the same export that do not fit, with
the reasons. ``clickstream`` derives the same event model from the generic ``events`` table
of a test-data folder (the fixture of FIXTURES.md F-1), so every query grows with that table.
"""

from __future__ import annotations

import csv
import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickflow.operators.joins import by_session
from clickflow.schema import LABEL, SESSION, SPLITS

#: Columns an export must have; ``event_id``, ``session_value`` and ``split`` may be absent.
REQUIRED = ("event_time", "event_type", "product_id", "category_id", "user_id", SESSION)
CORRUPT = "_corrupt_row"


def parse_event_time(col: Column | str, strict: bool = True) -> Column:
    """S3: text to wall-clock timestamp. ``strict`` raises on bad text (ANSI
    CAST_INVALID_INPUT); otherwise bad text becomes null for quarantine."""
    c = F.col(col) if isinstance(col, str) else col
    return F.to_timestamp_ntz(c) if strict else F.try_to_timestamp(c).cast("timestamp_ntz")


def format_of(spark: SparkSession, path: str) -> str:
    """``csv`` or ``parquet`` by the names of the data files, not by the folder's name."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return "parquet"  # the read itself reports the missing path
    names = [st.getPath().getName() for st in fs.listStatus(where) if not st.getPath().getName().startswith(("_", "."))]
    if names and all(".parquet" in n for n in names):
        return "parquet"
    if names and all(".csv" in n or ".txt" in n for n in names):
        return "csv"
    raise ValueError(f"give fmt ('csv' or 'parquet'): cannot tell it from the files of {path}")


def _first_line(spark: SparkSession, file) -> str | None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    stream = file.getFileSystem(conf).open(file)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
        inner = stream if codec is None else codec.createInputStream(stream)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(inner, "UTF-8")).readLine()
    finally:
        stream.close()


def csv_layouts(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of a CSV file or folder by the columns of their header lines. The first line of each file is read,
    by a few threads of the driver; empty files have no layout."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        spark.read.csv(path)  # raises with Spark's own error
    files = [st.getPath() for st in fs.listStatus(where) if st.isFile() and not st.getPath().getName().startswith(("_", "."))]
    files.sort(key=lambda f: f.toString())
    out: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(16) as pool:
        for file, line in zip(files, pool.map(lambda f: _first_line(spark, f), files)):
            if line:
                columns = tuple(next(csv.reader([line.removeprefix("\ufeff")])))
                out.setdefault(columns, []).append(file.toString())
    return out


def _read_csv(spark: SparkSession, path: str, strict: bool, multiline: bool) -> DataFrame:
    """The files of each layout under their own header, united by name; values as text."""
    parts = []
    for names, files in csv_layouts(spark, path).items():
        missing = [c for c in REQUIRED if c not in names]
        if missing:
            raise ValueError(f"{files[0]} lacks the columns {', '.join(missing)}")
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        reader = spark.read.option("header", True).option("enforceSchema", False).option("multiLine", multiline).option("escape", '"')
        if strict:
            parts.append(reader.option("mode", "FAILFAST").schema(schema).csv(files))
        else:
            schema = schema.add(CORRUPT, T.StringType())
            parts.append(reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(files))
    if not parts:
        raise ValueError(f"{path} has no file with a header line")
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p, allowMissingColumns=True)
    return raw


def _read_raw(spark: SparkSession, path: str, fmt: str | None, strict: bool, multiline: bool = True) -> DataFrame:
    """The export's columns under their own names; CSV values as text. Rows that break the CSV
    form raise if strict, else carry their text in a column of their own."""
    fmt = fmt or format_of(spark, path)
    if fmt == "csv":
        return _read_csv(spark, path, strict, multiline)
    if fmt != "parquet":
        raise ValueError(f"unknown format {fmt!r}")
    raw = spark.read.parquet(path)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return raw


def _typed(raw: DataFrame, strict: bool, split: str | None, tie_break: str) -> DataFrame:
    """Event columns and ``reasons`` (why a row does not fit; empty if it does)."""
    reasons: list[Column] = []

    def number(name: str, kind: str) -> Column:
        if strict:
            return F.col(name).cast(kind)
        out = F.col(name).try_cast(kind)
        reasons.append(F.when(F.col(name).isNotNull() & out.isNull(), F.lit(f"bad {name}")))
        return out

    time = F.col("event_time").cast("string")
    parsed = parse_event_time(time, strict)
    if strict:  # a missing time does not fit either
        parsed = F.when(time.isNull(), F.raise_error(F.lit("null event_time")).cast("timestamp_ntz")).otherwise(parsed)
    reasons.append(F.when(parsed.isNull(), F.lit("bad event_time")))
    reasons.append(F.when(F.col(SESSION).isNull(), F.lit(f"null {SESSION}")))
    if CORRUPT in raw.columns:
        reasons.append(F.when(F.col(CORRUPT).isNotNull(), F.lit("bad row")))
    # without a tie-break column, the order of the rows in the files breaks ties of time
    event_id = number(tie_break, "long") if tie_break in raw.columns else F.monotonically_increasing_id()
    label = number(LABEL, "double") if LABEL in raw.columns else F.lit(None).cast("double")
    if split is None and "split" not in raw.columns:
        raise ValueError("the export has no split column: give split")
    side = F.lit(split) if split is not None else F.col("split").cast("string")
    if split is None:
        reasons.append(F.when(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), F.lit("bad split")))
    kept = [F.col(c).cast("string").alias(c) for c in ("event_type", "product_id", "category_id", "user_id", SESSION)]
    why = F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("reasons")
    return raw.select(event_id.alias("event_id"), parsed.alias("event_time"), *kept, label.alias(LABEL), side.alias("split"), why)


def scan_events(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    strict: bool = True,
    split: str | None = None,
    tie_break: str = "event_id",
    multiline: bool = True,
) -> DataFrame:
    """Read an event export by column name; ids stay text.

    The CSV files of a folder may have different headers (other orders, further columns). Fields may hold line
    breaks in quotes; a file is then read by one task, so turn ``multiline`` off for huge files without them.
    ``strict`` raises on a value or row that does not fit (a null session key is kept, as the
    operators define it); otherwise rows that ``quarantine`` would return are left out. A missing
    path raises AnalysisException (PATH_NOT_FOUND), which is left to surface (S2).
    """
    typed = _typed(_read_raw(spark, path, fmt, strict, multiline), strict, split, tie_break)
    return (typed if strict else typed.where(F.size("reasons") == 0)).drop("reasons")


def quarantine(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    split: str | None = None,
    tie_break: str = "event_id",
    multiline: bool = True,
) -> DataFrame:
    """S3: the rows of an export that do not fit, with all their reasons."""
    return _typed(_read_raw(spark, path, fmt, False, multiline), False, split, tie_break).where(F.size("reasons") > 0)


def scan_splits(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    fmt: str | None = None,
    strict: bool = True,
    tie_break: str = "event_id",
    multiline: bool = True,
) -> DataFrame:
    """S1 for the two-file layout (train with labels, test without), tagged with ``split``. Without a
    tie-break column the ids are numbered over both."""
    raw = [
        _read_raw(spark, path, fmt, strict, multiline).withColumn("split", F.lit(split))
        for path, split in ((train_path, "train"), (test_path, "test"))
    ]
    typed = _typed(raw[0].unionByName(raw[1], allowMissingColumns=True), strict, None, tie_break)
    return (typed if strict else typed.where(F.size("reasons") == 0)).drop("reasons")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived click events (FIXTURES.md F-1) in the event schema.

    The per-session label is a sum over the session: computed as a grouped
    aggregate (map-side partial sums, so a hot session does not land in one
    task) and joined back on the session key, instead of a window over the
    session.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    e = ev.select(
        "event_id",
        F.col("ts").alias("event_time"),
        "user_id",
        "value",
        F.when(F.col("event_type") == "click", "ADD_CART")
        .when(F.col("event_type") == "error", "REMOVE_CART")
        .when(F.col("event_type") == "purchase", "BUY")
        .otherwise("VIEW")
        .alias("event_type"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.dayofmonth("ts").alias("dom"),
        F.when(F.col("user_id") % 25 < 2, F.col("user_id") - F.col("user_id") % 25)
        .otherwise(F.col("user_id"))
        .alias("su"),
    )
    k = e.select(
        "*",
        F.concat(F.lit("S_"), F.col("su").cast("string"), F.lit("_"), F.col("dom").cast("string")).alias(SESSION),
        ((F.col("su") + F.col("dom")) % 10).alias("b"),
    )
    cents = k.groupBy(SESSION).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("_cents"))
    out = by_session(k, cents, "left")
    return out.select(
        "event_id",
        "event_time",
        "event_type",
        F.col("k").cast("long").alias("product_id"),
        (F.col("k") % 12).cast("long").alias("category_id"),
        "user_id",
        SESSION,
        (F.col("_cents").cast("double") / 100).alias("session_value"),
        F.when(F.col("b") < 6, "train")
        .when(F.col("b") < 9, "test")
        .when(F.col("event_id") % 2 == 0, "train")
        .otherwise("test")
        .alias("split"),
    )


# DuckDB text of the same derivation, used by the oracle SQL of every query.
CLICKSTREAM_SQL = """
clk_e as (
  select event_id, ts as event_time, user_id, value,
         case event_type when 'click' then 'ADD_CART' when 'error' then 'REMOVE_CART'
                         when 'purchase' then 'BUY' else 'VIEW' end as event_type,
         cast(json_extract_string(props, '$.k') as int) as k, day(ts) as dom,
         case when user_id % 25 < 2 then user_id - user_id % 25 else user_id end as su
  from events),
clk_k as (
  select *, concat('S_', cast(su as varchar), '_', cast(dom as varchar)) as user_session,
         (su + dom) % 10 as b
  from clk_e),
clk as (
  select event_id, event_time, event_type, cast(k as bigint) as product_id,
         cast(k % 12 as bigint) as category_id, user_id, user_session,
         cast(sum(cast(round(value * 100) as bigint)) over (partition by user_session) as double) / 100
           as session_value,
         case when b < 6 then 'train' when b < 9 then 'test'
              when event_id % 2 = 0 then 'train' else 'test' end as split
  from clk_k)
"""
