"""Shared pieces of the training-data operators.

Tables are read with Spark's readers only. Intermediate tables go to the folder
that the session names in ``spark.checkpoint.dir`` (shared by all machines).
The array helpers below work on one Arrow batch inside a task.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
ROWS_PER_FILE = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; remainder 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


class Store:
    """Written intermediate tables of one operator call, in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith(
                "local-cluster"
            ):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            base = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="clickflow-")
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write and read back: cuts the lineage, and later joins get exchanges of their own.

        ``rows`` is a bound on the table's size where one is known; small tables get few files.
        """
        path = f"{self.root}/{name}"
        if rows is not None:
            df = df.coalesce(-(-max(rows, 1) // ROWS_PER_FILE))
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


# --- text as arrays -------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240611)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 21)
        seq = np.full(size, base, np.uint64)
        seq[0] = 1
        have = _powers[base] = np.multiply.accumulate(seq)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64 over an array of unsigned 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows in order, in pieces of about ``limit`` bytes of text (one long text may exceed it)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    if offs is None or not len(col):
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def spans_of(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that cross no row border: starts, ends (exclusive), row of each."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    border = np.zeros(len(inside) + 1, bool)
    border[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | border[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | border[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offs, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, by one running sum over the bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(data) + 1)[starts])


def doc_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row, A-Z lower-cased: hashes, row numbers, first word of each row."""
    data, offs = text_bytes(col)
    data = LOWER[data]
    starts, ends, row = spans_of(~SPACE[data], offs)
    return word_hashes(data, starts, ends), row, np.searchsorted(row, np.arange(len(offs)))


def shingle_sets(col: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct hashes of its word shingles (whole text if it has fewer words)."""
    words, _, first = doc_words(col)
    n = len(words)
    full = np.zeros(n, np.uint64)
    for k in range(width):
        full[: n - k] += words[k:] * np.uint64((0xD1342543DE82EF95 * (2 * k + 1) | 1) & MASK)
    full = mix(full)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(full[a : b - width + 1])
        elif b > a:
            short = np.array([(b - a) * 0x632BE59BD9B4E019 & MASK], np.uint64)
            for k in range(a, b):
                short = mix(short + words[k : k + 1] * np.uint64((0xD1342543DE82EF95 * (2 * (k - a) + 1) | 1) & MASK))
            yield short
        else:
            yield np.empty(0, np.uint64)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrow list column from one array for each row."""
    offs = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offs[1:])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, kind))


# --- connected components -------------------------------------------------


def components(store: Store, edges: DataFrame, name: str = "cc", rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each id that has an edge: (id, component).

    Alternating large-star and small-star steps over a written edge table. Each step
    is a minimum by key (combined before the shuffle) and a join with written tables,
    so AQE can split the rows of a hub. Edges stay on the executors.
    """
    now = store.put(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0"
    )
    n, state = now.count(), None
    for k in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = store.put(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-{k}a", 2 * n)
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = store.put(large, f"{name}-{k}b", n)
        low2 = store.put(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{k}c", n)
        small = large.join(low2, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low2.select("u", F.col("m").alias("v"))
        )
        after = store.put(small.where("u <> v").distinct(), f"{name}-{k}", n)
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        store.drop(f"{name}-{k - 1}", f"{name}-{k}a", f"{name}-{k}b", f"{name}-{k}c")
        now, n = after, seen[0]
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
