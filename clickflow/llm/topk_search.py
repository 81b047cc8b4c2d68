"""Exact top-k search by integer inner product with a bit-sliced index.

Components are quantised to whole numbers. A block of rows is turned on its side: for each component
and bit one bitmap over the rows of the block (the slices). The scores of a query against all rows of the
block come from bitmap arithmetic alone: a slice is added once for every signed binary digit of the query's
component, with full adders over bitmaps, which gives the slices of the sums. Walking these from the most
significant slice down finds the k-th largest sum and the rows at the boundary.

Only the most significant bits of a component are sliced. What the lower bits can add is bounded for each
query; all rows within that bound of the k-th largest sum are resolved exactly from their components.

Queries and rows meet in a grid: every cell has one group of queries and one part of the rows, both of
bounded size. Rows are dealt to the parts by position, so that no id or vector fills a part. Rows of a cell are
streamed in blocks, and each block leaves at most k rows for each query.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id,
take no part; an empty vector scores 0; components that a shorter vector lacks count as 0. A query's own row
is every row with its id. A repeated query id is asked once, with its smallest vector; repeated rows of
other ids are candidates each. Ties go to the smaller id. A query without candidates has no row. Scores
must fit in 64 bits, else the search raises. Ids are whole numbers; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickflow.llm.common import Store, table

SLICED = 5  # most significant bits of a component that are sliced
BLOCK = 1 << 21  # components of a block of rows
PART = 32_768  # rows of a part of the grid
GROUP = 16_384  # queries of a group of the grid


# --- bitmaps ----------------------------------------------------------------


def bitmaps(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(flags, axis=1, bitorder="little")
    words = np.zeros((len(flags), -(-flags.shape[1] // 64) * 8), np.uint8)
    words[:, : packed.shape[1]] = packed
    return words.view(np.uint64)


def positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def add_slices(levels: list[np.ndarray]) -> list[np.ndarray]:
    """Slices of the sum, from bitmaps that count 2**i each in level i: three bitmaps of a level make one of it
    and a carry to the next, until one is left."""
    out, carried, i = [], [], 0
    while i < len(levels) or carried:
        stack = np.concatenate([*levels[i : i + 1], *carried])
        carried = []
        while len(stack) > 2:
            m = len(stack) // 3
            a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
            half = a ^ b
            carried.append((a & b) | (c & half))
            stack = np.concatenate([half ^ c, stack[3 * m :]])
        if len(stack) == 2:
            carried.append((stack[0] & stack[1])[None])
            stack = (stack[0] ^ stack[1])[None]
        if len(stack):
            out.append(stack[0])
        else:
            out.append(np.zeros(levels[0].shape[1], np.uint64))
        carried = [c for c in carried if len(c)]
        i += 1
    return out


def kth_largest(slices: list[np.ndarray], alive: np.ndarray, k: int) -> int:
    """The k-th largest number among the rows of ``alive`` (which has k rows at least)."""
    value = 0
    for i in range(len(slices) - 1, -1, -1):
        ones = alive & slices[i]
        n = count(ones)
        if n >= k:
            alive, value = ones, value | 1 << i
        else:
            alive, k = alive & ~slices[i], k - n
    return value


def at_least(slices: list[np.ndarray], alive: np.ndarray, bound: int) -> np.ndarray:
    """The rows of ``alive`` whose number is ``bound`` or more."""
    more, equal = np.zeros_like(alive), alive
    for i in range(len(slices) - 1, -1, -1):
        if bound >> i & 1:
            equal = equal & slices[i]
        else:
            more |= equal & slices[i]
            equal = equal & ~slices[i]
    return more | equal


class Block:
    """Bit-sliced index of a block of rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, sliced: int = SLICED):
        self.ids, self.values = ids, values
        n, self.dims = values.shape
        base = int(values.min()) if values.size else 0
        spread = int(values.max()) - base if values.size else 0
        self.largest = max(abs(base), abs(base + spread))
        self.low = max(spread.bit_length() - sliced, 0)
        high = ((values - base) >> self.low).T
        self.bits = max(spread.bit_length() - self.low, 1)
        ones = np.concatenate([bitmaps((high >> i & 1).astype(bool)) for i in range(self.bits)])
        self.rows = bitmaps(np.ones((1, n), bool))[0]
        # slice i of component d stands at i * dims + d; its complement (within the rows) behind all of them
        self.slices = np.concatenate([ones, ~ones & self.rows])

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of the rows' sums with the query (shifted by a constant). A digit -1 adds the complement."""
        size = np.abs(query)
        thrice = 3 * size
        plus, minus = (thrice & ~size) >> 1, (size & ~thrice) >> 1  # the non-adjacent form of the component
        plus, minus = np.where(query < 0, minus, plus), np.where(query < 0, plus, minus)
        digits = int(max(plus.max(initial=0), minus.max(initial=0))).bit_length()
        levels: list[list[np.ndarray]] = [[] for _ in range(digits + self.bits - 1)]
        for j in range(digits):
            which = np.concatenate([np.flatnonzero(plus >> j & 1), np.flatnonzero(minus >> j & 1) + self.bits * self.dims])
            for i in range(self.bits):
                levels[i + j].append(which + i * self.dims)
        return add_slices([self.slices[np.concatenate(x)] for x in levels])

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than ``own``."""
        width = max(self.dims, len(query))
        query = np.pad(query, (0, width - len(query)))[: self.dims]
        reach = int(np.abs(query).max(initial=0))
        if reach * self.largest * self.dims >= 1 << 63:
            raise OverflowError("a score does not fit in 64 bits: scale the vectors down")
        alive = self.rows
        mine = np.flatnonzero(self.ids == own)
        if len(mine):
            alive = alive.copy()
            np.bitwise_and.at(alive, mine >> 6, ~(np.uint64(1) << (mine & 63).astype(np.uint64)))
        if count(alive) > k and reach:
            slices = self.sums(query)
            kth = kth_largest(slices, alive, k)
            doubt = int(np.abs(query).sum()) * ((1 << self.low) - 1) >> self.low
            alive = at_least(slices, alive, max(kth - doubt, 0))
        rows = positions(alive)
        scores = self.values[rows] @ query
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][order], scores[order]


# --- Spark --------------------------------------------------------------------


def usable(vector: str) -> Column:
    """Vectors without null or non-finite components (NaN is above every number)."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def quantised(scale: float):
    """Vectors as packed whole numbers floor(scale * x), of 2 bytes where all of a batch fit, else 8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            flat = np.floor(scale * col.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            if len(flat) and np.abs(flat).max() >= 2.0**62:
                raise OverflowError("a component does not fit in 64 bits: scale the vectors down")
            flat = flat.astype(np.int64)
            size = 2 if not len(flat) or (-32768 <= flat.min() and flat.max() < 32768) else 8
            ends = np.zeros(batch.num_rows + 1, np.int64)
            np.cumsum(pa.compute.list_value_length(col).to_numpy(zero_copy_only=False), out=ends[1:])
            data = flat.astype("<i2" if size == 2 else "<i8").tobytes()
            packed = pa.Array.from_buffers(
                pa.large_binary(), batch.num_rows, [None, pa.py_buffer((ends * size).tobytes()), pa.py_buffer(data)]
            )
            wide = pa.array(np.full(batch.num_rows, size, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), wide, packed.cast(pa.binary())], names=["id", "size", "v"])

    return run


def unpacked(size: np.ndarray, packed: list[bytes]) -> np.ndarray:
    """Matrix of the vectors; what a shorter one lacks is 0."""
    rows = [np.frombuffer(v, "<i2" if s == 2 else "<i8") for s, v in zip(size.tolist(), packed)]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def searched(k: int, sliced: int):
    """Answers of every cell: its queries come first, then its rows, in blocks."""

    def answers(queries: list, block: list) -> pa.RecordBatch:
        index = Block(np.concatenate([b[0] for b in block]), unpacked(np.concatenate([b[1] for b in block]), [v for b in block for v in b[2]]), sliced)
        found = [(own, *index.best(own, query, k)) for own, query in queries]
        asked = np.repeat(np.array([own for own, *_ in found], np.int64), [len(ids) for _, ids, _ in found])
        ids = np.concatenate([np.empty(0, np.int64), *[ids for _, ids, _ in found]])
        scores = np.concatenate([np.empty(0, np.int64), *[s for _, _, s in found]])
        return pa.RecordBatch.from_arrays([pa.array(asked), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, block, held = None, [], [], 0
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)])
            ids, size, packed = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_pylist()
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if cell != (here := tuple(key[:2, a].tolist())):
                    if block and queries:
                        yield answers(queries, block)
                    cell, queries, block, held = here, [], [], 0
                if key[2, a] == 0:
                    queries += zip(ids[a:b].tolist(), unpacked(size[a:b], packed[a:b]))
                    continue
                while queries and a < b:
                    width = max(len(v) for v in packed[a:b]) // 2 + 1
                    to = min(b, a + max(1, (BLOCK - held) // width))
                    block.append((ids[a:to], size[a:to], packed[a:to]))
                    held, a = held + (to - a) * width, to
                    if held + width > BLOCK:
                        yield answers(queries, block)
                        block, held = [], 0
        if block and queries:
            yield answers(queries, block)

    return run


def top_k(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: float = 256.0,
    sliced: int = SLICED,
    part: int = PART,
    group: int = GROUP,
) -> DataFrame:
    """For every row of ``queries`` the k rows of ``rows`` with the highest inner product of
    floor(scale * x): query_id, rank (from 1), vec_id, score.

    ``part`` and ``group`` bound the rows and queries of a cell; small inputs get smaller cells, so that
    all cores have one. The result depends on neither, nor on ``sliced``.
    """
    spark = rows.sparkSession
    store = Store(spark, "topk")
    packed = "id long, size int, v binary"

    def usable_rows(df: DataFrame) -> DataFrame:
        kept = df.where(F.col(key).isNotNull() & usable(vector))
        return kept.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))

    all_rows = store.put(usable_rows(rows).mapInArrow(quantised(scale), packed), "rows")
    asked = usable_rows(queries).groupBy("id").agg(F.min("x").alias("x"))
    asked = store.put(asked.mapInArrow(quantised(scale), packed), "queries")
    n, q = all_rows.count(), asked.count()
    cores = spark.sparkContext.defaultParallelism
    parts = max(-(-n // part), min(4 * cores, -(-n // (part // 4 or 1))), 1)
    groups = max(-(-q // group), -(-min(4 * cores, q) // parts), 1)
    place = F.monotonically_increasing_id()  # by position: no id fills a part
    dealt = all_rows.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64(place), F.lit(parts)).cast("int").alias("p"), F.lit(1).alias("kind"), "*")
    sent = asked.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), F.lit(0).alias("kind"), "*")
    tasks = min(parts * groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores))
    cells = sent.unionByName(dealt).repartition(tasks, "g", "p").sortWithinPartitions("g", "p", "kind")
    found = cells.mapInArrow(searched(k, sliced), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_topk_search(spark, sf_dir: str) -> DataFrame:
    """The 5 best rows for every embedding whose vec_id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"))
