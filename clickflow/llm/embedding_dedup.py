"""Near-duplicate embeddings by NN-descent, within labels, in double precision.

1. Equal vectors of one label are one node with a weight (their number).
2. First lists: for each of several random projections, vectors are sorted by label, sign code and
   projection (a range exchange), and neighbours within short stretches of that order give each
   node its best ``size`` neighbours so far.
3. NN-descent: at each node, its neighbours (in both directions, lists of hubs split by hash) are
   compared with each other; better partners replace worse ones. A few rounds settle the lists.
4. Wherever vectors are compared, pairs of cosine >= threshold join the graph whether or not a list has
   room for them: each compared group gives a spanning star of each of its connected parts. The
   graph's components are then compared in full, in blocks of ``block`` nodes against blocks,
   counting links without listing them.
5. A node whose list holds nothing but threshold edges is saturated. Another round with new projections
   follows, in which pairs inside one component are passed over, so that all places of a list go to
   nodes beyond it, until no list is saturated.
6. Audit: a hash-drawn sample of ``audit`` nodes is compared with all nodes of their labels. Links that
   the graph lacks are added; while recall is under ``target``, another round with new projections
   follows. Recall is the share of a node's links that are counted in step 4, averaged over nodes with
   links, and also over components (the lower one holds), so that a large group cannot hide lost pairs.
7. If ``rounds`` rounds do not settle it, all nodes of a label are compared in blocks.

Links are between rows of equal, non-null label and equal dimension. Vectors that are null, empty, zero or
hold null or non-finite components link with nothing. Equal vectors link with each other.
Ties in a list go to the smaller id. Ids are unique whole numbers. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickflow.llm.common import Store, components, table
from clickflow.llm.line_dedup import connected
from clickflow.llm.suffix_dedup import groups_of

STRETCH = 64
EXACT = 1024  # block of the comparison of whole labels


def matrix(col) -> np.ndarray:
    """Rows of a list column as a (rows, dimensions) array of doubles scaled to length 1."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def best(ids: np.ndarray, cell: np.ndarray, sims: np.ndarray, size: int, threshold: float, floor: np.ndarray | None = None):
    """(id, nbr, sim, link) of the best partners of each row of a similarity matrix, above the row's floor, and of all links.

    Pairs of one cell are passed over. Links: a star for each connected part of the pairs >= threshold.
    """
    n = len(ids)
    sims[cell[:, None] == cell[None, :]] = -2.0
    k = min(size, n - 1)
    if k < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool)
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    row = np.repeat(np.arange(n), k)
    at = at.ravel()
    sim = sims[row, at]
    use = (ids[row] != ids[at]) & (sim > -2.0)
    if floor is not None:
        use &= sim > floor[row]
    a, b, s = ids[row[use]], ids[at[use]], sim[use]
    x, y = star(sims >= threshold)
    link = np.repeat([False, True], [len(a), len(x)])
    return np.concatenate([a, ids[x]]), np.concatenate([b, ids[y]]), np.concatenate([s, np.full(len(x), threshold)]), link


def star(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that hold the connected parts of a boolean matrix together: each with the first of its part."""
    label = connected(len(linked), *np.nonzero(linked))
    moved = np.flatnonzero(label != np.arange(len(linked)))
    return moved, label[moved]


def batch_of(parts: list[tuple]) -> pa.RecordBatch:
    a, b, s, link = (np.concatenate([p[i] for p in parts]) for i in range(4))
    cols = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64()), pa.array(link, pa.bool_())]
    return pa.RecordBatch.from_arrays(cols, names=["id", "nbr", "sim", "link"])


LIST = "id long, nbr long, sim double, link boolean"


def stretches(nodes: DataFrame, seed: int, bits: int, size: int, threshold: float) -> DataFrame:
    """List entries from neighbours in the order of one random projection."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            for d in np.unique(dim).tolist():
                part = batch.filter(pa.array(dim == d))
                plane = np.random.default_rng([seed, d]).normal(size=(d, bits + 1))
                y = matrix(part.column("v")) @ plane
                code = ((y[:, :bits] > 0) @ (1 << np.arange(bits)[::-1])).astype(np.int64) if bits else np.zeros(len(y), np.int64)
                # neighbouring codes differ in one sign
                gray = code.copy()
                for s in (1, 2, 4, 8, 16):
                    gray ^= gray >> s
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("dim"), pa.array(gray), pa.array(y[:, bits]), part.column("id"), part.column("cell"), part.column("v")], names=names)

    names = ["label", "dim", "code", "along", "id", "cell", "v"]
    kind = nodes.schema["v"].dataType.simpleString()
    order = ["label", "dim", "code", "along", "id"]
    schema = f"label {nodes.schema['label'].dataType.simpleString()}, dim int, code long, along double, id long, cell long, v {kind}"
    near = nodes.select("label", "dim", "id", "cell", "v").mapInArrow(project, schema).repartitionByRange(*order).sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None  # last half stretch, so that stretches overlap
        for batch in batches:
            t = pa.Table.from_batches(([tail] if tail is not None else []) + [batch]).combine_chunks()
            n, parts = t.num_rows, []
            label, dim = t.column("label").to_numpy(zero_copy_only=False), t.column("dim").to_numpy()
            cut = [0, *(np.flatnonzero((label[1:] != label[:-1]) | (dim[1:] != dim[:-1])) + 1).tolist(), n]
            ids, cell = t.column("id").to_numpy(), t.column("cell").to_numpy()
            for a, z in zip(cut, cut[1:]):
                x = matrix(t.column("v").slice(a, z - a))
                for i in range(a, max(a + 1, z - STRETCH // 2), STRETCH // 2):
                    j = min(z, i + STRETCH)
                    y = x[i - a : j - a]
                    parts.append(best(ids[i:j], cell[i:j], y @ y.T, size, threshold))
            yield batch_of(parts)
            tail = t.slice(max(0, n - STRETCH // 2)).to_batches()[0]

    return near.mapInArrow(compare, LIST)


def top(entries: DataFrame, size: int) -> DataFrame:
    """The best ``size`` entries of each node, and all links."""
    entries = entries.groupBy("id", "link", "nbr").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("id", "link").orderBy(F.desc("sim"), "nbr"))
    return entries.withColumn("rank", rank).where(F.col("link") | (F.col("rank") <= size)).select("id", "nbr", "sim", "link")


def local_joins(lists: DataFrame, nodes: DataFrame, size: int, threshold: float, store: Store, name: str, total: int) -> DataFrame:
    """Entries found by comparing the neighbours of each node with each other."""
    near = lists.select(F.col("id").alias("m"), F.col("nbr").alias("x")).unionByName(lists.select(F.col("nbr").alias("m"), F.col("id").alias("x"))).distinct()
    degree = store.put(near.groupBy("m").agg(F.ceil(F.count("*") / STRETCH).alias("parts")), f"{name}-degree", total)
    floor = lists.groupBy("id").agg(F.when(F.count("*") >= size, F.min("sim")).otherwise(F.lit(-2.0)).alias("floor"))
    known = store.put(nodes.select("id", "cell", "v").join(floor, "id"), f"{name}-known", 10 * total)
    near = near.join(degree, "m").select("m", F.pmod(F.xxhash64("x"), F.col("parts")).alias("part"), F.col("x").alias("id"))
    sent = near.join(known, "id").select("m", "part", "id", "cell", "floor", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, 2, 4_000):
            t = t.combine_chunks()
            m, part, ids, cell, floor = (t.column(c).to_numpy() for c in range(5))
            x = matrix(t.column("v"))
            cut = [0, *(np.flatnonzero((m[1:] != m[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(m)]
            parts = [best(ids[a:b], cell[a:b], x[a:b] @ x[a:b].T, size, threshold, floor[a:b]) for a, b in zip(cut, cut[1:]) if b - a > 1]
            if parts:
                yield batch_of(parts)

    return sent.repartition("m", "part").sortWithinPartitions("m", "part").mapInArrow(compare, LIST)


def block_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links): weight of the nodes linked to each node within its (cell, i, j) groups.

    members: cell, i, j, side (block of the row), id, w, v. Groups i = j compare a block with itself.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, 3, 4_000):
            t = t.combine_chunks()
            cell, i, j, side, ids, w = (t.column(c).to_numpy() for c in range(6))
            x = matrix(t.column("v"))
            cut = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1).tolist(), len(cell)]
            links = np.zeros(len(ids), np.int64)
            for a, b in zip(cut, cut[1:]):
                linked = x[a:b] @ x[a:b].T >= threshold
                np.fill_diagonal(linked, False)
                if i[a] != j[a]:
                    linked &= side[a:b, None] != side[None, a:b]
                links[a:b] = linked @ w[a:b]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], names=["id", "links"])

    near = members.select("cell", "i", "j", "side", "id", "w", "v").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "id")
    return near.mapInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def label_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that hold the components of all pairs together, by comparison of all nodes of a label in blocks."""
    sizes = nodes.groupBy("label", "dim").agg(F.min("id").alias("g"), F.ceil(F.count("*") / EXACT).alias("blocks"))
    placed = nodes.select("label", "dim", "id", "v").join(sizes, ["label", "dim"]).withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("g", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, 3, 4_000):
            t = t.combine_chunks()
            g, i, j, ids = (t.column(c).to_numpy() for c in range(4))
            cut = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1).tolist(), len(g)]
            for a, b in zip(cut, cut[1:]):
                x = matrix(t.column("v").slice(a, b - a))
                r, c = star(x @ x.T >= threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][r]), pa.array(ids[a:b][c])], names=["a", "b"])

    return placed.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(run, "a long, b long")


def audited(nodes: DataFrame, threshold: float, audit: int, seed: int, total: int) -> DataFrame:
    """All links (a, b) of a bounded sample of nodes, by comparison with every node."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    asked = nodes.where(draw < min(1.0, audit / max(total, 1))).select("id", "label", "dim", "v").toPandas()
    groups = {k: (g["id"].to_numpy(), np.array(g["v"].tolist(), np.float64)) for k, g in asked.groupby(["label", "dim"])}
    groups = {k: (i, x / np.sqrt((x * x).sum(1, keepdims=True))) for k, (i, x) in groups.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim = batch.column("label").to_numpy(zero_copy_only=False), batch.column("dim").to_numpy()
            for (k, d), (ids, q) in groups.items():
                part = batch.filter(pa.array((label == k) & (dim == d)))
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024)
                    r, c = np.nonzero(matrix(some.column("v")) @ q.T >= threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[c]), pa.array(some.column("id").to_numpy()[r])], names=["a", "b"])

    return nodes.select("id", "label", "dim", "v").mapInArrow(run, "a long, b long").where("a <> b")


def recall_of(both: DataFrame) -> float:
    """Mean share of hits over audited nodes or over their components, whichever is lower. both: a, ca (component or null), hit."""
    by_node = both.groupBy("a", F.coalesce("ca", "a").alias("c")).agg(F.avg(F.col("hit").cast("double")).alias("r"), F.sum((~F.col("hit")).cast("long")).alias("lost"))
    by_cell = by_node.groupBy("c").agg(F.sum("r").alias("r"), F.count("*").alias("nodes"), F.sum("lost").alias("lost"))
    n = by_cell.agg(F.sum("r") / F.sum("nodes"), F.avg(F.col("r") / F.col("nodes")), F.sum("lost")).first()
    return 1.0 if not n[2] else min(n[0], n[1])


def near_duplicates(
    embeddings: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
    size: int = 8,
    projections: int = 5,
    descents: int = 2,
    block: int = 256,
    audit: int = 400,
    target: float = 0.99,
    rounds: int = 4,
) -> DataFrame:
    """key, n_links (other rows linked directly), component_id (smallest key reachable), kept."""
    store = Store(embeddings.sparkSession, "embedding-dedup")
    rows = embeddings.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull()).where(fine).withColumn("dim", F.size("v"))
    # equal vectors by a hash of their numbers; the node's row has the smallest id
    twin = [F.xxhash64("label", "dim", "v").alias("h1"), F.hash("v", "dim", "label").alias("h2")]
    hashed = store.put(valid.select("id", *twin), "hashed")
    total = hashed.count()
    twins = store.put(hashed.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("w")), "twins", total)
    nodes = store.put(valid.join(twins.select("id", "w"), "id").withColumn("cell", F.col("id")), "nodes", 10 * total)  # rows with vectors: fewer for each file
    bits = min(20, max(0, math.ceil(math.log2(max(total, 1) / STRETCH)))) if total else 0

    lists, edges, settled = None, store.put(hashed.limit(0).select(F.col("id").alias("a"), F.col("id").alias("b")), "edges", 1), False
    for r in range(rounds):
        entries = None
        for p in range(projections):
            found = stretches(nodes, 1000 * r + p, bits, size, threshold)
            entries = found if entries is None else entries.unionByName(found)
        if lists is not None:  # links are inside the components now
            entries = entries.unionByName(lists.where(F.col("sim") < threshold))
        found = store.put(top(entries, size), f"lists-{r}", size * total)
        lists, links = found.where("not link"), found.where("link")
        for d in range(descents):
            better = local_joins(lists, nodes, size, threshold, store, f"join-{r}-{d}", total)
            found = store.put(top(lists.unionByName(better), size), f"lists-{r}-{d}", size * total)
            lists, links = found.where("not link"), links.unionByName(found.where("link"))
            store.drop(f"join-{r}-{d}-degree", f"join-{r}-{d}-known")
        new = links.unionByName(lists.where(F.col("sim") >= threshold)).select(F.col("id").alias("a"), F.col("nbr").alias("b"))
        edges = store.put(edges.unionByName(new), f"edges-{r}", size * total)
        cells = store.put(components(store, edges, f"cc-{r}").withColumnRenamed("component", "cell"), f"cells-{r}", total)
        truth = store.put(audited(nodes, threshold, audit, r, total), f"audit-{r}")
        both = truth.join(cells.withColumnRenamed("id", "a").withColumnRenamed("cell", "ca"), "a", "left")
        both = both.join(cells.withColumnRenamed("id", "b").withColumnRenamed("cell", "cb"), "b", "left").withColumn("hit", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)))
        recall = recall_of(both)
        if recall < 1:
            edges = edges.unionByName(both.where("not hit").select("a", "b"))
            cells = store.put(components(store, edges, f"cc-{r}-audit").withColumnRenamed("component", "cell"), f"cells-{r}-audit", total)
        full = lists.groupBy("id").agg(F.count("*").alias("n"), F.min("sim").alias("low")).where((F.col("n") >= size) & (F.col("low") >= threshold))
        if recall >= target and not full.limit(1).count():
            settled = True
            break
        if r + 1 < rounds:
            renewed = nodes.drop("cell").join(cells, "id", "left").withColumn("cell", F.coalesce("cell", "id"))
            nodes, old = store.put(renewed, f"nodes-{r}", 10 * total), f"nodes-{r - 1}" if r else "nodes"
            store.drop(old)
    if not settled:
        edges = edges.unionByName(label_links(nodes, threshold))
        cells = store.put(components(store, edges, "cc-exact").withColumnRenamed("component", "cell"), "cells-exact", total)

    # each component is compared with itself in full
    sizes = store.put(cells.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("blocks")), "sizes", total)
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    placed = cells.join(sizes, "cell").withColumn("side", own).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("cell", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "id")
    links = block_counts(placed.join(nodes.select("id", "w", "v"), "id"), threshold).join(cells, "id")
    by_twin = store.put(twins.join(links, "id", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("cell", "id").alias("c")), "by-twin", total)
    result = hashed.join(by_twin, ["h1", "h2"]).select("id", "n", "c")
    out = rows.select("id").join(result, "id", "left")
    return out.select(
        F.col("id").alias(key),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("c", "id").alias("component_id"),
        (F.coalesce("c", "id") == F.col("id")).alias("kept"),
    )


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and classes of all embeddings at cosine >= 0.93 within labels."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
