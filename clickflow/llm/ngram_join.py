"""Near-duplicate documents: Jaccard self-join of n-gram sets over prefix trees.

1. Each text becomes its set of distinct word shingles (64-bit hashes). Texts with equal sets
   share a signature; the copy with the smallest key stands for all of them.
2. Blocking, exact by the prefix principle: under one global order of tokens, two sets of Jaccard
   >= t share a token among the first n - ceil(t n) + 1 of each. The order begins with the tokens in
   the first part of the hash range (2.5 (1 - t) of it), the rarest first, as counted over all distinct
   sets; the others follow by hash. So only that part is shuffled to be counted, and a token that a
   single set holds, which most are, leaves no key. Keys are tokens of the prefix together with a
   size class. Sets that share a key are candidates; candidates that hang together form a cell.
3. Within a cell, sets are sequences in one global order (common tokens first, then by hash) and
   are stored in a trie with joined edges. Each set runs through the trie: the overlap with a
   shared beginning is counted once for all sets below, and a subtree is left when the overlap so
   far plus what remains of both lengths cannot reach the threshold.
   Cells of more than ``block`` sets are split by hash into blocks; about 32 pivot sets stand in
   every block, which joins nearly all of a group of copies at once. Cells that are still in
   several components afterwards compare their blocks pair by pair, leaving out pairs that are
   connected already. Only links that join two components are written.
4. Components of the links.

Null and empty texts have an empty set and stay alone. Equal texts, ties and repeated rows
share a signature. Keys are whole numbers, unique by row; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickflow.llm.common import MASK, Store, components, mix, shingle_sets, signed, slices, table

CLASS_RATIO = 1.4
PIVOTS = 32
MARKS = 1 << 24  # bits that tell which texts a cell may need
HELD = 200_000  # rows of one token from which it counts as common, without an exact count
SEEN = 2_000_000  # signatures that a task remembers to write equal sets once


# --- blocking ---------------------------------------------------------------


class Classes:
    """Size classes for Jaccard >= num / den, and the parts of the hash range by the pigeonhole principle (not used by the join)."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        low = [1]
        while low[-1] < 1 << 40:  # a class reaches at least from n to n / t
            low.append(max(math.ceil(low[-1] * CLASS_RATIO), low[-1] * den // num + 1))
        self.low = low

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, "right")) - 1

    def labels(self, n: int) -> list[int]:
        """Classes under which a set of n tokens meets others: its own, and the one below if a smaller partner can be there."""
        c = self.of(n)
        below = c and self.low[c] - 1 >= -(-n * self.num // self.den)
        return [c - 1, c] if below else [c]

    def parts(self, c: int) -> tuple[int, int]:
        """(number of parts, number r of empty parts that need no key); (0, 0) if only equal sets can meet."""
        k = (self.low[c + 1] - 1) * (self.den - self.num) // self.num
        if not k:
            return 0, 0
        r = 1
        while r < k and r < 2 + 3 * (k + 1 + r) * math.exp(-self.low[c] / (k + 1 + r)):
            r += 1
        return k + 1 + r, r


def counted_below(num: int, den: int) -> np.uint64:
    """Hashes below this one come first in the order of tokens, by rarity; the others follow by hash."""
    return np.uint64(min(MASK, (MASK // (2 * den)) * 5 * (den - num)))


def prefix_size(n, num: int, den: int):
    return n - -(-n * num // den) + 1


def set_signature(s: np.ndarray) -> int:
    return int(signed(mix(np.array([mix(s).sum() + np.uint64(len(s))], np.uint64)))[0])


def signatures(docs: DataFrame, key: str, text: str, width: int, num: int, den: int) -> DataFrame:
    """id, n (set size), counted (its tokens that are ordered by rarity), sig (of the whole set)."""
    below = counted_below(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = list(shingle_sets(batch.column("text"), width))
            cols = [[len(s) for s in sets], [int(np.searchsorted(s, below)) for s in sets], [set_signature(s) for s in sets]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in cols)], names=["id", "n", "counted", "sig"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, n long, counted long, sig long")


def tokens_to_count(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(k, sig): the counted tokens of each set, and as many of the others as its prefix may need.

    Equal sets of one task are written once; sets that only equal ones can match are left out.
    """
    below = counted_below(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            tokens, sigs = [], []
            for s in shingle_sets(batch.column("text"), width):
                if len(s) * den < num * (len(s) + 1):
                    continue
                sig = set_signature(s)
                if sig in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(sig)
                counted = int(np.searchsorted(s, below))
                tokens.append(s[: max(counted, prefix_size(len(s), num, den))])  # s is sorted
                sigs.append(sig)
            if tokens:
                k = signed(np.concatenate(tokens))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.repeat(np.array(sigs, np.int64), [len(t) for t in tokens]))], names=["k", "sig"])

    return docs.select("text").mapInArrow(run, "k long, sig long")


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """(sig, k, df) of the tokens that two sets or more hold; df: how many, ``HELD`` for common ones. Rows are streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows, common, last = 0, None, None  # common: a token whose rows fill the buffer, and its last set

        def out(k, sig, df):
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(k), pa.array(df, pa.int64())], names=["sig", "k", "df"])

        def flush(block: np.ndarray) -> Iterator[pa.RecordBatch]:
            k, sig = block
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (sig[1:] != sig[:-1])
            if common is not None and len(k) and k[0] == common:
                new[0] = sig[0] != last
                same = k == common
                yield out(k[new & same], sig[new & same], np.full(int((new & same).sum()), HELD))
                new &= ~same
            k, sig = k[new], sig[new]
            if len(k):
                first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                size = np.diff(np.append(first, len(k)))
                df = np.repeat(size, size)
                yield out(k[df > 1], sig[df > 1], np.minimum(df[df > 1], HELD))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            rows += batch.num_rows
            if rows < HELD:
                continue
            block = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(block[0], block[0, -1]))
            if cut == 0:
                if common != block[0, -1]:
                    common, last = block[0, -1], None
                cut = block.shape[1]
            yield from flush(block[:, :cut])
            last = block[1, cut - 1]
            held, rows = [block[:, cut:]], block.shape[1] - cut
        if rows:
            yield from flush(np.concatenate(held, axis=1))

    return tokens.repartition("k").sortWithinPartitions("k", "sig").mapInArrow(run, "sig long, k long, df long")


def prefix_keys(shared: DataFrame, num: int, den: int) -> DataFrame:
    """(id, k): keys of each set's prefix. shared: id, n, counted, tokens (array of (rest, df, k), in order)."""
    classes = Classes(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            flat = batch.column("tokens")
            edge = flat.offsets.to_numpy()
            rest, k = (flat.values.field(c).to_numpy(zero_copy_only=False) for c in ("rest", "k"))
            for i, (key, n, counted) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "n", "counted")))):
                at, to = int(edge[i]), int(edge[i + 1])
                middle = at + int(np.searchsorted(rest[at:to], True))
                # tokens of this set alone come first
                use = max(0, prefix_size(n, num, den) - (counted - (middle - at)))
                tokens = np.concatenate([k[at : min(at + use, middle)], k[middle:to]]).view(np.uint64)
                for c in classes.labels(n) if len(tokens) else ():
                    keys.append(signed(mix(tokens ^ mix(np.array([c + 1], np.uint64)))))
                    ids.append(np.full(len(tokens), key))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(keys))], names=["id", "k"])

    return shared.select("id", "n", "counted", "tokens").mapInArrow(run, "id long, k long")


# --- trie join --------------------------------------------------------------


class Trie:
    """Compressed trie of sorted token sequences; nodes are kept by level for whole-array steps."""

    def __init__(self, seqs: list[np.ndarray]):
        self.seqs = seqs
        same = [0]
        for a, b in zip(seqs, seqs[1:]):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            same.append(int(differ[0]) if len(differ) else m)
        same = np.array(same)
        nodes: list[tuple[int, int, int, int, int, int]] = []  # level, parent, depth before, depth after, first leaf, last leaf + 1
        todo = [(0, len(seqs), 0, -1, 0)]
        while todo:
            lo, hi, depth, parent, level = todo.pop()
            to = len(seqs[lo]) if hi - lo == 1 else int(min(same[lo + 1 : hi].min(), len(seqs[lo])))
            at = len(nodes)
            nodes.append((level, parent, depth, to, lo, hi))
            if hi - lo > 1:
                cuts = [lo, *(np.flatnonzero(same[lo + 1 : hi] == to) + lo + 1).tolist(), hi]
                for a, b in zip(cuts, cuts[1:]):
                    todo.append((a, b, to, at, level + 1))
        order = sorted(range(len(nodes)), key=lambda i: nodes[i][0])
        place = {i: k for k, i in enumerate(order)}
        self.level, self.parent, self.before, self.depth, self.lo, self.hi = np.array([nodes[i] for i in order]).T
        self.parent = np.array([place.get(p, -1) for p in self.parent])
        size = np.array([len(s) for s in seqs])
        self.shortest = np.array([size[a:b].min() for a, b in zip(self.lo, self.hi)])
        self.longest = np.array([size[a:b].max() for a, b in zip(self.lo, self.hi)])
        self.leaf = (self.hi - self.lo == 1) & (self.depth == size[self.lo])
        pieces = [seqs[a][x:y] for a, x, y in zip(self.lo, self.before, self.depth)]
        self.tokens = np.concatenate(pieces)
        self.edge = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.last = np.array([seqs[a][y - 1] if y else -1 for a, y in zip(self.lo, self.depth)])
        self.levels = np.searchsorted(self.level, np.arange(self.level.max() + 2))

    def partners(self, i: int, present: np.ndarray, num: int, den: int) -> np.ndarray:
        """Later sequences j > i with Jaccard >= num / den. present: scratch flags over tokens, all False."""
        x = self.seqs[i]
        present[x] = True
        hits = np.concatenate([[0], np.cumsum(present[self.tokens])])
        present[x] = False
        shared = hits[self.edge[1:]] - hits[self.edge[:-1]]
        rest = len(x) - np.searchsorted(x, self.last, "right")  # tokens of x that can still meet below a node
        alive = (self.hi - 1 > i) & (self.longest * den >= len(x) * num) & (self.shortest * num <= len(x) * den)
        for a, b in zip(self.levels[:-1], self.levels[1:]):
            if a:
                up = self.parent[a:b]
                alive[a:b] &= alive[up]
                shared[a:b] += shared[up]
            most = shared[a:b] + np.minimum(rest[a:b], self.longest[a:b] - self.depth[a:b])
            alive[a:b] &= most * (num + den) >= num * (len(x) + self.shortest[a:b])
            if not alive[a:b].any():
                alive[b:] = False
                break
        at = np.flatnonzero(alive & self.leaf)
        size = self.longest[at]
        good = shared[at] * den >= num * (len(x) + size - shared[at])
        return self.lo[at[good]]


def trie_links(sets: list[np.ndarray], num: int, den: int, group: list | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join components among sets of Jaccard >= num / den; group: known components."""
    vocabulary, flat, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((vocabulary, -count))] = np.arange(len(vocabulary))
    edge = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    seqs = [np.sort(rank[flat[a:b]]) for a, b in zip(edge[:-1], edge[1:])]
    order = sorted(range(len(sets)), key=lambda i: seqs[i].astype(">u4").tobytes())
    trie = Trie([seqs[i] for i in order])
    present = np.zeros(len(vocabulary), bool)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if group is not None:
        first: dict = {}
        for i, g in enumerate(group):
            root[i] = find(first.setdefault(g, i))
    out = []
    for at, i in enumerate(order):
        for other in trie.partners(at, present, num, den).tolist():
            a, b = find(i), find(order[other])
            if a != b:
                root[a] = b
                out.append((i, order[other]))
    return out


def only_near(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id has a mark that an id of ``placed`` has: all that are placed, and few others while the
    marks are not full. The marks are a broadcast of at most ``MARKS`` / 64 rows, whatever the table's size."""
    mark = f"pmod(xxhash64(17, id), {MARKS}L)"
    word, bit = F.expr(f"shiftright({mark}, 6) as word"), F.expr(f"shiftleft(1L, cast({mark} % 64 as int)) as bit")
    marks = placed.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    near = docs.select("*", word, bit).join(F.broadcast(marks), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return near.select(*docs.columns)


def cell_links(docs: DataFrame, placed: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) found within each (cell, block) group. placed: id, cell, block, known (component or id)."""

    def join(cell: pa.Table) -> pa.Table:
        # a pivot stands in its block once
        ids, known = cell.column("id").to_numpy(), cell.column("known").to_numpy()
        sets = []
        for at in range(0, cell.num_rows, 64):
            sets += shingle_sets(cell.column("text").slice(at, 64).combine_chunks(), width)
        links = trie_links(sets, num, den, known.tolist())
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in links], pa.int64()), "b": pa.array([int(ids[j]) for _, j in links], pa.int64())})

    # the placed rows grow with the table: one plan at every size, no broadcast
    return only_near(docs, placed).join(placed.hint("merge"), "id").select("cell", "block", "id", "known", "text").groupBy("cell", "block").applyInArrow(join, "a long, b long")


# --- operator ---------------------------------------------------------------


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100, block: int = 256
) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links of Jaccard >= num / den)."""
    store = Store(docs.sparkSession, "ngram-join")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed_rows = store.put(signatures(rows, "id", "text", width, num, den), "signatures")
    docs_n = signed_rows.count()
    reps = signed_rows.where("n > 0").groupBy("sig").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("counted").alias("counted"))
    reps = store.put(reps, "reps", docs_n)

    # candidates: one row for each (key, set); a key is kept when two sets have it
    shared = shared_tokens(tokens_to_count(rows, width, num, den))
    below = int(counted_below(num, den)) - (1 << 63)
    rest = F.col("k").bitwiseXOR(F.lit(-(1 << 63))) >= F.lit(below)  # as unsigned numbers
    order = F.sort_array(F.collect_list(F.struct(rest.alias("rest"), "df", "k"))).alias("tokens")
    held = store.put(shared.groupBy("sig").agg(order), "held")
    keyed = held.join(reps, "sig").select(F.col("rep").alias("id"), "n", "counted", "tokens")
    keyed = store.put(prefix_keys(keyed, num, den), "keys")
    store.drop("held")
    met = keyed.groupBy("k").agg(F.min("id").alias("m"), F.max("id").alias("x")).where("m <> x").select("k", "m")
    met = store.put(met, "met")
    pairs = keyed.join(met, "k").where("id <> m").select(F.col("id").alias("a"), F.col("m").alias("b"))
    cells = store.put(components(store, pairs, "cells").withColumnRenamed("component", "cell"), "cell", docs_n)
    store.drop("keys", "met")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / block))
    sizes = store.put(sizes, "sizes", docs_n)
    sized = store.put(cells.join(sizes, "cell"), "sized", docs_n)
    draw = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    pivot = (F.col("blocks") > 1) & (draw < F.lit(float(PIVOTS) * (1 << 30)) / F.col("size"))
    blocks = F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own))
    placed = sized.select("id", "cell", F.explode(blocks).alias("block"), F.col("id").alias("known"))
    links = store.put(cell_links(rows, placed, width, num, den), "links")

    # cells of several blocks that are not yet in one piece compare block with block
    large = sized.where("blocks > 1")
    if large.limit(1).count():
        parts = components(store, links, "parts")
        large = large.join(parts, "id", "left").withColumn("known", F.coalesce("component", "id"))
        large = store.put(large.select("id", "cell", "blocks", "known"), "large", docs_n)
        open_cells = large.groupBy("cell").agg(F.min("known").alias("lo"), F.max("known").alias("hi")).where("lo <> hi")
        still = large.join(store.put(open_cells.select("cell"), "open", docs_n), "cell")
        every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        pair = F.transform(every, lambda j: F.greatest(own, j) * F.col("blocks") + F.least(own, j))
        across = store.put(still.select("id", "cell", F.explode(F.array_distinct(pair)).alias("block"), "known"), "across")
        if across.limit(1).count():
            links = links.unionByName(cell_links(rows, across, width, num, den))
    found = components(store, links, "components")
    classes = store.put(found.join(reps.select("sig", F.col("rep").alias("id")), "id").select("sig", "component"), "classes", docs_n)
    classes = reps.join(classes, "sig", "left").select("sig", F.coalesce("component", "rep").alias("c"))
    classes = store.put(classes, "class-of", docs_n)

    # membership by signature: both sides are written tables, so AQE splits the rows of a large group of copies
    member = signed_rows.join(classes, "sig", "left")
    return member.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("id")).alias("component_id")
    )


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 3-word shingles have Jaccard >= 0.9."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, num=90, den=100)
