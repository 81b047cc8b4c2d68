"""Near-duplicate lines across documents: exact set-similarity join of line tokens.

A line's set is its distinct words (A-Z lower-cased, split at white space). A line goes when an
earlier line (by document key, then line number) anywhere in the input has Jaccard >= num/den
with it. Lines with fewer than ``min_tokens`` distinct words stay (``op1_line_dedup`` and the pipeline
judge all lines that have a word). Sets too small to match any but an equal one (under 4 words at
0.8) are left out of the join; equal sets are found by signature at every size.

1. One pass writes (document, line, signature of the set) and a fixed-size count sketch of how many
   lines hold each word, over all documents. The sketch (min of two rows of cells, as in a
   count-min sketch) gives every word its rarity, the global order of tokens.
2. Equal sets are represented by their first line. A second pass writes, for each distinct set, its
   prefix: the n - ceil(t n) + 1 rarest tokens. Two sets of Jaccard >= t share a prefix token. Sets
   that share one, pass the length filter and can differ by few enough tokens (parity bits of the
   set, 64 for a short line and up to 1,024 for a long one, bound the difference from below) are
   candidates; candidates that hang together form a cell. Words whose prefix lists exceed the buffer link all their sets to one cell unseen.
3. Tokens of the candidate lines are fetched once for each cell and joined there: prefix index in
   order of rarity, length and positional filter, exact Jaccard. Cells over ``block`` lines are
   split by hash, with about 32 pivot lines in every block; lines that found no earlier match are
   then compared with the other blocks. Only the mark "has an earlier match" leaves a task.

Null and empty texts have no lines to judge. Repeated rows of one key count as one document's
lines twice, the copies being later. Ties follow key and line number. Other columns are kept as
they are by ``remove_lines``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickflow.llm.common import LOWER, SPACE, Store, components, lists, mix, signed, slices, spans_of, table, text_bytes, word_hashes
from clickflow.llm.ngram_join import only_near
from clickflow.llm.suffix_dedup import groups_of

CELLS = 1 << 19  # of each of the two sketch rows
SKETCH_PARTS = 32
BUFFER = 200_000
PIVOTS = 32
PAIRS = 4_000_000
#: Sets of more tokens than these take 2, 4, 8, 16 words of parity bits: with fewer, unrelated sets would pass for near ones.
WIDER = np.array([64, 160, 400, 900])


TOKEN_BITS = 44


def line_tokens(col: pa.Array, whole: bool = False):
    """Distinct tokens of each line that has any: token hashes (by line, then hash), line of each, and (row, line number) of each line.

    Hashes have 44 bits unless ``whole``, so that line and token sort as one number.
    """
    data, offs = text_bytes(col)
    data = LOWER[data]
    starts, ends, row = spans_of(~SPACE[data], offs)
    if not len(starts):
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty, empty
    breaks = np.flatnonzero(data == 10)
    before = np.searchsorted(breaks, starts)  # line breaks before each word
    number = before - np.searchsorted(breaks, offs)[row]
    line = np.cumsum(np.diff(row * (len(breaks) + 1) + before, prepend=-1) != 0) - 1
    first = np.flatnonzero(np.diff(line, prepend=-1))
    h = word_hashes(data, starts, ends)
    if whole or line[-1] >= 1 << 64 - TOKEN_BITS:
        if not whole:
            h >>= np.uint64(64 - TOKEN_BITS)
        order = np.lexsort((h, line))
        h, at = h[order], line[order]
    else:
        both = np.sort((line.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (h >> np.uint64(64 - TOKEN_BITS)))
        h, at = both & np.uint64((1 << TOKEN_BITS) - 1), (both >> np.uint64(TOKEN_BITS)).astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    return h[new], at[new], row[first], number[first]


def cell_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(CELLS - 1)).astype(np.int64), ((h >> np.uint64(22)) & np.uint64(CELLS - 1)).astype(np.int64)


def signature(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    size = np.diff(np.append(edge, len(h))).astype(np.uint64)
    return signed(mix(np.add.reduceat(mix(h + np.uint64(0x5BD1E995)), edge) + size))


def lines_and_sketch(rows: DataFrame, min_tokens: int) -> DataFrame:
    """(id, line, sig) of each line, and in rows with a null id parts of this task's word counts (part, cells)."""
    names = ["id", "line", "sig", "part", "cells"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, CELLS), np.uint32)
        for batch in slices(batches, "text"):
            h, at, row, number = line_tokens(batch.column("text"))
            if not len(h):
                continue
            for k, cell in enumerate(cell_of(h)):
                counts[k] += np.bincount(cell, minlength=CELLS).astype(np.uint32)
            edge = np.flatnonzero(np.diff(at, prepend=-1))
            use = np.diff(np.append(edge, len(h))) >= min_tokens
            n = int(use.sum())
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            cols = [ids[row[use]], number[use], signature(h, edge)[use]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.nulls(n, types[3]), pa.nulls(n, types[4])], names=names)
        flat, width = counts.reshape(-1), 2 * CELLS // SKETCH_PARTS
        for p in range(SKETCH_PARTS):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64())] * 3 + [pa.array([p], types[3]), pa.array([flat[p * width : (p + 1) * width].tobytes()], types[4])], names=names
            )

    return rows.mapInArrow(run, "id long, line long, sig long, part int, cells binary")


def sketch_sum(parts: DataFrame) -> np.ndarray:
    """Word counts over all tasks: two rows of cells, a fixed 4 MB."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.uint32).astype(np.uint64) for c in group.column("cells"))
        total = np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pa.table({"part": group.column("part").slice(0, 1), "cells": pa.array([total.tobytes()], pa.binary())})

    got = {r["part"]: r["cells"] for r in parts.groupBy("part").applyInArrow(add, "part int, cells binary").toLocalIterator()}
    width = 2 * CELLS // SKETCH_PARTS
    return np.concatenate([np.frombuffer(got.get(p, bytes(4 * width)), np.uint32) for p in range(SKETCH_PARTS)]).reshape(2, CELLS)


def rarity(h: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    a, b = cell_of(h)
    return np.minimum(sketch[0][a], sketch[1][b])


def parity(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of each set (its tokens stand together in ``h``): 64-bit words, and where those of each set begin.

    The bit of a token is its hash modulo the number of bits. The first 1, 2, 4, ... words of a set tell its
    parity in 64, 128, 256, ... bits: a half that is folded onto the other is kept behind it (see ``differing``).
    """
    width = np.left_shift(1, np.searchsorted(WIDER, size))
    begin = np.concatenate([[0], np.cumsum(width)])
    flat = np.empty(begin[-1], np.uint64)
    m = mix(h)
    for w in np.unique(width).tolist():
        of = width == w
        n = size[of]
        mine = m[np.repeat(of, size)]
        edge = np.cumsum(n) - n
        bit = np.left_shift(np.uint64(1), mine & np.uint64(63))
        word = (mine >> np.uint64(6)) & np.uint64(w - 1)
        words = np.stack([np.bitwise_xor.reduceat(np.where(word == q, bit, np.uint64(0)), edge) for q in range(w)])
        half = w // 2
        while half:
            words[:half] ^= words[half : 2 * half]
            half //= 2
        flat[begin[:-1][of][:, None] + np.arange(w)] = words.T
    return flat, begin


def differing(words: np.ndarray) -> np.ndarray:
    """Bits set in rows of folded words as ``parity`` writes them, 1, 2, 4, ... to a row: the least number of differing
    tokens, where the words are those of two sets xor-ed."""
    full = words[:, :1]
    while full.shape[1] < words.shape[1]:
        upper = words[:, full.shape[1] : 2 * full.shape[1]]
        full = np.concatenate([full ^ upper, upper], axis=1)
    return np.bitwise_count(full).sum(axis=1, dtype=np.int64)


def prefixes(rows: DataFrame, sketch, min_tokens: int, num: int, den: int) -> DataFrame:
    """(k, sig, bits, more): prefix token (44 bits) with the set's size (16 bits, saturated), signature, first and further words of parity bits.

    Equal sets of one task are written once; tokens that only one line holds cannot meet and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            h, at, _, _ = line_tokens(batch.column("text"))
            if not len(h):
                continue
            edge = np.flatnonzero(np.diff(at, prepend=-1))
            size = np.diff(np.append(edge, len(h)))
            sig = signature(h, edge)
            fresh = np.zeros(len(edge), bool)
            fresh[np.unique(sig, return_index=True)[1]] = True
            fresh &= (size >= min_tokens) & (size * den >= num * (size + 1))  # others match equal sets only
            fresh &= np.fromiter((s not in seen for s in sig.tolist()), bool, len(sig))
            if len(seen) > 2_000_000:
                seen.clear()
            seen.update(sig[fresh].tolist())
            keep = np.repeat(fresh, size)
            h, size, sig = h[keep], size[fresh], sig[fresh]
            if not len(h):
                continue
            at, df = np.repeat(np.arange(len(size)), size), rarity(h, counts)
            words, own = parity(h, size)
            # by line, rarity (in steps of 1/64 of a doubling), hash: ties of the packed number keep the order by hash
            step = (np.log2(df) * 64).astype(np.uint64)
            order = np.argsort((at.astype(np.uint64) << np.uint64(44)) | (step << np.uint64(32)) | (h >> np.uint64(TOKEN_BITS - 32)), kind="stable")
            h, df = h[order], df[order]
            n = size[at]
            place = np.arange(len(h)) - (np.cumsum(size) - size)[at]
            use = (place <= n - -(-n * num // den)) & (df > 1)
            h, at = h[use], at[use]
            k = (h << np.uint64(16)) | np.minimum(size[at], 0xFFFF).astype(np.uint64)
            count = np.diff(own)[at] - 1
            stop = np.cumsum(count)
            further = words[np.repeat(own[at] + 1 - (stop - count), count) + np.arange(count.sum())]
            ends = pa.array(np.append(0, 8 * stop), pa.int32())
            more = pa.Array.from_buffers(pa.binary(), len(at), [None, ends.buffers()[1], pa.py_buffer(further)])
            yield pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(sig[at]), pa.array(signed(words[own[at]])), more], names=["k", "sig", "bits", "more"])

    return rows.select("text").mapInArrow(run, "k long, sig long, bits long, more binary")


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    while (label != label[label]).any():
        label = label[label]
    return label


def further_words(more: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit words of a binary column end to end, and where each row's begin."""
    _, ends, data = more.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(more.type) else np.int32)[more.offset : more.offset + len(more) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[ends[0] : ends[-1]].copy().view(np.uint64), (ends - ends[0]) // 8


def meet(k: np.ndarray, sig: np.ndarray, bits: np.ndarray, more: pa.Array, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate links among prefix rows sorted by k (token, then size): each set to the smallest row of its component."""
    words, own = further_words(more)
    width = np.diff(own) + 1
    size = (k & np.uint64(0xFFFF)).astype(np.int64)
    token = np.cumsum(np.diff(k >> np.uint64(16), prepend=np.uint64(0)) != 0)
    sortable = token * (1 << 17) + size
    reach = np.where(size * den // num >= 0xFFFF, 0xFFFF, size * den // num)
    stop = np.searchsorted(sortable, token * (1 << 17) + reach, "right")
    count = stop - np.arange(len(k)) - 1
    _, node = np.unique(sig, return_inverse=True)
    left, right = [], []
    total = np.cumsum(count)
    at = 0
    while at < len(k):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        c = count[at:to]
        i = np.repeat(np.arange(at, to), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        differ = np.bitwise_count(bits[i] ^ bits[j]).astype(np.int64)
        ok = (differ * (num + den) <= (size[i] + size[j]) * (den - num)) | (size[j] == 0xFFFF)
        i, j = i[ok], j[ok]
        both = np.minimum(width[i], width[j])
        ok = np.ones(len(i), bool)
        for w in np.unique(both[both > 1]).tolist():
            those = np.flatnonzero(both == w)
            for a in range(0, len(those), PAIRS // w):
                here = those[a : a + PAIRS // w]
                x, y = i[here], j[here]
                rest = np.arange(w - 1)
                rest = words[own[x][:, None] + rest] ^ words[own[y][:, None] + rest]
                differ = differing(np.concatenate([(bits[x] ^ bits[y])[:, None], rest], axis=1))
                ok[here] = (differ * (num + den) <= (size[x] + size[y]) * (den - num)) | (size[y] == 0xFFFF)
        i, j = node[i[ok]], node[j[ok]]
        ok = i != j
        pair = np.unique(i[ok] * len(k) + j[ok])
        left.append(pair // len(k))
        right.append(pair % len(k))
        at = to
    label = connected(len(k), np.concatenate(left), np.concatenate(right))
    name = np.zeros(len(k), np.int64)
    name[node] = sig
    own = np.unique(node)
    moved = own[label[own] != own]
    return name[moved], name[label[moved]]


def candidates(posted: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between sets that share a prefix token and pass the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, hub = 0, None  # hub: (token, set) of a token whose list fills the buffer

        def out(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def flush(block: pa.Table):
            if hub is not None:
                same = block.column("k").to_numpy() >> 16 == hub[0]
                yield out(block.column("sig").to_numpy()[same], np.full(int(same.sum()), hub[1]))
                block = block.filter(pa.array(~same)).combine_chunks()
            if block.num_rows:
                k, sig, bits = (block.column(c).to_numpy() for c in ("k", "sig", "bits"))
                yield out(*meet(k.view(np.uint64), sig, bits.view(np.uint64), block.column("more").chunk(0), num, den))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < BUFFER:
                continue
            block = pa.Table.from_batches(held).combine_chunks()
            token = block.column("k").to_numpy() >> 16
            cut = int(np.searchsorted(token, token[-1]))
            if cut == 0:
                if hub is None or hub[0] != token[-1]:
                    hub = (token[-1], int(block.column("sig")[0].as_py()))
                cut = rows
            yield from flush(block.slice(0, cut))
            held, rows = block.slice(cut).to_batches(), rows - cut
        if rows:
            yield from flush(pa.Table.from_batches(held).combine_chunks())

    near = posted.repartition(F.shiftright("k", 16)).sortWithinPartitions("k")  # by token, then size
    return near.mapInArrow(run, "a long, b long").where("a <> b")


def later_matches(sets: list[np.ndarray], probe: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets have an earlier one (lower index) of Jaccard >= num/den; only pairs with a probe as the later one count."""
    vocabulary, flat, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((vocabulary, count))] = np.arange(len(vocabulary))  # rarest first
    edge = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    seqs = [np.sort(rank[flat[a:b]]) for a, b in zip(edge[:-1], edge[1:])]
    hit = np.zeros(len(sets), bool)
    index: dict[int, list[tuple[int, int]]] = defaultdict(list)
    whole: dict[int, set[int]] = {}

    def as_set(i: int) -> set[int]:
        if i not in whole:
            whole[i] = set(seqs[i].tolist())
        return whole[i]

    for x in sorted(range(len(sets)), key=lambda i: (len(seqs[i]), i)):
        n = len(seqs[x])
        prefix = seqs[x][: n - -(-n * num // den) + 1].tolist()
        tried: set[int] = set()
        for p, token in enumerate(prefix):
            for y, q in index[token]:
                late = max(x, y)
                if y in tried or hit[late] or not probe[late]:
                    continue
                m = len(seqs[y])
                if m * den < n * num:  # length
                    continue
                if (1 + min(n - p - 1, m - q - 1)) * (num + den) < num * (n + m):  # position
                    continue
                tried.add(y)
                shared = len(as_set(x) & as_set(y))
                if shared * den >= num * (n + m - shared):
                    hit[late] = True
            index[token].append((x, p))
    return hit


def marked(rows: DataFrame, placed: DataFrame, num: int, den: int) -> DataFrame:
    """Signatures with an earlier match within their (cell, block). placed: id, line, sig, cell, block, probe."""
    wanted = placed.groupBy("id").agg(F.collect_list(F.struct("line", "sig", "cell", "block", "probe")).alias("want"))
    names = ["cell", "block", "id", "line", "sig", "probe", "tokens"]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, at, row, number = line_tokens(batch.column("text"), whole=True)
            edge = np.searchsorted(at, np.arange(len(row) + 1))
            where = {(r, n): k for k, (r, n) in enumerate(zip(row.tolist(), number.tolist()))}
            ids = batch.column("id").to_pylist()
            got = [(w["cell"], w["block"], ids[r], w["line"], w["sig"], w["probe"], where[r, w["line"]]) for r, want in enumerate(batch.column("want").to_pylist()) for w in want]
            cols = list(zip(*got))
            kinds = [pa.int64()] * 5 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)] + [lists([signed(h[edge[k] : edge[k + 1]]) for k in cols[6]], pa.int64())], names=names
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, 2, 5_000):
            t = t.combine_chunks()
            cell, part, sig, probe = (t.column(c).to_numpy() for c in ("cell", "block", "sig", "probe"))
            tokens = t.column("tokens").combine_chunks()
            if isinstance(tokens, pa.ChunkedArray):
                tokens = tokens.chunk(0)
            values, offs = tokens.values.to_numpy().view(np.uint64), tokens.offsets.to_numpy()
            cut = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(cell)]
            hit = np.zeros(len(cell), bool)
            for a, b in zip(cut, cut[1:]):
                if b - a > 1:
                    hit[a:b] = later_matches([values[x:y] for x, y in zip(offs[a:b], offs[a + 1 : b + 1])], probe[a:b], num, den)
            yield pa.RecordBatch.from_arrays([pa.array(sig[hit])], names=["sig"])

    # the wanted lines grow with the table: one plan at every size, no broadcast
    # and only texts with wanted lines are shuffled (the second call, for large cells, needs few)
    fetched = only_near(rows, placed).join(wanted.hint("merge"), "id").mapInArrow(fetch, "cell long, block long, id long, line long, sig long, probe boolean, tokens array<long>")
    return fetched.repartition("cell", "block").sortWithinPartitions("cell", "block", "id", "line").mapInArrow(join, "sig long")


def repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 80, den: int = 100, min_tokens: int = 5, block: int = 512
) -> DataFrame:
    """(id, line) of each line that goes; line numbers from 0."""
    spark = docs.sparkSession
    store = Store(spark, "line-dedup")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    passed = store.put(lines_and_sketch(rows, min_tokens), "lines")
    sketch = spark.sparkContext.broadcast(sketch_sum(passed.where("id is null").select("part", "cells")))
    lines = passed.where("id is not null").select("id", "line", "sig")
    n = lines.count()
    firsts = lines.groupBy("sig").agg(F.min(F.struct("id", "line")).alias("f")).select("sig", "f.id", "f.line")
    firsts = store.put(firsts, "firsts", n)
    edges = candidates(prefixes(rows, sketch, min_tokens, num, den), num, den)
    cells = store.put(components(store, edges, "cells").withColumnRenamed("component", "cell").withColumnRenamed("id", "sig"), "cell", n)
    sizes = store.put(cells.groupBy("cell").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / block)), "sizes", n)
    sized = store.put(cells.join(firsts, "sig").join(sizes, "cell"), "sized", n)
    own = F.pmod(F.xxhash64("sig"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit(5), "sig"), F.lit(1 << 30)) < F.lit(float(PIVOTS) * (1 << 30)) / F.col("size"))
    columns = ["id", "line", "sig", "cell"]
    placed = sized.select(*columns, F.explode(F.when(pivot, every).otherwise(F.array(own))).alias("block"), F.lit(True).alias("probe"))
    found = store.put(marked(rows, placed, num, den).distinct(), "found", n)
    large = sized.where("blocks > 1")
    if large.limit(1).count():
        left = large.join(found, "sig", "left_anti")
        there = large.join(left.select("cell").distinct(), "cell")
        again = left.select(*columns, F.explode(every).alias("block"), F.lit(True).alias("probe"))
        others = there.join(left.select("sig"), "sig", "left_anti").select(*columns, own.alias("block"), F.lit(False).alias("probe"))
        again = store.put(again.unionByName(others), "again")  # read for the marks of texts and for the join
        found = store.put(found.unionByName(marked(rows, again, num, den)).distinct(), "found2", n)
    judged = store.put(firsts.join(found.withColumn("late", F.lit(True)), "sig", "left").select("sig", F.col("id").alias("fi"), F.col("line").alias("fl"), "late"), "judged", n)
    return lines.join(judged, "sig").where("late or id <> fi or line <> fl").select("id", "line").distinct()


def remove_lines(docs: DataFrame, gone: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the given (id, line) lines; all columns stay."""
    removed = gone.groupBy(F.col("id").alias("removed_id")).agg(F.collect_list("line").alias("removed_lines"))
    joined = docs.join(removed, F.col(key).cast("long") == F.col("removed_id"), "left")
    return joined.withColumn(text, without("removed_lines", text)).select(*docs.columns)


def without(removed: str, text: str) -> Column:
    kept = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(removed, i.cast("long")))
    return F.when(F.col(removed).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """For every document: number of lines, number removed, and which (from 0, ascending)."""
    docs = table(spark, sf_dir, "documents")
    gone = repeated_lines(docs, min_tokens=1).groupBy("id").agg(F.sort_array(F.collect_list("line")).alias("removed"))
    count = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    joined = count.join(gone, count.doc_id == gone.id, "left")
    empty = F.array().cast("array<bigint>")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", empty).alias("removed"))
