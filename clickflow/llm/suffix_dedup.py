"""Repeated byte strings: removal of every byte under a ``width``-byte string that starts earlier.

All ``width``-byte windows of all texts are judged, but only a sparse set of suffixes is sorted:

1. The anchor of a window is the smallest hashed ``GRAM``-byte string in it (leftmost on ties). Equal
   windows have equal anchors at equal offsets. Neighbouring windows with one anchor form a run;
   there are about two runs for every ``width - GRAM`` bytes.
2. Runs go to the tasks of two keys: their anchor with ``SIDE`` bytes to its left, and with ``SIDE`` bytes to its
   right. There they are ordered by the hash of the run's whole string and by place. All but the
   first run of one string are repeats from end to end.
3. A first run can still repeat in part. If its key has another string, it fetches its bytes. What stands right of the anchors, and
   (reversed) left of them, is sorted as suffixes by deep-shallow sorting: multikey quicksort on
   8-byte words to a shallow depth, then a blind trie for each group that still agrees. The longest
   common extensions follow from neighbours in both orders; a window repeats if an earlier run
   extends far enough to both sides of the anchor.
   Keys with more than ``block`` such runs are split by hash of the place; windows that a block leaves
   open are then compared by their own hashes, pre-aggregated, over all blocks.

Strings are judged on the input, matches never cross texts, order is (key, byte position). Null and empty
texts, and texts shorter than ``width``, lose nothing. Repeated keys count as one place each; ties of
place cannot occur for unique keys. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickflow.llm.common import BASE, BYTE, INVERSE, Store, mix, powers, signed, slices, table, text_bytes

GRAM = 20
SIDE = 40
SHALLOW = 16


class Hasher:
    """Hashes of substrings of one byte array."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * powers(BASE, len(data)), out=self.sums[1:])
        self.back = powers(INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def window_anchors(data: np.ndarray, offs: np.ndarray, width: int, hasher: Hasher):
    """Runs of windows with one anchor: first window, last window, anchor (positions in data), row."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return [np.empty(0, np.int64)] * 4
    at = np.arange(n)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    low = (hasher.of(at, at + GRAM) >> bits << bits) | at.astype(np.uint64)
    span, reach = width - GRAM + 1, 1
    while reach * 2 <= span:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # windows that lie within one text
    inside = np.zeros(len(anchor) + 1, np.int32)
    size = np.diff(offs)
    long = size >= width
    np.add.at(inside, offs[:-1][long], 1)
    np.add.at(inside, offs[1:][long] - width + 1, -1)
    ok = np.cumsum(inside[:-1]) > 0
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
    first[offs[:-1][long]] = True
    start = np.flatnonzero(first)
    last = ok.copy()
    last[:-1] &= ~ok[1:] | first[1:]
    return start, np.flatnonzero(last), anchor[start], np.searchsorted(offs, start, "right") - 1


def pack(start: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """First window << 16 | further windows << 8 | offset of the anchor."""
    return (start << 16) | ((last - start) << 8) | (anchor - start)


def unpack(pos):
    start = pos >> 16
    return start, start + ((pos >> 8) & 0xFF), start + (pos & 0xFF)


def runs_of(rows: DataFrame, width: int) -> DataFrame:
    """(k, h, id, pos, again), twice for each run: k is the hash of the anchor with ``SIDE`` bytes to its left or (odd k) right, h of the run's string.

    A window agrees with its repeats on the anchor and on ``SIDE`` bytes to one of both sides at least, so
    either k brings them together, while an anchor that is common in itself spreads over many keys.
    Runs whose string stands earlier in the same piece of the input are known repeats already: they get one
    row, under a key of their own place.
    """
    names = ["k", "h", "id", "pos", "again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offs = text_bytes(batch.column("text"))
            hasher = Hasher(data)
            start, last, anchor, row = window_anchors(data, offs, width, hasher)
            if not len(start):
                continue
            left = hasher.of(np.maximum(anchor - SIDE, offs[row]), anchor + GRAM)
            right = hasher.of(anchor, np.minimum(anchor + GRAM + SIDE, offs[row + 1]))
            one = np.uint64(1)
            base = offs[row]
            h, ids, pos = hasher.of(start, last + width), batch.column("id").to_numpy()[row], pack(start - base, last - base, anchor - base)
            order = np.lexsort((pos, ids, h))
            known = np.zeros(len(h), bool)
            known[order[1:]] = h[order[1:]] == h[order[:-1]]
            place = mix(ids.astype(np.uint64) * np.uint64(BASE) + pos.astype(np.uint64))
            for k, use in ((left & ~one, ~known), (right | one, ~known), (place, known)):
                cols = [pa.array(c[use], pa.int64()) for c in (signed(k), signed(h), ids, pos)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(known[use])], names=names)

    return rows.mapInArrow(run, "k long, h long, id long, pos long, again boolean")


def groups_of(batches: Iterator[pa.RecordBatch], keys: int, least: int = 100_000) -> Iterator[pa.Table]:
    """Pieces of a sorted partition that never part rows equal in the first ``keys`` columns, unless one group fills a piece."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(t.num_rows, bool)
        for c in range(keys):
            v = t.column(c).to_numpy()
            same &= v == v[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
        held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        least = max(least, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


def whole_repeats(runs: DataFrame) -> DataFrame:
    """Repeated runs (part = false) and first runs that may repeat in part (part = true), from the rows of ``runs_of``.

    Rows of a key come in order of string and place. The first run of each string may repeat in part if
    its key has another string. Only the last row of the rows before is held, whatever the size of a key.
    Whole repeats are read from one of a run's two rows: the left one if the anchor is ``SIDE`` or more into the run.
    """
    names = ["k", "id", "pos", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # last row, and whether it was a first run alone in its key so far
        lonely = None  # such a row, not written yet
        for batch in batches:
            if not batch.num_rows:
                continue
            known = batch.column("again").to_numpy(zero_copy_only=False)
            if known.any():
                k, _, ids, pos = (c.filter(batch.column("again")) for c in batch.columns[:4])
                yield pa.RecordBatch.from_arrays([k, ids, pos, pa.array(np.zeros(len(k), bool))], names=names)
            k, h, ids, pos = (c.to_numpy()[~known] for c in batch.columns[:4])
            if not len(k):
                continue
            new_k, new_h = np.ones(len(k), bool), np.ones(len(k), bool)
            new_k[1:] = k[1:] != k[:-1]
            new_h[1:] = new_k[1:] | (h[1:] != h[:-1])
            if before is not None:
                new_k[0] = k[0] != before[0]
                new_h[0] = new_k[0] or h[0] != before[1]
            main = (pos & 0xFF >= SIDE) == (k & 1 == 0)
            again = ~new_h & main
            # a first run is written if its key begins before it, or if the key goes on with another string
            part = new_h & ~new_k
            first = np.flatnonzero(new_h)
            follows = np.flatnonzero(part[first][1:])  # the first run before such a one
            part[first[follows]] = True
            if len(first) and not new_k[first[0]] and lonely is not None:
                yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in lonely), pa.array([True])], names=names)
            use = again | part
            yield pa.RecordBatch.from_arrays([pa.array(k[use]), pa.array(ids[use]), pa.array(pos[use]), pa.array(part[use])], names=names)
            if len(first):
                f = first[-1]
                lonely = None if part[f] else (int(k[f]), int(ids[f]), int(pos[f]))
            before = (k[-1], h[-1])

    near = runs.repartition("k").sortWithinPartitions("k", "h", "id", "pos")
    return near.mapInArrow(run, "k long, id long, pos long, part boolean")


# --- deep-shallow sorting -----------------------------------------------------


def common_prefix(a: bytes, b: bytes, least: int = 0) -> int:
    m = min(len(a), len(b))
    if a[:m] == b[:m]:
        return m
    lo, hi = least, m
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """Trie that keeps only branching depths; strings are looked at once for each insertion."""

    def __init__(self):
        self.root = None

    def insert(self, strings: list[bytes], i: int, depth: int) -> None:
        """Nodes are (depth, {byte: node}) with -1 for the end of a string; leaves are lists of equal strings."""
        s = strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):  # blind descent: any branch will do where the byte is unknown
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        other = strings[node[0]]
        agree = common_prefix(s, other, depth)
        if agree == len(s) == len(other):
            node.append(i)
            return
        up, key, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < agree:
            up, key = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][key]
        mine = s[agree] if agree < len(s) else -1
        if isinstance(node, tuple) and node[0] == agree:
            node[1][mine] = [i]
            return
        theirs = other[agree] if agree < len(other) else -1
        new = (agree, {theirs: node, mine: [i]})
        if up is None:
            self.root = new
        else:
            up[1][key] = new

    def in_order(self) -> Iterator[int]:
        todo = [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                yield from node


def deep_shallow(strings: list[bytes]) -> list[int]:
    """Order of the strings."""

    def sort(group: list[int], depth: int) -> Iterator[int]:
        if len(group) < 2:
            yield from group
        elif depth >= SHALLOW:
            trie = BlindTrie()
            for i in group:
                trie.insert(strings, i, depth)
            yield from trie.in_order()
        else:  # one step of multikey quicksort, on words of 8 bytes
            word = [strings[i][depth : depth + 8] for i in group]
            pivot = word[len(word) // 2]
            less, same, more = [], [], []
            for i, w in zip(group, word):
                (less if w < pivot else more if w > pivot else same).append(i)
            yield from sort(less, depth)
            yield from sort(same, depth + 8) if len(pivot) == 8 else same
            yield from sort(more, depth)

    return list(sort(list(range(len(strings))), 0))


def extensions(strings: list[bytes]) -> np.ndarray:
    """Longest common prefix of each pair, from neighbours in sorted order."""
    n = len(strings)
    order = deep_shallow(strings)
    lcp = np.array([common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])], np.int64)
    out = np.zeros((n, n), np.int64)
    for i in range(n - 1):
        out[i, i + 1 :] = np.minimum.accumulate(lcp[i:])
    out = np.maximum(out, out.T)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return out[np.ix_(back, back)]


def partial_repeats(ids, pos, texts: list[bytes], width: int) -> list[np.ndarray]:
    """For runs of one key: which windows of each run stand in an earlier run."""
    start, last, anchor = unpack(np.asarray(pos))
    left = [t[: o][::-1] for t, o in zip(texts, (anchor - start).tolist())]
    right = [t[o:] for t, o in zip(texts, (anchor - start).tolist())]
    l, r = extensions(left), extensions(right)
    place = np.lexsort((anchor, ids))
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    out = []
    for i in range(len(texts)):
        # window at offset o before the anchor repeats if an earlier run has left >= o and right >= width - o
        lo, hi = np.maximum(width - r[i], anchor[i] - last[i]), np.minimum(l[i], anchor[i] - start[i])
        ok = (rank < rank[i]) & (lo <= hi)
        cover = np.zeros(last[i] - start[i] + 2, np.int64)
        np.add.at(cover, anchor[i] - hi[ok] - start[i], 1)
        np.add.at(cover, anchor[i] - lo[ok] - start[i] + 1, -1)
        out.append(np.cumsum(cover[:-1]) > 0)
    return out


def fetch(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Adds the bytes of each wanted run."""
    want = wanted.groupBy("id").agg(F.collect_list(F.struct("k", "block", "blocks", "pos")).alias("want"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for i, t, want in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("want").to_pylist()):
                b = (t or "").encode()
                for w in want:
                    start, last, _ = unpack(w["pos"])
                    out.append((w["k"], w["block"], w["blocks"], i, w["pos"], b[start : last + width]))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())], names=["k", "block", "blocks", "id", "pos", "s"])

    return rows.join(want, "id").mapInArrow(run, "k long, block long, blocks long, id long, pos long, s binary")


def part_repeats(fetched: DataFrame, width: int) -> DataFrame:
    """(id, a, b) byte ranges that repeat; for windows left open in a split group (id, a, w: hash of the window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in groups_of(batches, 2, 20_000):
            k, block, blocks, ids, pos = (piece.column(c).to_numpy() for c in range(5))
            texts = piece.column(5).to_pylist()
            cut = np.flatnonzero((np.diff(k, prepend=k[0] - 1) != 0) | (np.diff(block, prepend=0) != 0))
            out: list[tuple] = []
            for x, y in zip(cut, [*cut[1:], len(k)]):
                if y - x < 2 and blocks[x] == 1:
                    continue
                again = partial_repeats(ids[x:y], pos[x:y], texts[x:y], width)
                for i, hit in zip(range(x, y), again):
                    start = int(pos[i]) >> 16
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                    out.extend((int(ids[i]), start + int(a), start + int(b) - 1 + width, None) for a, b in zip(edge[::2], edge[1::2]))
                    if blocks[i] > 1:
                        for p in np.flatnonzero(~hit).tolist():
                            w = hashlib.blake2b(texts[i][p : p + width], digest_size=8).digest()
                            out.append((int(ids[i]), start + p, start + p + width, int.from_bytes(w, "big", signed=True)))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "a", "b", "w"])

    return fetched.repartition("k", "block").sortWithinPartitions("k", "block").mapInArrow(run, "id long, a long, b long, w long")


def repeated_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 100, block: int = 512) -> DataFrame:
    """(id, a, b): byte ranges of each text that go; ranges may overlap."""
    store = Store(docs.sparkSession, "suffix-dedup")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    runs = store.put(whole_repeats(runs_of(rows.where(F.octet_length("text") >= width), width)), "runs")
    start = F.shiftright("pos", 16)
    whole = runs.where("not part").select("id", start.alias("a"), (start + F.shiftright("pos", 8).bitwiseAND(F.lit(0xFF).cast("long")) + width).alias("b"))
    part = runs.where("part").select("k", "id", "pos")
    n = part.count()
    size = store.put(part.groupBy("k").agg(F.ceil(F.count("*") / block).alias("blocks")), "size", n)
    wanted = part.join(size, "k").withColumn("block", F.pmod(F.xxhash64("id", "pos"), F.col("blocks")))
    some = store.put(part_repeats(fetch(rows, wanted, width), width), "some")
    open_ = some.where("w is not null")
    first = store.put(open_.groupBy("w").agg(F.min(F.struct("id", "a")).alias("f")).select("w", F.col("f.id").alias("fi"), F.col("f.a").alias("fa")), "first", open_.count())
    late = open_.join(first, "w").where("id <> fi or a <> fa").select("id", "a", "b")
    return whole.unionByName(some.where("w is null").select("id", "a", "b")).unionByName(late)


RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def remove_ranges(docs: DataFrame, ranges: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, what is left (bytes cut within a character are replaced)."""
    # runs overlap a lot: ranges are joined within fixed stretches of a text before they are listed for each text
    stretch = 1 << 20
    listed = ranges.groupBy("id", F.floor(F.col("a") / stretch).alias("s")).agg(F.collect_set(F.struct("a", "b")).alias("r"))
    listed = listed.groupBy("id").agg(F.flatten(F.collect_list("r")).alias("r"))
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if keep_text else 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for i, t, found in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("r")):
                b = (t or "").encode()
                gone = spans = 0
                if found.is_valid:
                    a, z = (found.values.field(f).to_numpy() for f in ("a", "b"))
                    cover = np.zeros(len(b) + 1, np.int64)
                    np.add.at(cover, a, 1)
                    np.add.at(cover, z, -1)
                    hit = np.cumsum(cover[:-1]) > 0
                    gone = int(hit.sum())
                    spans = int((np.diff(np.concatenate([[0], hit.view(np.int8)])) == 1).sum())
                    left = np.frombuffer(b, np.uint8)[~hit].tobytes()
                else:
                    left = b
                row = (i, len(b), gone, spans, hashlib.sha256(left).hexdigest())
                out.append(row + (left.decode("utf-8", "replace"),) if keep_text else row)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=names)

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    schema = RESULT if keep_text else RESULT.rpartition(",")[0]
    return rows.join(listed, "id", "left").mapInArrow(run, schema).withColumnRenamed("id", key)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of every document under 100-byte strings that start earlier, and the hash of the rest."""
    docs = table(spark, sf_dir, "documents")
    return remove_ranges(docs, repeated_ranges(docs), keep_text=False)
