"""Benchmark decontamination: item-sized windows, CGK embedding, bit sampling, edit verification.

Texts and benchmark items are sequences of words (runs of letters, digits and other non-ASCII
characters, lower-cased). An item leaks into a document when some stretch of the document has a word edit
distance of at most ``floor(edits * words)`` to the item.

1. Every word position starts a window as long as the item plus its edits, for each length
   class of items. Each edit spoils at most two pairs of neighbouring words, so a window with
   fewer benchmark pairs than the items of its class must keep cannot match; running counts
   drop it (the q-gram lemma: a lossless test).
2. The CGK random walk turns a word sequence into a longer one in which edit distance becomes
   Hamming distance: at each step the current word is written, and a random function of (step,
   word) decides whether to move on. Each of ``tables`` hash tables reads ``bits`` random
   positions of the walk; windows and items with an equal reading meet.
3. Each (document, item, position) that meets is verified exactly with Myers' bit-parallel
   edit distance over the words around the window.

With ``recall`` the number of tables follows from the edits allowed; the tests measure it. Items
go through in blocks of at most ``block`` words, so what is sent to tasks is bounded; all
documents are scanned for each block.

Null and empty texts hold nothing. Items that are null or have fewer than ``min_words`` words
are not searched, since they occur in clean text. Equal items are reported each by its id.
Repeated rows are reported each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickflow.llm.common import mix, slices, spans_of, table, text_bytes, word_hashes

INSIDE = np.zeros(256, bool)
INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
OTHER = -1
STRIDE = 1.25  # ratio of the longest to the shortest item of a length class


def text_words(col: pa.Array):
    """Word hashes, first word of each row, and the byte range of each word within its row."""
    data, offs = text_bytes(pc.utf8_lower(col))
    starts, ends, row = spans_of(INSIDE[data], offs)
    return word_hashes(data, starts, ends), np.searchsorted(row, np.arange(len(offs))), row


@dataclass
class LengthClass:
    items: np.ndarray  # indices of items
    shortest: int
    window: int  # words in a window
    least: int  # benchmark word pairs that a matching window must have
    steps: int
    picks: np.ndarray  # (walks, tables, bits): steps read by each table of each random walk
    keys: list[np.ndarray]  # for each table, sorted keys of the items
    owner: list[np.ndarray]  # item of each key


MARKS = 1 << 16


class Index:
    """Benchmark items by length class, with their sampled CGK keys."""

    def __init__(self, ids: list, texts: list[str], edits: float, min_words: int, tables: int, bits: int, walks: int = 4, seed: int = 7):
        words, first, _ = text_words(pa.array(texts, pa.string()))
        self.ids = ids
        self.vocabulary = np.unique(words)
        self.marks = np.zeros(MARKS, bool)
        self.marks[self.vocabulary & np.uint64(MARKS - 1)] = True
        at = np.searchsorted(self.vocabulary, words)
        self.items = [at[a:b] for a, b in zip(first[:-1], first[1:])]
        self.pairs = np.unique(np.concatenate([x[:-1] * len(self.vocabulary) + x[1:] for x in self.items]))
        self.edits = [int(edits * len(x)) for x in self.items]
        self.seed, self.classes = np.uint64(seed), []
        self.masks: dict[int, dict[int, int]] = {}
        rng = np.random.default_rng(seed)
        order = sorted((k for k in range(len(ids)) if len(self.items[k]) >= min_words), key=lambda k: len(self.items[k]))
        while order:
            low = len(self.items[order[0]])
            own = [k for k in order if len(self.items[k]) <= max(low, int(low * STRIDE))]
            order = order[len(own) :]
            high, slack = len(self.items[own[-1]]), max(self.edits[k] for k in own)
            steps = max(bits, int(1.6 * low))
            picks = np.array([[rng.choice(steps, bits, replace=False) for _ in range(tables)] for _ in range(walks)])
            group = LengthClass(np.array(own), low, high + slack, min(len(self.items[k]) - 1 - 2 * self.edits[k] for k in own), steps, picks, [], [])
            flat = np.concatenate([np.concatenate([self.items[k], np.full(steps, OTHER)]) for k in own])
            starts = np.concatenate([[0], np.cumsum([len(self.items[k]) + steps for k in own])[:-1]])
            for t, key in enumerate(self.read(flat, starts, group)):
                o = np.argsort(key, kind="stable")
                group.keys.append(key[o])
                group.owner.append(group.items[o])
            self.classes.append(group)

    def read(self, flat: np.ndarray, starts: np.ndarray, group: LengthClass) -> Iterator[np.ndarray]:
        """For each walk and table, the key of each walk that starts at one of the positions."""
        for walk, picks in enumerate(group.picks):
            out = np.zeros((len(picks), len(starts)), np.uint64)
            wanted: dict[int, list[int]] = {}
            for t, row in enumerate(picks):
                for s in row:
                    wanted.setdefault(int(s), []).append(t)
            at = starts.copy()
            for step in range(group.steps):
                word = flat[np.minimum(at, len(flat) - 1)].astype(np.uint64)
                seed = np.uint64((step + 1) * (walk + 1)) * self.seed + np.uint64(walk)
                h = mix(word * np.uint64(0x9E3779B97F4A7C15) + seed)
                for t in wanted.get(step, ()):
                    out[t] = mix(out[t] * np.uint64(31) + word + np.uint64(step))
                at += (h >> np.uint64(63)).astype(np.int64)
            yield from out

    def distance(self, k: int, text: np.ndarray) -> tuple[int, int]:
        """Least edit distance of item k to a stretch of the text, and the end of that stretch (Myers)."""
        item = self.items[k]
        masks = self.masks.get(k)
        if masks is None:
            masks = self.masks[k] = {}
            for i, w in enumerate(item.tolist()):
                masks[w] = masks.get(w, 0) | 1 << i
        m = len(item)
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, best = full, 0, m, (m, 0)
        for j, w in enumerate(text.tolist()):
            eq = masks.get(w, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | (full & ~(xh | pv)), pv & xh
            score += (ph & top > 0) - (mh & top > 0)
            ph, mh = (ph << 1) & full, (mh << 1) & full
            pv, mv = mh | (full & ~(xv | ph)), ph & xv
            if score < best[0]:
                best = (score, j + 1)
        return best


def search(index: Index, col: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(row, item, distance, first word, word after the last) of each leak; the closest one for each row and item."""
    words, first, row = text_words(col)
    if not len(words) or not len(index.vocabulary):
        return []
    # most words of the documents are not the benchmark's: a small table of marks tells before the search
    word = np.full(len(words), OTHER)
    maybe = np.flatnonzero(index.marks[words & np.uint64(MARKS - 1)])
    at = np.minimum(np.searchsorted(index.vocabulary, words[maybe]), len(index.vocabulary) - 1)
    hit = index.vocabulary[at] == words[maybe]
    word[maybe[hit]] = at[hit]
    last = first[1:][row]  # end of the row of each word
    both = np.flatnonzero((word[:-1] >= 0) & (word[1:] >= 0) & (row[:-1] == row[1:]))
    code = word[both] * len(index.vocabulary) + word[both + 1]
    at = np.minimum(np.searchsorted(index.pairs, code), len(index.pairs) - 1)
    known = np.zeros(len(word) + 1, np.int32)
    if len(index.pairs):
        known[both[index.pairs[at] == code] + 1] = 1
    if not known.any() and all(group.least > 0 for group in index.classes):
        return []
    known = np.cumsum(known)  # benchmark pairs that begin before each position
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for group in index.classes:
        here = np.arange(len(word))
        stop = np.minimum(here + group.window, last)
        starts = here[known[stop - 1] - known[here] >= group.least]
        for at in range(0, len(starts), 200_000):
            part = starts[at : at + 200_000]
            tried = set()
            for t, key in enumerate(index.read(word, part, group)):
                lo = np.searchsorted(group.keys[t], key, "left")
                hi = np.searchsorted(group.keys[t], key, "right")
                for p in np.flatnonzero(hi > lo):
                    pos = int(part[p])
                    for k in group.owner[t][lo[p] : hi[p]].tolist():
                        if (pos, k) in tried:
                            continue
                        tried.add((pos, k))
                        r = int(row[pos])
                        if found.get((r, k), (9,))[0] == 0:
                            continue
                        slack = index.edits[k]
                        a = max(int(first[r]), pos - slack)
                        b = min(int(first[r + 1]), pos + len(index.items[k]) + 2 * slack)
                        d, end = index.distance(k, word[a:b])
                        if d <= slack and d < found.get((r, k), (1 << 30,))[0]:
                            found[r, k] = (d, max(a, a + end - len(index.items[k])) - int(first[r]), a + end - int(first[r]))
    return [(r, k, *v) for (r, k), v in sorted(found.items())]


def tables_for(recall: float, edits: float, bits: int) -> int:
    """Tables needed so that one of them agrees with the given probability.

    CGK stretches a share e of edited words to at most about 2e differing steps on the walks that
    resynchronise soon (more than half of them); half of the tables are counted as lost. The index
    repeats the tables on several independent walks.
    """
    agree = max(1e-6, (1 - min(0.95, 2 * edits)) ** bits)
    return max(2, int(np.ceil(2 * np.log(1 - recall) / np.log(1 - agree))))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    edits: float = 0.2,
    min_words: int = 6,
    recall: float = 0.95,
    bits: int = 3,
    block: int = 200_000,
) -> DataFrame:
    """One row for each leak: key, item_id, distance, first_word, end_word (words of the document, end exclusive)."""
    kind = docs.schema[key].dataType.simpleString()
    item_kind = benchmark.schema[item].dataType.simpleString()
    types = pa.schema([("key", pa.int64()), ("item", pa.int64()), ("distance", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64())])
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    out = None
    for ids, texts in item_blocks(benchmark, item, item_text, block):
        index = Index(ids, texts, edits, min_words, tables_for(recall, edits, bits), bits)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                keys = batch.column("key").to_pylist()
                got = [(keys[r], index.ids[k], d, a, b) for r, k, d, a, b in search(index, batch.column("text").cast(pa.string()))]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], schema=types)

        part = rows.mapInArrow(run, "key long, item long, distance long, first_word long, end_word long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "key long, item long, distance long, first_word long, end_word long")
    return out.select(F.col("key").cast(kind).alias(key), F.col("item").cast(item_kind).alias("item_id"), "distance", "first_word", "end_word")


def item_blocks(benchmark: DataFrame, item: str, item_text: str, block: int) -> Iterator[tuple[list, list[str]]]:
    """Items in blocks of about ``block`` words, streamed through the driver one block at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null").orderBy("i", "t").toLocalIterator():
        n = len(r["t"].split())
        if texts and size + n > block:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        size += n
    if texts:
        yield ids, texts


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item into a document."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
