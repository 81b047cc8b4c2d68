"""Alignment of two tokenizers over the same texts, and how often their tokens are linked corpus-wide.

Method: interval coalescing. The byte ranges of all tokens of both kinds are sorted by start (one lexsort);
a group ends where a start reaches the running maximum of the ends. Within a group all pairs of an A and a B
token are links.

A is a byte-level tokenizer file, B a sentencepiece model; both read a space and the text. Neither has a
token or pre-token that goes on from a character other than white space into a space (this is checked for B's
pieces; A's splitting has it by form), so texts fall into units there, and tokens of a unit do not depend
on its neighbours. A worker keeps the groups of the units it has met (at most ``KEPT``) and aligns only
new ones; a text's figures are sums over its units. A text with a unit that does not come back as its own
bytes is aligned as a whole.

Corpus-wide counts: each text's distinct linked pairs are written once and counted by key (combined before
the shuffle). Counts go back to the texts in a grid of pair buckets and text groups, sized by the number of pairs
so that a cell holds a bounded part of both; nothing is broadcast but the maximum of each A id (bounded by
A's vocabulary).

Defined results: a null or empty text, or one whose tokens do not join to its bytes, has no tokens, zeros
and an empty digest. Repeated rows are documents of their own; ids may be of any type or null. Other columns are
not read. The tokenizer folder must exist on every machine.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickflow.llm.common import Store, slices, table, text_bytes, word_hashes

FOLDER = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
# The pattern by which byte-level files split texts (fixed values).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT = 400_000  # units a worker keeps
CHUNK = 512  # pairs of a written row
CELL = 1 << 21  # pairs of a cell of the grid, on either side
EXPANDED = 1 << 22  # links made at a time

DIGEST = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 letters
    stand for themselves, the other bytes in order for the letters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (size numbers) of every row, end to end."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def coalesce(starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the intervals by start (then kind), and the group of each in this order: overlapping ones share one."""
    order = np.lexsort((kind, starts))
    reached = np.maximum.accumulate(ends[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = starts[order][1:] >= reached[:-1]
    return order, np.cumsum(fresh) - 1


class Tokens:
    """Both tokenizers, and the bytes of their tokens.

    A's file is a byte-level BPE whose ids are in order of its merges, so its vocabulary serves as ranks.
    """

    def __init__(self, file_a: str, file_b: str):
        import sentencepiece
        import tiktoken

        with open(file_a, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocabulary = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"][x + y] for x, y in merges]
        form = spec["pre_tokenizer"]
        if form.get("type") != "ByteLevel" or not form.get("use_regex") or spec.get("normalizer") or ids != sorted(ids):
            raise ValueError(f"{file_a} is no byte-level BPE with ids in order of its merges")
        self.a = tiktoken.Encoding("a", pat_str=WORD, mergeable_ranks=vocabulary, special_tokens={})
        bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            bytes_a[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        if len(bytes_a) > 1 << 17 or len(pieces) > 1 << 15:
            raise ValueError("pairs hold A ids of 17 bits and B ids of 15 bits")
        if any(x != "▁" and y == "▁" for p in pieces for x, y in zip(p, p[1:])):
            raise ValueError("a piece goes on into a space: texts cannot be cut there")
        self.table_a, self.table_b = Table(bytes_a), Table(bytes_b)
        self.digits = Table([b"%d," % i for i in range(max(len(bytes_a), len(pieces)))])

    def encode(self, texts: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For both kinds the ids end to end and their number in each text, for texts that begin with a space;
        a text whose bytes do not come back has none."""
        strings = [t.decode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        whole, sides = np.ones(len(texts), bool), []
        encode = self.a.encode_ordinary
        for table, lists in (
            (self.table_a, [encode(s) for s in strings]),
            (self.table_b, self.b.encode([s[1:] for s in strings], num_threads=1)),
        ):
            n = np.array([len(x) for x in lists], np.int64)
            ids = np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum()))
            text = np.repeat(np.arange(len(texts)), n)
            fits = np.bincount(text, table.size[ids], len(texts)) == size
            kept = fits[text]
            wrong = table.gather(ids[kept]) != data[np.repeat(fits, size)]
            at = np.cumsum(np.where(fits, size, 0))
            fits[np.searchsorted(at, np.flatnonzero(wrong), "right")] = False
            whole &= fits
            sides.append((ids, n, text))
        return tuple((ids[whole[text]], np.where(whole, n, 0)) for ids, n, text in sides)


class Table:
    """Byte strings by number, end to end."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(x) for x in strings], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def gather(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.first[ids], self.size[ids])]


class Groups:
    """Groups of the tokens of several texts (each text's tokens tile it, so groups never cross texts)."""

    def __init__(self, tokens: Tokens, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]):
        self.tokens, ids = tokens, (a[0], b[0])
        sizes = tokens.table_a.size[ids[0]], tokens.table_b.size[ids[1]]
        ends = np.concatenate([np.cumsum(s) for s in sizes])
        kind = np.repeat([0, 1], [len(x) for x in ids])
        starts = ends - np.concatenate(sizes)
        order, self.group = coalesce(starts, ends, kind)
        self.ids, self.kind = np.concatenate(ids)[order], kind[order]
        self.starts, self.ends = starts[order], ends[order]
        n = int(self.group[-1]) + 1 if len(order) else 0
        self.n_a = np.bincount(self.group[self.kind == 0], minlength=n)
        self.n_b = np.bincount(self.group[self.kind == 1], minlength=n)
        self.first = np.searchsorted(self.group, np.arange(n + 1))
        text = np.concatenate([np.repeat(np.arange(len(x)), x) for x in (a[1], b[1])])[order]
        self.text = text[self.first[:-1]]  # of each group

    def by_side(self) -> np.ndarray:
        """Ids group by group, those of A first."""
        return self.ids[np.lexsort((self.kind, self.group))]

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """The groups as bytes, each as its A ids, a bar, its B ids and a semicolon; and the length of each."""
        ids = self.by_side()
        size = self.tokens.digits.size[ids]
        out, ends = self.tokens.digits.gather(ids), np.cumsum(size)
        last = np.cumsum(self.n_a + self.n_b)
        out[ends[last - 1] - 1] = ord(";")
        out[ends[last - self.n_b - 1] - 1] = ord("|")
        return out, np.diff(np.r_[0, ends[last - 1]])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pair (A id and B id in one number) and number of links: one row for each pair of a text."""
        sides = []
        for kind in (0, 1):
            key, n = np.unique(self.group[self.kind == kind] << 20 | self.ids[self.kind == kind], return_counts=True)
            sides.append((key >> 20, key & 0xFFFFF, n))
        (group, a, n), (group_b, b, m) = sides
        low, high = np.searchsorted(group_b, group, "left"), np.searchsorted(group_b, group, "right")
        out = []
        cuts = np.searchsorted(np.cumsum(high - low), np.arange(EXPANDED, int((high - low).sum()) + EXPANDED, EXPANDED))
        at = 0
        for to in [*(cuts + 1).tolist(), len(group)]:
            to = min(to, len(group))
            if at < to:
                wide = high[at:to] - low[at:to]
                other = ranges(low[at:to], wide)
                key = np.repeat(self.text[group[at:to]] << 36 | a[at:to] << 18, wide) | b[other]
                out.append(summed(key, np.repeat(n[at:to], wide) * m[other]))
                at = to
        key, links = summed(*map(np.concatenate, zip(*out))) if out else (np.empty(0, np.int64), np.empty(0, np.int64))
        return key >> 36, key & ((1 << 36) - 1), links


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``n`` over each."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


_loaded: dict[tuple[str, str], "Units"] = {}


def loaded(folder: str, file_a: str, file_b: str) -> "Units":
    """This worker's tokenizers and units."""
    files = os.path.join(folder, file_a), os.path.join(folder, file_b)
    if files not in _loaded:
        _loaded[files] = Units(Tokens(*files))
    return _loaded[files]


class Units:
    """Figures of the units met so far: token, group and link counts, the digest's text, the pairs."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.figures = np.zeros((0, 4), np.int64)
        self.length, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.written = np.zeros(0, np.uint8)
        self.pair, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def aligned(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of texts: figures, lengths and bytes of what is written, number of pairs, pairs and their links."""
        a, b = self.tokens.encode(texts)
        groups, n = Groups(self.tokens, a, b), len(texts)
        text, pair, links = groups.pairs()
        written, length = groups.written()
        count = np.bincount(groups.text, minlength=n)
        figures = [a[1], b[1], count, np.bincount(groups.text, groups.n_a * groups.n_b, n)]
        length = np.bincount(groups.text, length, n).astype(np.int64)
        return np.stack(figures, axis=1).astype(np.int64), length, written, np.bincount(text, minlength=n), pair, links

    def add(self, units: list[bytes]) -> None:
        old = self.figures, self.length, self.written, self.sizes, self.pair, self.links
        new = [np.concatenate(x) for x in zip(old, self.aligned(units))]
        self.figures, self.length, self.written, self.sizes, self.pair, self.links = new

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each unit; new ones are aligned and kept."""
        keys, first, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.place) > KEPT:
            self.clear()
        new, known = [], self.place
        for key, i in zip(keys.tolist(), first.tolist()):
            if key not in known:
                known[key] = len(known)
                new.append(data[starts[i] : ends[i]].tobytes())
        if new:
            self.add(new)
        return np.array([known[k] for k in keys.tolist()], np.int64)[back]


def unit_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where units begin: at every text, and at a space behind a character that is surely no white space."""
    before, two, three = (np.concatenate([np.zeros(k, np.uint8), data])[: len(data)] for k in (1, 2, 3))
    wide = (two == 0xC2) & ((before == 0x85) | (before == 0xA0)) | (three >= 0xE1) & (three <= 0xE3) & (before < 0xB0)
    cut = (data == 0x20) & (before > 0x20) & ~((before >= 0x80) & wide)
    cut[offs[:-1][offs[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


def measured(folder: str, file_a: str, file_b: str):
    """Of every text its figures and digest, and its distinct pairs in rows of at most ``CHUNK``."""

    def piece(batch: pa.RecordBatch, units: Units) -> pa.RecordBatch:
        uid, texts = batch.column(0).to_numpy(), batch.column(1).fill_null("")
        data, offs = text_bytes(pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type)))
        starts = unit_starts(data, offs)
        place = units.find(data, starts, np.r_[starts[1:], len(data)])
        rows = len(uid)
        row = np.searchsorted(offs, starts, "right") - 1
        bounds = np.searchsorted(row, np.arange(rows + 1))
        figures = np.stack([np.bincount(row, units.figures[place, k], rows) for k in range(4)], axis=1).astype(np.int64)
        broken = np.bincount(row, units.figures[place, 0] == 0, rows) > 0
        figures[broken] = 0
        blank = offs[1:] - offs[:-1] <= 1  # the space alone
        length = units.length[place]
        written = units.written[ranges((np.cumsum(units.length) - units.length)[place], length)]
        ends = np.r_[0, np.cumsum(length)][bounds]
        digest = [""] * rows
        for i in np.flatnonzero(~broken & ~blank).tolist():
            digest[i] = hashlib.sha256(written[ends[i] : ends[i + 1] - 1]).hexdigest()  # without the last semicolon
        figures[blank] = 0
        use = ~(broken | blank)[row]
        key, times = np.unique(row[use] << 32 | place[use], return_counts=True)
        row_of, place_of = key >> 32, key & 0xFFFFFFFF
        first = np.cumsum(units.sizes) - units.sizes
        size = units.sizes[place_of]
        at = ranges(first[place_of], size)
        owner, pair, links = [np.repeat(row_of, size)], [units.pair[at]], [units.links[at] * np.repeat(times, size)]
        for i in np.flatnonzero(broken & ~blank).tolist():
            numbers, _, written, _, p, n = units.aligned([data[offs[i] : offs[i + 1]].tobytes()])
            figures[i] = numbers[0]
            digest[i] = hashlib.sha256(written[:-1]).hexdigest() if len(p) else ""
            owner.append(np.full(len(p), i))
            pair.append(p)
            links.append(n)
        owner, pair, links = map(np.concatenate, (owner, pair, links))
        by_row = np.lexsort((pair, owner))
        owner, pair, links = owner[by_row], pair[by_row], links[by_row]
        fresh = np.r_[True, (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])] if len(owner) else np.empty(0, bool)
        first = np.flatnonzero(fresh)
        owner, pair = owner[first], pair[first]
        links = np.add.reduceat(links, first) if len(first) else links
        # rows: one for each text and every CHUNK of its pairs; only the first has the figures
        have = np.bincount(owner, minlength=rows)
        chunks = np.maximum(-(-have // CHUNK), 1)
        line = np.repeat(np.arange(rows), chunks)
        part = ranges(np.zeros(rows, np.int64), chunks)
        length = np.minimum(have[line] - part * CHUNK, CHUNK).clip(0)
        ends = pa.array(np.r_[0, np.cumsum(length)].astype(np.int32))
        head = part > 0
        columns = [pa.array(uid[line]), batch.column(2).take(pa.array(line))]
        columns += [pa.array(figures[line, k], mask=head) for k in range(4)]
        columns.append(pa.array([None if h else digest[i] for h, i in zip(head.tolist(), line.tolist())], pa.string()))
        # A id and B id in 32 bits: 17 and 15
        columns.append(pa.ListArray.from_arrays(ends, pa.array(((pair >> 18) << 15 | pair & 0x3FFFF).astype(np.uint32).view(np.int32))))
        columns.append(pa.ListArray.from_arrays(ends, pa.array(links.astype(np.int64))))
        return pa.RecordBatch.from_arrays(columns, names=["uid", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = None
        for batch in slices(batches, "text", 1 << 20):
            units = units or loaded(folder, file_a, file_b)
            yield piece(batch, units)

    return run


def packed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, pair, n, best) as one row of arrays for each bucket of a batch."""
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        order = np.argsort(bucket, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else np.empty(0, np.int64)
        ends = pa.array(np.r_[first, len(order)].astype(np.int32))
        arrays = [pa.ListArray.from_arrays(ends, batch.column(k).take(pa.array(order))) for k in (1, 2, 3)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[order][first]), *arrays], names=["bucket", "pairs", "n", "best"])


def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the pairs of each text's rows. In every cell the counts come first."""
    cell, counts, sorted_counts = None, [], None
    for batch in batches:
        key = np.stack([batch.column(i).to_numpy() for i in range(3)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for at, to in zip(cuts, cuts[1:]):
            if at == to:
                continue
            part = batch.slice(at, to - at)
            if cell != (here := tuple(key[:2, at].tolist())):
                cell, counts, sorted_counts = here, [], None
            if key[2, at] == 0:
                counts.append([part.column(k).flatten().to_numpy(zero_copy_only=False) for k in (4, 5, 6)])
                continue
            if sorted_counts is None:
                pair, n, best = map(np.concatenate, zip(*counts))
                order = np.argsort(pair)
                sorted_counts, counts = (pair[order], n[order], best[order]), []
            pair, n, best = sorted_counts
            where = np.searchsorted(pair, part.column(4).flatten().to_numpy())
            links = part.column(5).flatten().to_numpy()
            size = pc.list_value_length(part.column(4)).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            sums = [np.zeros(len(size), np.int64) for _ in range(2)]
            np.add.at(sums[0], row, links * best[where])
            np.add.at(sums[1], row, links * n[where])
            yield pa.RecordBatch.from_arrays([part.column(3), *map(pa.array, sums)], names=["uid", "n_best", "count_sum"])


def link_counts(store: Store, pairs: DataFrame) -> DataFrame:
    """For every linked pair of ids in how many texts it is linked, and whether no pair of its A id has more."""
    counts = pairs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = store.put(counts.withColumn("a", F.shiftrightunsigned("pair", 15)), "counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most one row for each A id
    return counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    folder: str = FOLDER,
    file_a: str = FILE_A,
    file_b: str = FILE_B,
    cell: int = CELL,
) -> DataFrame:
    """Per text: key, n_a, n_b, n_groups, n_links, n_best (links whose pair is counted as often as any of its A id),
    count_sum (counts of all links), groups_sha256. ``cell`` bounds the pairs of a cell, not the result."""
    spark = docs.sparkSession
    store = Store(spark, "alignment")
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text"), F.col(key).alias("key"))
    kind = texts.schema["key"].dataType.simpleString()
    schema = f"uid long, key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, links array<long>"
    lines = store.put(texts.mapInArrow(measured(folder, file_a, file_b), schema), "lines")
    pairs = lines.where(F.size("pairs") > 0).select("uid", "pairs", "links")
    counts = store.put(link_counts(store, pairs), "model")
    n_counts, n_pairs = counts.count(), pairs.agg(F.sum(F.size("pairs"))).first()[0] or 0
    buckets = max(-(-n_counts // cell), 1)
    groups = max(-(-n_pairs // (buckets * cell)), 1)
    bucket = F.pmod("pair", F.lit(buckets))
    model = counts.select(bucket.alias("bucket"), "pair", "n", "best").mapInArrow(
        packed_counts, "bucket int, pairs array<int>, n array<long>, best array<boolean>"
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    model = model.select(every.alias("g"), F.col("bucket").alias("b"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("uid"), "pairs", "n", "best")
    group = F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int")
    sent = pairs.select(group.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("b"), F.lit(1).alias("kind"), "*")
    if buckets > 1:
        mine = F.filter(F.arrays_zip("pairs", "links"), lambda x: F.pmod(x["pairs"], F.lit(buckets)) == F.col("b"))
        sent = sent.withColumn("mine", mine).withColumns({"pairs": F.col("mine.pairs"), "links": F.col("mine.links")}).drop("mine")
    sent = sent.withColumnRenamed("links", "n").withColumn("best", F.lit(None).cast("array<boolean>"))
    cores = spark.sparkContext.defaultParallelism
    tasks = min(groups * buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores))
    cells = model.unionByName(sent).repartition(tasks, "g", "b").sortWithinPartitions("g", "b", "kind")
    found = cells.mapInArrow(looked_up, "uid long, n_best long, count_sum long")
    sums = found.groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    heads = lines.where(F.col("n_a").isNotNull()).drop("pairs", "links")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return heads.join(sums, "uid", "left").select(F.col("key").alias(key), *DIGEST[:4], *zero, DIGEST[4])


def token_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B
) -> DataFrame:
    """The groups themselves: key, first and last byte (exclusive) in a space and the text, ids of both kinds."""
    texts = docs.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            tokens = loaded(folder, file_a, file_b).tokens
            whole = [b" " + t.encode() for t in batch.column(1).to_pylist()]
            groups = Groups(tokens, *tokens.encode(whole))
            if not len(groups.text):
                continue
            begin, end = groups.starts[groups.first[:-1]], groups.ends[groups.first[1:] - 1]
            fresh = np.r_[True, np.diff(groups.text) != 0]
            origin = begin[fresh][np.cumsum(fresh) - 1]
            ids, cut = groups.by_side(), np.cumsum(groups.n_a + groups.n_b)
            a, b = ([ids[x:y] for x, y in zip(lo, hi)] for lo, hi in ((cut - groups.n_a - groups.n_b, cut - groups.n_b), (cut - groups.n_b, cut)))
            columns = [batch.column(0).take(pa.array(groups.text)), pa.array(begin - origin), pa.array(end - origin)]
            columns += [pa.array(list(a), pa.list_(pa.int64())), pa.array(list(b), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "end", "a", "b"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.mapInArrow(run, f"key {kind}, start long, end long, a array<long>, b array<long>").withColumnRenamed("key", key)


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Alignment of the two tokenizers over all documents."""
    return align(table(spark, sf_dir, "documents"))
