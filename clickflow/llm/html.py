"""Main text of web pages by nearest-URL page differencing.

Each page is cut into text lines, one per block element, with the zone of the page that a
line stands in. Pages stand in the order of host, path and id; pages that follow each other with the same html are
one run. Each run is compared with the ``NEAR`` runs before and the ``NEAR`` runs after it on its host: lines are
aligned by longest common subsequence. Pages that share more than half of the main text (characters of the
lines that landmarks would keep) are near copies of one article and no witnesses; the others are. A line that
the nearest witness on either side shares is deleted as template. Inside of an article one shared sentence says
little, so there a line goes only if ``STRONG`` witnesses or more were found and three quarters of them share it.
Of what is left, landmarks decide: the lines of the article if the page has one, else those of <main>, else all
that stand outside of menus, notices, forms and the like.

Class, id and role names mark boilerplate by whole tokens, never on html, body, main or article, and an
article or main inside an element so marked (or a form) is text again. Hidden elements, menus, footers
and the like stay closed.

Spark: the ids are sorted by range (small columns and a hash of the html), which gives the cuts between blocks of
neighbouring pages, and for each cut the few runs on either side of it (at most 2 * ``NEAR`` rows a cut go
to the driver and to all tasks, whatever the pages). Pages are then parsed where they are read and shuffled
once, as lines, to their block; those beside a cut go to the other block too. So neighbours do not depend on
the number of partitions.

Null or empty html gives an empty text; a page whose url is null or names no host has no neighbours. Pages alone on
their host keep what the landmarks allow. Repeated rows are extracted alike. A tag that is never closed is text.
Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickflow.llm.common import Store, slices, table

NEAR = 4  # runs of pages on either side that a page is compared with
STRONG = 3  # witnesses that are needed against a line of an article
NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile(r"""[>"']""")
# Elements whose content is no text.
RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>?", re.I) for n in "script style template noscript svg iframe textarea title math".split()}
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""\shidden(?:[\s=]|\Z)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
# Element names and name parts that mark zones.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
BOILER_TAGS = frozenset("nav footer aside form button select option dialog menu fieldset head".split())
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies dialog disqus footer login menu modal nav navbar navigation newsletter notice notices popup "
    "promo promotion related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TRACKED = frozenset("div section article main nav footer header aside form ul ol table td tr button select dialog menu fieldset head body".split())
ROOTS = frozenset("html body".split())
CLOSED = BOILER_TAGS - {"form", "fieldset"}  # no article or main inside opens these again
HIDING, BOILER, NEUTRAL, MAIN, ARTICLE = -1, 0, 1, 2, 3


def tag_end(html: str, at: int) -> int:
    """Position behind the > that ends a tag whose name ends at ``at``; quoted ones count only if the quotes are never
    closed. -1 if there is none."""
    p = at
    while m := STOP.search(html, p):
        if m[0] == ">":
            return m.end()
        p = html.find(m[0], m.end()) + 1
        if not p:
            break
    return html.find(">", at) + 1 or -1


def markup(html: str) -> Iterator[tuple[str | None, bool, str, str]]:
    """The page in one pass forward: (None, False, "", text) and (tag name, closing, attributes, "")."""
    at = begin = 0
    while (lt := html.find("<", at)) >= 0:
        name = NAME.match(html, lt + 1)
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 2) + 3
            end = end if end > 2 else len(html)
        elif name or html.startswith(("<!", "<?"), lt):
            end = tag_end(html, name.end()) if name else html.find(">", lt) + 1 or -1
            if end < 0:  # no > from here on: no more tags
                break
        else:
            at = lt + 1
            continue
        if lt > begin:
            yield None, False, "", html[begin:lt]
        if name:
            tag = name[2].lower()
            if tag in RAW and not name[1] and not (tag in ("svg", "math") and html[end - 2] == "/"):
                last = RAW[tag].search(html, end)
                end = last.end() if last else len(html)
            elif tag not in RAW:
                yield tag, bool(name[1]), html[name.end() : end - 1], ""
        at = begin = end
    if begin < len(html):
        yield None, False, "", html[begin:]


def page_lines(html: str) -> tuple[list[str], list[int]]:
    """Text lines of a page in order, and the zone of each."""
    lines: list[str] = []
    zones: list[int] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    zone, parts = NEUTRAL, []

    def close() -> None:
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            lines.append(text)
            zones.append(zone)
        parts.clear()

    for name, closing, attrs, text in markup(html):
        if name is None:
            parts.append(text)
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            continue
        close()
        if closing:
            while opened[name]:
                last, zone = stack.pop()
                opened[last] -= 1
                if last == name:
                    break
            continue
        if name in VOID:
            continue
        inner = zone
        if zone != HIDING:
            words = {w for v in NAMED.findall(attrs) for w in v.strip("\"'").lower().split()} if "=" in attrs else set()
            landmark = name in ("article", "main") or "main" in words and "role" in attrs.lower()
            if name in CLOSED or (HIDDEN.search(attrs) if attrs else None):
                inner = HIDING
            elif landmark and zone == BOILER:
                inner = NEUTRAL  # main text under a misleading name, or teasers: ranked like other text
            elif name == "article":
                inner = ARTICLE
            elif landmark:
                inner = max(zone, MAIN)
            elif name in BOILER_TAGS or name not in ROOTS and words & BOILER_NAMES or name == "header" and zone != ARTICLE:
                inner = BOILER
        if name in TRACKED or inner != zone:
            stack.append((name, zone))
            opened[name] += 1
            zone = inner
    close()
    return lines, zones


def rows_of(a: list, b: list) -> list[int]:
    """Bit-parallel rows of the longest common subsequence: zero bits of row i below j are its length for the first i of
    a and j of b. One number for each row."""
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    full = (1 << len(b)) - 1
    masks: dict = {}
    bits, v = [full], full
    for x in a:
        if x not in masks:
            flags = np.zeros(len(b) + 1, np.uint8)
            flags[where.get(x, [])] = 1
            masks[x] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
        u = v & masks[x]
        v = ((v + u) | (v - u)) & full
        bits.append(v)
    return bits


def lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of a with every beginning of b; one row is held."""
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        places = where.get(x)
        if places is None:
            continue
        if len(places) == 1:
            u = v & 1 << places[0]
        else:
            flags = np.zeros(len(b), np.uint8)
            flags[places] = 1
            u = v & int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
        v = ((v + u) | (v - u)) & full
    ones = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - ones.astype(np.int64))])


SMALL = 1 << 22  # bits of a table of rows that is held at once


def longest(a: list, b: list, base: int, out: set[int]) -> None:
    """Adds the positions of ``a`` (from ``base``) in a longest common subsequence; large ones are halved, so that
    memory stays in proportion to a and b."""
    if not a or not b:
        return
    if len(a) > 1 and len(a) * len(b) > SMALL:
        mid = len(a) // 2
        j = int(np.argmax(lengths(a[:mid], b) + lengths(a[mid:][::-1], b[::-1])[::-1]))
        longest(a[:mid], b[:j], base, out)
        longest(a[mid:], b[j:], base + mid, out)
        return
    bits = rows_of(a, b)

    def length(i: int, j: int) -> int:
        return j - (bits[i] & ((1 << j) - 1)).bit_count()

    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(base + i - 1)
            i, j = i - 1, j - 1
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1


def aligned(a: list, b: list) -> set[int]:
    """Positions of ``a`` in a longest common subsequence of a and b."""
    out: set[int] = set()
    lo, na, nb = 0, len(a), len(b)
    while lo < na and lo < nb and a[lo] == b[lo]:
        out.add(lo)
        lo += 1
    while na > lo and nb > lo and a[na - 1] == b[nb - 1]:
        na, nb = na - 1, nb - 1
        out.add(na)
    common = set(a[lo:na]) & set(b[lo:nb])
    rows = [i for i in range(lo, na) if a[i] in common]
    found: set[int] = set()
    longest([a[i] for i in rows], [x for x in b[lo:nb] if x in common], 0, found)
    return out.union(rows[i] for i in found)


def alike(lines: list[str], zones: list[int], shared: set[int]) -> bool:
    """Whether the shared lines are more than half of what landmarks alone would keep."""
    best = max(zones, default=BOILER)
    sizes = [(len(t), i in shared) for i, (t, z) in enumerate(zip(lines, zones)) if z == best]
    return 2 * sum(n for n, s in sizes if s) > sum(n for n, _ in sizes)


def template(lines: list[str], zones: list[int], before: list[list[str]], after: list[list[str]]) -> set[int]:
    """Positions of the lines that go: ``before`` and ``after`` are the lines of the neighbours, nearest first."""
    gone: set[int] = set()
    votes: Counter[int] = Counter()
    witnesses = 0
    for side in (before, after):
        nearest = True
        for other in side:
            shared = aligned(lines, other)
            if alike(lines, zones, shared):
                continue
            witnesses += 1
            votes.update(shared)
            if nearest:
                gone.update(i for i in shared if zones[i] != ARTICLE)
                nearest = False
    if witnesses >= STRONG:
        gone.update(i for i, n in votes.items() if zones[i] == ARTICLE and 4 * n >= 3 * witnesses)
    return gone


def main_text(lines: list[str], zones: list[int], shared: set[int]) -> str:
    left = [(t, z) for i, (t, z) in enumerate(zip(lines, zones)) if i not in shared]
    best = max((z for _, z in left), default=BOILER)
    return "\n".join(t for t, z in left if z == best) if best > BOILER else ""


ADDRESS = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^#]*)"


ORDER = ("host", "path", "key", "h1", "h2")


def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range of ids its first and its last ``NEAR`` + 1 runs: one page of each."""
    block = TaskContext.get().partitionId()
    first: list[dict] = []
    last: deque[dict] = deque(maxlen=NEAR + 1)
    run = None
    for batch in batches:
        for row in batch.to_pylist():
            here = (row["host"], row["h1"], row["h2"])
            if here != run:
                run = here
                if len(first) <= NEAR:
                    first.append(row)
                last.append(row)
    rows = [(block, side, i, *(r[c] for c in ORDER)) for side, rs in ((0, first), (1, last)) for i, r in enumerate(rs)]
    if rows:
        names = ["block", "side", "place", *ORDER]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema([("block", pa.int32()), ("side", pa.int32()), ("place", pa.int32()), *[(c, batch.schema.field(c).type) for c in ORDER]]))


def cuts_and_context(rows: list) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """First id of every block but the first, and the other blocks that need a page as a neighbour: up to ``NEAR`` runs of
    the same host on either side of each cut, through blocks of few runs where need be."""
    blocks: dict[int, tuple[list, list]] = {}
    for r in sorted(rows, key=lambda r: (r["block"], r["side"], r["place"])):
        blocks.setdefault(r["block"], ([], []))[r["side"]].append(tuple(r[c] for c in ORDER))
    order = sorted(blocks)
    context: dict[tuple, list[int]] = {}

    def reach(k: int, step: int) -> None:
        """The runs that block k has behind its border on one side."""
        edge = blocks[order[k]][0][0] if step < 0 else blocks[order[k]][1][-1]
        run, found, j = (edge[0], *edge[3:]), 0, k + step
        while 0 <= j < len(order) and found < NEAR:
            whole = blocks[order[j]][1][::-1] if step < 0 else blocks[order[j]][0]
            for page in whole:
                if page[0] != edge[0] or found == NEAR:
                    return
                if (page[0], *page[3:]) != run:
                    run, found = (page[0], *page[3:]), found + 1
                    context.setdefault(page, []).append(k)
            j += step  # the block has no further runs

    for k in range(len(order)):
        reach(k, -1)
        reach(k, 1)
    return [blocks[b][0][0] for b in order[1:]], context


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text (main text, blocks joined by one newline), n_chars (code points)."""
    spark = pages.sparkSession
    kind = pages.schema[key].dataType.simpleString()
    host = F.coalesce(F.lower(F.regexp_extract("url", ADDRESS, 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", ADDRESS, 2), F.lit(""))
    hashes = [F.coalesce(F.xxhash64("html", *more), F.lit(0)) for more in ((), (F.lit(1),))]
    # a null key sorts first in Spark and has no order in Python: its text does
    name = F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    ids = rows.select(host.alias("host"), path.alias("path"), name, *[h.alias(f"h{i + 1}") for i, h in enumerate(hashes)])
    ids = Store(spark, "html").put(ids.where("host <> ''"), "ids")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = ids.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)
    found = ranged.mapInArrow(borders, "block int, side int, place int, host string, path string, key string, h1 long, h2 long").collect()
    shared = spark.sparkContext.broadcast(cuts_and_context([r.asDict() for r in found]))

    key_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    columns = ["block", "context", "host", "path", "name", "h1", "h2", "key", "url", "lines", "zones"]
    schema = f"block int, context boolean, host string, path string, name string, h1 long, h2 long, key {kind}, url string, lines array<string>, zones array<tinyint>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, context = shared.value
        for batch in slices(batches, "html", 1 << 21):
            ids = list(zip(*(batch.column(i).to_pylist() for i in range(5))))
            got = [page_lines(h) for h in batch.column(7).to_pylist()]
            take, block, other = [], [], []
            for i, page in enumerate(ids):
                take.append(i)
                block.append(bisect_right(cuts, page) if page[0] else -1 - i % n)
                other.append(False)
                for b in context.get(page, ()):
                    take.append(i)
                    block.append(b)
                    other.append(True)
            picked = batch.select(range(7)).take(pa.array(take))
            lines, zones = (pa.array([got[i][k] for i in take], pa.list_(t)) for k, t in ((0, pa.string()), (1, pa.int8())))
            arrays = [pa.array(block, pa.int32()), pa.array(other), *[picked.column(i) for i in range(7)], lines, zones]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        size = 0

        def batch() -> pa.RecordBatch:
            keys, urls, found = zip(*kept) if kept else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(urls, pa.string()), pa.array(found, pa.string())], names=["key", "url", "text"])

        for members, text in runs(batches):
            for page in members:
                kept.append((*page, text))
                size += len(text)
                if size > 1 << 22:
                    yield batch()
                    kept, size = [], 0
        yield batch()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, str]]:
        """Pages of each run of a block with their text, once the runs behind it are known."""
        held: list[dict] = []  # runs in order: up to NEAR done ones, then those to do
        done, place = 0, None

        def text(k: int) -> tuple[list, str]:
            run = held[k]
            before = [r["lines"] for r in held[max(0, k - NEAR) : k]][::-1]
            gone = template(run["lines"], run["zones"], before, [r["lines"] for r in held[k + 1 : k + 1 + NEAR]])
            return run["pages"], main_text(run["lines"], run["zones"], gone)

        pieces = (batch.slice(at, 200) for batch in batches for at in range(0, batch.num_rows, 200))
        for piece in pieces:
            for row in piece.to_pylist():
                if place != (row["block"], row["host"]) or not row["host"]:
                    yield from (text(k) for k in range(done, len(held)) if held[k]["pages"])
                    held, done, place = [], 0, (row["block"], row["host"])
                same = (row["h1"], row["h2"])
                if not held or held[-1]["same"] != same:
                    held.append({"same": same, "lines": row["lines"], "zones": row["zones"], "pages": []})
                if not row["context"]:
                    held[-1]["pages"].append((row["key"], row["url"]))
                while done + NEAR < len(held) - 1:
                    if held[done]["pages"]:
                        yield text(done)
                    done += 1
                    if done > NEAR:
                        del held[0]
                        done -= 1
        yield from (text(k) for k in range(done, len(held)) if held[k]["pages"])

    named = rows.select(host.alias("host"), path.alias("path"), name.alias("name"), *[h.alias(f"h{i + 1}") for i, h in enumerate(hashes)], "key", "url", "html")
    lined = named.mapInArrow(cut, schema)
    near = lined.repartition(n, "block").sortWithinPartitions("block", "host", "path", "name", "h1", "h2", "context")
    out = near.mapInArrow(texts, f"key {kind}, url string, text string")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
