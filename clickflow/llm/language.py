"""Language identification of mixed-language text.

Letters are grouped into words. The script of a word (a code-point range) narrows the
candidate languages to those that use this script in the training texts. Each word gets a
log-likelihood per candidate from hashed character n-grams (1 to 4 letters, word borders
included). Viterbi over the words of a text, with a penalty for each change of language,
labels spans; the text's language is the one with the most letters.

Training reads a bounded sample of labelled rows (``per_lang`` texts a language, by hash);
every row is scored over its whole text.

Nulls and texts without letters give ``und`` with score 0 and no spans. Rows with a null
language are never trained on. An empty training table gives ``und`` everywhere. Repeated
rows are scored alike; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickflow.llm.common import mix, slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"

# First code points of script blocks and the script's number (0: other).
SCRIPTS = (
    (0x0041, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0780, 0),
    (0x0900, 7), (0x0980, 8), (0x0A00, 0), (0x0B80, 9), (0x0C00, 0), (0x0E00, 10), (0x0E80, 0), (0x10A0, 11),
    (0x1100, 12), (0x1200, 13), (0x1380, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 14), (0x3100, 0),
    (0x3400, 15), (0xA000, 0), (0xAC00, 12), (0xD7B0, 0), (0xF900, 15), (0xFB00, 0), (0x20000, 15), (0x30000, 0),
)
N_SCRIPTS = 16
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def script_of(cp: np.ndarray) -> np.ndarray:
    at = np.searchsorted(np.array([s for s, _ in SCRIPTS]), cp, "right") - 1
    return np.array([k for _, k in SCRIPTS])[np.maximum(at, 0)]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, each text closed by one 0; first position of each."""
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.concatenate([[0], np.cumsum(lens)])


def lowered(cp: np.ndarray) -> np.ndarray:
    """Simple lower case, one code point for one, so that positions stay."""
    out = cp.copy()
    for c in np.unique(cp):
        low = chr(c).lower()
        if len(low) == 1 and ord(low) != c:
            out[cp == c] = ord(low)
    return out


def grams(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """For each n: (word of each gram, bucket of each gram); words are framed by two borders."""
    size = ends - starts + 2
    first = np.concatenate([[0], np.cumsum(size)])
    flat = np.zeros(first[-1], np.uint64)
    word = np.repeat(np.arange(len(starts)), size)
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    inner[first[1:] - 1] = False
    take = np.repeat(starts - first[:-1] - 1, size) + np.arange(first[-1])
    flat[inner] = cp[take[inner]].astype(np.uint64) + np.uint64(1)
    key = np.zeros_like(flat)
    for n in ORDERS:
        key = key[: len(flat) - n + 1] * np.uint64(0x1F3D5B79A7C15) + flat[n - 1 :]
        whole = word[: len(key)] == word[n - 1 :]
        if n == 1:
            whole = whole & inner
        yield word[: len(key)][whole], (mix(key[whole] + np.uint64(n << 56)) >> np.uint64(48)).astype(np.int64)


@dataclass
class LanguageModel:
    langs: list[str]
    weight: np.ndarray  # (orders, buckets, langs): log-probability of a gram
    scripts: np.ndarray  # (scripts, langs): whether the language uses the script
    switch: float


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 1500, switch: float = 6.0
) -> LanguageModel:
    """Learn gram log-probabilities from about ``per_lang`` labelled texts a language.

    The sample is drawn by a hash of the key, so its size is bounded whatever the table's size.
    Gram counts are summed on the executors; the driver gets one row per (language, order) at most.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((len(ORDERS), BUCKETS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool), switch)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_lang / n))])
    draw = F.pmod(F.xxhash64(F.lit(17), "key"), F.lit(1 << 20)) / float(1 << 20)
    sample = known.where(draw < share[F.col("lang")])
    at = {k: i for i, k in enumerate(langs)}

    def count(batches):
        total = np.zeros((len(langs), len(ORDERS), BUCKETS), np.int64)
        seen = np.zeros((len(langs), N_SCRIPTS), np.int64)
        for batch in slices(batches, "text"):
            own = np.array([at[x] for x in batch.column("lang").to_pylist()])
            for k in range(len(langs)):
                texts = [t or "" for t in batch.column("text").filter(pa.array(own == k)).to_pylist()]
                if not texts:
                    continue
                cp, _ = code_points(texts)
                starts, ends = words_of(cp)
                if not len(starts):
                    continue
                cp = lowered(cp)
                np.add.at(seen[k], script_of(cp[starts]), ends - starts)
                for n, (_, bucket) in enumerate(grams(cp, starts, ends)):
                    total[k, n] += np.bincount(bucket, minlength=BUCKETS)
        for k in range(len(langs)):
            if seen[k].any():
                for n in range(len(ORDERS)):
                    hit = np.flatnonzero(total[k, n])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(hit), k, np.int32)), pa.array(np.full(len(hit), n, np.int32)), pa.array(hit.astype(np.int32)), pa.array(total[k, n][hit])],
                        names=["lang", "n", "bucket", "c"],
                    )
                hit = np.flatnonzero(seen[k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(hit), k, np.int32)), pa.array(np.full(len(hit), -1, np.int32)), pa.array(hit.astype(np.int32)), pa.array(seen[k][hit])],
                    names=["lang", "n", "bucket", "c"],
                )

    rows = sample.select("text", "lang").mapInArrow(count, "lang int, n int, bucket int, c long")
    rows = rows.groupBy("lang", "n").agg(F.collect_list(F.struct("bucket", "c")).alias("cells"))
    counts = np.zeros((len(ORDERS), BUCKETS, len(langs)))
    seen = np.zeros((N_SCRIPTS, len(langs)))
    for r in rows.toLocalIterator():
        cells = np.array([(c["bucket"], c["c"]) for c in r["cells"]])
        cell = (seen if r["n"] < 0 else counts[r["n"]])
        np.add.at(cell[:, r["lang"]], cells[:, 0], cells[:, 1])
    weight = np.log((counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * BUCKETS)) / len(ORDERS)
    return LanguageModel(langs, weight.astype(np.float32), seen >= 0.01 * np.maximum(seen.sum(0), 1), switch)


def words_of(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = letters()[cp]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def viterbi(score: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word. score: (words, labels); first: word range of each text.

    All texts advance together, one word a step; longer texts come first, so the texts
    that still run are a prefix of the order.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    steps = int(size[0]) if len(size) else 0
    label = np.empty(len(score), np.int64)
    if not steps:
        return label
    active = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
    top = np.empty(len(score), np.int64)  # best label before each word
    stay = np.empty(score.shape, bool)  # whether a label is kept rather than entered by a switch
    last = np.empty(active[0], np.int64)  # label at the end of each text
    best = score[begin[: active[0]]]
    for t in range(1, steps):
        a = active[t]
        last[a : len(best)] = best[a:].argmax(1)
        best, at = best[:a], begin[:a] + t
        top[at] = arg = best.argmax(1)
        jump = (best[np.arange(a), arg] - switch)[:, None]
        stay[at] = best >= jump
        best = np.maximum(best, jump) + score[at]
    last[: len(best)] = best.argmax(1)
    now = last
    for t in range(steps - 1, -1, -1):
        a = active[t]
        at = begin[:a] + t
        label[at] = now[:a]
        if t:
            now[:a] = np.where(stay[at, now[:a]], now[:a], top[at])
    return label


def label_words(model: LanguageModel, texts: list[str]):
    """Word starts and ends in code points of each text, word label, first word of each text."""
    cp, first = code_points(texts)
    starts, ends = words_of(cp)
    row = np.searchsorted(first, starts, "right") - 1
    at = np.searchsorted(row, np.arange(len(texts) + 1))
    score = np.zeros((len(starts), len(model.langs)))
    low = lowered(cp)
    for n, (word, bucket) in enumerate(grams(low, starts, ends)):
        if len(word):
            edge = np.flatnonzero(np.diff(word, prepend=-1))
            score[word[edge]] += np.add.reduceat(model.weight[n][bucket], edge, axis=0)
    usable = model.scripts[script_of(low[starts])]
    usable |= ~usable.any(1, keepdims=True)
    score[~usable] -= 1e4
    return starts - first[row], ends - first[row], viterbi(score, at, model.switch), at, row


SPANS = "array<struct<start:long,end:long,lang:string>>"


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """Language of each whole text: key, lang_pred, score (share of its letters), optionally labelled spans.

    Spans are in code points, end exclusive, words of one language joined.
    """
    kinds = f"key {docs.schema[key].dataType.simpleString()}, lang_pred string, score double" + (f", spans {SPANS}" if spans else "")
    names = np.array([*model.langs, UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.langs)
        for batch in slices(batches, "text", 1 << 22):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = len(texts)
            if k:
                starts, ends, label, at, row = label_words(model, texts)
                mass = np.zeros((n, k))
                np.add.at(mass, (row, label), ends - starts)
            else:
                mass, at = np.zeros((n, 1)), np.zeros(n + 1, np.int64)
            total = mass.sum(1)
            best = np.where(total > 0, mass.argmax(1), k)
            score = np.where(total > 0, mass.max(1) / np.maximum(total, 1), 0.0)
            cols = [batch.column("key"), pa.array(names[best].tolist(), pa.string()), pa.array(score)]
            if spans:
                out = []
                for i in range(n):
                    a, b = at[i], at[i + 1]
                    cut = np.flatnonzero(np.diff(label[a:b], prepend=-1)) + a if b > a else np.empty(0, np.int64)
                    stop = np.append(cut[1:], b) - 1 if b > a else cut
                    out.append([{"start": int(starts[x]), "end": int(ends[y]), "lang": model.langs[label[x]]} for x, y in zip(cut, stop)])
                cols.append(pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(cols, names=["key", "lang_pred", "score"] + ["spans"] * spans)

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, kinds)
    return out.withColumnRenamed("key", key)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document; rows with crc32(doc_id) mod 5 = 0 are held out of training."""
    from clickflow.llm.common import fold, table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold(F.col("doc_id")) != 0))
    found = identify(docs, model, spans=False)
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
