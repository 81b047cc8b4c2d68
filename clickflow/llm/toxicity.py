"""Toxicity scores: Levenshtein automata over a lexicon trie, and context windows.

A lexicon is learned from labelled rows: words that stand in toxic texts far more often than
in others. Each distinct word of a text block is matched against the trie of the lexicon by a
Levenshtein automaton (one deletion, insertion, replacement or swap; short words exactly),
so misspelled terms count too. The words around a hit decide how much it counts: between
quotation marks, or near words that report or reject (learned from labelled rows as well),
it weighs less. A logistic model over the hit features gives the score.

The lexicon and the weights are fitted on a bounded, hash-drawn sample of labelled rows
(``sample`` documents); every row is scored over its whole text. Null and empty texts get the
score of a text without hits. Labels that are null are not learned from. With no labels at
all, the score is 0 everywhere. Repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickflow.llm.common import Store, fold, slices, table

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
OPEN_QUOTES, CLOSE_QUOTES = "\"“«„‘", "\"”»“’"
N_FEATURES = 7


# --- lexicon trie and automaton -------------------------------------------


def build_trie(terms: dict[str, float]) -> dict:
    root: dict = {}
    for term, weight in terms.items():
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = weight
    return root


def allowed_edits(length: int) -> int:
    return 0 if length < 5 else 1


def match(root: dict, word: str) -> tuple[float, int]:
    """Largest weight of a lexicon term within reach of the word, and its edits; (0, 0) if none.

    The automaton's states are (position in the word, edits so far); it is run along the
    trie, so terms with a common beginning are tried together and dead branches end early.
    """
    n, best = len(word), (0.0, 0)
    most = allowed_edits(n)
    todo = [(root, 0, 0)]
    seen = set()
    while todo:
        node, i, e = todo.pop()
        if (id(node), i, e) in seen:
            continue
        seen.add((id(node), i, e))
        if i == n and "" in node:
            weight = node[""] * (1.0 if e == 0 else 0.7)
            if weight > best[0]:
                best = (weight, e)
        if i < n and word[i] in node:
            todo.append((node[word[i]], i + 1, e))
        if e < most:
            if i < n:
                todo.append((node, i + 1, e + 1))
            if i + 1 < n and word[i + 1] in node and word[i] in node[word[i + 1]]:
                todo.append((node[word[i + 1]][word[i]], i + 2, e + 1))
            for c, below in node.items():
                if c:
                    todo.append((below, i, e + 1))
                    if i < n:
                        todo.append((below, i + 1, e + 1))
    return best


@dataclass
class ToxicityModel:
    terms: dict[str, float] = field(default_factory=dict)  # log-odds of a word
    stems: dict[str, float] = field(default_factory=dict)  # log-odds of the first letters of a word
    reject: dict[str, float] = field(default_factory=dict)  # words near hits in texts that are not toxic
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES + 1))
    window: int = 6
    fitted: bool = False


class Scorer:
    """Features of one text; matches of words are kept, since most words recur."""

    def __init__(self, model: ToxicityModel):
        self.model, self.trie = model, build_trie(model.terms)
        self.known: dict[str, tuple[float, int]] = {}
        # two words within one edit agree, as they are or with one letter left out
        self.reach = set(model.terms) | {t[:i] + t[i + 1 :] for t in model.terms for i in range(len(t))}
        self.widths = sorted({len(s) for s in model.stems}, reverse=True)

    def near(self, word: str) -> bool:
        """Whether the automaton can find a term: a cheap test that spares it most words."""
        if word in self.model.terms:
            return True
        n = len(word)
        return allowed_edits(n) > 0 and (word in self.reach or any(word[:i] + word[i + 1 :] in self.reach for i in range(n)))

    def weigh(self, word: str) -> tuple[float, int]:
        got = self.known.get(word)
        if got is None:
            got = match(self.trie, word) if self.near(word) else (0.0, 0)
            if got[0] <= 0:
                for k in self.widths:
                    weight = self.model.stems.get(word[:k])
                    if weight:
                        got = (0.7 * weight, 1)
                        break
            if len(self.known) > 400_000:
                self.known.clear()
            self.known[word] = got
        return got

    def hits(self, text: str) -> tuple[list[tuple[int, int, float, int, float]], int]:
        """(start, end, weight, edits, context) of each hit, and the number of words.

        context is 1 for plain use, 0.5 inside quotation marks, less near rejecting words.
        """
        low = text.lower()
        if len(low) != len(text):  # a few letters change their length; keep positions
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        words = WORD.findall(low)
        terms = {w: got for w in set(words) if (got := self.weigh(w))[0] > 0}
        if not terms:
            return [], len(words)
        spans = [m.span() for m in WORD.finditer(low)]
        out = []
        for k, (a, b) in enumerate(spans):
            if words[k] in terms:
                weight, edits = terms[words[k]]
                near = spans[max(0, k - self.model.window) : k + self.model.window + 1]
                context = 0.5 if quoted(text, a, b, near[0][0], near[-1][1]) else 1.0
                if self.model.reject:
                    for x, y in near:
                        context *= 1.0 - self.model.reject.get(low[x:y], 0.0)
                out.append((a, b, weight, edits, context))
        return out, len(spans)

    def features(self, text: str) -> np.ndarray:
        hits, n = self.hits(text)
        f = np.zeros(N_FEATURES)
        if hits:
            w = np.array([h[2] for h in hits])
            edited = np.array([h[3] > 0 for h in hits])
            context = np.array([h[4] for h in hits])
            f[0] = np.log1p((w * context * ~edited).sum())
            f[1] = np.log1p((w * context * edited).sum())
            f[2] = np.log1p(len(hits) * 100 / max(n, 20))
            f[3] = (w * context).max() / 5
            f[4] = (context < 1).mean()
            f[5] = len({text[h[0] : h[1]].lower() for h in hits}) >= 2
            f[6] = 1.0
        return f


def quoted(text: str, a: int, b: int, lo: int, hi: int) -> bool:
    """Whether a quotation opens before the word and closes after it within the window."""
    left, right = text[max(0, lo - 2) : a], text[b : hi + 2]
    for o, c in zip(OPEN_QUOTES, CLOSE_QUOTES):
        if o in left and c in right and (o != c or left.count(o) % 2 == 1):
            return True
    return False


# --- training ---------------------------------------------------------------


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = 12_000,
    max_terms: int = 2_000,
) -> ToxicityModel:
    """Learn lexicon, rejecting words and weights from about ``sample`` labelled documents."""
    marked = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).distinct()
    count = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if not count.get(0) or not count.get(1):
        return ToxicityModel()
    draw = F.pmod(F.xxhash64(F.lit(29), "key"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("y") == 1, min(1.0, 0.5 * sample / count[1])).otherwise(min(1.0, 0.5 * sample / count[0]))
    chosen = marked.where(draw < share)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(chosen), "key")  # at most about ``sample`` ids

    # presence of words and word beginnings, counted on the executors
    def presence(batches):
        for batch in slices(batches, "text"):
            for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                words = set(m[0] for m in WORD.finditer(t.lower()))
                keys = ["w" + w for w in words if len(w) > 2] + ["s" + s for s in {w[:k] for w in words for k in (4, 5) if len(w) > k}]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.full(len(keys), y, np.int32))], names=["k", "y"])

    store = Store(docs.sparkSession, "toxicity")
    rows = store.put(rows, "sample")
    n1, n0 = (rows.where(f"y = {y}").count() for y in (1, 0))
    seen = rows.select("text", "y").mapInArrow(presence, "k string, y int").groupBy("k")
    seen = seen.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    odds = F.log((F.col("p") + 0.2) / (n1 + 1)) - F.log((F.col("q") + 0.2) / (n0 + 1))
    prior = n1 / max(n0 + n1, 1)
    gain = 2 * (F.col("p") * F.log(F.col("p") / ((F.col("p") + F.col("q")) * prior)))  # as in a G test
    strong = seen.where("p >= 3").where(gain >= 15).withColumn("odds", odds).where("odds > 2")
    strong = strong.orderBy(F.desc(F.col("odds") * F.log("p")), "k").limit(max_terms).collect()
    terms = {r["k"][1:]: min(r["odds"], 6.0) for r in strong if r["k"][0] == "w"}
    stems = {r["k"][1:]: min(r["odds"], 6.0) for r in strong if r["k"][0] == "s"}
    model = ToxicityModel(terms, stems)

    # words near hits: those that stand there in texts that are not toxic make a hit count less
    def around(batches):
        scorer = Scorer(model)
        for batch in slices(batches, "text"):
            for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                low, near = t.lower(), set()
                for a, b, *_ in scorer.hits(t)[0]:
                    near.update(WORD.findall(low[max(0, a - 40) : b + 40]))
                if near:
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(near), pa.string()), pa.array(np.full(len(near), y, np.int32))], names=["w", "y"])

    seen = rows.select("text", "y").mapInArrow(around, "w string, y int").groupBy("w")
    seen = seen.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")).where("q >= 5 and q > 4 * p")
    most = seen.orderBy(F.desc("q"), "w").limit(200).collect()
    reject = {r["w"]: min(0.9, (r["q"] / (r["p"] + r["q"]) - 0.5) * 1.5) for r in most if r["w"] not in terms}
    model = ToxicityModel(terms, stems, reject)

    # feature rows of the sample come to the driver: ``sample`` rows of a few numbers
    def featured(batches):
        scorer = Scorer(model)
        for batch in slices(batches, "text"):
            f = [scorer.features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), batch.column("y")], names=["f", "y"])

    data = rows.select("text", "y").mapInArrow(featured, "f array<double>, y int").collect()
    store.drop("sample")
    x = np.array([r["f"] for r in data]).reshape(len(data), N_FEATURES)
    y = np.array([r["y"] for r in data], float)
    model.weights, model.fitted = logistic(x, y), True
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40, n: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant. Classes weigh by their counts; ``n``: how
    many times a row counts."""
    n = np.ones(len(x)) if n is None else n
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (n * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """key, score (0 to 1) of each whole text, optionally the hits with their context weight."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches, "text", 1 << 22):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            f = np.array([scorer.features(t) for t in texts]).reshape(len(texts), N_FEATURES)
            z = f @ model.weights[:-1] + model.weights[-1]
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30))) if model.fitted else np.zeros(len(texts))
            cols = [batch.column("key"), pa.array(s)]
            if spans:
                hits = [[{"start": h[0], "end": h[1], "weight": h[2], "context": h[4]} for h in scorer.hits(t)[0]] for t in texts]
                cols.append(pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64()), ("context", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=["key", "score"] + ["hits"] * spans)

    schema = f"key {kind}, score double" + (", hits array<struct<start:long,end:long,weight:double,context:double>>" if spans else "")
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document; labels of rows with crc32(doc_id) mod 5 = 0 are not learned from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold(F.col("doc_id")) != 0))
    found = score(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
