"""Personal data spans: fixed patterns, and weak supervision for what they miss.

Base spans (email, ip, card, phone) follow fixed patterns and are always kept. Further candidates are
tokens of 12 characters or more with a digit, which could be secrets, telephone numbers without a plus sign, and
spelled-out email addresses (a local part of at most 64 and labels of at most 63 characters, as addresses have). Labelers
(patterns, gazetteers, context words) vote yes, no or nothing on each candidate; the gazetteers are heads of
issued keys, area codes and top-level domains. Expectation-maximisation over the counts of vote patterns, summed over all documents,
estimates how reliable each labeler is; the patterns' posteriors train a logistic span classifier
on a bounded, hash-drawn sample (``sample`` distinct feature rows, each weighing as often as it stands), and spans it
accepts are added.

Null and empty texts have no spans. Long texts are searched whole, in time that grows with their length. With no candidates at all, only base
spans are returned. Repeated rows get the same spans. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickflow.llm.common import Store, slices, table
from clickflow.llm.toxicity import logistic

KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Matches of [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+) take whole runs of digits, so each run is tried once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
LOOSE_PHONE = re.compile(r"(?<![0-9.+-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])")
SPELLED_AT = re.compile(r" ?(?:\(at\)|\[at\]|\bat\b)", re.I)
SPELLED_DOMAIN = re.compile(r" ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\bdot\b) ?[A-Za-z0-9-]{1,63})+", re.I)
TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-=")
# Words of the gazetteers.
SECRET_WORDS = re.compile(r"passw|pwd|token|secret|api.?key|access.?key|credential|bearer|auth|kennwort|contrase|mot de passe", re.I)
PHONE_WORDS = re.compile(r"tel|phone|call|fax|mobile|cell|whatsapp|sms|anruf|llam|appel", re.I)
MAIL_WORDS = re.compile(r"mail|contact|write|reach|kontakt|correo|courriel", re.I)
PLAIN_WORDS = re.compile(r"version|license|section|chapter|page|figure|isbn|issue|volume", re.I)
KEY_HEADS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xox", "eyJ", "AIza")
KEY_SHAPES = re.compile(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[A-Z0-9]{20}|[A-Za-z0-9+/]{40}")
AREA_CODES = frozenset("201 202 212 213 312 415 555 617 800 833 844 855 866 877 888 900 01 02 03 04 05 06 07 08 09 015 016 017 020 030 040 089".split())
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu ch at it nl us ca au jp cn br ru example".split())
NAMES = ("pattern", "hex", "context", "entropy", "wordlike", "digits only", "plain words", "gazetteer", "form", "assignment")
LABELERS = len(NAMES)


# --- base spans ---------------------------------------------------------------


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@domain``, found from each at sign."""
    end, at = 0, text.find("@")
    while at >= 0:
        look, start = 64, at
        while True:
            lo = max(end, at - look)
            start = at - (at - lo - len(text[lo:at].rstrip(LOCAL)))
            if start > lo or lo == end:
                break
            look *= 4
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- candidates, labelers, features ----------------------------------------------


def spelled(text: str) -> Iterator[tuple[int, int]]:
    """Spelled-out addresses, found from each "at"."""
    end = 0
    for m in SPELLED_AT.finditer(text):
        lo = max(end, m.start() - 65)
        run = m.start() - lo - len(text[lo : m.start()].rstrip(LOCAL))
        domain = SPELLED_DOMAIN.match(text, m.end()) if 0 < run <= 64 else None
        if domain:
            end = domain.end()
            yield m.start() - run, end


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of further candidates, none of which meets a base span or another candidate."""
    taken = bytearray(len(text))
    for a, _, b in base:
        taken[a:b] = b"\1" * (b - a)
    out: list[tuple[int, int, int]] = []

    def add(a: int, kind: int, b: int) -> None:
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\1" * (b - a)
            out.append((a, kind, b))

    low = text.lower()
    if "at" in low and "dot" in low:
        for a, b in spelled(text):
            add(a, 0, b)
    first = DIGITS.search(text)
    if first:
        for m in LOOSE_PHONE.finditer(text, first.start() - 1 if first.start() else 0):
            add(m.start(), 3, m.end())
        end = -1
        for m in DIGITS.finditer(text):
            if m.start() < end:
                continue
            a, b = m.span()
            while a > 0 and text[a - 1] in TOKEN_CHARS and text[a - 1] != "=":
                a -= 1
            while b < len(text) and text[b] in TOKEN_CHARS:
                b += 1
            end = b
            if b - a >= 12:
                add(a, 4, b)
    return out


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def votes_and_features(text: str, a: int, kind: int, b: int) -> tuple[list[int], list[float]]:
    """Votes (0 none, 1 no, 2 yes) of the labelers and the classifier's inputs."""
    s, before = text[a:b], text[max(0, a - 24) : a]
    after = text[b : b + 16]
    digits = sum(c.isdigit() for c in s)
    upper, letters = sum(c.isupper() for c in s), sum(c.isalpha() for c in s)
    hexadecimal = letters > 0 and not set(s.lower()) - set("0123456789abcdef")
    bits = entropy(s)
    words = (MAIL_WORDS, None, None, PHONE_WORDS, SECRET_WORDS)[kind]
    context = bool(words.search(before))
    turns = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:]))
    vote = [0] * LABELERS
    if kind == 4:
        vote[0] = 2 if KEY_SHAPES.fullmatch(s) else 0
        vote[1] = 2 if hexadecimal and len(s) >= 16 else 0
        vote[3] = 2 if bits > 3.0 and turns >= 3 else 1 if bits < 2.6 else 0
        vote[4] = 1 if turns <= 1 and digits < letters else 0
        vote[5] = 1 if not letters else 0
        vote[7] = 2 if s.startswith(KEY_HEADS) else 0
        vote[9] = 2 if before.rstrip()[-1:] in ("=", ":", '"', "'") else 0
        vote[8] = 2 if len(s) >= 16 and turns >= 4 and (s.isupper() or hexadecimal) else 1 if "/" in s or s.count("-") > 2 else 0
    elif kind == 3:
        groups = [len(g) for g in DIGITS.findall(s)]
        vote[0] = 2 if groups in ([3, 3, 4], [2, 4, 4], [3, 4, 4], [3, 3, 3]) or "(" in s else 1
        vote[5] = 1 if "." in s and "-" not in s and " " not in s and "(" not in s else 0
        vote[7] = 2 if DIGITS.search(s)[0] in AREA_CODES else 0
        vote[8] = 1 if re.match(r"(19|20)[0-9]{2}|[0-9]{2}[.-][0-9]{2}", s) else 2 if s[0] not in "01" else 0
    else:
        top = re.split(r"[^a-z]+", s.lower())[-1]
        vote[7] = 2 if top in TOP_DOMAINS else 1
        vote[0] = 2 if "(" in s or "[" in s else 0
        vote[8] = 1 if s.count(" ") > 6 else 0
    vote[2] = 2 if context else 0
    vote[6] = 1 if PLAIN_WORDS.search(before) else 0
    features = [kind == 4, kind == 3, kind == 0, min(len(s), 64) / 16, digits / len(s), upper / len(s), bits / 4, float(hexadecimal)]
    features += [float(context), min(turns, 20) / 10, float(before[-1:] in ("=", '"', "'")), float(bool(PLAIN_WORDS.search(before + after)))]
    return vote, [float(f) for f in features]


def code_of(vote: list[int]) -> int:
    code = 0
    for v in vote:
        code = code * 3 + v
    return code


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = 50) -> dict[tuple[int, int], float]:
    """Posterior of each (kind, vote pattern) by expectation-maximisation; labelers vote independently given the truth."""
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    kind = np.array([k for k, _ in keys])
    votes = np.array([[code // 3 ** (LABELERS - 1 - i) % 3 for i in range(LABELERS)] for _, code in keys])
    yes, no = (votes == 2).sum(1), (votes == 1).sum(1)
    p = np.clip(0.5 + 0.2 * (yes - no), 0.05, 0.95)  # first guess: the majority
    for _ in range(rounds):
        z = np.zeros(len(keys))
        for g in np.unique(kind):
            own = kind == g
            for truth, q in ((1, p), (0, 1 - p)):
                w = n[own] * q[own]
                log = np.full(own.sum(), math.log((w.sum() + 1) / (n[own].sum() + 2)))
                for i in range(LABELERS):
                    for v in range(3):
                        hit = votes[own, i] == v
                        # better than chance is assumed: one pseudo vote each to the expected side
                        bonus = 2.0 if v == 1 + truth else 1.0
                        log[hit] += math.log((w[hit].sum() + bonus) / (w.sum() + 4.0))
                z[own] += log if truth else -log
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        done = np.abs(new - p).max() < 1e-6
        p = new
        if done:
            break
    return {k: float(x) for k, x in zip(keys, p)}


@dataclass
class SpanModel:
    weights: np.ndarray | None = None

    def accepts(self, features: list[float]) -> bool:
        return self.weights is not None and float(np.dot(self.weights[:-1], features) + self.weights[-1]) >= 0


def fit(docs: DataFrame, text: str = "text", sample: int = 20_000) -> SpanModel:
    """Weak supervision over all documents' candidates; the classifier is fitted on about ``sample`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for t in batch.column("text").to_pylist():
                if t and (any(c in t for c in "0123456789") or "at" in t.lower()):
                    for a, kind, b in candidates(t, base_spans(t)):
                        vote, features = votes_and_features(t, a, kind, b)
                        rows.append((kind, code_of(vote), features))
            if rows:
                k, c, f = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(c, pa.int32()), pa.array(f, pa.list_(pa.float64()))], names=["kind", "code", "f"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "kind int, code int, f array<double>")
    # equal rows are counted; features are functions of few counts, so the groups are far fewer than the rows
    found = found.groupBy("kind", "code", "f").agg(F.count("*").alias("n"))
    store = Store(docs.sparkSession, "pii")
    found = store.put(found, "candidates")
    counts = {(r["kind"], r["code"]): r["n"] for r in found.groupBy("kind", "code").agg(F.sum("n").alias("n")).toLocalIterator()}
    if not counts:
        return SpanModel()
    posterior = reliabilities(counts)
    total = found.count()
    draw = F.pmod(F.xxhash64("kind", "code", "f"), F.lit(1 << 30)) / float(1 << 30)
    rows = found.where(draw < min(1.0, sample / total)).select("kind", "code", "f", "n").collect()
    x = np.array([r["f"] for r in rows])
    y = np.array([posterior[r["kind"], r["code"]] for r in rows])
    store.drop("candidates")
    return SpanModel(logistic(x, y, ridge=0.1, n=np.array([float(r["n"]) for r in rows])))


def find(docs: DataFrame, model: SpanModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and all spans as lists of (start, end, kind), code points, end exclusive."""
    kind = docs.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def as_rows(spans):
        return [{"start": a, "end": b, "kind": KINDS[k]} for a, k, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            base, every = [], []
            for t in batch.column("text").to_pylist():
                own = base_spans(t) if t else []
                more = [c for c in candidates(t, own) if model.accepts(votes_and_features(t, *c)[1])] if t else []
                base.append(as_rows(own))
                every.append(as_rows(sorted(own + more)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(base, span), pa.array(every, span)], names=["key", "base", "spans"])

    struct = "array<struct<start:long,end:long,kind:string>>"
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, base {struct}, spans {struct}").withColumnRenamed("key", key)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Counts of base spans, their hash, and all spans of every document."""
    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    joined = {c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",") for c in ("base", "spans")}
    kinds = F.transform("base", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *count, F.sha2(joined["base"], 256).alias("base_sha256"), joined["spans"].alias("spans"))
