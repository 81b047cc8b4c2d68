"""Mixing to target weights with soft domain membership, in DataFrame operations only.

A labelled table names the domain of some documents (here: quality and toxic flags together).
A multinomial classifier over text statistics learns the domains from a bounded, hash-drawn
sample (``sample`` labelled rows) and gives every document a posterior over domains. Then
nonnegative rates r are fitted by projected-gradient least squares so that the expected tokens
of each domain, sum(r * tokens * posterior), meet the targets. The residual is weighted by the
inverse Gram matrix of the domains, which makes 1 a safe step. A step needs one aggregate of
as many numbers as there are domains; a document's rate is a fold over the steps taken, from a
state that is written every few steps.

Null and empty texts have no tokens; their rate is the starting rate. Null label values form no
domain. With no labelled rows there is one domain, and all rates are equal. Domains without a
target weight get 0; if no weight is given for any known domain, the present mix is the target.
Repeated rows and ties get equal rates. Of the documents only key and text are read. Targets that
no rates meet get the nearest mix; what was missed at the last look, as a share of all target tokens, is returned.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickflow.llm.common import Store, table

STATISTICS = ("size", "symbols", "capitals", "variety", "length")


def words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def one_of(lexicon: list[str], word: Column) -> Column:
    return word.isin(lexicon)


def statistics(docs: DataFrame, lexicons: list[list[str]]) -> DataFrame:
    """Adds n_tokens and the classifier's inputs; docs has ``text`` and ``w`` (its words)."""
    chars = F.greatest(F.char_length("text"), F.lit(1))
    n = F.size("w")
    every = sorted({w for lexicon in lexicons for w in lexicon})
    out = docs.withColumn("distinct", F.array_distinct("w"))
    # the words of any lexicon first, which are few; sets of literals are hashed once, not once a row
    out = out.withColumn("hits", F.filter("distinct", partial(one_of, every)) if every else F.array().cast("array<string>"))
    share = lambda of: F.coalesce((F.char_length("text") - F.char_length(F.translate("text", of, ""))) / chars, F.lit(0.0))
    out = out.withColumns(
        {
            "n_tokens": n.cast("long"),
            "size": F.log1p(n),
            "symbols": share("#$%&*|!{}<>="),
            "capitals": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "variety": F.size("distinct") / F.greatest(n, F.lit(1)),
            "length": F.coalesce(F.char_length("text") / F.greatest(n, F.lit(1)), F.lit(0.0)) / 10,
        }
    )
    for k, lexicon in enumerate(lexicons):
        hits = F.size(F.filter("hits", partial(one_of, lexicon))) if lexicon else F.lit(0)
        out = out.withColumn(f"lexicon{k}", F.log1p(hits))
    return out.drop("distinct", "hits")


def lexicon_of(sample: DataFrame, domain: str, most: int) -> list[str]:
    """Words that stand in texts of a domain far more often than in others (G test), strongest first."""
    own = F.sum((F.col("domain") == domain).cast("int"))
    seen = sample.select("domain", F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(own.alias("p"), F.count("*").alias("n"))
    size = sample.agg(own.alias("p"), F.count("*").alias("n")).first()
    if not size["p"] or size["p"] == size["n"]:
        return []
    prior = size["p"] / size["n"]
    gain = 2 * F.col("p") * F.log(F.col("p") / (F.col("n") * prior))
    found = seen.where("p >= 3").withColumn("gain", gain).where("gain > 20").where(F.col("p") > 0.5 * F.col("n"))
    return [r["word"] for r in found.orderBy(F.desc("gain"), "word").limit(most).collect()]


def posteriors(docs: DataFrame, labelled: DataFrame, store: Store, key: str, text: str, sample: int, lexicon: int):
    """(key, n_tokens, p: array of posteriors) of every document, and the domain names in array order."""
    plain = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = plain.withColumn("w", words("text"))
    known = labelled.where(F.col("domain").isNotNull()).groupBy("id").agg(F.min("domain").alias("domain"))
    known = known.join(plain.select("id"), "id", "left_semi")
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    domains = sorted(counts)
    if len(domains) < 2:
        return rows.select("id", F.size("w").cast("long").alias("n_tokens"), F.array(F.lit(1.0)).alias("p")), domains or ["all"]
    each = sample / len(domains)
    share = F.create_map(*[F.lit(x) for d in domains for x in (d, min(1.0, each / counts[d]))])
    draw = F.pmod(F.xxhash64(F.lit(41), "id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.where(draw < share[F.col("domain")])
    learn = plain.join(F.broadcast(chosen), "id").withColumn("w", words("text"))  # about ``sample`` ids at most
    learn = store.put(learn.select("id", "domain", "text", "w"), "sample")
    lexicons = [lexicon_of(learn, d, lexicon) for d in domains]
    inputs = [*STATISTICS, *(f"lexicon{k}" for k in range(len(domains)))]
    at = F.create_map(*[F.lit(x) for k, d in enumerate(domains) for x in (d, float(k))])
    back = F.create_map(*[F.lit(x) for d in domains for x in (d, max(1.0, counts[d] / each))])  # undo the drawing by domain
    data = statistics(learn, lexicons).withColumn("y", at[F.col("domain")]).withColumn("weight", back[F.col("domain")])
    data = VectorAssembler(inputCols=inputs, outputCol="x").transform(data).select("x", "y", "weight")
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", family="multinomial", regParam=1e-4, maxIter=100).fit(data)
    coefficients, constants = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    scored = statistics(rows, lexicons).select("id", "n_tokens", *inputs)
    logits = [sum((F.col(c) * float(v) for c, v in zip(inputs, row)), F.lit(float(b))) for row, b in zip(coefficients, constants)]
    scored = scored.select("id", "n_tokens", F.array(*logits).alias("z"))
    scored = scored.select("id", "n_tokens", F.transform("z", lambda v: F.exp(v - F.array_max("z"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    return scored.withColumn("total", total).select("id", "n_tokens", F.transform("e", lambda v: v / F.col("total")).alias("p")), domains


def fit_rates(
    members: DataFrame, target: np.ndarray, start: float, store: Store | None = None, steps: int = 60, tolerance: float = 1e-5, every: int = 6, report: dict | None = None
) -> list[list[float]]:
    """Steps of the accelerated projected gradient over (n_tokens, p): a multiplier for each domain, and the momentum.

    With a store, the rows' state is written after every few steps, so that a step folds over few of them.
    """
    k = len(target)
    n = F.col("n_tokens").cast("double")
    dot = [F.sum(n * n * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    gram_row = members.agg(*dot).first()
    gram = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = gram_row[f"g{i}_{j}"] or 0.0
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
    now, rows, written = members, members.count() if store else 0, 0
    taken: list[list[float]] = []
    rates, t = target, 1.0
    for step in range(steps):
        at = state_of(taken[written:], k, start, "state" if written else None)
        if store and step - written == every:
            now = store.put(now.select("n_tokens", "p", at.alias("state")), f"state-{step}", rows)
            if written:
                store.drop(f"state-{written}")
            written, at = step, F.col("state")
        sums = [F.sum(n * F.col("p")[i] * F.col("s")[v]).alias(f"{v}{i}") for v in ("r", "y") for i in range(k)]
        row = now.withColumn("s", at).agg(*sums).first()
        rates, ahead = (np.array([row[f"{v}{i}"] or 0.0 for i in range(k)]) for v in ("r", "y"))
        if np.abs(rates - target).max() <= tolerance * max(target.sum(), 1.0):
            break
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        taken.append([*(float(v) for v in inverse @ (ahead - target)), float((before - 1) / t)])
    if written:
        store.drop(f"state-{written}")
    if report is not None:
        report["missed"] = ((rates - target) / max(target.sum(), 1.0)).tolist()
    return taken


def state_of(taken: list[list[float]], k: int, start: float, state: str | None = None) -> Column:
    """Rate r and look-ahead rate y of a row after the steps, from the start or from a written state.

    Each step subtracts the gradient at y, projects to r >= 0 and looks ahead along the change
    (Nesterov's momentum, the last number of a step).
    """
    first = F.col(state) if state else F.struct(F.lit(float(start)).alias("r"), F.lit(float(start)).alias("y"))
    if not taken:
        return first
    n = F.col("n_tokens").cast("double")

    def step(s: Column, m: Column) -> Column:
        slope = F.lit(0.0)
        for i in range(k):
            slope = slope + F.col("p")[i] * m[i]
        r = F.greatest(F.lit(0.0), s["y"] - n * slope)
        return F.struct(r.alias("r"), (r + m[k] * (r - s["r"])).alias("y"))

    return F.aggregate(F.lit([*taken]), first, step)


def mix_to_targets(
    docs: DataFrame,
    labelled: DataFrame,
    weights: dict[str, float],
    key: str = "doc_id",
    text: str = "text",
    budget: float = 1.0,
    sample: int = 8_000,
    lexicon: int = 300,
) -> DataFrame:
    """key, n_tokens, domains, posterior (array), rate, missed (array: expected less target tokens by domain). labelled: (id, domain). budget: target tokens as a share of all."""
    store = Store(docs.sparkSession, "mixing")
    members, domains = posteriors(docs, labelled, store, key, text, sample, lexicon)
    members = store.put(members, "members")
    store.drop("sample")
    k = len(domains)
    now = members.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * F.col("p")[i]).alias(f"t{i}") for i in range(k)]).first()
    goal = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
    if not goal.sum():
        goal = np.array([now[f"t{i}"] or 0.0 for i in range(k)])
    target = goal / max(goal.sum(), 1e-300) * budget * float(now["n"] or 0)
    report: dict[str, list[float]] = {}
    rate = state_of(fit_rates(members, target, budget, store, report=report), k, budget)["r"]
    out = members.select(F.col("id").alias(key), "n_tokens", F.lit(domains).alias("domains"), F.col("p").alias("posterior"), rate.alias("rate"), F.lit(report["missed"]).alias("missed"))
    return out


def label_domains(labels: DataFrame) -> DataFrame:
    """(id, domain) of the labels table: quality and toxic flags together, such as ``q1t0``."""
    return labels.select(F.col("doc_id").alias("id"), F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("domain"))


#: Target shares of tokens by domain: mostly good clean text.
TARGETS = {"q1t0": 0.90, "q0t0": 0.08, "q1t1": 0.015, "q0t1": 0.005}


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Rate of every document for the target mix of quality and toxicity domains."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mix_to_targets(docs, label_domains(labels), TARGETS)
