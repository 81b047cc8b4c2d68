"""Embeddings against all pairs, mixing against a direct solution, the pipeline and the registry."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickflow.llm import embedding_dedup, mixing
from clickflow.llm.queries import llm_oracle, llm_queries

SF = "/root/testdata/sf0.001"


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(40):
            v = rng.normal(size=16)
            for _ in range(rng.integers(1, 5)):
                rows.append((k, (v + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.3])).tolist(), label))
                k += 1
    hot = rng.normal(size=16)
    for _ in range(60):  # a group larger than a list and than a block
        rows.append((k, (hot + rng.normal(size=16) * 0.05).tolist(), 1))
        k += 1
    for bad in (None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]):
        rows.append((k, bad, 1))
        k += 1
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, id string, w int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(table, block=16, rounds=2).collect()}
    fine = {i: (np.array(v), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: [] for i, *_ in rows}
    for i, (x, a) in fine.items():
        for j, (y, b) in fine.items():
            if i != j and a == b and len(x) == len(y) and float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)) >= 0.93:
                links[i].append(j)
    label = {i: i for i, *_ in rows}
    for _ in rows:
        new = {i: min([label[i], *(label[j] for j in links[i])]) for i in label}
        if new == label:
            break
        label = new
    assert got == {i: (len(links[i]), label[i], label[i] == i) for i in label}


def all_pairs(x, threshold=0.93):
    """(n_links, component) of each row of a matrix, ids from 0."""
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min([label[i], *label[linked[i]]]) for i in range(len(x))])
        if (new == label).all():
            return {i: (int(linked[i].sum()), int(label[i])) for i in range(len(x))}
        label = new


def test_embeddings_of_two_dense_groups(spark):
    rng = np.random.default_rng(8)
    one, other = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
    centres = [one, 0.955 * one + math.sqrt(1 - 0.955**2) * other]
    x = np.array([c + rng.normal(size=32) * 0.01 for c in centres for _ in range(45)])
    table = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(table, block=16, audit=0).collect()
    want = all_pairs(x)
    assert {c for _, c in want.values()} == {0} and min(n for n, _ in want.values()) > 50
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_embeddings_pairs_beside_a_hot_group(spark):
    rng = np.random.default_rng(9)
    dim, hot, pairs = 64, 400, 300
    unit = lambda v: v / np.sqrt((v * v).sum(-1, keepdims=True))
    first = unit(rng.normal(size=(pairs, dim)))
    aside = rng.normal(size=(pairs, dim))
    aside = unit(aside - (aside * first).sum(1, keepdims=True) * first)
    x = np.concatenate([unit(rng.normal(size=dim)) + rng.normal(size=(hot, dim)) * 0.01, first, 0.935 * first + math.sqrt(1 - 0.935**2) * aside])
    table = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(table, projections=1, descents=0, audit=200, rounds=1).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == all_pairs(x)


def test_recall_counts_nodes_and_components(spark):
    hot = [(a, 0, True) for a in range(30) for _ in range(100)]
    both = spark.createDataFrame([*hot, (50, None, False), (51, 51, True), (52, None, False)], "a long, ca long, hit boolean")
    assert embedding_dedup.recall_of(both) == pytest.approx(2 / 4)
    assert embedding_dedup.recall_of(both.where("hit")) == 1 and embedding_dedup.recall_of(both.limit(0)) == 1


def test_embeddings_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(none).count() == 0


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4, 0.4, 0.4], 300)
    n = rng.integers(0, 500, 300)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>").cache()
    target = np.array([0.6, 0.3, 0.1]) * n.sum()
    taken = mixing.fit_rates(members, target, 1.0)
    rates = np.array([r.r for r in members.withColumn("s", mixing.state_of(taken, 3, 1.0)).select(F.col("s")["r"].alias("r")).collect()])
    order = [(r.n_tokens, tuple(r.p)) for r in members.collect()]
    nn, pp = np.array([o[0] for o in order]), np.array([o[1] for o in order])
    assert (rates >= 0).all()
    assert np.abs((pp * (nn * rates)[:, None]).sum(0) - target).max() < 1e-4 * n.sum()
    # the same steps in numpy
    gram = (pp * nn[:, None] ** 2).T @ pp
    r = y = np.ones(300)
    t = 1.0
    for _ in taken:
        new = np.maximum(0, y - nn * (pp @ (np.linalg.pinv(gram) @ ((pp * (nn * y)[:, None]).sum(0) - target))))
        t, b = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        r, y = new, new + (b - 1) / t * (new - r)
    assert np.allclose(r, rates, atol=1e-6)


def test_mixing_edge_rows(spark):
    rows = [(0, None), (1, ""), (2, "good words here"), (3, "good words here"), (4, "BAD!! BAD!!"), (5, "long " * 4000)]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, rate double, w string")
    none = spark.createDataFrame([], "id long, domain string")
    got = {r.doc_id: r for r in mixing.mix_to_targets(docs, none, {}).collect()}
    assert got[0].n_tokens == 0 and got[1].n_tokens == 0 and got[2].rate == got[3].rate == got[5].rate == pytest.approx(1.0)
    labelled = spark.createDataFrame([(2, "a"), (4, "b"), (3, None), (77, "c")], "id long, domain string")
    got = {r.doc_id: r for r in mixing.mix_to_targets(docs, labelled, {"a": 1.0, "b": 1.0}).collect()}
    assert got[2].domains == ["a", "b"] and got[2].rate == got[3].rate
    assert mixing.mix_to_targets(docs.limit(0), labelled, {"a": 1.0}).count() == 0


def test_mixing_plan_is_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    df = mixing.mix_to_targets(docs, mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet")), mixing.TARGETS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
    assert df.count() == docs.count()


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from clickflow.llm import decontaminate, ngram_join

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_join", "decontaminate", "mixing"]
    before = {r.doc_id for r in docs.collect()}
    toxic = dict(cp.STAGES)["toxicity"](spark, docs, SF)
    assert toxic.columns == docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in toxic.collect()}
    assert sum(1 for i in before - kept if labels.get(i) == 0) == 0 and before - kept
    lines = dict(cp.STAGES)["line_dedup"](spark, docs, SF)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    assert lines.agg(F.sum(F.length("text"))).first()[0] < docs.agg(F.sum(F.length("text"))).first()[0]
    near = {r.doc_id for r in dict(cp.STAGES)["ngram_join"](spark, docs, SF).collect()}
    classes = ngram_join.near_duplicates(docs).collect()
    assert near == {c.component_id for c in classes} and len(near) < len(before)
    clean = {r.doc_id for r in dict(cp.STAGES)["decontaminate"](spark, docs, SF).collect()}
    leaks = {r.doc_id for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert clean == before - leaks


def test_registry():
    names = list(llm_queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(llm_oracle()) <= set(names)
    assert os.path.exists(os.path.join(os.path.dirname(__file__), "..", "..", "corpus_pipeline.py"))
