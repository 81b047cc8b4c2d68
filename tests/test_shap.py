"""TreeSHAP: local accuracy and agreement with brute-force Shapley values."""

import time
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickflow.operators import shap as SH
from clickflow.operators.select import assemble, fit_forest
from clickflow.schema import LABEL

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.range(300).select(
        F.col("id").cast("string").alias("user_session"),
        (F.col("id") % 17).cast("double").alias("a"),
        (F.col("id") % 5).cast("double").alias("b"),
        ((F.col("id") * 7) % 3).cast("double").alias("c"),
    ).withColumn(LABEL, 2 * F.col("a") + F.col("b") * F.col("c"))
    model = fit_forest(df, COLS, num_trees=4, max_depth=4)
    return df, model, SH.forest_tables(spark, model)


def cond_expect(tree, x, subset, j=0):
    if tree["left"][j] < 0:
        return tree["value"][j]
    f, lj, rj = tree["feature"][j], tree["left"][j], tree["right"][j]
    if f in subset:
        return cond_expect(tree, x, subset, lj if x[f] <= tree["threshold"][j] else rj)
    c = tree["cover"]
    return (c[lj] * cond_expect(tree, x, subset, lj) + c[rj] * cond_expect(tree, x, subset, rj)) / c[j]


def brute_shap(trees, x, m):
    phi = np.zeros(m)
    for t in trees:
        for i in range(m):
            others = [k for k in range(m) if k != i]
            for size in range(m):
                for s in combinations(others, size):
                    wgt = factorial(size) * factorial(m - size - 1) / factorial(m)
                    phi[i] += wgt * (cond_expect(t, x, set(s) | {i}) - cond_expect(t, x, set(s)))
    return phi / len(trees)


def test_local_accuracy_and_brute_force(fitted):
    df, model, trees = fitted
    pdf = model.transform(assemble(df, COLS)).select(*COLS, "prediction").limit(40).toPandas()
    x = pdf[COLS].to_numpy(dtype=float)
    phi, base = SH.forest_shap(x, trees)
    assert phi.sum(axis=1) + base == pytest.approx(pdf["prediction"].to_numpy(), rel=1e-9, abs=1e-9)
    for r in range(0, 40, 7):
        assert phi[r] == pytest.approx(brute_shap(trees, x[r], 3), rel=1e-9, abs=1e-9)


def test_importance_job(spark, fitted):
    df, model, _ = fitted
    imp = {r.feature: r.score for r in SH.shap_importance(spark, df, model, COLS).collect()}
    assert imp["a"] > imp["b"] > 0


def test_attributions_of_every_row_add_up(spark, fitted, monkeypatch):
    df, model, _ = fitted
    monkeypatch.setattr(SH, "PIECE", 7)
    rows = SH.shap_sums(spark, df, model, COLS).collect()
    assert sorted(r.user_session for r in rows) == sorted(str(i) for i in range(300))
    for r in rows:
        assert r.base + r.attributed == pytest.approx(r.prediction, rel=1e-9, abs=1e-9)
    assert len({r.base for r in rows}) == 1


def full_tree(rng, depth, m):
    """A whole binary tree of random splits; features come again on a path."""
    n, inner = (1 << depth + 1) - 1, (1 << depth) - 1
    tree = {"value": rng.normal(size=n), "threshold": rng.normal(size=n) / 2, "cover": np.ones(n)}
    tree.update({"left": np.full(n, -1), "right": np.full(n, -1), "feature": rng.integers(0, m, n)})
    at = np.arange(inner)
    tree["left"][at], tree["right"][at] = 2 * at + 1, 2 * at + 2
    tree["cover"][inner:] = rng.integers(1, 20, n - inner)
    for j in at[::-1]:
        tree["cover"][j] = tree["cover"][2 * j + 1] + tree["cover"][2 * j + 2]
    return tree


def predicted(tree, x):
    at = np.zeros(len(x), np.int64)
    while (tree["left"][at] >= 0).any():
        goes = x[np.arange(len(x)), tree["feature"][at]] <= tree["threshold"][at]
        at = np.where(tree["left"][at] < 0, at, np.where(goes, tree["left"][at], tree["right"][at]))
    return tree["value"][at]


def test_many_rows_of_deep_trees_take_seconds():
    rng = np.random.default_rng(3)
    trees, x = [full_tree(rng, 9, 20) for _ in range(4)], rng.normal(size=(20_000, 20))
    start = time.process_time()
    phi, base = SH.forest_shap(x, trees)
    assert time.process_time() - start < 15
    assert phi.sum(axis=1) + base == pytest.approx(sum(predicted(t, x) for t in trees) / 4, rel=1e-9, abs=1e-9)
    few, _ = SH.forest_shap(x[:5], trees)  # hardly any tables
    assert few == pytest.approx(phi[:5], rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("n", [1, 3, 200])
def test_tables_agree_with_brute_force(n):
    rng = np.random.default_rng(n)
    trees, x = [full_tree(rng, 4, 6) for _ in range(3)], rng.normal(size=(n, 6))
    phi, _ = SH.forest_shap(x, trees)
    for r in range(0, n, 50):
        assert phi[r] == pytest.approx(brute_shap(trees, x[r], 6), rel=1e-9, abs=1e-9)
