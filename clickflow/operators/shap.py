"""SHAP importance of a regression forest, computed on the executors.

Path-dependent TreeSHAP (Lundberg, Erion and Lee, 2018, algorithm 2) over the
trees of a fitted MLlib forest. The node table (bounded by the model size)
is read from the saved model and broadcast; rows are explained inside
``mapInPandas``. The values of a tree's small subtrees are put into tables, once per tree and
piece of rows, and a row looks its values up by the outcomes of the splits (as in Fast TreeSHAP, Yang,
2021, version 2). Each piece emits per-feature sums of |phi| and a row
count, and the importance is their grouped mean: one row per feature leaves a
piece, whatever the number of rows explained.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickflow.config import session_workspace
from clickflow.operators.select import assemble, fit_forest, sample_rows
from clickflow.schema import SESSION


def forest_tables(spark, model) -> list[dict]:
    """Per tree: arrays of feature, threshold, left, right, value, cover,
    indexed by node id (from the model's saved node data)."""
    path = session_workspace(spark).folder("forest")
    model.write().save(path)
    nodes = spark.read.parquet(os.path.join(path, "data")).select(
        "treeID",
        F.col("nodeData.id").alias("id"),
        F.col("nodeData.prediction").alias("value"),
        F.get(F.col("nodeData.impurityStats"), 0).alias("cover"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), 0).alias("threshold"),
    )
    pdf = nodes.toPandas()  # model-sized: trees x nodes
    trees = []
    for _, t in pdf.groupby("treeID"):
        t = t.sort_values("id")
        n = int(t["id"].max()) + 1
        arr = {k: np.zeros(n) for k in ("value", "cover", "threshold")}
        arr.update({k: np.full(n, -1, dtype=np.int64) for k in ("left", "right", "feature")})
        ids = t["id"].to_numpy()
        for k in ("value", "cover", "threshold"):
            arr[k][ids] = t[k].fillna(0.0).to_numpy()
        for k in ("left", "right", "feature"):
            arr[k][ids] = t[k].fillna(-1).to_numpy().astype(np.int64)
        trees.append(arr)
    return trees


#: Bits of a table's index: a subtree whose path features and splits fit is looked up, not walked.
TABLE_BITS = 11


def _shares(z: np.ndarray, value: float, bits: np.ndarray | None = None) -> np.ndarray:
    """Attributions of a leaf to the features of its path, (feature, column). ``z``: cover shares. ``bits``: whether
    the column's row meets the feature's conditions; default: column p stands for the bits of p.

    The attribution to i is value (o_i - z_i) times the integral over t in 0..1 of the product over the others of
    t o_j + (1 - t) z_j, a polynomial in t: Gauss-Legendre with half as many points as features is exact.
    """
    d = len(z)
    t, weight = np.polynomial.legendre.leggauss((d + 1) // 2)
    t, weight = (t + 1) / 2, weight / 2
    out, met = (1 - t) * z[:, None], t + (1 - t) * z[:, None]
    if bits is None:
        bits = (np.arange(1 << d) >> np.arange(d)[:, None]) & 1 == 1
        product = np.ones((len(t), 1))
        for o, m in zip(out, met):
            product = np.concatenate([product * o[:, None], product * m[:, None]], axis=1)
    else:
        product = np.ones((len(t), bits.shape[1]))
        for o, m, b in zip(out, met, bits):
            product *= np.where(b, m[:, None], o[:, None])
    # (o_i - z_i) / (t o_i + (1 - t) z_i) is -1 / (1 - t) for a row that does not meet i
    return value * np.where(bits, (weight * (1 - z)[:, None] / met) @ product, (-weight / (1 - t)) @ product)


def _child(path: list[int], z: np.ndarray, pattern: np.ndarray, feature: int, share: float, goes: np.ndarray):
    """Path features, their cover shares and the bits of their conditions, one split further down."""
    if feature not in path:
        return path + [feature], np.append(z, share), pattern | (goes.astype(np.int32) << len(path))
    k = path.index(feature)
    z = z.copy()
    z[k] *= share
    return path, z, np.where(goes, pattern, pattern & ~np.int32(1 << k))


def tree_shap(x: np.ndarray, tree: dict, phi: np.ndarray) -> float:
    """Adds one tree's SHAP values of the rows ``x`` to ``phi``; returns the
    tree's expected value (cover-weighted mean of the leaves).

    What a leaf adds depends on the row only by which path features' conditions it meets, so the sum over the leaves
    of a small subtree is a table by these bits and those of the splits below. Tables have no more entries than rows.
    """
    n = x.shape[0]
    feat, thr, left, right = tree["feature"], tree["threshold"], tree["left"], tree["right"]
    value, cover = tree["value"], tree["cover"]
    limit = min(TABLE_BITS, n.bit_length() - 1)

    def splits(j: int) -> list[int]:
        return [] if left[j] < 0 else [j, *splits(left[j]), *splits(right[j])]

    def children(j, path, z, pattern, goes_left):
        f = int(feat[j])
        for c, goes in ((left[j], goes_left), (right[j], ~goes_left)):
            yield c, *_child(path, z, pattern, f, cover[c] / cover[j], goes)

    def below(j, path, z, pattern, bit, table):
        if left[j] < 0:
            for f, row in zip(path, _shares(z, value[j])[:, pattern]):
                table[f] = table[f] + row if f in table else row
            return
        for child in children(j, path, z, pattern, bit[j]):
            below(*child, bit, table)

    def walk(j, path, z, pattern):
        inner = splits(j)
        d = len(path)
        if d + len(inner) <= limit and d + len(inner):
            states, bit, table, at = np.arange(1 << (d + len(inner)), dtype=np.int32), {}, {}, pattern.astype(np.intp)
            for k, i in enumerate(inner, d):
                bit[i] = (states >> k) & 1 == 1
                at |= (x[:, feat[i]] <= thr[i]).astype(np.intp) << k
            below(j, path, z, states & np.int32((1 << d) - 1), bit, table)
            for f, row in table.items():
                phi[:, f] += row[at]
        elif left[j] >= 0:
            for child in children(j, path, z, pattern, x[:, feat[j]] <= thr[j]):
                walk(*child)
        elif path:
            phi[:, path] += _shares(z, value[j], (pattern >> np.arange(d, dtype=np.int32)[:, None]) & 1 == 1).T

    walk(0, [], np.zeros(0), np.zeros(n, np.int32))
    leaves = left < 0
    return float(np.sum(value[leaves] * cover[leaves]) / cover[0])


def forest_shap(x: np.ndarray, trees: list[dict]) -> tuple[np.ndarray, float]:
    """SHAP values of a forest that averages its trees (MLlib forest)."""
    x, phi = np.asfortranarray(x), np.zeros(x.shape, dtype=float, order="F")  # by feature
    base = 0.0
    for t in trees:
        base += tree_shap(x, t, phi)
    return phi / len(trees), base / len(trees)


def _explained(spark, rows: DataFrame, model, cols: Sequence[str], batch, schema: str, key: str | None = None) -> DataFrame:
    """``batch(keys, phi, base)`` of the rows' attributions. The model's nodes are broadcast; Arrow batches are put
    together to pieces of ``PIECE`` rows, since each piece makes the trees' tables anew."""
    trees = spark.sparkContext.broadcast(forest_tables(spark, model))
    names = list(cols)

    def explain(piece):
        phi, base = forest_shap(piece[names].to_numpy(dtype=float), trees.value)
        return batch(piece["_key"] if key else None, phi, base)

    def run(batches):
        held, rows = [], 0
        for pdf in batches:
            while rows + len(pdf) >= PIECE:
                yield explain(pd.concat([*held, pdf.iloc[: PIECE - rows]]))
                pdf, held, rows = pdf.iloc[PIECE - rows :], [], 0
            held, rows = [*held, pdf], rows + len(pdf)
        if rows:
            yield explain(pd.concat(held))

    keys = [F.col(key).alias("_key")] if key else []
    return rows.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in names]).mapInPandas(run, schema)


#: Rows that are explained at a time.
PIECE = 1 << 16


def shap_importance(spark, rows: DataFrame, model, cols: Sequence[str]) -> DataFrame:
    """mean |SHAP| per feature over ``rows`` (feature, score)."""
    names = list(cols)

    def sums(_, phi, base):
        return pd.DataFrame({"feature": names, "abs_sum": np.abs(phi).sum(axis=0), "n": len(phi)})

    parts = _explained(spark, rows, model, cols, sums, "feature string, abs_sum double, n long")
    return parts.groupBy("feature").agg((F.sum("abs_sum") / F.sum("n")).alias("score"))


def shap_sums(spark, rows: DataFrame, model, cols: Sequence[str], key: str = SESSION) -> DataFrame:
    """per row the base value, the sum of its attributions, and what the model predicts, which they add up to:
    key, base, attributed, prediction."""

    def sums(keys, phi, base):
        return pd.DataFrame({key: keys, "base": base, "attributed": phi.sum(axis=1)})

    kind = rows.schema[key].dataType.simpleString()
    parts = _explained(spark, rows, model, cols, sums, f"{key} {kind}, base double, attributed double", key)
    predicted = model.transform(assemble(rows, cols)).select(key, "prediction")
    return parts.join(predicted, key)


def shap_ranking(spark, train: DataFrame, cols: Sequence[str], sample: int = 5000) -> DataFrame:
    """F2-F4 together: forest fitted on a sample of at most ``sample`` rows, SHAP importance over all rows."""
    model = fit_forest(sample_rows(train, sample), cols)
    return shap_importance(spark, train, model, cols)
