"""Boosted and bagged trees against a plain search over all cuts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedloom.operators import trees as T


def grown(x, g, h, node, depth, ridge, splits, leaves, rate, allowed=None, level=0):
    best = None
    if level < depth:
        for i in allowed(node) if allowed else range(x.shape[1]):
            for cut in sorted(set(x[h > 0, i]))[:-1]:
                left = x[:, i] <= cut
                gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()
                if hl < 1 or hr < 1:
                    continue
                gain = round(gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum()**2 / (h.sum() + ridge), 6)
                if gain > 0 and (best is None or (-gain, i, cut) < best[0]):
                    best = (-gain, i, cut), left
    if best is None:
        leaves[node] = -g.sum() / (h.sum() + ridge) * rate
        return
    (_, i, cut), left = best
    splits[node] = (i, cut)
    for child, side in ((2 * node, left), (2 * node + 1, ~left)):
        grown(x[side], g[side], h[side], child, depth, ridge, splits, leaves, rate, allowed, level + 1)


def placed(x, splits, leaves):
    out = np.empty(len(x))
    for k, row in enumerate(x):
        n = 1
        while n in splits:
            i, cut = splits[n]
            n = 2 * n + (row[i] > cut)
        out[k] = leaves[n]
    return out


@pytest.fixture
def data(spark):
    r = np.random.default_rng(4)
    x = np.column_stack([r.integers(0, 12, 400), r.integers(0, 5, 400) / 10, r.integers(0, 30, 400)]).astype(float)
    y = np.where(x[:, 0] > 6, 3.0, -1.0) + x[:, 1] * 4 + r.normal(0, 0.3, 400)
    return spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, a double, `b c` double, d double, y double"), x, y


def test_boosting_equals_a_search_over_all_cuts(data):
    df, x, y = data
    fitted = T.boosted_trees(df, ["a", "b c", "d"], "y", trees=4, depth=3, rate=0.4, ridge=1.5)
    m = np.full(len(y), y.mean())
    errors = [np.mean((y - m) ** 2)]
    for tree in fitted.trees:
        splits, leaves = {}, {}
        grown(x, m - y, np.ones(len(y)), 1, 3, 1.5, splits, leaves, 0.4)
        assert tree.splits == splits and tree.leaves == pytest.approx(leaves)
        m = m + placed(x, splits, leaves)
        errors.append(np.mean((y - m) ** 2))
    assert fitted.errors == pytest.approx(errors) and errors[-1] < errors[0] / 4
    got = [r["prediction"] for r in fitted.predict(df).orderBy("id").collect()]
    assert got == pytest.approx(m.tolist())


@pytest.mark.parametrize("tried", [None, 2])
def test_bagging_equals_a_search_on_the_drawn_rows(data, tried):
    df, x, y = data
    fitted = T.bagged_trees(df, ["a", "b c", "d"], "y", ["id"], trees=5, depth=3, tried=tried)
    sums, hits, whole = np.zeros(len(y)), np.zeros(len(y)), np.zeros(len(y))
    for t, tree in enumerate(fitted.trees):
        u = [int(hashlib.md5(f"{i}:{t}".encode()).hexdigest()[:8], 16) / 2**32 for i in range(len(y))]
        w = np.array([sum(v >= p for p in T.POISSON) for v in u], float)
        assert 0.8 < w.mean() < 1.2
        splits, leaves = {}, {}
        grown(x, -y * w, w, 1, 3, 0.0, splits, leaves, 1.0, (lambda n, t=t: sorted(T.inputs_tried(t, n, 3, tried))) if tried else None)
        assert tree.splits == splits and tree.leaves == pytest.approx(leaves)
        value = placed(x, splits, leaves)
        sums += np.where(w == 0, value, 0)
        hits += w == 0
        whole += value / 5
    seen = hits > 0
    assert fitted.error == pytest.approx(np.mean((y[seen] - sums[seen] / hits[seen]) ** 2))
    got = [r["prediction"] for r in fitted.predict(df).orderBy("id").collect()]
    assert got == pytest.approx(whole.tolist())


def test_many_values_are_cut_at_quantiles(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(r.random() * 100, float(i % 3), 1.0) for i in range(5000)], "x double, k double, c double")
    cuts = T.cut_points(df, ["x", "k", "c"], 16)
    assert len(cuts[0]) == 15 and cuts[0] == sorted(cuts[0]) and abs(cuts[0][7] - 50) < 3
    assert cuts[1:] == [[0.0, 1.0, 2.0], [1.0]]
    step = df.withColumn("y", F.when(F.col("x") > 50, 1.0).otherwise(0.0))
    fitted = T.boosted_trees(step, ["x", "k", "c"], "y", trees=8, depth=2, rate=0.5, bins=16)
    assert fitted.errors[-1] < 0.02


def test_gaps_and_nothing(data, spark):
    df, _, _ = data
    odd = df.unionByName(spark.createDataFrame([(1000, None, 1.0, 2.0, 1.0), (1001, 1.0, float("nan"), 2.0, 1.0)], df.schema))
    for fit in (lambda d: T.boosted_trees(d, ["a", "b c"], "y", trees=1), lambda d: T.bagged_trees(d, ["a", "b c"], "y", ["id"], trees=1)):
        with pytest.raises(ValueError, match="2 rows"):
            fit(odd)
    with pytest.raises(ValueError, match="no rows"):
        T.boosted_trees(df.limit(0), ["a"], "y")
    flat = T.boosted_trees(df.withColumn("y", F.lit(2.0)), ["a"], "y", trees=2)
    assert flat.errors == [0.0] * 3 and flat.predict(df).select("prediction").distinct().collect()[0][0] == 2.0
