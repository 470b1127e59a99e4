"""Networks and support vectors: gradients by differences, certificates, and rows that are refused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedloom.operators import hinge as H
from fedloom.operators import models
from fedloom.operators import network as N


@pytest.mark.parametrize("activation", sorted(N.ACTIVATIONS))
@pytest.mark.parametrize("task", ["classification", "regression"])
def test_gradients_equal_finite_differences(activation, task):
    r = np.random.default_rng(5)
    x = r.normal(size=(17, 3))
    y = r.integers(0, 4, 17).astype(float) if task == "classification" else r.normal(size=17)
    sizes = [3, 5, 4, 4 if task == "classification" else 1]
    weights = [r.normal(size=s) for s in zip(sizes, sizes[1:])]
    biases = [r.normal(size=s) for s in sizes[1:]]
    _, to_weights, to_biases = N.gradient(x, y, weights, biases, activation, task)
    for params, slopes in ((weights, to_weights), (biases, to_biases)):
        for p, s in zip(params, slopes):
            for at in np.ndindex(p.shape):
                kept = p[at]
                sides = []
                for step in (1e-6, -1e-6):
                    p[at] = kept + step
                    sides.append(N.gradient(x, y, weights, biases, activation, task)[0])
                p[at] = kept
                assert s[at] == pytest.approx((sides[0] - sides[1]) / 2e-6, rel=1e-4, abs=1e-5)


@pytest.fixture
def points(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(600, 2)) * [3.0, 0.5] + [10.0, -1.0]
    z = (x[:, 0] - 10) / 3 + (x[:, 1] + 1) * 2
    return spark.createDataFrame([(i, float(a), float(b), int(v > 0), int(v > -0.8) + int(v > 0.8), float(np.tanh(v))) for i, ((a, b), v) in enumerate(zip(x, z))], "id int, a double, `b c` double, two int, three int, y double")


@pytest.mark.parametrize("activation", ["relu", "tanh"])
def test_networks_learn(points, activation):
    classes = N.network(points, ["a", "b c"], "three", [8], classes=3, activation=activation, rate=0.5, steps=60, momentum=0.9, seed=2)
    assert classes.losses[-1] < classes.losses[0] / 2
    right = classes.predict(points).agg(F.avg((F.col("prediction") == F.col("three")).cast("int"))).first()[0]
    assert right > 0.9
    line = N.network(points, ["a", "b c"], "y", [6], activation=activation, rate=0.1, steps=60, momentum=0.9, seed=3)
    gap = line.predict(points).agg(F.avg((F.col("prediction") - F.col("y")) ** 2) / 2).first()[0]
    assert gap == pytest.approx(line.losses[-1]) and gap < 0.05
    two = N.network(points, ["a", "b c"], "two", [], classes=2, activation=activation, rate=1.0, steps=20)
    assert two.predict(points).agg(F.avg((F.col("prediction") == F.col("two")).cast("int"))).first()[0] > 0.95


def test_the_sum_does_not_depend_on_the_partitions(points):
    one = N.network(points.coalesce(1), ["a", "b c"], "y", [4], steps=2, seed=1)
    many = N.network(points.repartition(23), ["a", "b c"], "y", [4], steps=2, seed=1)
    assert one.losses == pytest.approx(many.losses) and all(np.allclose(a, b) for a, b in zip(one.weights, many.weights))


def test_certificates_close_in_on_the_optimum(points):
    scaled = points.select("two", "three", ((F.col("a") - 10) / 3).alias("a"), ((F.col("b c") + 1) * 2).alias("b"))
    short, long = (H.linear_hinge(scaled, ["a", "b"], "two", [0, 1], ridge=0.1, rate=1.0, steps=n) for n in (3, 150))
    assert 0 <= long.certificates[0].gap < short.certificates[0].gap and long.certificates[0].gap < 0.05
    assert long.certificates[0].primal <= short.certificates[0].primal + 1e-9
    assert short.certificates[0].dual <= long.certificates[0].primal
    assert long.predict(scaled).agg(F.avg((F.col("prediction") == F.col("two")).cast("int"))).first()[0] > 0.95
    three = H.linear_hinge(scaled, ["a", "b"], "three", [0, 1, 2], ridge=0.01, rate=1.0, steps=40)
    assert len(three.certificates) == 3 and all(c.gap >= 0 for c in three.certificates)


def test_certificate_values_match_numpy(points):
    rows = H.hinge_rows(F.array(F.col("a"), F.col("b c")), F.col("two"), points)
    w = [[0.3, -0.2, -2.9]]
    held = H.certify(rows, 3, [0, 1], w, 0.05)[0]
    x, y = np.array([(r["a"], r["b c"]) for r in points.collect()]), np.array([2 * r["two"] - 1 for r in points.collect()])
    margin = y * (x @ w[0][:2] + w[0][2])
    assert held.primal == pytest.approx(0.05 / 2 * 0.13 + np.maximum(0, 1 - margin).mean())
    alpha = (margin < 1).astype(float)
    least = min(alpha[y > 0].sum(), alpha[y < 0].sum())
    alpha[y > 0] *= least / alpha[y > 0].sum()
    alpha[y < 0] *= least / alpha[y < 0].sum()
    values = [t * alpha.mean() - 0.05 / 2 * np.sum((t * (alpha * y) @ x / (0.05 * len(y))) ** 2) for t in np.linspace(0, 1, 20001)]
    assert held.dual == pytest.approx(max(values), abs=1e-6)


def test_gaps_are_refused(points, spark):
    odd = points.unionByName(spark.createDataFrame([(900, None, 1.0, 1, 1, 1.0), (901, 1.0, float("nan"), 0, 2, 1.0)], points.schema))
    for fit in (
        lambda: N.network(odd, ["a", "b c"], "y", [2], steps=1), lambda: H.linear_hinge(odd, ["a", "b c"], "two", [0, 1], steps=1),
        lambda: models.landmark_svm(odd.withColumn("v", F.array("a", "b c")), "v", "two", "id", landmarks=3),
    ):
        with pytest.raises(ValueError, match="rows have a NULL or NaN"):
            fit()
    with pytest.raises(ValueError, match="no class"):
        N.network(points, ["a"], "three", [2], classes=2, steps=1)
    with pytest.raises(ValueError, match="unknown activation"):
        N.network(points, ["a"], "three", [2], activation="step")
    with pytest.raises(ValueError, match="no rows"):
        N.network(points.limit(0), ["a"], "y", [2])
