"""Predictions from given parameters, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import argmax_class, metrics_report, sign_class, threshold_class
from ..functions.vectors import array_literal, dot, linear
from .columns import fit, q

MARGIN_LIMIT = 250.0
KERNELS = ("rbf", "linear", "polynomial", "sigmoid")


def _cells(columns: Sequence[str]) -> list[Column]:
    return [q(c).cast("double") for c in columns]


def score_linear(columns: Sequence[str], weights: Sequence[float], intercept: float) -> Column:
    return linear(_cells(columns), weights, intercept)


def sigmoid(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


def score_logistic(columns: Sequence[str], weights: Sequence[float], bias: float) -> Column:
    """Probability of class 1; the margin is kept within +-250."""
    margin = linear(_cells(columns), weights, bias)
    return sigmoid(F.greatest(F.lit(-MARGIN_LIMIT), F.least(F.lit(MARGIN_LIMIT), margin)))


def score_logistic_class(columns: Sequence[str], weights: Sequence[float], bias: float, threshold: float = 0.5) -> Column:
    return threshold_class(score_logistic(columns, weights, bias), threshold)


def score_svm(columns: Sequence[str], weights: Sequence[Sequence[float]], biases: Sequence[float]) -> Column:
    """Sign of one margin, or the class with the largest of several."""
    cells = _cells(columns)
    if len(weights) == 1:
        return sign_class(linear(cells, weights[0], biases[0]))
    return argmax_class(F.array(*[linear(cells, w, b) for w, b in zip(weights, biases, strict=True)]))


ACTIVATIONS = {
    "relu": lambda z: F.greatest(F.lit(0.0), z),
    "tanh": F.tanh,
    "logistic": sigmoid,
    "sigmoid": sigmoid,
    "identity": lambda z: z,
}


# layers with more weights than this are evaluated on arrays instead of plain columns
UNROLLED_WEIGHTS = 1_024


def _unit_sums(inputs: Sequence[Column], matrix: Sequence[Sequence[float]], biases: Sequence[float]) -> list[Column]:
    """inputs · matrix + biases as one compiled expression per unit; the matrix has one row per input."""
    return [linear(inputs, [row[j] for row in matrix], b) for j, b in enumerate(biases)]


def _array_sums(inputs: Column, matrix: Sequence[Sequence[float]], biases: Sequence[float]) -> Column:
    """The same for wide layers, with array expressions."""
    by_unit = F.array(*[array_literal([row[j] for row in matrix]) for j in range(len(biases))])
    return F.zip_with(F.transform(by_unit, lambda w: dot(inputs, w)), array_literal(biases), lambda s, b: s + b)


def score_mlp(df: DataFrame, columns: Sequence[str], weights: Sequence, biases: Sequence, activation: str = "relu", task: str = "classification",
              num_classes: int = 2, mean: Sequence[float] | None = None, scale: Sequence[float] | None = None, name: str = "prediction",
              probability: str | None = None) -> DataFrame:
    """Forward pass of a feed-forward network over numeric columns.

    Every layer is one projection of column expressions, so the network costs
    no Python and no shuffle.  ``probability`` names a column for the
    probability of class 1 of a two-class network.
    """
    act = ACTIVATIONS.get(activation, ACTIVATIONS["relu"])
    cells = _cells(columns)
    if mean is not None and scale is not None:
        cells = [(x - m) / F.lit(float(s)) for x, m, s in zip(cells, mean, scale, strict=True)]
    units = [f"_unit{i}" for i in range(len(cells))]
    out = df.select("*", *[x.alias(u) for x, u in zip(cells, units)])
    for i, (matrix, bias) in enumerate(zip(weights, biases, strict=True)):
        last = i == len(weights) - 1
        level = [F.col(u) for u in units]
        fresh = [f"_unit{i + 1}_{j}" for j in range(len(bias))]
        kept = [q(c) for c in df.columns]
        if len(level) * len(bias) <= UNROLLED_WEIGHTS:
            sums = _unit_sums(level, matrix, bias)
            out = out.select(*kept, *[(z if last else act(z)).alias(u) for z, u in zip(sums, fresh)])
        else:
            wide = out.select(*kept, _array_sums(F.array(*level), matrix, bias).alias("_wide"))
            out = wide.select(*kept, *[(F.col("_wide")[j] if last else act(F.col("_wide")[j])).alias(u) for j, u in enumerate(fresh)])
        units = fresh
    outputs = [F.col(u) for u in units]
    if task == "regression":
        result = outputs[0]
    elif num_classes > 2:
        result = argmax_class(F.array(*outputs))
    else:
        result = threshold_class(sigmoid(outputs[0]))
    chance = [sigmoid(outputs[0]).alias(probability)] if probability else []
    return out.select(*[q(c) for c in df.columns], result.alias(name), *chance)


def softmax(scores: Column) -> Column:
    """Class probabilities of an array of scores."""
    powers = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda p: p / total)


def score_importance(df: DataFrame, columns: Sequence[str], importances: Sequence[float], task: str = "classification", name: str = "prediction") -> DataFrame:
    """Importance-weighted sum, scaled to [0, 1] for classification (0.5 when constant)."""
    score = linear(_cells(columns), importances)
    if task != "classification":
        return df.withColumn(name, score)
    seen = fit(df, {"low": F.min(score), "high": F.max(score)})
    if seen["low"] is None or seen["high"] <= seen["low"]:
        return df.withColumn(name, F.lit(0.5))
    return df.withColumn(name, (score - seen["low"]) / F.lit(seen["high"] - seen["low"]))


def apply_model(df: DataFrame, model: dict, columns: Sequence[str], prediction: str = "prediction", score: str = "score") -> DataFrame:
    """``prediction`` and, for two classes, ``score`` (probability of class 1, or the margin of an SVM) from stored parameters.

    ``model["kind"]`` is linear (weights, intercept), logistic (weights, bias,
    threshold), svm (weights and biases by class), mlp (the arguments of
    ``score_mlp``) or importance (importances, task).  Where there is no such
    score the column is NULL.
    """
    model = dict(model)
    kind = model.pop("kind")
    none = F.lit(None).cast("double")
    if kind == "linear":
        return df.withColumns({prediction: score_linear(columns, model["weights"], model["intercept"]), score: none})
    if kind == "logistic":
        return df.withColumn(score, score_logistic(columns, model["weights"], model["bias"])).withColumn(prediction, threshold_class(q(score), model.get("threshold", 0.5)))
    if kind == "svm":
        two = len(model["weights"]) == 1
        margin = score_linear(columns, model["weights"][0], model["biases"][0]) if two else none
        return df.withColumns({prediction: score_svm(columns, model["weights"], model["biases"]), score: margin})
    if kind == "mlp":
        two = model.get("task", "classification") != "regression" and model.get("num_classes", 2) <= 2
        out = score_mlp(df, columns, name=prediction, probability=score if two else None, **model)
        return out if two else out.withColumn(score, none)
    if kind == "importance":
        task = model.get("task", "classification")
        out = score_importance(df, columns, model["importances"], task, score)
        return out.withColumn(prediction, threshold_class(q(score))) if task == "classification" else out.withColumnRenamed(score, prediction).withColumn(score, none)
    raise ValueError(f"unknown model kind {kind!r}")


def evaluate_model(df: DataFrame, model: dict, columns: Sequence[str], label: str, metrics: Sequence[str], by: Sequence[str] = (), average: str = "binary") -> DataFrame:
    """Report of a model given by its stored parameters; area and log loss come from its scores where it has them."""
    regression = model["kind"] == "linear" or model.get("task") == "regression"
    several = model.get("num_classes", 2) > 2 or (model["kind"] == "svm" and len(model["weights"]) > 1)
    scored = apply_model(df.select(*[q(c) for c in dict.fromkeys([*by, label, *columns])]), model, columns, "_prediction", "_score")
    return metrics_report(scored, metrics, label, "_prediction", by, average, score=None if regression or several else "_score")


def pick_landmarks(df: DataFrame, features: str, key: str, count: int = 15) -> list[list[float]]:
    """A repeatable choice of landmark rows: the lowest hashes of the key."""
    order = [F.md5(q(key).cast("string")).asc(), q(key).asc()]
    return [list(r[0]) for r in df.orderBy(*order).limit(count).select(q(features).cast("array<double>")).collect()]


def landmark_features(features: Column, landmarks: Sequence[Sequence[float]], kernel: str = "rbf", gamma: float = 1.0,
                      degree: int = 3, coef0: float = 0.0) -> Column:
    """Kernel value of each row against each landmark, as an array."""
    x = features.cast("array<double>")
    table = F.array(*[array_literal(v) for v in landmarks])

    def total(products: Column) -> Column:
        return F.aggregate(products, F.lit(0.0), lambda a, v: a + v)

    def inner(w: Column) -> Column:
        return dot(x, w)

    if kernel == "rbf":
        return F.transform(table, lambda w: F.exp(-gamma * total(F.zip_with(x, w, lambda a, b: (a - b) * (a - b)))))
    if kernel == "linear":
        return F.transform(table, inner)
    if kernel == "polynomial":
        return F.transform(table, lambda w: F.pow(inner(w) + coef0, F.lit(degree)))
    if kernel == "sigmoid":
        return F.transform(table, lambda w: F.tanh(gamma * inner(w) + coef0))
    raise ValueError(f"unknown kernel {kernel!r}, expected one of {KERNELS}")
