"""Linear support vectors by full-batch subgradient descent, with a certificate of how far from the optimum they are.

The primal is ``ridge / 2 * |w|^2 + mean(max(0, 1 - y * (w x + b)))`` with a free intercept.  Rows inside the margin
are dual weights of one; scaled so that both classes weigh the same they are feasible, and their dual value bounds the
primal from below.  One pass gives both, so a fit tells its own duality gap.  All classes share every pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread
from .columns import fit, q
from .descent import _margin, _missing
from .scoring import score_svm


@dataclass
class Certificate:
    """Value of the fit, a lower bound of the best value, and their difference."""

    primal: float
    dual: float

    @property
    def gap(self) -> float:
        return self.primal - self.dual


@dataclass
class Hinge:
    """One margin for two classes, one per class for more."""

    inputs: Sequence[str]
    classes: list
    weights: list[list[float]]
    biases: list[float]
    certificates: list[Certificate]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """The class: by the sign of the one margin, or by the greatest of several."""
        place = score_svm(self.inputs, self.weights, self.biases).cast("int")
        return df.withColumn(name, F.get(F.array(*[F.lit(c) for c in self.classes]), place))


def hinge_rows(x: Column, label: Column, df: DataFrame) -> DataFrame:
    """``x`` with a constant one at its end and the label, stored; rows with a NULL or NaN are refused."""
    rows = materialize(spread(df.select(F.concat(x, F.array(F.lit(1.0))).alias("x"), label.alias("label"))))
    bad = F.exists("x", lambda v: _missing(v)) | F.col("x").isNull() | F.col("label").isNull()
    gaps, count = rows.agg(F.count_if(bad), F.count(F.lit(1))).first()
    if gaps:
        raise ValueError(f"{gaps} rows have a NULL or NaN; fill or drop them first")
    if not count:
        raise ValueError("no rows to fit")
    return rows


def _signs(classes: Sequence) -> list[Column]:
    """For each margin the side of a row, 1 or -1."""
    positive = classes[1:] if len(classes) == 2 else classes
    return [F.when(F.col("label") == F.lit(c), 1.0).otherwise(-1.0) for c in positive]


def descend_hinge(rows: DataFrame, width: int, classes: Sequence, ridge: float, rate: float, steps: int) -> list[list[float]]:
    """Weights (the intercept last) of every margin after so many steps of ``rate / sqrt(step)``."""
    signs = _signs(classes)
    w = [[0.0] * width for _ in signs]
    n = F.count(F.lit(1))
    for step in range(1, steps + 1):
        short = [s * _margin(width, v) < 1 for s, v in zip(signs, w, strict=True)]
        sums = fit(rows, {(c, i): F.sum(F.when(short[c], signs[c] * F.col("x")[i]).otherwise(0.0)) for c in range(len(w)) for i in range(width)} | {"n": n})
        pace = rate / math.sqrt(step)
        w = [[v - pace * ((ridge * v if i < width - 1 else 0.0) - sums[c, i] / sums["n"]) for i, v in enumerate(own)] for c, own in enumerate(w)]
    return w


def certify(rows: DataFrame, width: int, classes: Sequence, weights: Sequence[Sequence[float]], ridge: float) -> list[Certificate]:
    """Primal and dual value of each margin's weights, from one pass."""
    wanted: dict = {"n": F.count(F.lit(1))}
    for c, (sign, w) in enumerate(zip(_signs(classes), weights, strict=True)):
        margin = sign * _margin(width, w)
        wanted[c, "loss"] = F.avg(F.greatest(F.lit(0.0), 1 - margin))
        for name, side in (("+", sign > 0), ("-", sign < 0)):
            inside = side & (margin < 1)
            wanted[c, name] = F.count_if(inside)
            for i in range(width - 1):
                wanted[c, name, i] = F.sum(F.when(inside, F.col("x")[i]).otherwise(0.0))
    found = fit(rows, wanted)
    out = []
    for c, w in enumerate(weights):
        plus, minus = found[c, "+"], found[c, "-"]
        primal = ridge / 2 * sum(v * v for v in w[:-1]) + found[c, "loss"]
        dual = 0.0
        if plus and minus:
            least = min(plus, minus)
            pull = [(least / plus * found[c, "+", i] - least / minus * found[c, "-", i]) / (ridge * found["n"]) for i in range(width - 1)]
            size, mass = sum(v * v for v in pull), 2 * least / found["n"]
            share = 1.0 if not size else min(1.0, mass / (ridge * size))  # the best multiple of these dual weights
            dual = share * mass - share * share * ridge / 2 * size
        out.append(Certificate(primal, dual))
    return out


def linear_hinge(df: DataFrame, inputs: Sequence[str], label: str, classes: Sequence, ridge: float = 0.01, rate: float = 1.0, steps: int = 50) -> Hinge:
    """Linear support vectors for the stated classes; two give one margin, more give one against the rest each."""
    x = F.array(*[q(c).cast("double") for c in inputs])
    rows = hinge_rows(x, q(label), df)
    weights = descend_hinge(rows, len(inputs) + 1, classes, ridge, rate, steps)
    held = certify(rows, len(inputs) + 1, classes, weights, ridge)
    return Hinge(list(inputs), list(classes), [w[:-1] for w in weights], [w[-1] for w in weights], held)


def kernel_hinge(df: DataFrame, features: Column, width: int, label: Column, classes: Sequence, ridge: float = 0.01, rate: float = 1.0, steps: int = 50) -> tuple[list[list[float]], list[Certificate]]:
    """The same on an array column of ``width`` numbers, such as kernels against landmarks: weights and certificates."""
    rows = hinge_rows(features, label, df)
    weights = descend_hinge(rows, width + 1, classes, ridge, rate, steps)
    return weights, certify(rows, width + 1, classes, weights, ridge)
