"""Feed-forward networks by data-parallel backpropagation.

Every step hands the weights to the tasks; a task works out the gradient of its rows block by block (Arrow batches as
matrices) and tells one vector; the vectors are added up in two levels, so the driver gets one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread
from .columns import fit, q
from .descent import _missing
from .scoring import score_mlp

#: Value and slope, the slope from the value.
ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, 0.0), lambda a: (a > 0).astype(float)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "logistic": (lambda z: 1 / (1 + np.exp(-np.clip(z, -250, 250))), lambda a: a * (1 - a)),
    "identity": (lambda z: z, np.ones_like),
}
#: Partial sums are added up in about this many groups before the last one.
GROUPS = 16


@dataclass
class Network:
    """Weights and biases by layer, the scaling of the inputs, and the loss before every step and after the last."""

    inputs: Sequence[str]
    weights: list[np.ndarray]
    biases: list[np.ndarray]
    mean: list[float]
    scale: list[float]
    activation: str
    task: str
    losses: list[float]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        classes = {} if self.task == "regression" else {"num_classes": max(3, len(self.biases[-1]))}  # two units are two classes, not one chance
        return score_mlp(
            df, list(self.inputs), weights=[w.tolist() for w in self.weights], biases=[b.tolist() for b in self.biases], activation=self.activation,
            mean=self.mean, scale=self.scale, task=self.task, name=name, **classes,
        )


def gradient(x: np.ndarray, y: np.ndarray, weights: Sequence[np.ndarray], biases: Sequence[np.ndarray], activation: str, task: str) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
    """Summed loss of some rows and its gradients: half the squared gap, or the cross-entropy of classes 0, 1, ..."""
    value, slope = ACTIVATIONS[activation]
    layers = [x]
    for w, b in zip(weights[:-1], biases[:-1], strict=True):
        layers.append(value(layers[-1] @ w + b))
    out = layers[-1] @ weights[-1] + biases[-1]
    if task == "regression":
        back = out - y[:, None]
        loss = float((back * back).sum() / 2)
    else:
        out = out - out.max(axis=1, keepdims=True)
        logs = out - np.log(np.exp(out).sum(axis=1, keepdims=True))
        at = (np.arange(len(y)), y.astype(int))
        loss, back = -float(logs[at].sum()), np.exp(logs)
        back[at] -= 1
    to_weights, to_biases = [], []
    for i in range(len(weights) - 1, -1, -1):
        to_weights.insert(0, layers[i].T @ back)
        to_biases.insert(0, back.sum(axis=0))
        if i:
            back = (back @ weights[i].T) * slope(layers[i])
    return loss, to_weights, to_biases


def _flat(arrays: Sequence[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.reshape(-1) for a in arrays])


def _total(rows: DataFrame, weights: list[np.ndarray], biases: list[np.ndarray], activation: str, task: str) -> tuple[float, np.ndarray]:
    """Loss and gradient, as one vector, over all rows."""
    width = weights[0].shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            loss, to_weights, to_biases = gradient(x, batch.column("y").to_numpy(zero_copy_only=False), weights, biases, activation, task)
            own = np.concatenate([[loss], _flat(to_weights), _flat(to_biases)])
            told = own if told is None else told + own
        if told is not None:
            yield pa.RecordBatch.from_arrays([pa.array([told.tolist()], pa.list_(pa.float64()))], ["g"])

    parts = rows.mapInArrow(run, "g array<double>").select(array_to_vector("g").alias("g"), (F.spark_partition_id() % GROUPS).alias("group"))
    sums = parts.groupBy("group").agg(Summarizer.sum(F.col("g")).alias("g"))
    found = sums.agg(Summarizer.sum(F.col("g"))).first()[0].toArray()
    return float(found[0]), found[1:]


def _shaped(flat: np.ndarray, like: Sequence[np.ndarray]) -> list[np.ndarray]:
    out, at = [], 0
    for a in like:
        out.append(flat[at:at + a.size].reshape(a.shape))
        at += a.size
    return out


def network(df: DataFrame, inputs: Sequence[str], label: str, hidden: Sequence[int], classes: int | None = None, activation: str = "relu", rate: float = 0.1,
            steps: int = 100, ridge: float = 0.0, momentum: float = 0.0, seed: int = 0, start: tuple | None = None, scaling: tuple | None = None) -> Network:
    """Full-batch descent with momentum; ``classes`` makes it a classifier of labels 0 to classes - 1, otherwise a regression.

    Inputs are standardised by their own mean and deviation, or by ``scaling`` (means, scales).  Weights start from
    ``start`` (weights, biases) or from a seeded uniform draw.  Rows with a NULL or NaN are refused.
    """
    if activation not in ACTIVATIONS:
        raise ValueError(f"unknown activation {activation!r}, expected one of {sorted(ACTIVATIONS)}")
    cells = [q(c).cast("double") for c in inputs]
    if scaling is None:
        stats = fit(df, {(i, k): f(x) for i, x in enumerate(cells) for k, f in (("mean", F.avg), ("scale", F.stddev_pop))})
        scaling = [stats[i, "mean"] for i in range(len(cells))], [stats[i, "scale"] or 1.0 for i in range(len(cells))]
    mean, scale = [list(map(float, s)) if None not in s else [0.0] * len(cells) for s in scaling]
    scaled = F.array(*[(x - m) / s for x, m, s in zip(cells, mean, scale, strict=True)])
    rows = materialize(spread(df.select(scaled.alias("x"), q(label).cast("double").alias("y"))))
    wrong = F.lit(False) if classes is None else ~F.col("y").isin(*map(float, range(classes)))
    gaps, bad, n = rows.agg(F.count_if(F.exists("x", lambda v: _missing(v)) | _missing(F.col("y"))), F.count_if(wrong), F.count(F.lit(1))).first()
    if gaps or bad:
        raise ValueError(f"{gaps} rows have a NULL or NaN; fill or drop them first" if gaps else f"{bad} labels are no class from 0 to {classes - 1}")
    if not n:
        raise ValueError("no rows to fit")
    sizes = [len(inputs), *hidden, classes or 1]
    if start is None:
        draw = np.random.default_rng(seed)
        weights = [draw.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        biases = [np.zeros(b) for b in sizes[1:]]
    else:
        weights, biases = ([np.array(a, float) for a in part] for part in start)
    task, losses = "regression" if classes is None else "classification", []
    speed = np.zeros(sum(a.size for a in [*weights, *biases]))
    for _ in range(steps):
        loss, slope = _total(rows, weights, biases, activation, task)
        held = np.concatenate([_flat(weights), np.zeros(sum(b.size for b in biases))])
        losses.append(loss / n + ridge / 2 * float(held @ held))
        speed = momentum * speed - rate * (slope / n + ridge * held)
        moved = np.concatenate([_flat(weights), _flat(biases)]) + speed
        together = _shaped(moved, [*weights, *biases])
        weights, biases = together[:len(weights)], together[len(weights):]
    losses.append(_total(rows, weights, biases, activation, task)[0] / n + ridge / 2 * float(_flat(weights) @ _flat(weights)))
    return Network(list(inputs), weights, biases, mean, scale, activation, task, losses)
