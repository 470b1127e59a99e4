"""Gradient descent on lines, planes and logistic models, for one table or for the clients of a federation.

A client enters a round with its gradient as one vector, added up element by element with map-side partial sums, so a
client that holds a third of the rows is no hot spot.  Squared loss needs the rows once: its gradients come from each
client's matrix of second moments.  The logistic loss needs them once for each local step.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import array_literal, dot
from ..session import materialize, spread
from .columns import fit, q
from .scoring import MARGIN_LIMIT, sigmoid

#: Numbers of all clients' weights that are broadcast at most; beyond that rows and weights are joined by a shuffle.
BROADCAST_WEIGHTS = 4_000_000
#: Up to so many sums are plain columns, which compile; more are one vector.
UNROLLED_SUMS = 64
MODELS = ("linear", "logistic")
#: Keeps the logarithm of a probability finite.
TINY = 1e-15


def _missing(*values: Column) -> Column:
    return reduce(or_, [v.isNull() | F.isnan(v) for v in values])


def _refuse(gaps: int, what: str) -> None:
    if gaps:
        raise ValueError(f"{gaps} {what} have a NULL or NaN; fill or drop them first")


def moment_sums(x: Column, y: Column) -> dict[str, Column]:
    """Everything full-batch descent on a line needs, for any number of steps, and how many rows are incomplete."""
    both = ~_missing(x, y)
    x, y = F.when(both, x), F.when(both, y)
    return {"n": F.count(x), "sx": F.sum(x), "sy": F.sum(y), "sxy": F.sum(x * y), "sxx": F.sum(x * x), "gaps": F.count_if(~both)}


def descend(sums: dict, rate: float, steps: int, slope: float = 0.0, intercept: float = 0.0) -> tuple[float, float]:
    """Gradient descent on scalars: the data enter only through their sums."""
    m, c = slope, intercept
    for _ in range(steps):
        dm = -2 / sums["n"] * (sums["sxy"] - m * sums["sxx"] - c * sums["sx"])
        dc = -2 / sums["n"] * (sums["sy"] - m * sums["sx"] - c * sums["n"])
        m, c = m - rate * dm, c - rate * dc
    return m, c


def linear_gd(df: DataFrame, x: Column, y: Column, rate: float = 0.01, steps: int = 100) -> dict:
    """Line by full-batch gradient descent; one pass over the data, however many steps.  Rows with a NULL or NaN are refused."""
    sums = fit(df, moment_sums(x.cast("double"), y.cast("double")))
    _refuse(sums["gaps"], "rows")
    if not sums["n"]:
        raise ValueError("no rows to fit")
    m, c = descend(sums, rate, steps)
    return {"m": m, "c": c, "learning_rate": rate, "iterations": steps}


def _summed(groups, values: Sequence[Column], vector: Column, *more: Column) -> DataFrame:
    """``n`` and ``sums`` of each group: the ``values`` one by one where they are few, otherwise as the one ``vector``."""
    n = F.count(F.lit(1)).alias("n")
    if len(values) > UNROLLED_SUMS:
        found = groups.agg(n, Summarizer.sum(array_to_vector(vector)).alias("sums"), *more)
        return found.withColumn("sums", vector_to_array("sums"))
    found = groups.agg(n, *[F.sum(v).alias(f"_s{i}") for i, v in enumerate(values)], *more)
    return found.withColumn("sums", F.array(*[F.col(f"_s{i}") for i in range(len(values))])).drop(*[f"_s{i}" for i in range(len(values))])


def _margin(width: int, weights: Column | Sequence[float]) -> Column:
    """Inputs times weights, spelt out where they are few."""
    given = weights if isinstance(weights, Column) else [F.lit(float(w)) for w in weights]
    if width > UNROLLED_SUMS:
        return dot(F.col("x"), given if isinstance(given, Column) else F.array(*given))
    return reduce(add, [F.col("x")[i] * given[i] for i in range(width)])


def _moments(rows: DataFrame, width: int) -> DataFrame:
    """``client, n, sums``: for each input and the constant a row of sums with every input, the constant and the label."""
    all_ = F.concat("x", F.array("y"))
    cells = [F.col("x")[i] for i in range(width)]
    values = [a * b for a in cells for b in [*cells, F.col("y")]] if width * (width + 1) <= UNROLLED_SUMS else [F.lit(0)] * (UNROLLED_SUMS + 1)
    return _summed(rows.groupBy("client"), values, F.flatten(F.transform("x", lambda a: F.transform(all_, lambda b: a * b))))


def _plane_step(width: int, rate: float, weights: Column) -> Column:
    """Weights after one step on squared loss, from a client's moments."""
    each = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.slice("sums", i * (width + 1) + 1, F.lit(width + 1)))
    slope = lambda sums: dot(F.slice(sums, 1, width), weights) - F.element_at(sums, width + 1)
    return F.zip_with(weights, each, lambda w, sums: w - F.lit(2.0 * rate) / F.col("n") * slope(sums))


def _chance(width: int, weights: Column | Sequence[float]) -> Column:
    return sigmoid(F.greatest(F.lit(-MARGIN_LIMIT), F.least(F.lit(MARGIN_LIMIT), _margin(width, weights))))


def _logistic_step(rows: DataFrame, weights: DataFrame | None, start: Sequence[float], rate: float, clients: int) -> DataFrame:
    """``client, w`` after one step on the logistic loss; ``weights`` are the clients' own, if they have left ``start``."""
    width = len(start)
    if weights is None:
        own, before = rows.withColumn("gap", _chance(width, start) - F.col("y")), F.any_value(array_literal(start))
    else:
        held = F.broadcast(weights) if clients * width <= BROADCAST_WEIGHTS else weights
        same = F.col("r.client").eqNullSafe(F.col("k.client"))
        joined = rows.alias("r").join(held.alias("k"), same).select("r.client", "x", "y", "w")
        own, before = joined.withColumn("gap", _chance(width, F.col("w")) - F.col("y")), F.any_value("w")
    values = [F.col("x")[i] * F.col("gap") for i in range(width)]
    found = _summed(own.groupBy("client"), values, F.transform("x", lambda v: v * F.col("gap")), before.alias("w"))
    return materialize(found.select("client", F.zip_with("w", "sums", lambda w, g: w - F.lit(rate) * g / F.col("n")).alias("w")))


def _measures(model: str, weights: Sequence[float], label: Column) -> dict[str, Column]:
    if model == "linear":
        gap = label - _margin(len(weights), weights)
        return {"mse": F.avg(gap * gap), "mae": F.avg(F.abs(gap))}
    chance = _chance(len(weights), weights)
    loss = -(label * F.log(chance + TINY) + (1 - label) * F.log(1 - chance + TINY))
    return {"log_loss": F.avg(loss), "accuracy": F.avg(((chance >= 0.5) == (label >= 0.5)).cast("int"))}


def federated_descent(train: DataFrame, client: str, inputs: Sequence[str], label: str, test: DataFrame, rounds: int,
                      rate: float = 0.01, steps: int = 10, model: str = "linear") -> DataFrame:
    """Rounds of local descent per client, averaging, and evaluation on held-out rows, for any number of inputs.

    One row per round: ``round, clients, weights`` (one per input), ``intercept`` and the metrics: ``mse, mae`` for
    squared loss, ``log_loss, accuracy`` for ``model="logistic"`` with a label of 0 or 1.  Every client counts the
    same, as in ``fedavg``.  The training rows are stored once; the test rows are read once for all rounds.  Rows with
    a NULL or NaN are refused, in training and test; rows without a client are a client of their own.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}, expected one of {MODELS}")
    width = len(inputs) + 1

    def slim(df: DataFrame, *kept: Column) -> DataFrame:
        cells = [q(c).cast("double") for c in inputs]
        return df.select(*kept, F.array(*cells, F.lit(1.0)).alias("x"), q(label).cast("double").alias("y"))

    gap = F.count_if(F.exists("x", lambda v: _missing(v)) | _missing(F.col("y")))
    rows = materialize(spread(slim(train, q(client).alias("client"))))
    gaps, clients = rows.agg(gap, F.approx_count_distinct("client")).first()
    _refuse(gaps, "training rows")
    held_out = slim(test)
    now, history = [0.0] * width, []
    sums = materialize(_moments(rows, width)) if model == "linear" else None
    for number in range(1, rounds + 1):
        if model == "linear":
            start = array_literal(now)
            moved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda w, _: _plane_step(width, rate, w)) if steps else start
            local = sums.select("client", moved.alias("w"))
        else:
            local = None
            for _ in range(steps):
                local = _logistic_step(rows, local, now, rate, 2 * clients)
            if local is None:
                local = rows.select("client").distinct().withColumn("w", array_literal(now))
        got = local.agg(F.count(F.lit(1)).alias("clients"), Summarizer.mean(array_to_vector("w")).alias("w")).first()
        if not got["clients"]:
            raise ValueError("no rows to fit")
        now = got["w"].toArray().tolist()
        history.append((number, got["clients"], now))
    measured = {f"{name}_{number}": e for number, _, w in history for name, e in _measures(model, w, F.col("y")).items()}
    found = held_out.agg(gap.alias("gaps"), *[e.alias(n) for n, e in measured.items()])
    gaps = F.raise_error(F.concat(F.col("gaps").cast("string"), F.lit(" test rows have a NULL or NaN; fill or drop them first")))
    names = list(_measures(model, now, F.col("y")))
    lines = [
        F.struct(
            F.lit(number).alias("round"), F.lit(count).cast("long").alias("clients"), array_literal(w[:-1]).alias("weights"), F.lit(w[-1]).alias("intercept"),
            *[F.when(F.col("gaps") > 0, gaps.cast("double")).otherwise(F.col(f"{n}_{number}")).alias(n) for n in names],
        )
        for number, count, w in history
    ]
    return found.select(F.inline(F.array(*lines)))


def federated_rounds(train: DataFrame, client: str, x: str, y: str, test: DataFrame, rounds: int, rate: float = 0.01, steps: int = 10) -> DataFrame:
    """``federated_descent`` of a line: slope ``m`` and intercept ``c`` of each round, with ``mse`` and ``mae``."""
    done = federated_descent(train, client, [x], y, test, rounds, rate, steps)
    return done.select("round", "clients", F.col("weights")[0].alias("m"), F.col("intercept").alias("c"), "mse", "mae")
