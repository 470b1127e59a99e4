"""Boosted and bagged trees grown level by level from gradient histograms.

Inputs are cut into bins once.  A level costs one aggregation: sums of gradients and hessians by tree, node, input and
bin, added up in the map tasks, so what is shuffled depends on trees, nodes and bins only.  The best cut of a node has
the greatest regularised gain ``G_l^2 / (H_l + r) + G_r^2 / (H_r + r) - G^2 / (H + r)``; leaves are ``-G / (H + r)``.
Bagged trees are the same with weighted labels as gradients, and all of them grow together.  Their bootstrap weights
come from a hash of the row's key and the tree, so they are the same after a lost executor, and anyone can work them out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize, spread
from .columns import q

MAX_BINS = 64
#: Gains are compared at this many digits, so that the order of a sum does not decide; ties go to the first input and cut.
GAIN_DIGITS = 6
#: Cumulated probabilities of the Poisson weights 0, 1, ... of a bootstrap row.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]


@dataclass
class Tree:
    """Nodes by number: the root is 1, the children of n are 2n and 2n + 1; an input at most the cut goes to 2n."""

    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    bins: dict[int, int] = field(default_factory=dict)
    gains: dict[int, float] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def depth(self) -> int:
        return max((n.bit_length() for n in self.splits), default=0)


def cut_points(df: DataFrame, inputs: Sequence[str], most: int = MAX_BINS) -> list[list[float]]:
    """Cuts of each input: its values where there are at most ``most``, otherwise that many quantiles."""
    cells = [q(c).cast("double") for c in inputs]
    found = df.agg(*[F.approx_count_distinct(x).alias(f"n{i}") for i, x in enumerate(cells)]).first()
    few = [i for i in range(len(inputs)) if found[f"n{i}"] <= 2 * most]
    cuts: list[list[float]] = [[] for _ in inputs]
    for i in few:
        values = [r[0] for r in df.select(cells[i].alias("v")).where("v IS NOT NULL").distinct().limit(most + 1).collect()]
        if len(values) <= most:
            cuts[i] = sorted(values)
    rest = [i for i, c in enumerate(cuts) if not c]
    if rest:
        shares = [k / most for k in range(1, most)]
        row = df.agg(*[F.percentile_approx(cells[i], shares, 10_000).alias(f"c{i}") for i in rest]).first()
        for i in rest:
            cuts[i] = sorted(set(row[f"c{i}"] or []))
    return cuts


def _binned(df: DataFrame, inputs: Sequence[str], label: str, cuts: list[list[float]], *kept: Column) -> DataFrame:
    """``bins, y`` and the kept columns, stored; rows with a NULL or NaN are refused."""
    cells = [q(c).cast("double") for c in inputs]
    y = q(label).cast("double")

    def place(x: Column, edges: list[float]) -> Column:
        edges_ = F.array(*[F.lit(e) for e in edges]) if edges else F.array().cast("array<double>")
        return F.size(F.filter(edges_, lambda e: e < x))

    gap = reduce(or_, [v.isNull() | F.isnan(v) for v in [*cells, y]])
    rows = materialize(spread(df.select(F.array(*[place(x, e) for x, e in zip(cells, cuts, strict=True)]).alias("bins"), y.alias("y"), gap.alias("gap"), *kept)))
    gaps = rows.agg(F.count_if("gap")).first()[0]
    if gaps:
        raise ValueError(f"{gaps} rows have a NULL or NaN in {[*inputs, label]}; fill or drop them first")
    return rows.drop("gap")


def _node(trees: list[Tree], tree: Column, bins: Column, levels: int) -> Column:
    """The node a row has reached in its tree after some levels."""
    size = 1 << max(1, levels)
    inputs, cuts = [-1] * (len(trees) * size), [0] * (len(trees) * size)
    for t, grown in enumerate(trees):
        for n, (i, _) in grown.splits.items():
            if n < size:
                inputs[t * size + n], cuts[t * size + n] = i, grown.bins[n]
    if not levels:
        return F.lit(1)
    of, at = (F.array(*[F.lit(v) for v in values]) for values in (inputs, cuts))

    def step(n: Column, _: Column) -> Column:
        place = tree * size + F.least(n, F.lit(size - 1))
        i = F.get(of, place)
        down = 2 * n + (F.get(bins, i) > F.get(at, place)).cast("int")
        return F.when((n < size) & (i >= 0), down).otherwise(n)

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(1), step)


def _value(trees: list[Tree], tree: Column, node: Column) -> Column:
    """The value of a leaf."""
    size = max([n for t in trees for n in t.leaves], default=0) + 1
    values = [0.0] * (len(trees) * size)
    for t, grown in enumerate(trees):
        for n, v in grown.leaves.items():
            values[t * size + n] = v
    return F.get(F.array(*[F.lit(v) for v in values]), tree * size + node)


def _grow(rows: DataFrame, trees: list[Tree], cuts: list[list[float]], depth: int, ridge: float, least_gain: float, least_weight: float, rate: float, tried=None) -> None:
    """Grow trees on rows of ``tree, bins, g, h``; ``tried(tree, node)`` names the inputs a node may use."""
    totals: dict[tuple[int, int], tuple[float, float]] = {}
    frontier = {(t, 1) for t in range(len(trees))}
    for level in range(depth + 1):
        if not frontier or level == depth:
            break
        node = _node(trees, F.col("tree"), F.col("bins"), level)
        here = rows.select("tree", node.alias("node"), "bins", "g", "h").where(F.col("node") >= 1 << level)
        cells = here.select("tree", "node", "g", "h", F.posexplode("bins").alias("input", "bin"))
        sums = cells.groupBy("tree", "node", "input", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        own = W.partitionBy("tree", "node", "input")
        upto = own.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
        run = sums.select("tree", "node", "input", "bin", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"), F.sum("g").over(own).alias("g"), F.sum("h").over(own).alias("h"))
        score = lambda g, h: g * g / (h + ridge)
        gr, hr = F.col("g") - F.col("gl"), F.col("h") - F.col("hl")
        sides = (F.col("hl") >= least_weight) & (hr >= least_weight)
        gain = F.when(sides, F.round(score(F.col("gl"), F.col("hl")) + score(gr, hr) - score(F.col("g"), F.col("h")), GAIN_DIGITS))
        best = F.row_number().over(own.orderBy(F.desc_nulls_last("gain"), "bin"))
        # at most one row for each tree, node and input
        found = run.withColumn("gain", gain).withColumn("place", best).where("place = 1").drop("place").collect()
        chosen: dict[tuple[int, int], object] = {}
        for r in sorted(found, key=lambda r: (r["tree"], r["node"], r["input"])):
            key = (r["tree"], r["node"])
            totals[key] = (r["g"], r["h"])
            if key not in frontier or r["gain"] is None or r["gain"] <= least_gain or (tried and r["input"] not in tried(*key)):
                continue
            if key not in chosen or r["gain"] > chosen[key]["gain"]:
                chosen[key] = r
        for (t, n), r in chosen.items():
            trees[t].splits[n], trees[t].bins[n], trees[t].gains[n] = (r["input"], cuts[r["input"]][r["bin"]]), r["bin"], r["gain"]
            totals[t, 2 * n], totals[t, 2 * n + 1] = (r["gl"], r["hl"]), (r["g"] - r["gl"], r["h"] - r["hl"])
        frontier = {(t, child) for t, n in chosen for child in (2 * n, 2 * n + 1)}
    for (t, n), (g, h) in totals.items():
        if n not in trees[t].splits and (n == 1 or n // 2 in trees[t].splits):
            trees[t].leaves[n] = -g / (h + ridge) * rate if h + ridge else 0.0


def facts(trees: Sequence[Tree], inputs: Sequence[str]) -> dict:
    """Importances (an input's share of all gains) and average sizes of the trees."""
    gains = [sum(t.gains[n] for t in trees for n, (i, _) in t.splits.items() if i == j) for j in range(len(inputs))]
    return {
        "importances": [g / sum(gains) if sum(gains) else 0.0 for g in gains], "trees": len(trees),
        "average_depth": sum(t.depth() for t in trees) / len(trees), "average_nodes": sum(len(t.splits) + len(t.leaves) for t in trees) / len(trees),
        "average_leaves": sum(len(t.leaves) for t in trees) / len(trees),
    }


@dataclass
class Boosted:
    """Sum of a start value and the leaves of all trees."""

    inputs: Sequence[str]
    start: float
    trees: list[Tree]
    errors: list[float]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        total = reduce(lambda a, b: a + b, [_leaf_of(t, self.inputs) for t in self.trees], F.lit(self.start))
        return df.withColumn(name, total)


def _leaf_of(tree: Tree, inputs: Sequence[str]) -> Column:
    """The value of a row's leaf, on the inputs themselves."""
    def below(n: int) -> Column:
        if n not in tree.splits:
            return F.lit(tree.leaves.get(n, 0.0))
        i, cut = tree.splits[n]
        return F.when(q(inputs[i]).cast("double") <= cut, below(2 * n)).otherwise(below(2 * n + 1))

    return below(1)


def boosted_trees(df: DataFrame, inputs: Sequence[str], label: str, trees: int = 10, depth: int = 6, rate: float = 0.3, ridge: float = 1.0,
                  least_gain: float = 0.0, least_weight: float = 1.0, bins: int = MAX_BINS) -> Boosted:
    """Second-order boosting on squared error: the gradient is prediction minus label, the hessian one.

    Starts from the mean label.  ``errors`` holds the mean squared error before the first tree and after each.
    """
    cuts = cut_points(df, inputs, bins)
    rows = _binned(df, inputs, label, cuts)
    start = rows.agg(F.avg("y")).first()[0]
    if start is None:
        raise ValueError("no rows to fit")
    out = Boosted(list(inputs), start, [], [])
    rows = rows.withColumn("m", F.lit(start))
    for _ in range(trees):
        grown = [Tree()]
        _grow(rows.select(F.lit(0).alias("tree"), "bins", (F.col("m") - F.col("y")).alias("g"), F.lit(1.0).alias("h")), grown, cuts, depth, ridge, least_gain, least_weight, rate)
        node = _node(grown, F.lit(0), F.col("bins"), grown[0].depth())
        out.errors.append(rows.agg(F.avg((F.col("y") - F.col("m")) ** 2)).first()[0])
        rows = materialize(rows.withColumn("m", F.col("m") + _value(grown, F.lit(0), node)))
        out.trees.append(grown[0])
    out.errors.append(rows.agg(F.avg((F.col("y") - F.col("m")) ** 2)).first()[0])
    return out


def bootstrap_weight(key: Column, tree: Column) -> Column:
    """How often a row is drawn for a tree, Poisson with mean one, from the first 32 bits of an MD5 of ``key:tree``."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), tree.cast("string"))), 1, 8), 16, 10).cast("long")
    share = F.array(bits / F.lit(float(1 << 32)))  # a list of one, so that the hash is worked out once
    return F.transform(share, lambda u: reduce(lambda a, b: a + b, [(u >= p).cast("int") for p in POISSON]))[0]


def inputs_tried(tree: int, node: int, inputs: int, most: int) -> list[int]:
    """The inputs a node of a bagged tree may use, by the least MD5 of ``tree:node:input``."""
    return sorted(range(inputs), key=lambda i: hashlib.md5(f"{tree}:{node}:{i}".encode()).hexdigest())[:most]


@dataclass
class Bagged:
    """Mean of the leaves of all trees, with the mean squared error of rows in the trees that have not drawn them."""

    inputs: Sequence[str]
    trees: list[Tree]
    error: float | None

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        total = reduce(lambda a, b: a + b, [_leaf_of(t, self.inputs) for t in self.trees])
        return df.withColumn(name, total / len(self.trees))


def bagged_trees(df: DataFrame, inputs: Sequence[str], label: str, key: Sequence[str], trees: int = 20, depth: int = 5, tried: int | None = None,
                 least_weight: float = 1.0, bins: int = MAX_BINS) -> Bagged:
    """Random forest of a number, or of a class given as 0 and 1, whose prediction is then its share.

    ``key`` columns tell rows apart; equal keys are drawn together.  A node tries ``tried`` inputs, all by default.
    """
    cuts = cut_points(df, inputs, bins)
    name = F.concat_ws(":", *[q(c).cast("string") for c in key])
    rows = _binned(df, inputs, label, cuts, F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: bootstrap_weight(name, t)).alias("draws"))
    each = rows.select("bins", "y", F.posexplode("draws").alias("tree", "h")).where("h > 0")
    drawn = each.select("tree", "bins", (-F.col("y") * F.col("h")).alias("g"), F.col("h").cast("double").alias("h"))
    grown = [Tree() for _ in range(trees)]
    allowed = None if tried is None else lambda t, n: inputs_tried(t, n, len(inputs), tried)
    _grow(drawn, grown, cuts, depth, 0.0, 0.0, least_weight, 1.0, allowed)
    levels = max((t.depth() for t in grown), default=0)
    guesses = F.transform("draws", lambda h, t: F.when(h == 0, _value(grown, t, _node(grown, t, F.col("bins"), levels))))
    known = rows.select("y", F.array_compact(guesses).alias("guesses")).where(F.size("guesses") > 0)
    mean = F.aggregate("guesses", F.lit(0.0), lambda a, x: a + x) / F.size("guesses")
    error = known.agg(F.avg((F.col("y") - mean) ** 2)).first()[0]
    return Bagged(list(inputs), grown, error)
