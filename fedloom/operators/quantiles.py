"""Quantiles of whole columns: sketched, or exact by narrowing brackets.

Exact selection never gathers a column.  A bounded-memory sketch gives a value
bracket round the wanted rank, one aggregate counts what lies below and inside,
and the sketch is repeated on the strictly smaller inside until it holds so few
rows that the sketch itself is exact.  Each round keeps about six rows in ten
thousand, so even 10^13 rows need only a handful of scans of one column, and a
value that fills a third of the column ends the search at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import as_double, fit

ACCURACY = 10_000
MARGIN = 3.0 / ACCURACY
EXACT_BELOW = 4_000


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], relative_error: float = 0.01) -> dict[str, list]:
    """Value at rank ceil(p*n) per column and probability; None for an empty column."""
    if relative_error == 0:
        return exact_quantiles(df, columns, probabilities)
    accuracy = math.ceil(1 / relative_error)
    found = fit(df, {c: F.percentile_approx(as_double(df, c), [float(p) for p in probabilities], accuracy) for c in columns})
    return {c: (values or [None] * len(probabilities)) for c, values in found.items()}


@dataclass
class _Search:
    """One wanted rank in one column."""

    slot: str
    rank: int
    total: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0
    value: float | None = None
    done: bool = False

    def bracket(self) -> Column:
        """True for values strictly inside the bracket."""
        x = F.col(self.slot)
        return x.isNotNull() if self.low is None else (x > self.low) & (x < self.high)

    def local_rank(self) -> int:
        return self.rank - self.below


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], interpolate: bool = False,
                    brackets: dict[str, tuple[int, list[float]]] | None = None) -> dict[str, list]:
    """Exact quantiles; ``interpolate`` blends the two neighbours of a fractional rank.

    ``brackets`` saves the first scan where a sketch is at hand already: each column's number of values, and the
    values at ``bracket_points(probabilities, ...)``.
    """
    slots = {c: f"c{i}" for i, c in enumerate(columns)}
    base = df.select(*[as_double(df, c).alias(s) for c, s in slots.items()])
    if brackets is None:
        first = fit(base, {
            (s, kind): e
            for s in slots.values()
            for kind, e in (
                ("n", F.count(s)),
                ("v", F.percentile_approx(s, bracket_points(probabilities), ACCURACY)),
            )
        })
    else:
        first = {(s, kind): v for c, s in slots.items() for kind, v in zip("nv", brackets[c], strict=True)}
    searches: list[_Search] = []
    plans: dict[str, list] = {}
    for c, s in slots.items():
        n = first[(s, "n")]
        plans[c] = []
        for i, p in enumerate(probabilities):
            if n == 0:
                plans[c].append(None)
                continue
            low_rank, high_rank, share = _ranks(p, n, interpolate)
            found = {}
            for rank in (low_rank, high_rank):
                if rank not in found:
                    found[rank] = _Search(s, rank, n, inside=n)
                    if n > EXACT_BELOW:
                        found[rank].low, found[rank].high = first[(s, "v")][2 * i: 2 * i + 2]
            searches += found.values()
            plans[c].append(((found[low_rank], found[high_rank]), share))
    _narrow(base, searches)
    return {
        c: [None if item is None else _blend(item) for item in items]
        for c, items in plans.items()
    }


def bracket_points(probabilities: Sequence[float], margin: float | None = None) -> list[float]:
    """Ranks a margin below and above each probability."""
    points: list[float] = []
    margin = MARGIN if margin is None else margin
    for p in probabilities:
        points += [max(0.0, p - margin), min(1.0, p + margin)]
    return points


def _ranks(p: float, n: int, interpolate: bool) -> tuple[int, int, float]:
    if not interpolate:
        rank = min(n, max(1, math.ceil(p * n)))
        return rank, rank, 0.0
    position = p * (n - 1)
    low = math.floor(position)
    return low + 1, min(n, low + 2), position - low


def _blend(item) -> float:
    (low, high), share = item
    return low.value if share == 0.0 else low.value + (high.value - low.value) * share


def _narrow(base: DataFrame, searches: list[_Search]) -> None:
    open_searches = [s for s in searches if not s.done]
    fresh = [s for s in open_searches if s.low is not None]
    while open_searches:
        if fresh:
            _count(base, fresh)
        open_searches = [s for s in open_searches if not s.done]
        if open_searches:
            _refine(base, open_searches)
        open_searches = [s for s in open_searches if not s.done]
        fresh = open_searches


def _count(base: DataFrame, searches: list[_Search]) -> None:
    """Locate each rank against the edges of its bracket."""
    wanted: dict = {}
    for i, s in enumerate(searches):
        x = F.col(s.slot)
        wanted[(i, "below")] = F.count_if(x < s.low)
        wanted[(i, "low")] = F.count_if(x == s.low)
        wanted[(i, "high")] = F.count_if(x == s.high)
        wanted[(i, "inside")] = F.count_if((x > s.low) & (x < s.high))
    got = fit(base, wanted)
    for i, s in enumerate(searches):
        below, at_low = got[(i, "below")], got[(i, "low")]
        inside, at_high = got[(i, "inside")], got[(i, "high")]
        if s.low == s.high:
            at_high = inside = 0
        if below < s.rank <= below + at_low:
            s.value, s.done = s.low, True
        elif below + at_low + inside < s.rank <= below + at_low + inside + at_high:
            s.value, s.done = s.high, True
        elif below + at_low < s.rank <= below + at_low + inside:
            s.below, s.inside = below + at_low, inside
        else:
            s.low = s.high = None
            s.below, s.inside = 0, s.total


def _refine(base: DataFrame, searches: list[_Search]) -> None:
    wanted: dict = {}
    for i, s in enumerate(searches):
        at = (s.local_rank() - 0.5) / s.inside
        points = [at] if s.inside <= EXACT_BELOW else bracket_points([at])
        wanted[i] = F.percentile_approx(F.when(s.bracket(), F.col(s.slot)), points, ACCURACY)
    # the sketches are not compiled; a compiled filter leaves them few rows
    got = fit(base.filter(reduce(lambda a, b: a | b, [s.bracket() for s in searches])), wanted)
    for i, s in enumerate(searches):
        if s.inside <= EXACT_BELOW:
            s.value, s.done = got[i][0], True
        else:
            s.low, s.high = got[i]
