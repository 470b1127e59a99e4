"""Vectors kept as arrays: parsing, reshaping, arithmetic."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_vector(text: Column) -> Column:
    """Numbers of a comma-separated string; blank parts are skipped."""
    parts = F.filter(F.transform(F.split(text, ","), lambda part: F.trim(part)), lambda part: part != "")
    return F.transform(parts, lambda part: part.cast("double"))


def reshape(flat: Column, shape: Sequence[int]) -> Column:
    """Nested array of the given shape; NULL stays NULL, a length that does not fit is an error."""
    misfit = F.raise_error(F.concat(F.lit(f"a vector for shape {list(shape)} has length "), F.size(flat).cast("string")))
    nested = _nest(flat, list(shape))
    kind = "array<" * len(shape) + "double" + ">" * len(shape)
    return F.when(flat.isNull(), None).when(F.size(flat) == prod(shape), nested).otherwise(misfit.cast(kind))


def reshape_or_keep(flat: Column, shape: Sequence[int]) -> Column:
    """``struct<flat, shaped>``: the nested array where the length fits the shape, otherwise the vector as it is.

    One of the two is NULL, so a column of one type holds both; NULL gives two NULLs.
    """
    fits = F.size(flat) == prod(shape)
    return F.struct(F.when(~fits, flat).alias("flat"), F.when(fits, _nest(flat, list(shape))).alias("shaped"))


def _nest(flat: Column, shape: list[int]) -> Column:
    if len(shape) == 1:
        return flat
    step = prod(shape[1:])
    return F.transform(
        F.sequence(F.lit(0), F.lit(shape[0] - 1)),
        lambda i: _nest(F.slice(flat, i * step + 1, F.lit(step)), shape[1:]),
    )


def array_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def linear(cells: Sequence[Column], weights: Sequence[float], intercept: float = 0.0) -> Column:
    """Weighted sum of plain columns."""
    total = F.lit(float(intercept))
    for x, w in zip(cells, weights, strict=True):
        total = total + x * F.lit(float(w))
    return total
