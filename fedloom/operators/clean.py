"""Row filters, column selection and duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import is_missing, numeric_columns, present, q, require
from .quantiles import quantiles


def drop_column(df: DataFrame, column: str) -> DataFrame:
    require(df, [column])
    return df.select(*[q(c) for c in df.columns if c != column])


def drop_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows without NULL or NaN in the given columns (default: all)."""
    names = df.columns if columns is None else list(columns)
    require(df, names)
    return df.filter(reduce(lambda a, b: a & b, [~is_missing(df, c) for c in names], F.lit(True)))


def outlier_bounds(df: DataFrame, columns: Sequence[str], factor: float = 1.5, relative_error: float = 0.01) -> dict[str, tuple[float, float]]:
    """Interquartile fences per column; every fence comes from the same input."""
    fences = {}
    for c, (q1, q3) in quantiles(df, columns, [0.25, 0.75], relative_error).items():
        if q1 is None:
            raise ValueError(f"column {c!r} holds no values, so it has no quartiles")
        reach = factor * (q3 - q1)
        fences[c] = (q1 - reach, q3 + reach)
    return fences


def within(df: DataFrame, fences: dict[str, tuple[float, float]]) -> Column:
    """True where every fenced column lies inside its bounds (both ends included)."""
    return reduce(lambda a, b: a & b, [present(df, c).between(low, high) for c, (low, high) in fences.items()])


def remove_outliers(df: DataFrame, columns: Sequence[str] | None = None, factor: float = 1.5, relative_error: float = 0.01) -> DataFrame:
    """Drop rows with a value outside the interquartile fences, or without a value."""
    names = numeric_columns(df) if columns is None else list(columns)
    require(df, names)
    if not names:
        return df
    return df.filter(within(df, outlier_bounds(df, names, factor, relative_error)))


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_duplicates_by(df: DataFrame, columns: Sequence[str], order_by: Sequence[Column] | None = None) -> DataFrame:
    """One row per key; with ``order_by`` the first row in that order survives.

    Spark limits each key before the shuffle (``WindowGroupLimit``), so a hot
    key sends one row per map task.
    """
    require(df, columns)
    if order_by is None:
        return df.dropDuplicates(list(columns))
    rank = F.row_number().over(W.partitionBy(*[q(c) for c in columns]).orderBy(*order_by))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
