"""Constant fills and imputation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import as_double, fit, is_missing, numeric_columns, present, q, replace, require, type_of
from .quantiles import exact_quantiles


def fill_value(df: DataFrame, value, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace NULL (and NaN) by a constant in columns whose type fits the constant."""
    names = df.columns if columns is None else list(columns)
    require(df, names)
    return replace(df, {c: fill_expression(df, c, value) for c in names if accepts(type_of(df, c), value)})


def fill_expression(df: DataFrame, column: str, value) -> Column:
    kind = type_of(df, column)
    return F.when(is_missing(df, column), F.lit(value).cast(kind)).otherwise(q(column))


def accepts(kind: T.DataType, value) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    return isinstance(kind, T.NumericType)


def fill_defaults(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """0 for numbers, ``unknown`` for strings, False for booleans, in one projection."""
    names = df.columns if columns is None else list(columns)
    require(df, names)
    changed = {}
    for c in names:
        for value in (0, "unknown", False):
            if accepts(type_of(df, c), value):
                changed[c] = fill_expression(df, c, value)
    return replace(df, changed)


def impute_statistics(df: DataFrame, columns: Sequence[str], strategy: str, relative_error: float = 0.001) -> dict[str, Column]:
    """The aggregates an imputation needs, one per column."""
    if strategy == "mean":
        return {c: F.avg(as_double(df, c)) for c in columns}
    if strategy == "median":
        accuracy = math.ceil(1 / relative_error)
        return {c: F.percentile_approx(as_double(df, c), 0.5, accuracy) for c in columns}
    raise ValueError(f"unknown strategy {strategy!r}")


def most_frequent(df: DataFrame, column: str):
    """The commonest value, the smallest one on ties."""
    counts = df.select(present(df, column).alias("v")).filter("v is not null").groupBy("v").count()
    top = counts.orderBy(F.desc("count"), F.asc("v")).limit(1).collect()
    return top[0]["v"] if top else None


def surrogates(df: DataFrame, columns: Sequence[str], strategy: str, relative_error: float = 0.001) -> dict[str, float]:
    if strategy == "mode":
        return {c: most_frequent(df, c) for c in columns}
    if strategy == "median" and relative_error == 0:
        return {c: v[0] for c, v in exact_quantiles(df, columns, [0.5]).items()}
    return fit(df, impute_statistics(df, columns, strategy, relative_error))


def impute_with(df: DataFrame, values: dict) -> DataFrame:
    """Fill missing cells; integer columns keep their type, so the value is truncated."""
    empty = [c for c, v in values.items() if v is None]
    if empty:
        raise ValueError(f"no value to impute from in column(s) {empty}")
    return replace(df, {c: fill_expression(df, c, v) for c, v in values.items()})


def impute(df: DataFrame, columns: Sequence[str] | None = None, strategy: str = "mean", relative_error: float = 0.001) -> DataFrame:
    """Fill NULL and NaN in numeric columns by mean, median or mode."""
    names = numeric_columns(df) if columns is None else list(columns)
    require(df, names)
    for c in names:
        if not isinstance(type_of(df, c), T.NumericType):
            raise ValueError(f"column {c!r} is not numeric")
    return impute_with(df, surrogates(df, names, strategy, relative_error))
