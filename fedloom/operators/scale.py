"""Scaling and numeric transforms.

Two families share their labels.  The column family scales one column by its
own statistics.  The row family treats the numeric cells of a row as a vector
(norms), or scales all numeric columns at once with other rules for constant
and uncentred columns (min-max, z-score).  Every statistic comes from one
aggregate; the result is a plain projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import fit, is_missing, numeric_columns, q, replace, require

METHODS = ("Min-Max", "Z-score", "L1 Norm", "L2 Norm", "L inf Norm")


def column_statistics(column: str, method: str) -> dict[str, Column]:
    """Aggregates needed to scale one column."""
    x = q(column)
    if method == "Min-Max":
        return {"low": F.min(x), "high": F.max(x)}
    if method == "Z-score":
        return {"count": F.count(x), "mean": F.avg(x), "spread": F.stddev_samp(x)}
    if method == "L1 Norm":
        return {"norm": F.sum(F.abs(x))}
    if method == "L2 Norm":
        return {"norm": F.sum(F.pow(x, F.lit(2)))}
    if method == "L inf Norm":
        return {"norm": F.max(F.abs(x))}
    raise ValueError(f"unknown normalisation method {method!r}")


def column_expression(column: str, method: str, stats: dict) -> Column:
    """The scaled column; a column without spread becomes 0.0 everywhere."""
    x = q(column)
    if method == "Z-score":
        if not stats["count"]:
            raise ValueError(f"column {column!r} holds no values to scale by")
        return (x - stats["mean"]) / stats["spread"] if stats["spread"] else F.lit(0.0)
    if any(v is None for v in stats.values()):
        raise ValueError(f"column {column!r} holds no values to scale by")
    if method == "Min-Max":
        width = stats["high"] - stats["low"]
        return (x - stats["low"]) / F.lit(width) if width != 0 else F.lit(0.0)
    norm = math.sqrt(stats["norm"]) if method == "L2 Norm" else stats["norm"]
    return x / F.lit(norm) if norm != 0 else F.lit(0.0)


def scale_column(df: DataFrame, column: str, method: str) -> DataFrame:
    require(df, [column])
    stats = fit(df, column_statistics(column, method))
    return replace(df, {column: column_expression(column, method, stats)})


CHECK = "_row_check"


def _broken(df: DataFrame, columns: Sequence[str]) -> Column:
    """True for a row that cannot form a vector."""
    return reduce(lambda a, b: a | b, [is_missing(df, c) for c in columns])


def row_check(df: DataFrame, columns: Sequence[str], method: str) -> Column:
    """Per row, once: its norm, or 1.0 for the scalings; a missing cell fails the job."""
    value = row_norm(columns, method) if method.endswith("Norm") else F.lit(1.0)
    refusal = F.raise_error(F.lit("row vector holds a NULL or NaN")).cast("double")
    return F.when(_broken(df, columns), refusal).otherwise(value)


def incomplete_rows(df: DataFrame, columns: Sequence[str]) -> Column:
    """Aggregate: rows that cannot form a vector."""
    return F.count_if(_broken(df, columns))


def row_norm(columns: Sequence[str], method: str) -> Column:
    cells = [q(c).cast("double") for c in columns]
    if method == "L1 Norm":
        return reduce(lambda a, b: a + b, [F.abs(x) for x in cells])
    if method == "L2 Norm":
        return F.sqrt(reduce(lambda a, b: a + b, [x * x for x in cells]))
    if method == "L inf Norm":
        return F.abs(cells[0]) if len(cells) == 1 else F.greatest(*[F.abs(x) for x in cells])
    raise ValueError(f"unknown row norm {method!r}")


def row_expressions(columns: Sequence[str]) -> dict[str, Column]:
    """Each cell over the norm in ``CHECK``; an all-zero row stays zero."""
    norm = F.col(CHECK)
    return {c: F.when(norm == 0, q(c).cast("double")).otherwise(q(c).cast("double") / norm) for c in columns}


def normalize_rows(df: DataFrame, columns: Sequence[str] | None, method: str) -> DataFrame:
    """Divide each row vector by its norm; a row with a missing cell fails the job."""
    names = numeric_columns(df) if columns is None else list(columns)
    return replace(df, row_expressions(names), {CHECK: row_check(df, names, method)}) if names else df


def all_statistics(columns: Sequence[str], method: str) -> dict:
    """Aggregates for all columns together."""
    wanted: dict = {}
    for c in columns:
        x = q(c).cast("double")
        if method == "Min-Max":
            wanted[(c, "low")], wanted[(c, "high")] = F.min(x), F.max(x)
        elif method == "Z-score":
            wanted[(c, "spread")] = F.stddev_samp(x)
        else:
            raise ValueError(f"unknown scaling method {method!r}")
    return wanted


def all_expressions(columns: Sequence[str], method: str, stats: dict) -> dict[str, Column]:
    """Scaled columns, for rows whose ``CHECK`` went well."""
    changed = {}
    for c in columns:
        x = q(c).cast("double")
        if method == "Min-Max":
            low, high = stats[(c, "low")], stats[(c, "high")]
            scaled = (x - low) / F.lit(high - low) if high is not None and high != low else F.lit(0.5)
        else:
            spread = stats[(c, "spread")]
            scaled = x / F.lit(spread) if spread else F.lit(0.0)
        changed[c] = F.when(F.col(CHECK).isNotNull(), scaled)
    return changed


def scale_all(df: DataFrame, columns: Sequence[str] | None, method: str) -> DataFrame:
    """Min-max (constant -> 0.5) or uncentred z-score (constant -> 0.0) of every numeric column."""
    names = numeric_columns(df) if columns is None else list(columns)
    if not names:
        return df
    if method not in ("Min-Max", "Z-score"):
        return normalize_rows(df, names, method)
    expressions = all_expressions(names, method, fit(df, all_statistics(names, method)))
    return replace(df, expressions, {CHECK: row_check(df, names, method)})


def transform_expression(column: str, operation: str) -> Column:
    x = q(column)
    if operation == "Log":
        return F.log(x)
    if operation == "Square":
        return F.pow(x, F.lit(2))
    if operation == "Square Root":
        return F.sqrt(x)
    raise ValueError(f"unknown transform {operation!r}")


def transform_column(df: DataFrame, column: str, operation: str) -> DataFrame:
    """Natural log (NULL at or below zero), square, or square root (NaN below zero)."""
    require(df, [column])
    return replace(df, {column: transform_expression(column, operation)})
