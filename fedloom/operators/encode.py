"""Label and one-hot encoding, target type detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .columns import as_double, fit, q, replace, require, type_of
from .ordering import row_numbers

# sizes up to which a dictionary may sit in one task or be sent to every executor
SMALL_LABELS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024
HEAD_LABELS = 10_000
HEAD_LABEL_BYTES = 1_000


def label_table(df: DataFrame, column: str) -> tuple[DataFrame, dict]:
    """``(value, count, label)`` by falling frequency, ties by value, and its size."""
    require(df, [column])
    counts = materialize(df.groupBy(q(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count")))
    size = fit(counts, {
        "labels": F.count(F.lit(1)),
        "nulls": F.count_if(F.col("value").isNull()),
        "bytes": F.coalesce(F.sum(F.octet_length("value")), F.lit(0)),
    })
    if size["nulls"]:
        raise ValueError(f"Null values found in column {column!r}")
    order = [F.desc("count"), F.asc("value")]
    if size["labels"] <= SMALL_LABELS and size["bytes"] <= BROADCAST_BYTES:
        ranked = counts.withColumn("n", F.row_number().over(W.orderBy(*order)).cast("long"))
    else:
        ranked = row_numbers(counts, order, "n")
    return ranked.select("value", "count", (F.col("n") - 1).cast("double").alias("label")), size


def with_labels(df: DataFrame, column: str, name: str) -> tuple[DataFrame, int]:
    """Join the label of each value; frequent values never pass through a shuffle."""
    table, size = label_table(df, column)
    table = table.select(F.col("value").alias("_value"), F.col("label").alias(name))
    key = q(column).cast("string") == F.col("_value")
    if size["labels"] <= SMALL_LABELS and size["bytes"] <= BROADCAST_BYTES:
        return df.join(F.broadcast(table), key, "inner").drop("_value"), size["labels"]
    # Labels are dealt by falling frequency: the head below holds every hot value.
    table = materialize(table)
    in_head = (F.col(name) < HEAD_LABELS) & (F.octet_length("_value") <= HEAD_LABEL_BYTES)
    head, tail = table.filter(in_head), table.filter(~in_head)
    found = df.join(F.broadcast(head), key, "inner").drop("_value")
    rest = df.join(F.broadcast(head.select("_value")), key, "left_anti")
    return found.unionByName(rest.join(tail, key, "inner").drop("_value")), size["labels"]


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """Replace strings by 0-based doubles, the commonest value first."""
    hidden = "_label"
    joined, _ = with_labels(df, column, hidden)
    return joined.select(*[F.col(hidden).alias(c) if c == column else q(c) for c in df.columns])


def one_hot_encode(df: DataFrame, column: str) -> DataFrame:
    """``struct<size, indices, values>`` with the one category set, the last category nothing.

    Strings are label-encoded first; numbers must be whole and not negative.
    The type does not depend on the data and a row does not grow with the
    dictionary; ``dense`` gives the plain array of it.
    """
    require(df, [column])
    if isinstance(type_of(df, column), T.StringType):
        hidden = "_label"
        joined, size = with_labels(df, column, hidden)
        index, width = F.col(hidden), size - 1
    else:
        x = as_double(df, column)
        seen = fit(df, {"nulls": F.count_if(x.isNull()), "top": F.max(x), "bad": F.count_if((x < 0) | (x != F.floor(x)))})
        if seen["nulls"]:
            raise ValueError(f"Null values found in column {column!r}")
        if seen["bad"]:
            raise ValueError(f"column {column!r} holds values that are no category index")
        joined, index, width = df, x, int(seen["top"] or 0)
    return joined.select(*[_sparse(index, width).alias(c) if c == column else q(c) for c in df.columns])


def dense(hot: Column) -> Column:
    """Array of 0/1 per category of a one-hot struct."""
    places = F.when(hot["size"] > 0, F.sequence(F.lit(0), hot["size"] - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.when(F.array_contains(hot["indices"], i), 1.0).otherwise(0.0))


def _sparse(index: Column, width: int) -> Column:
    kept = index < width
    return F.struct(
        F.lit(width).alias("size"),
        F.when(kept, F.array(index.cast("int"))).otherwise(F.array().cast("array<int>")).alias("indices"),
        F.when(kept, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("values"),
    )


CLASSES = 20
NETWORK_CLASSES = 50
NETWORK_SHARE = 0.1


def task_type(df: DataFrame, target: str) -> str:
    """``classification`` for at most 20 distinct whole-number targets, else ``regression``."""
    y = q(target).cast("double")
    whole = fit(df, {"whole": F.coalesce(F.bool_and(y == F.floor(y)), F.lit(True))})["whole"]
    return "classification" if whole and _at_most(df, target, CLASSES) else "regression"


def task_type_network(df: DataFrame, target: str) -> str:
    """Second rule: continuous when not whole or with more than max(50, 10 % of rows) values."""
    y = q(target).cast("double")
    seen = fit(df, {
        "rows": F.count(F.lit(1)),
        "whole": F.coalesce(F.bool_and(F.abs(y - F.rint(y)) < 1e-8), F.lit(True)),
    })
    limit = max(NETWORK_CLASSES, int(NETWORK_SHARE * seen["rows"]))
    return "classification" if seen["whole"] and _at_most(df, target, limit) else "regression"


def _at_most(df: DataFrame, target: str, most: int) -> bool:
    """Whether the target has at most so many distinct values, counted exactly and no further."""
    return df.select(q(target).alias("v")).filter("v is not null").distinct().limit(most + 1).count() <= most
