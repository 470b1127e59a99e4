"""Registered queries, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``function(spark, sf_dir)``; ``sql`` is its DuckDB equivalent."""

    def register(function):
        if key in QUERIES:
            raise ValueError(f"query {key!r} registered twice")
        QUERIES[key] = function
        if sql is not None:
            SQL[key] = sql
        return function

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that summation order does not show."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def stamp(name: str):
    """A timestamp as text, the same in both engines."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def with_(*names_and_body: str, **extra: str) -> str:
    """``WITH`` clause from named inputs of ``inputs.TABLES``, further named selects, and a final select."""
    from .inputs import TABLES

    *names, body = names_and_body
    parts = {n: TABLES[n] for n in names} | extra
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in parts.items()) + " " + body
