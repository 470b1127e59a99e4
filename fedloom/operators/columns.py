"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def q(name: str) -> Column:
    """The column called ``name``, also when the name holds spaces or dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> T.DataType:
    for field in df.schema.fields:
        if field.name == name:
            return field.dataType
    raise ValueError(f"no column {name!r}")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns in schema order."""
    skipped = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skipped]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def array_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]


def is_missing(df: DataFrame, name: str) -> Column:
    """True for NULL and, in floating point columns, for NaN."""
    missing = q(name).isNull()
    if isinstance(type_of(df, name), (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(q(name))
    return missing


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    if isinstance(type_of(df, name), (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(q(name)), q(name))
    return q(name)


def as_double(df: DataFrame, name: str) -> Column:
    return present(df, name).cast("double")


def replace(df: DataFrame, changed: dict[str, Column], hidden: dict[str, Column] | None = None) -> DataFrame:
    """One projection that swaps the given columns and keeps the order.

    ``hidden`` columns are worked out first, once per row, for use in ``changed``.
    """
    base = df.withColumns(hidden) if hidden else df
    return base.select(*[changed[c].alias(c) if c in changed else q(c) for c in df.columns])


# more aggregates than this no longer compile well together
AGGREGATES_PER_JOB = 256


def fit(df: DataFrame, wanted: dict[Hashable, Column]) -> dict:
    """Evaluate aggregates in one job; one row of statistics comes back.

    Very wide tables are worked off in groups of aggregates.  Callers list them
    column by column, so each group reads its own columns.
    """
    names = list(wanted)
    values: dict = {}
    for start in range(0, len(names), AGGREGATES_PER_JOB):
        part = names[start:start + AGGREGATES_PER_JOB]
        row = df.agg(*[wanted[n].alias(f"s{i}") for i, n in enumerate(part)]).first()
        values.update({n: row[i] for i, n in enumerate(part)})
    return values


def require(df: DataFrame, names: Sequence[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"column(s) not found: {absent}")
