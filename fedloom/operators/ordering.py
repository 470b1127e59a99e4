"""Global order without a single-task window.

``orderBy`` range-partitions the rows, so every task holds one slice of the
order.  Totals per slice are tiny (one row per slice and group); their running
sum gives each slice its offset.  The sorted rows are materialized once, because
slice borders must not move between the two uses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize


BROADCAST_OFFSETS = 200_000


def running_totals(df: DataFrame, order: Sequence[Column], totals: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Add inclusive running sums over a total order, restarted for each ``by`` group.

    ``order`` must end in a unique key; it decides how a hot group is cut.
    """
    measured = df.withColumns({f"_m_{n}": e for n, e in totals.items()})
    slices = materialize(measured.orderBy(*by, *order).withColumn("_slice", F.spark_partition_id()))
    keys = ["_slice", *by]
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = slices.groupBy(*keys).agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in totals])
    offsets = offsets.select(*keys, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals])
    # one row per slice and group in it; joining null-safe keys would shuffle the rows again
    offsets = materialize(offsets)
    if offsets.count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    counted = slices.withColumns({f"_r_{n}": F.sum(f"_m_{n}").over(inside) for n in totals})
    joined = counted.alias("rows").join(
        offsets.alias("offsets"),
        [F.col(f"rows.{k}").eqNullSafe(F.col(f"offsets.{k}")) for k in keys],
    )
    return joined.select(
        *[F.col(f"rows.`{c}`") for c in df.columns if c not in totals],
        *[(F.col(f"rows._r_{n}") + F.col(f"offsets._o_{n}")).alias(n) for n in totals],
    )


def row_numbers(df: DataFrame, order: Sequence[Column], name: str, by: Sequence[str] = ()) -> DataFrame:
    """1-based position in a total order, per ``by`` group when given.

    The sorted rows are numbered where they lie, so they are shuffled once; a group's numbers in a slice are then
    moved to follow those of its earlier slices.
    """
    slices = materialize(df.orderBy(*by, *order).withColumn("_at", F.monotonically_increasing_id()))
    slices = slices.withColumn("_slice", F.shiftright("_at", 33))
    keys = ["_slice", *by]
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    spans = slices.groupBy(*keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1
    offsets = materialize(spans.select(*keys, shift.alias("_shift")))
    if offsets.count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    joined = slices.alias("rows").join(offsets.alias("offsets"), [F.col(f"rows.{k}").eqNullSafe(F.col(f"offsets.{k}")) for k in keys])
    return joined.select(*[F.col(f"rows.`{c}`") for c in df.columns if c != name], (F.col("rows._at") + F.col("offsets._shift")).alias(name))
