"""Pages of an ordered table by an index of its slices.

The rows are stored once, cut into slices by ranges of the order and numbered in their slice, and the index knows how
many rows each slice holds.  A page reads its places of the slices it falls into and no other, whatever its number.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows of a slice, about.
SLICE_ROWS = 100_000
#: Slices of fewer rows than that are made as long as a core has no more than so many: each is a task, a folder and a file.
SLICES_PER_CORE = 4
_SLICE, _PLACE = "_slice", "_place"
# monotonically_increasing_id: the number of the row in its partition
_IN_PARTITION = (1 << 33) - 1


@dataclass
class PageIndex:
    """Where the slices are, the order of their rows, and how many rows precede each (one more entry: all rows)."""

    spark: SparkSession
    path: str
    order: Sequence[Column]
    slices: list[int]
    before: list[int]

    @property
    def total(self) -> int:
        return self.before[-1]

    def page(self, skip: int, limit: int) -> DataFrame:
        """Rows ``skip`` to ``skip + limit`` of the order."""
        if skip < 0 or limit < 0:
            raise ValueError("skip and limit are not negative")
        stored = self.spark.read.parquet(self.path)
        first = max(0, bisect_right(self.before, skip) - 1)
        last = max(first, bisect_right(self.before, skip + max(limit, 1) - 1) - 1)
        asked = self.slices[first:last + 1]
        if not asked:
            return stored.where(F.lit(False)).drop(_SLICE, _PLACE)
        start = skip - self.before[first]
        if len(asked) == 1:
            places = F.col(_PLACE).between(start, start + limit - 1)
        else:
            places = (F.col(_SLICE) != asked[0]) | (F.col(_PLACE) >= start)
        rows = stored.where(F.col(_SLICE).isin(asked)).where(places)
        return rows.orderBy(_SLICE, _PLACE).limit(limit).drop(_SLICE, _PLACE)


def index_pages(rows: DataFrame, order: Sequence[Column], path: str | None = None, slice_rows: int = SLICE_ROWS) -> PageIndex:
    """Store the rows by slices of a total order and count them; the driver holds two numbers per slice.

    Slices have ``slice_rows`` rows; where that gives more slices than ``SLICES_PER_CORE``, they are longer, up to
    ``SLICE_ROWS``.
    """
    spark = rows.sparkSession
    path = path or scratch_path(spark, "pages")
    n = rows.count()
    few = max(SLICES_PER_CORE * spark.sparkContext.defaultParallelism, -(-n // SLICE_ROWS))
    slices = max(1, min(-(-n // slice_rows), few))
    dealt = rows.repartitionByRange(slices, *order).withColumn(_SLICE, F.spark_partition_id()).sortWithinPartitions(_SLICE, *order)
    dealt.withColumn(_PLACE, F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))).write.partitionBy(_SLICE).parquet(path)
    if not _has_rows(spark, path):
        rows.limit(0).withColumns({_PLACE: F.lit(0).cast("long"), _SLICE: F.lit(0)}).write.mode("overwrite").parquet(path)
        return PageIndex(spark, path, order, [], [0])
    counts = sorted((r[_SLICE], r["count"]) for r in spark.read.parquet(path).groupBy(_SLICE).count().collect())
    return PageIndex(spark, path, order, [s for s, _ in counts], [0, *accumulate(n for _, n in counts)])


def _has_rows(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return any(f.getPath().getName().startswith(f"{_SLICE}=") for f in files)
