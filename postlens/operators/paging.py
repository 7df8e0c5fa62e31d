"""Pages of an ordered table (H8) without sorting what comes before them.

The table is dealt by its order to parts, each a partition folder, whose sorted
rows are numbered by ranges; a small table has each range's number of rows.  The place
where a page begins is found in the sums of these numbers, only the ranges that
the page touches are read, and they alone are sorted.  A page that follows another
can also be asked for by the last row before it (keyset): the ranges before that
row's aren't read, and rows that came or went meanwhile don't shift it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.sources import published

RANGE = "_range"
#: The folder that a range's rows are in, and about how many ranges a folder holds.
PART, RANGES = "_part", 200


def build(df: DataFrame, path: str, order: Sequence[Column], rows_per_range: int = 100_000) -> None:
    """Write ``df`` for paging by ``order``, which should end with a unique column."""
    # ranges are cut from parts by the places of their sorted rows (Spark's increasing id: the part above 33 bits, the
    # row below), so that tasks, files and what the driver hears of them are fewer than ranges
    n = max(1, -(-df.count() // (rows_per_range * RANGES)))
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", place)
    part, row = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    ranged = ranged.withColumn(RANGE, F.shiftleft(part, 33) + F.floor(row / rows_per_range)).withColumn(PART, part.cast("int")).drop("_place")
    folder = published.publish(ranged, f"{path}/rows", [PART])
    rows = published.load(df.sparkSession, folder)
    sizes = rows.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    published.publish(sizes.withColumn("before", before).withColumn("folder", F.lit(folder)).coalesce(1), f"{path}/sizes")


def touched(spark: SparkSession, path: str, offset: int, limit: int) -> tuple[str | None, int, list[int]]:
    """The folder of the rows, the rows before the first range that a page touches, and the ranges it touches."""
    sizes = published.read(spark, f"{path}/sizes")
    hit = sizes.where((F.col("before") + F.col("n") > offset) & (F.col("before") < offset + limit)).orderBy(RANGE).collect()
    return (hit[0]["folder"], hit[0]["before"], [r[RANGE] for r in hit]) if hit else (None, 0, [])


def page(spark: SparkSession, path: str, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset + 1`` to ``offset + limit`` of the order, in order."""
    folder, before, ranges = touched(spark, path, max(0, offset), max(0, limit))
    if folder is None:
        return published.read(spark, f"{path}/rows").where("false").drop(RANGE, PART)
    rows = published.load(spark, folder).where(F.col(PART).isin(sorted({r >> 33 for r in ranges})) & F.col(RANGE).isin(ranges))
    return rows.orderBy(*order).offset(max(0, offset) - before).limit(limit).drop(RANGE, PART)


def page_after(spark: SparkSession, path: str, order: Sequence[Column], after: Column, limit: int, within: Column | None = None) -> DataFrame:
    """The first ``limit`` rows for which ``after`` holds, such as ``(createdat, id) < last``: the predicate goes down to
    the scan, and row groups outside it are skipped."""
    rows = published.read(spark, f"{path}/rows").where(after)
    return (rows.where(within) if within is not None else rows).orderBy(*order).limit(limit).drop(RANGE, PART)
