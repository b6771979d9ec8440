"""Places in a sort order, and pages far down a listing.

An order is stored once as ranges: rows are dealt to ranges by their order, each range is sorted and numbered by itself,
and a small table of fences says how many rows stand before each range.  A page at any offset then opens the one or two
ranges it lies in, and the places of all rows need no task that sees them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bits that number a row within its task.
ROW_BITS = 33


@dataclass(frozen=True)
class Ranked:
    """Rows stored in an order: ``path/rows`` by range, ``path/fences`` with a row per range."""

    spark: SparkSession
    path: str
    schema: T.StructType

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def fences(self) -> DataFrame:
        """``range_no``, ``before`` (rows in the ranges before) and ``n_rows``."""
        return self.spark.read.parquet(f"{self.path}/fences")

    def rows(self) -> DataFrame:
        """All rows with their ``place``, from 1."""
        stored = self._stored()
        # A row per range: as many as the writing job had tasks.
        placed = stored.join(F.broadcast(self.fences().select("range_no", "before")), "range_no")
        return placed.withColumn("place", F.col("before") + F.col("inside") + 1).drop("range_no", "before", "inside")

    def total(self) -> int:
        return self.fences().agg(F.sum("n_rows")).first()[0] or 0

    def page(self, skip: int, limit: int) -> DataFrame:
        """``limit`` rows behind the first ``skip``, in order, with their ``place``; opens the ranges they lie in."""
        inside = self.fences().where((F.col("before") < skip + limit) & (F.col("before") + F.col("n_rows") > skip))
        ranges = [r["range_no"] for r in inside.select("range_no").collect()]
        stored = self._stored().where(F.col("range_no").isin(ranges) if ranges else F.lit(False))
        placed = stored.join(F.broadcast(self.fences().select("range_no", "before")), "range_no")
        placed = placed.withColumn("place", F.col("before") + F.col("inside") + 1)
        chosen = placed.where(F.col("place").between(skip + 1, skip + limit))
        return chosen.drop("range_no", "before", "inside").orderBy("place")


def write_ranked(rows: DataFrame, order: list[Column], path: str, ranges: int | None = None) -> Ranked:
    """Stores ``rows`` in ``order``, which must leave no ties (end it with an id), and returns the stored order.

    One sort by range; ``ranges`` is the number of shuffle partitions unless given.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    number = F.monotonically_increasing_id()
    numbered = dealt.sortWithinPartitions(*order).withColumns(
        {"range_no": F.shiftright(number, ROW_BITS).cast("int"), "inside": number.bitwiseAND(F.lit((1 << ROW_BITS) - 1))}
    )
    numbered.write.mode("overwrite").partitionBy("range_no").parquet(f"{path}/rows")
    stored = Ranked(spark, path, numbered.schema)
    counted = stored._stored().groupBy("range_no").agg(F.count(F.lit(1)).alias("n_rows"))
    before = F.sum("n_rows").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))
    fences = counted.select("range_no", F.coalesce(before, F.lit(0)).alias("before"), "n_rows")
    fences.coalesce(1).write.mode("overwrite").parquet(f"{path}/fences")
    return stored
