"""Row positions (0, 1, 2, ...) in a given order, without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialize

# monotonically_increasing_id() keeps the row number within a partition in its low bits.
_LOCAL_BITS = (1 << 33) - 1
#: Reserved names: columns of a table are not called so.
PART, PLACE, SKIPPED = "__part", "__place", "__skipped"


def sorted_positions(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    """Range-partition and sort, then tag rows with partition and position within it.

    The order should end with a unique column: it lets many equal leading keys spread
    over several partitions, and makes the positions reproducible.
    """
    return (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumns(
            {
                PART: F.spark_partition_id(),
                PLACE: F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_BITS)),
            }
        )
    )


def row_index(df: DataFrame, order_by: Sequence[str | Column], name: str = "t") -> DataFrame:
    """``df`` with the 0-based position ``name`` in the given order.

    The tagged rows are written to shared scratch first, because partition numbers may
    only be used twice (for offsets and for rows) if both uses see the same partitions.
    The offsets frame has one row per partition, which bounds the window and the broadcast.
    """
    tagged = materialize(sorted_positions(df, order_by), "row-index")
    sizes = tagged.groupBy(PART).agg(F.count("*").alias("rows"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(PART, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(SKIPPED))
    return (
        tagged.join(F.broadcast(offsets), PART)
        .withColumn(name, F.col(SKIPPED) + F.col(PLACE))
        .drop(PART, PLACE, SKIPPED)
    )
