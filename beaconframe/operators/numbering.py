"""Row numbers over a whole table, without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: An id that Spark gives a row has the row's place in its partition in so many bits.
_PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... in the order of the columns ``order``, nulls first.

    The table is dealt by ranges of the order and written, each row with its place in
    its range; then the number of rows in the ranges before is added, one row a
    range.  Rows equal in all of ``order`` lie in one range, in any order.
    """
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()))
    part = F.shiftright("at_", _PLACE_BITS)
    sizes = sorted(tuple(r) for r in placed.groupBy(part).count().collect())  # a row a range
    before, total = [], 0
    for range_, n in sizes:
        before.append((range_, total))
        total += n
    place = F.col("at_").bitwiseAND((1 << _PLACE_BITS) - 1)
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "part_ long, before_ long"))
    return placed.withColumn("part_", part).join(offsets, "part_").withColumn(name, place + F.col("before_") + 1).drop("at_", "part_", "before_")
