"""Distributed places in an order: a range sort, then the offset of each partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.llm.common import looked_up, staged

#: ``monotonically_increasing_id`` has the partition above these bits and the row below.
_BITS = 33


def numbered(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``df`` with ``idx``, the row's place (from 0) in its ``group`` by ``order``, and ``n``, the group's rows.

    ``order`` must begin with the group and should tell all rows apart: a range sort then cuts
    hot groups over as many partitions as they need. What meets in one task is a row for each
    partition of one group, never the group's rows. ``df`` is read twice (for the ranges and
    for the sort), so it should be a written table. Groups are not null.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    own = F.struct(F.shiftright("at", _BITS).alias("part"), F.col(group).alias("group")).alias("place")
    placed = placed.select("*", own)
    parts = placed.groupBy("place").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("low"))
    whole = Window.partitionBy("place.group")
    before = whole.orderBy("place.part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "place", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("low")).alias("shift"), F.sum("rows").over(whole).alias("n")
    )
    found = looked_up(placed, parts, "place", "at")
    return found.select(*df.columns, (F.col("at") + F.col("shift")).alias("idx"), "n")
