"""Ranks over tables of any size: range partitions, sorted and numbered, moved by the sizes of those before them."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import cut

#: Bits of monotonically_increasing_id that number a partition's rows.
ROW_BITS = 33


def ranked(df: DataFrame, order: list[Column], group: str | None = None, name: str = "rank") -> DataFrame:
    """df with the place of each row (from 1) in the order, or in its group's part of it; group then leads the order and isn't
    null. Rows that the order doesn't tell apart get neighbouring places. The driver sees one count for each partition."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = [F.col(group), *order] if group else order
    table = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", ROW_BITS).cast("int")
    sizes = dict(table.groupBy(part.alias("part")).count().collect())
    before = F.array(*map(F.lit, accumulate([0] + [sizes.get(k, 0) for k in range(max(sizes, default=0) + 1)])))
    place = lambda c: F.get(before, F.shiftright(c, ROW_BITS).cast("int")) + F.col(c).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    if group is None:
        return table.withColumn(name, place("_place") + 1).drop("_place")
    first = table.groupBy(group).agg(F.min("_place").alias("_first"))
    return table.join(first, group).withColumn(name, place("_place") - place("_first") + 1).drop("_place", "_first")
