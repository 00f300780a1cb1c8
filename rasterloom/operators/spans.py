"""Interval sets of rows: a relation (y, x1, x2), with image_id where images differ; x2 is the first place after a span.

Union is gaps and islands over each row; painting joins pixels with their row's spans, so its cost follows rows, not the
pixels times the spans of an image. Spans without an image_id hold for all images of a stack.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.model import Raster


def _rows_of(spans: DataFrame) -> list[str]:
    return ["image_id", "y"] if "image_id" in spans.columns else ["y"]


def made(spark: SparkSession, spans: Iterable[tuple[int, int, int]]) -> DataFrame:
    """Spans (y, x1, x2) of a shape; a shape has about as many as it has rows."""
    return spark.createDataFrame(list(spans), "y int, x1 int, x2 int")


def union(spans: DataFrame) -> DataFrame:
    """Disjoint spans that cover the same places; overlapping and touching ones are one, empty ones none."""
    rows = _rows_of(spans)
    order = Window.partitionBy(*rows).orderBy("x1", "x2")
    before = F.max("x2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = spans.where("x1 < x2").withColumn("_new", F.when(F.col("x1") <= before, 0).otherwise(1))
    found = found.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return found.groupBy(*rows, "_island").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2")).drop("_island")


def clip(spans: DataFrame, width: int, height: int) -> DataFrame:
    """What lies within an image of this size."""
    rows = _rows_of(spans)
    return spans.where(F.col("y").between(0, height - 1)).select(*rows, F.greatest("x1", F.lit(0)).alias("x1"), F.least("x2", F.lit(width)).alias("x2")).where("x1 < x2")


def covered(r: Raster, spans: DataFrame, name: str = "_covered") -> DataFrame:
    """r's pixels with a boolean column: whether a span covers them."""
    rows = _rows_of(spans)
    held = union(clip(spans, r.width, r.height)).groupBy(*rows).agg(F.collect_list(F.struct("x1", "x2")).alias("_spans"))
    # without image_id there is a row for each row of one image at most
    px = r.px.join(F.broadcast(held) if rows == ["y"] else held, rows, "left")
    inside = F.exists(F.coalesce("_spans", F.expr("array()").cast("array<struct<x1:int,x2:int>>")), lambda s: (F.col("x") >= s["x1"]) & (F.col("x") < s["x2"]))
    return px.withColumn(name, inside).drop("_spans")


def paint(r: Raster, spans: DataFrame, colour: tuple[int | Column, ...]) -> Raster:
    """Covered pixels take a colour: constants, or columns over the pixels."""
    return r.with_px(covered(r, spans)).project({n: F.when(F.col("_covered"), colour[k] if isinstance(colour[k], Column) else F.lit(colour[k])).otherwise(F.col(n)) for k, n in enumerate(r.names)})


def shared(r: Raster, runs: DataFrame, name: str = "_share") -> DataFrame:
    """r's pixels with the share of the run (y, x1, x2, share) that they lie in, 0 outside; runs are disjoint."""
    rows = _rows_of(runs)
    held = runs.groupBy(*rows).agg(F.collect_list(F.struct("x1", "x2", "share")).alias("_runs"))
    # without image_id there is a row for each row of one image at most
    px = r.px.join(F.broadcast(held) if rows == ["y"] else held, rows, "left")
    here = F.get(F.filter("_runs", lambda s: (F.col("x") >= s["x1"]) & (F.col("x") < s["x2"])), F.lit(0))
    return px.withColumn(name, F.coalesce(here["share"], F.lit(0))).drop("_runs")


def runs(r: Raster) -> DataFrame:
    """(image_id, y, x1, x2, channels): each row's longest runs of equal pixels."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    new = F.when(F.struct(*r.names) == F.lag(F.struct(*r.names)).over(row), 0).otherwise(1)
    found = r.px.withColumn("_new", new).withColumn("_run", F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return found.groupBy("image_id", "y", "_run", *r.names).agg(F.min("x").alias("x1"), (F.max("x") + 1).alias("x2")).select("image_id", "y", "x1", "x2", *r.names)
