"""Connected regions of images of any size: runs of rows are nodes, runs that touch are edges, and stars join them.

A run is told by its image and its first pixel's number. Every round joins minima back to the edges; a round's edges are a
written table, and rounds end when the edges stay the same. Nothing gathers an image, or a row of runs, in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.model import KEYS, Raster
from rasterloom.sources.scratch import stored


def labelled_runs(px: DataFrame, width: int) -> DataFrame:
    """px (image_id, y, x) with the run of neighbours in a row that each pixel belongs to."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    first = F.when(F.col("x") - 1 == F.lag("x").over(row), None).otherwise(F.col("y").cast("long") * width + F.col("x"))
    return px.withColumn("_first", first).withColumn("run", F.last("_first", ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0))).drop("_first")


def touching(px: DataFrame) -> DataFrame:
    """(image_id, v, u): each run with the runs above that share a column with it."""
    column = Window.partitionBy("image_id", "x").orderBy("y")
    above = F.when(F.lag("y").over(column) == F.col("y") - 1, F.lag("run").over(column))
    return px.select("image_id", F.col("run").alias("v"), above.alias("u")).where("u is not null").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(image_id, v, u): each run that isn't its region's least, with that one."""
    now = stored(edges.select("image_id", F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select("image_id", F.col("u").alias("v"), F.col("v").alias("u")))
        least = stored(both.groupBy("image_id", "v").agg(F.min("u").alias("m")).withColumn("m", F.least("v", "m")), "least")
        large = stored(both.join(least, ["image_id", "v"]).where("u > v").select("image_id", F.col("u").alias("v"), F.col("m").alias("u")).distinct(), "large")
        least = stored(large.groupBy("image_id", "v").agg(F.min("u").alias("m")), "least")
        small = large.join(least, ["image_id", "v"]).select("image_id", F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        now = stored(small.distinct(), "edges")
        before, state = state, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("image_id", "v", "u").cast("decimal(38,0)"))).first())
        if state == before:
            return now


def region(r: Raster, open_: Column, x: int, y: int) -> DataFrame:
    """(image_id, y, x) of the open pixels that are connected with a place by steps to the side, up or down."""
    px = stored(labelled_runs(r.px.where(open_).select(*KEYS), r.width), "runs")
    found = stars(touching(px))
    named = px.join(found.select("image_id", F.col("v").alias("run"), F.col("u").alias("_least")), ["image_id", "run"], "left").select(*KEYS, F.coalesce("_least", "run").alias("_region"))
    seed = named.where((F.col("x") == x) & (F.col("y") == y)).select("image_id", "_region")
    return named.join(seed, ["image_id", "_region"]).select(*KEYS)
