"""Files that keep arriving: the file stream source reads their bytes, the same decoder makes scanlines, and figures for each
image go to a sink. A frame belongs to one file, so no state is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.sources import images

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of scanlines of the image files that appear in a folder."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder)
    return images.scanlines(files)


def line_means(lines: DataFrame) -> DataFrame:
    """A row for each scanline with the mean of its samples: a projection, fit for append mode."""
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda a, v: a + v)
    return lines.where("error is null").select("path", "frame", "y", (total / F.size("samples")).alias("mean"))


def write(stream: DataFrame, folder: str, checkpoint: str):
    """Appends a stream to a Parquet table, what is there now and then no more."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
