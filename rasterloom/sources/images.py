"""Image files as relations. Spark's binaryFile source reads the bytes, from any store that Spark reads; decoding runs in
Arrow batches, one row of the result a scanline, so that a large image is spread before it becomes pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.model import KEYS, Raster
from rasterloom.sources import codecs

SCANLINES = "path string, frame int, xsize int, ysize int, channels int, bits string, format string, tags map<string,string>, error string, y int, samples array<int>"


def scanlines(files: DataFrame, kind: str | None = None, limits: codecs.Limits = codecs.Limits(), incomplete: bool = False) -> DataFrame:
    """files (path, content) -> a row for each line of each frame; a broken file is one row with its error."""
    names = [x.split()[0] for x in SCANLINES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py() or b""
                try:
                    rows = []
                    for f, p in enumerate(codecs.decode(data, kind, limits, incomplete)):
                        h, w, c = p.samples.shape
                        head = (path, f, w, h, c, p.bits, kind or codecs.probe(data), list(p.tags.items()), None)
                        rows += [(*head, y, p.samples[y].ravel()) for y in range(h)]
                except codecs.ImageError as e:
                    rows = [(path, None, None, None, None, None, kind or codecs.probe(data), [], str(e), None, None)]
                types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run, SCANLINES)


def read_files(spark: SparkSession, path: str, **options) -> DataFrame:
    return scanlines(spark.read.format("binaryFile").load(path), **options)


def pixels(lines: DataFrame, image_id) -> DataFrame:
    """Scanlines -> (image_id, y, x, c0..c3); missing channels are null."""
    good = lines.where("error is null").select(F.lit(image_id).alias("image_id") if not hasattr(image_id, "alias") else image_id.alias("image_id"), "y", "channels", "samples", F.explode(F.sequence(F.lit(0), F.col("xsize") - 1)).alias("x"))
    return good.select(*KEYS, *(F.when(F.col("channels") > k, F.element_at("samples", (F.col("x") * F.col("channels") + k + 1).cast("int"))).alias(f"c{k}") for k in range(4)))


def encoded(r: Raster, kind: str, **options) -> DataFrame:
    """(image_id, content): each image of a stack as a file's bytes. Pixels are packed by line first; a group is an image. A file
    ends with the last row and column that its image has pixels in; places without one before that are 0."""
    names, bits = r.names, r.bits
    lines = r.px.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", *names))).alias("line"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        places = [[p["x"] for p in line] for line in group["line"]]
        s = np.zeros((int(group["y"].max()) + 1, max(map(max, places)) + 1, len(names)), np.int64)
        for y, xs, line in zip(group["y"], places, group["line"], strict=True):
            s[y, xs] = [[p[n] for n in names] for p in line]
        return pd.DataFrame({"image_id": group["image_id"].iloc[:1], "content": [codecs.encode(codecs.Picture(s, bits), kind, **options)]})

    return lines.groupBy("image_id").applyInPandas(run, "image_id long, content binary")


def probe_format(files: DataFrame, extra: list[tuple[bytes, str]] = ()) -> DataFrame:
    """(path, format) by the first bytes, own entries first: a CASE over the content, nothing is decoded."""
    out = F.lit(None).cast("string")
    for magic, name in reversed([*extra, *codecs.MAGIC]):
        out = F.when(F.substring("content", 1, len(magic)) == F.lit(magic), F.lit(name)).otherwise(out)
    return files.select("path", out.alias("format"))


def within(limits: codecs.Limits, width: Column, height: Column, channels: Column, sample_bytes: int = 1) -> Column:
    """Whether headers keep the limits, as Limits.check() says for one."""
    size = width.cast("long") * height * channels * sample_bytes
    fits = (width >= 1) & (height >= 1) & channels.between(1, 4)
    for value, most in ((width, limits.width), (height, limits.height), (size, limits.bytes)):
        fits = fits & (value <= most) if most else fits
    return fits


def guess_type(path) -> F:
    """A file's type by its extension, in lower case; known spellings are folded."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{2,})$", 1))
    folded = F.when(ext.isin("jpg", "jpeg"), "jpeg").when(ext.isin("pbm", "pgm", "ppm", "pnm"), "pnm").when(ext.isin("tif", "tiff"), "tiff").when(ext.isin("rgb", "bw", "sgi", "rgba"), "sgi").otherwise(ext)
    return F.when(ext == "", None).otherwise(folded)
