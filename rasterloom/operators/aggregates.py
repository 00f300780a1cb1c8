"""Aggregations over an image's pixels, and the level filters that are made from them. Partial sums meet by image and bin, so
nothing grows with an image's pixels after the first stage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.samples import clamp, grey
from rasterloom.model import Raster


def colour_usage(r: Raster, most: int | None = None) -> DataFrame:
    """(image_id, colours..., n): the pixels of each colour; alpha doesn't count. With most, images of more colours have no
    rows, and only the others' colours are counted."""
    px = r.px
    if most is not None:
        px = px.join(colour_count(r, most).where("colours is not null").select("image_id"), "image_id", "left_semi")
    return px.groupBy("image_id", *r.colour_names).agg(F.count(F.lit(1)).alias("n"))


def _first_colours(names: list[str], most: int):
    """In a task: each image's distinct colours as they come, until there are more than most."""

    keys = ["image_id", *names]
    schema = pa.schema([("image_id", pa.int64()), *((n, pa.int32()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set[tuple]] = {}
        for batch in batches:
            distinct = pa.Table.from_batches([batch]).group_by(keys).aggregate([])
            for image, *colour in zip(*(distinct.column(n).to_pylist() for n in keys), strict=True):
                found = held.setdefault(image, set())
                if len(found) <= most:
                    found.add(tuple(colour))
        rows = [(image, *c) for image, found in held.items() for c in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def colour_count(r: Raster, most: int | None = None) -> DataFrame:
    """(image_id, colours): the distinct colours, or null beyond most. With most, a task hands on most + 1 colours of an image
    at the most, so that no image's colours are all shuffled."""
    if most is None:
        return colour_usage(r).groupBy("image_id").agg(F.count(F.lit(1)).alias("colours"))
    names = r.colour_names
    found = r.px.select("image_id", *(F.col(n).cast("int") for n in names)).mapInArrow(_first_colours(names, most), "image_id long, " + ", ".join(f"{n} int" for n in names))
    n = found.distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("colours"))
    return n.withColumn("colours", F.when(F.col("colours") <= most, F.col("colours")))


def colour_usage_counts(r: Raster) -> DataFrame:
    """(image_id, counts): each colour's pixels, ascending."""
    return colour_usage(r).groupBy("image_id").agg(F.array_sort(F.collect_list("n")).alias("counts"))


def count_colour(r: Raster, colour: tuple[int, ...]) -> DataFrame:
    same = F.lit(True)
    for n, v in zip(r.names, colour, strict=False):
        same = same & (F.col(n) == v)
    return r.px.groupBy("image_id").agg(F.count_if(same).alias("n"))


def histogram(r: Raster) -> DataFrame:
    """(image_id, channel, bin, n) of all channels."""
    bins = F.explode(F.array(*(F.struct(F.lit(k).alias("channel"), F.col(n).alias("bin")) for k, n in enumerate(r.names)))).alias("s")
    return r.px.select("image_id", bins).groupBy("image_id", "s.channel", "s.bin").agg(F.count(F.lit(1)).alias("n")).select("image_id", "channel", "bin", "n")


def _cumulated(bins: DataFrame, keys: list[str]) -> DataFrame:
    """bins (keys, bin, n) with the pixels before and through each bin, and in all."""
    w = Window.partitionBy(*keys).orderBy("bin")
    through = F.sum("n").over(w)
    return bins.withColumns({"through": through, "before": through - F.col("n"), "total": F.sum("n").over(Window.partitionBy(*keys))})


def autolevels(r: Raster, lsat: float = 0.1, usat: float = 0.1) -> Raster:
    """Stretches colours so that shares lsat and usat of the luminance histogram saturate. The lower cut is the last bin whose
    prior count is under the share, the upper one the first from above; a single cut changes nothing."""
    low, high = (F.lit(v).cast("float").cast("double") for v in (lsat, usat))
    lum = grey(*(F.col(n) for n in r.names[:3]), rounded=True) if r.channels >= 3 else F.col("c0")
    bins = r.px.groupBy("image_id", lum.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # bins run over 0..255: an empty bin has the prior count of the next full one
    c = _cumulated(bins, ["image_id"])
    nxt = F.coalesce(F.lead("bin").over(Window.partitionBy("image_id").orderBy("bin")), F.lit(256))
    prv = F.coalesce(F.lag("bin").over(Window.partitionBy("image_id").orderBy("bin")), F.lit(-1))
    c = c.withColumns({"last": nxt, "first": prv})
    above = F.col("total") - F.col("through")
    # the prior count of every bin after this one, up to the next full one, is "through"
    lo = F.max(F.when(F.col("through") < F.col("total") * low, F.least(F.col("last"), F.lit(255))).when(F.col("before") < F.col("total") * low, F.col("bin")))
    hi = F.min(F.when(F.col("n") + above < F.col("total") * high, F.greatest(F.col("first"), F.lit(0))).when(above < F.col("total") * high, F.col("bin")))
    cuts = c.groupBy("image_id").agg(F.coalesce(lo, F.lit(0)).alias("lo"), F.coalesce(hi, F.lit(255)).alias("hi"))
    px = r.px.join(cuts, "image_id")
    span = F.col("hi") - F.col("lo")
    stretch = lambda col: F.when(span == 0, col).otherwise(clamp(((col - F.col("lo")) * 255 / F.when(span != 0, span)).cast("int")))
    return r.with_px(px).project({n: stretch(F.col(n)) for n in r.colour_names})


def autolevels_skew(r: Raster, lsat: float = 0.1, usat: float = 0.1) -> Raster:
    """Each of three channels by its own histogram; counts include the bin itself. A channel of one level stays."""
    if r.channels < 3:
        raise ValueError("three channels are needed")
    low, high = (F.lit(v).cast("float").cast("double") for v in (lsat, usat))
    c = _cumulated(histogram(r).where("channel < 3"), ["image_id", "channel"])
    at_least = F.col("total") - F.col("before")
    lo = F.coalesce(F.min(F.when(F.col("through") >= F.col("total") * low, F.col("bin"))), F.lit(0))
    hi = F.coalesce(F.max(F.when(at_least >= F.col("total") * high, F.col("bin"))), F.lit(255))
    cuts = c.groupBy("image_id", "channel").agg(lo.alias("lo"), hi.alias("hi"))
    wide = cuts.groupBy("image_id").agg(*(F.max(F.when(F.col("channel") == k, F.col(v))).alias(f"{v}{k}") for k in range(3) for v in ("lo", "hi")))
    px = r.px.join(wide, "image_id")
    out = {}
    for k in range(3):
        v, a, b = F.col(f"c{k}"), F.col(f"lo{k}"), F.col(f"hi{k}")
        out[f"c{k}"] = F.when(b == a, v).otherwise(clamp(((v - a) * 255 / F.when(b != a, b - a)).cast("int")))
    return r.with_px(px).project(out)
