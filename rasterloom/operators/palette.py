"""Paletted images: a stack whose pixels are indexes into a palette that each image has of its own.

An image that is given a colour which its palette lacks turns direct: its pixels then hold colours, and its palette goes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.model import KEYS, Raster, blank

Colour = tuple[int, int, int]
COLOUR = "struct<r:int,g:int,b:int>"


@dataclass(frozen=True)
class Paletted:
    """px has image_id, y, x, the index i (null in direct images) and the colour d (null in paletted ones); heads has image_id,
    palette (null for direct images) and capacity."""

    px: DataFrame
    heads: DataFrame
    width: int
    height: int

    def with_heads(self, heads: DataFrame) -> Paletted:
        return replace(self, heads=heads)


def colour(c: Colour) -> Column:
    return F.struct(*(F.lit(v).cast("int").alias(n) for v, n in zip(c, "rgb", strict=True)))


def _list(colours: list[Colour]) -> Column:
    return F.array(*map(colour, colours)).cast(f"array<{COLOUR}>")


def _capacity(most: int) -> int:
    if not 1 <= most <= 256:
        raise ValueError("a palette holds 1 to 256 colours")
    return most


def create(spark: SparkSession, width: int, height: int, capacity: int = 256, images: int = 1) -> Paletted:
    """Images of index 0 with empty palettes."""
    grid = blank(spark, width, height, 1, images=images).px
    heads = spark.range(images).select(F.col("id").alias("image_id"), _list([]).alias("palette"), F.lit(_capacity(capacity)).alias("capacity"))
    return Paletted(grid.select(*KEYS, F.lit(0).alias("i"), F.lit(None).cast(COLOUR).alias("d")), heads, width, height)


def exact(r: Raster, capacity: int = 256) -> Paletted:
    """Each image with the palette of its own colours, in ascending order; one of more colours than the capacity is direct.
    Colours are counted before any list of them is made, so that no list is longer than the capacity."""
    if r.channels != 3:
        raise ValueError("a palette is made from three channels")
    px = r.px.select(*KEYS, F.struct(*(F.col(n).alias(a) for n, a in zip(r.names, "rgb", strict=True))).cast(COLOUR).alias("d"))
    used = px.groupBy("image_id", "d").agg(F.lit(1).alias("_one"))
    few = used.groupBy("image_id").count().where(F.col("count") <= _capacity(capacity)).select("image_id")
    lists = used.join(few, "image_id").groupBy("image_id").agg(F.array_sort(F.collect_list("d")).alias("palette"))
    heads = used.groupBy("image_id").agg(F.lit(capacity).alias("capacity")).join(lists, "image_id", "left").select("image_id", "palette", "capacity")
    place = F.array_position("palette", F.col("d")).cast("int") - 1
    px = px.join(heads, "image_id").select(*KEYS, place.alias("i"), F.when(F.col("palette").isNull(), F.col("d")).alias("d"))
    return Paletted(px, heads, r.width, r.height)


def expand(p: Paletted) -> Raster:
    """The colours of all pixels; an index beyond the palette is black."""
    got = F.coalesce(F.col("d"), F.get("palette", F.col("i")), colour((0, 0, 0)))
    px = p.px.join(p.heads.select("image_id", "palette"), "image_id").select(*KEYS, got.alias("_c"))
    return Raster(px.select(*KEYS, *(F.col(f"_c.{n}").alias(f"c{k}") for k, n in enumerate("rgb"))), p.width, p.height)


def add_colours(p: Paletted, colours: list[Colour]) -> Paletted:
    """Appends to each palette that has room for all of them; heads gains added, the first one's index, or -1 where none came
    in."""
    room = F.col("palette").isNotNull() & (F.size("palette") + len(colours) <= F.col("capacity"))
    heads = p.heads.select("image_id", F.when(room, F.concat("palette", _list(colours))).otherwise(F.col("palette")).alias("palette"), "capacity", F.when(room, F.size("palette")).otherwise(-1).alias("added"))
    return p.with_heads(heads)


def set_colours(p: Paletted, start: int, colours: list[Colour], where: Column | None = None) -> Paletted:
    """Overwrites from start on; a palette that doesn't reach that far, and a head for which where isn't true, stay."""
    fits = (F.size("palette") >= start + len(colours)) & F.lit(start >= 0 and len(colours) > 0)
    if where is not None:
        fits = fits & where
    new = F.transform("palette", lambda c, k: F.when(k.between(start, start + len(colours) - 1), F.get(_list(colours), k - start)).otherwise(c))
    return p.with_heads(p.heads.withColumn("palette", F.when(fits, new).otherwise(F.col("palette"))))


def get_colours(start: int, count: int = 1) -> Column:
    """An expression over heads: count colours from start on, null where the palette doesn't hold them all."""
    if start < 0 or count < 1:
        raise ValueError("a range of a palette starts at 0 or later and has at least one colour")
    return F.when(F.size("palette") >= start + count, F.slice("palette", start + 1, count))


def colour_count() -> Column:
    """An expression over heads: the palette's size, -1 for direct images."""
    return F.when(F.col("palette").isNull(), -1).otherwise(F.size("palette"))


def max_colours() -> Column:
    """An expression over heads: the capacity, -1 for direct images."""
    return F.when(F.col("palette").isNull(), -1).otherwise(F.col("capacity"))


def find_colour(c: Colour | Column) -> Column:
    """An expression over heads: the first index of a colour, null if the palette lacks it or there is none."""
    at = F.array_position("palette", c if isinstance(c, Column) else colour(c))
    return F.when(at > 0, (at - 1).cast("int"))


def zero_is_white() -> Column:
    """An expression over heads: true or false for palettes of just white and black, by which comes first; null for others."""
    black, white = colour((0, 0, 0)), colour((255, 255, 255))
    return F.when(F.col("palette") == F.array(white, black), True).when(F.col("palette") == F.array(black, white), False)


def get_indexes(p: Paletted, y: int, left: int = 0, right: int | None = None) -> DataFrame:
    """(image_id, y, x, i) of a row from left to before right; direct images and rows outside have none."""
    return p.px.where((F.col("y") == y) & (F.col("x") >= left) & (F.col("x") < (p.width if right is None else right)) & F.col("i").isNotNull()).select(*KEYS, "i")


def set_indexes(p: Paletted, updates: DataFrame) -> Paletted:
    """updates (image_id, y, x, seq, i): the last of each place by seq wins; direct images and places outside stay."""
    last = updates.groupBy(*KEYS).agg(F.max_by("i", "seq").alias("_i"))
    px = p.px.join(last, KEYS, "left")
    return replace(p, px=px.select(*KEYS, F.when(F.col("i").isNotNull(), F.coalesce("_i", "i")).cast("int").alias("i"), "d"))


def set_pixels(p: Paletted, updates: DataFrame) -> Paletted:
    """updates (image_id, y, x, seq, r, g, b): the last of each place by seq wins. An image with any update inside it whose
    colour its palette lacks turns direct, and all its pixels with it. Updates are looked up before places are told apart, as
    a colour that is written over later counts too."""
    inside = updates.where(F.col("y").between(0, p.height - 1) & F.col("x").between(0, p.width - 1)).select(*KEYS, "seq", F.struct("r", "g", "b").cast(COLOUR).alias("_d"))
    known = inside.join(p.heads, "image_id").select(*KEYS, "seq", "_d", find_colour(F.col("_d")).alias("_i"), F.col("palette").isNotNull().alias("_p"))
    missed = known.where(F.col("_p") & F.col("_i").isNull()).select("image_id").distinct().withColumn("_miss", F.lit(True))
    last = known.groupBy(*KEYS).agg(F.max_by(F.struct("_d", "_i"), "seq").alias("_new"))
    heads = p.heads.join(missed, "image_id", "left").withColumn("_miss", F.coalesce("_miss", F.lit(False)))
    px = p.px.join(heads.select("image_id", "palette", "_miss"), "image_id").join(last, KEYS, "left")
    direct = F.col("palette").isNull() | F.col("_miss")
    held = F.coalesce(F.col("d"), F.get("palette", F.col("i")), colour((0, 0, 0)))
    px = px.select(*KEYS, F.when(~direct, F.coalesce(F.col("_new._i"), F.col("i"))).alias("i"), F.when(direct, F.coalesce(F.col("_new._d"), held)).alias("d"))
    return replace(p, px=px, heads=heads.withColumn("palette", F.when(~F.col("_miss"), F.col("palette"))).drop("_miss"))
